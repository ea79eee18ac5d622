"""Registered queries: each runs an operator over the provided tables and, where SQL can say it, names the same result
as independent SQL."""

from grainmill.workloads.registry import ORACLES, QUERIES, Tables


def load_all() -> None:
    from grainmill.workloads import (  # noqa: F401
        cleaning,
        explore,
        funds,
        inspection,
        loading,
        profiling,
        relational,
        rules,
        salary,
        scalar,
        tracking,
        watch,
    )


__all__ = ["ORACLES", "QUERIES", "Tables", "load_all"]
