"""Value mappings small enough to be literals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def map_values(c: Column, mapping: Mapping, default=None) -> Column:
    """Literal lookup; unknown values take the default (a value, or a Column to fall back on)."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.create_map(*pairs)[c]
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))
