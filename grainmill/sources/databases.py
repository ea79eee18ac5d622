"""Database scans: read-only queries, limits, partitioned reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statement verbs that are refused.
WRITE_VERBS = ("insert", "update", "delete", "drop", "truncate", "create", "alter", "replace", "merge", "call", "exec")

# A write hidden behind WITH.
WRITE_STATEMENT = r"\b(insert\s+into|delete\s+from|update\s+\S+\s+set|merge\s+into|(drop|alter|create)\s+(table|view|index))\b"


def read_only(query: str) -> str:
    """The query without comments and closing semicolon; raises unless it is one SELECT (or WITH ... SELECT)."""
    text = re.sub(r"/\*.*?\*/|--[^\n]*", " ", query, flags=re.DOTALL).strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", text.lower())
    first = re.match(r"[\s(]*([a-z]+)", bare)
    if first is None or first.group(1) not in ("select", "with"):
        raise ValueError(f"refused: {first.group(1) if first else 'empty query'}; only SELECT is allowed")
    if ";" in bare or re.search(WRITE_STATEMENT, bare):
        raise ValueError("refused: only a single SELECT is allowed")
    return text


def bounded(query: str, limit: int | None) -> str:
    """Add a row limit unless the query has one."""
    if limit is None or re.search(r"\blimit\s+\d+\s*$", query, flags=re.IGNORECASE):
        return query
    return f"{query} LIMIT {int(limit)}"


def table_query(table: str, limit: int | None = None) -> str:
    if not re.fullmatch(r"[A-Za-z_][\w.]*", table):
        raise ValueError("not a table name")
    return bounded(f"SELECT * FROM {table}", limit)


def read_database(
    spark: SparkSession,
    url: str,
    query: str | None = None,
    table: str | None = None,
    limit: int | None = None,
    partition: tuple[str, object, object, int] | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Scan a database by JDBC.

    `partition` is (column, lower bound, upper bound, pieces): the scan is then split over tasks. Without it the
    driver of the database decides, and one task reads the result.
    """
    text = read_only(query) if query else table_query(table or "", limit)
    text = bounded(text, limit)
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if partition is None:
        return reader.option("query", text).load()
    column, low, high, pieces = partition
    return (
        reader.option("dbtable", f"({text}) AS source")
        .option("partitionColumn", column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", str(pieces))
        .load()
    )
