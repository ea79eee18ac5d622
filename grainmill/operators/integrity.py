"""Checks on tables and between tables: inventory, keys, preconditions, ranks, row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainmill.operators.dedup import duplicate_count
from grainmill.operators.positions import sorted_ranges

# Name parts that mark a candidate key column.
KEY_WORDS = ("code", "id", "date", "month", "house", "category")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def candidate_keys(df: DataFrame, words: Sequence[str] = KEY_WORDS) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def find_column(df: DataFrame, words: Sequence[str]) -> str | None:
    """First column, in table order, whose name contains one of the words."""
    return next((c for c in df.columns if any(w in c.lower() for w in words)), None)


def inventory(tables: Mapping[str, DataFrame], words: Sequence[str] = KEY_WORDS) -> DataFrame:
    """Per table: rows, columns, share of missing cells, candidate keys. One aggregate per table."""
    parts = []
    for name, df in tables.items():
        missing = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
        cells = F.count(F.lit(1)) * len(df.columns)
        parts.append(
            df.agg(
                F.lit(name).alias("dataset"),
                F.count(F.lit(1)).alias("rows"),
                F.lit(len(df.columns)).alias("columns"),
                F.coalesce(F.try_divide(missing * 100.0, cells), F.lit(0.0)).alias("missing_pct"),
                F.lit(", ".join(candidate_keys(df, words)) or "None").alias("candidate_keys"),
            )
        )
    return union_all(parts)


def shared_columns(tables: Mapping[str, DataFrame], words: Sequence[str] = KEY_WORDS) -> DataFrame:
    """Key-like column names found in more than one table, from schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    where: dict[str, list[str]] = {}
    for name, df in tables.items():
        for c in df.columns:
            where.setdefault(c, []).append(name)
    rows = [
        (c, ", ".join(names), len(names))
        for c, names in where.items()
        if len(names) > 1 and any(w in c.lower() for w in words)
    ]
    return spark.createDataFrame(rows, "column string, datasets string, n int")


def missing_and_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, missing cells, surplus copies of whole rows."""
    parts = []
    for name, df in tables.items():
        missing = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
        cells = df.agg(F.coalesce(missing, F.lit(0)).alias("m")).scalar()
        parts.append(duplicate_count(df).select(F.lit(name).alias("dataset"), "rows", cells.alias("missing"), "duplicates"))
    return union_all(parts)


def key_match(master: DataFrame, key: str, facts: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per fact table: distinct keys, keys unknown to the master, master keys without facts, null keys.

    A full join of the two distinct key sets answers both directions at once.
    """
    known = master.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct().withColumn("m", F.lit(1))
    parts = []
    for name, (df, column) in facts.items():
        used = df.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        both = used.join(known, "k", "full")
        present = F.col("k").isNotNull()
        parts.append(
            both.agg(
                F.lit(name).alias("fact"),
                F.count(F.when(present & F.col("n").isNotNull(), 1)).alias("distinct_keys"),
                F.count(F.when(present & F.col("m").isNull(), 1)).alias("orphan_keys"),
                F.coalesce(F.sum(F.when(present & F.col("m").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
                F.count(F.when(F.col("n").isNull(), 1)).alias("unused_keys"),
                F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_rows"),
            )
        )
    return union_all(parts)


def preconditions(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each named rule, all in one pass. A null result of a rule counts as a break."""
    checks = [F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(name) for name, rule in rules.items()]
    wide = df.agg(*checks)
    return wide.unpivot([], list(rules), "rule", "violations")


def require(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Raise when a rule is broken. Runs one job."""
    broken = {r["rule"]: r["violations"] for r in preconditions(df, rules).collect() if r["violations"]}
    if broken:
        raise ValueError(f"preconditions broken: {broken}")


def ranking_checks(df: DataFrame, score: str, rank: str, low: float, high: float) -> DataFrame:
    """Scores out of range, repeated ranks, and places where a worse rank has a better score.

    Order is checked on one row per rank (its best and worst score), sorted in ranges across all tasks. Runs a job.
    """
    by_rank = df.groupBy(rank).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((F.col(score) < low) | (F.col(score) > high), 1)).alias("outside"),
        F.min(score).alias("worst"),
        F.max(score).alias("best"),
    )
    ranged = sorted_ranges(by_rank, [rank])
    inside = Window.partitionBy("_range").orderBy("_at")
    # The first rank of a range is held against the last of the range before it: one row per range.
    lasts = ranged.groupBy(F.col("_range").alias("_r")).agg(F.max_by("worst", "_at").alias("_last"))
    lasts = lasts.select("_r", F.lag("_last").over(Window.orderBy("_r")).alias("_before"))
    marked = ranged.withColumn("_lag", F.lag("worst").over(inside)).join(
        F.broadcast(lasts), F.col("_range") == F.col("_r")
    )
    marked = marked.withColumn("break", F.when(F.col("best") > F.coalesce("_lag", "_before"), 1))
    return marked.agg(
        F.sum("outside").alias("out_of_range"),
        F.sum(F.col("n") - 1).alias("repeated_ranks"),
        F.count("break").alias("order_breaks"),
    )


def row_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Source rows against loaded rows per table."""
    parts = []
    for name, (source, loaded) in pairs.items():
        n = loaded.agg(F.count(F.lit(1)).alias("n")).scalar()
        parts.append(
            source.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("source_rows"), n.alias("loaded_rows"))
        )
    rows = union_all(parts)
    return rows.withColumn("matches", F.col("source_rows") == F.col("loaded_rows"))


def master_profile(df: DataFrame, code: str, groups: Sequence[str]) -> DataFrame:
    """Distinct codes, code lengths and distinct values of the grouping columns."""
    return df.agg(
        F.count_distinct(code).alias("distinct_codes"),
        F.min(F.length(F.col(code).cast("string"))).alias("min_code_length"),
        F.max(F.length(F.col(code).cast("string"))).alias("max_code_length"),
        *[F.count_distinct(g).alias(f"distinct_{g}") for g in groups],
    )


def snapshot_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row difference and column-set change between two versions of a source."""
    added = [c for c in new.columns if c not in old.columns]
    removed = [c for c in old.columns if c not in new.columns]
    before = old.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = new.agg(before.alias("old_rows"), F.count(F.lit(1)).alias("new_rows"))
    return rows.select(
        "old_rows",
        "new_rows",
        (F.col("new_rows") - F.col("old_rows")).alias("row_change"),
        F.lit(", ".join(added)).alias("added_columns"),
        F.lit(", ".join(removed)).alias("removed_columns"),
    )


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)
