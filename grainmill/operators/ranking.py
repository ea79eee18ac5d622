"""Ranks over a whole table without gathering it in one task.

`average_rank` gives tied values the mean of their positions; `percent` divides by the number of present values. Ranks
over a table are read off the counted positions of its distinct values (`positions`), on the column's own type.

Ranks meet their rows by equal values, so the values are computed once and checkpointed: a sum of doubles taken twice may
differ in its last bit, as shuffled rows arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.operators.positions import value_positions
from grainmill.session import cut_lineage


def add_average_rank(
    df: DataFrame, column: str, name: str, descending: bool = False, percent: bool = False
) -> DataFrame:
    """`df` with the average rank of `column`; null stays without a rank. Runs the jobs that
    compute `df` and sort its distinct values."""
    df = cut_lineage(df)
    values = value_positions(df.select(F.col(column).alias("_x")), [], "_x")
    ranks = values.select(F.col("_x").alias("_k"), _rank(descending, percent).alias("_rank"))
    return df.join(ranks, df[column] == ranks["_k"], "left").select(*[df[c] for c in df.columns], F.col("_rank").alias(name))


def _rank(descending: Column | bool, percent: bool) -> Column:
    up = F.col("_upto") - (F.col("_times") - 1) / F.lit(2.0)
    down = F.col("_n") + 1 - up
    rank = F.when(descending, down).otherwise(up) if isinstance(descending, Column) else (down if descending else up)
    return rank / F.col("_n") if percent else rank


def average_rank(
    c: Column, partition: list[str] | None = None, descending: bool = False, percent: bool = False
) -> Column:
    """Window form, for partitions known to be small."""
    keys = [F.col(k) for k in (partition or [])]
    present = c.isNotNull()
    place = F.rank().over(Window.partitionBy(*keys, present).orderBy(c.desc() if descending else c.asc()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
    value = place + (ties - 1) / F.lit(2.0)
    if percent:
        value = value / F.count(c).over(Window.partitionBy(*keys))
    return F.when(present, value)


def percent_ranks(df: DataFrame, key: str, columns: dict[str, bool]) -> DataFrame:
    """Key plus `<column>_pct` for each `{column: descending}`. One row per key; all measures share one sort."""
    cells = [F.struct(F.lit(name).alias("m"), F.col(name).cast("double").alias("v")) for name in columns]
    long = cut_lineage(df.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.m", "c.v"))
    falling = F.col("m").isin([name for name, descending in columns.items() if descending])
    values = value_positions(long, ["m"], "v")
    ranks = values.select("m", "v", _rank(falling, percent=True).alias("r"))
    ranked = long.join(ranks, ["m", "v"], "left")
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("m") == n, F.col("r"))).alias(f"{n}_pct") for n in columns])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First `n` rows per group with their place. Spark prunes each partition to `n` per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
