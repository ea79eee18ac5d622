"""Positions in the order of values, per group, for groups of any size.

Equal values are counted first, so a value repeated over a third of the table is one row. The distinct values are then
sorted in ranges across all tasks, and running counts inside a range are completed by the totals of the ranges before
it: a group larger than a task is simply spread over several ranges. There is one plan for every size and every type
that Spark can order; NaN is the largest number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.session import cut_lineage


def same_keys(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of the named columns of two frames; true without any."""
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in pairs], F.lit(True))


def sorted_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """`df` sorted across tasks, with `_at` growing along the order and `_range`, the task's range. Runs a job.

    The frame is checkpointed, so that everything that reads it sees the same ranges even when executors are lost.
    """
    rows = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_range", F.shiftright("_at", 33))


def running_total(ranged: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add the total of `amount` up to and with each row along the order of `sorted_ranges`."""
    ranged = ranged.withColumn("_amount", amount)
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum("_amount").alias("_t"))  # one row per range
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select("_r", (F.sum("_t").over(before) - F.col("_t")).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    added = ranged.withColumn(name, F.sum("_amount").over(inside))
    return (
        added.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_r", "_offset", "_amount")
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct present values per key: keys, value, `_times` (rows), `_upto` (rows up to and with it), `_n` (rows of the key)."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    running = running_total(sorted_ranges(counts, [*keys, value]), F.col("_times"), "_upto")
    starts = running.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min(F.col("_upto") - F.col("_times")).alias("_start"), F.sum("_times").alias("_n")
    )
    if not keys:
        start = starts.select(F.struct("_start", "_n").alias("s")).scalar()
        running = running.withColumn("_s", start).select(value, "_times", "_upto", "_s._start", "_s._n")
    else:
        running = running.join(starts, same_keys(running, starts, [(k, f"_k_{k}") for k in keys]))
    return running.select(*keys, value, "_times", (F.col("_upto") - F.col("_start")).alias("_upto"), "_n")
