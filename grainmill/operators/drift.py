"""Metric snapshots and their comparison with a baseline.

A snapshot is a long frame (snapshot, kind, column, value_name, metric): row counts, number statistics, the most
frequent category values and null counts per snapshot key (a day, a batch). Comparison is joins on that frame, which
is small: columns times metrics per snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.functions.stats import count_if
from grainmill.operators.ranking import top_per_group

# Alert limits.
ROW_CHANGE_PCT, ROW_CHANGE_HIGH_PCT = 20.0, 50.0
Z_ALERT, Z_HIGH = 2.0, 3.0
HISTORY = 30
STEADY_STD = 1e-9


def number_metrics(df: DataFrame, snapshot: Column, numbers: Sequence[str]) -> DataFrame:
    """Row count and, per numeric column, mean, deviation, extremes and null count per snapshot, in one aggregate."""
    return df.groupBy(snapshot.alias("snapshot")).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in numbers],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in numbers],
        *[F.min(F.col(c).cast("double")).alias(f"{c}_min") for c in numbers],
        *[F.max(F.col(c).cast("double")).alias(f"{c}_max") for c in numbers],
    )


def null_metrics(df: DataFrame, snapshot: Column, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(snapshot.alias("snapshot")).agg(*[count_if(F.col(c).isNull()).alias(c) for c in columns])


def category_shares(df: DataFrame, snapshot: Column, column: str, n: int | None = None) -> DataFrame:
    """Values per snapshot with their share; with `n`, the most frequent ones, ties to the smaller value."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(snapshot.alias("snapshot"), F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("snapshot").agg(F.sum("n").alias("total"))
    top = counts if n is None else top_per_group(counts, ["snapshot"], [F.col("n").desc(), F.col("value").asc()], n)
    return top.join(totals, "snapshot").select("snapshot", "value", (F.col("n") / F.col("total")).alias("share"))


def row_count_changes(metrics: DataFrame, baseline_rows: Column) -> DataFrame:
    change = F.abs(F.col("row_count") - baseline_rows) / baseline_rows * 100
    rows = metrics.select("snapshot", "row_count", baseline_rows.alias("expected"), change.alias("change_pct"))
    severity = F.when(F.col("change_pct") > ROW_CHANGE_HIGH_PCT, "high").otherwise("medium")
    return rows.where((F.col("expected") > 0) & (F.col("change_pct") > ROW_CHANGE_PCT)).withColumn("severity", severity)


def mean_drift(history: DataFrame, value: str, baseline_mean: Column | None = None, include_current: bool = False):
    """Alerts where a snapshot mean is far from the means before it (columns snapshot and `value`).

    By default the 30 earlier snapshots are the yardstick, and a change over 20% against the baseline mean is the rule
    while fewer than two exist. `include_current` puts the current mean into its own yardstick. The history has one
    row per snapshot, so the window over it is small.
    """
    frame = Window.orderBy("snapshot").rowsBetween(-(HISTORY - 1) if include_current else -HISTORY, 0 if include_current else -1)
    base = baseline_mean if baseline_mean is not None else F.first(value).over(
        Window.orderBy("snapshot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    rows = history.withColumns(
        {
            "points": F.count(value).over(frame),
            "expected": F.avg(value).over(frame),
            "spread": F.stddev_samp(value).over(frame),
            "baseline": base,
        }
    )
    steady = F.when(F.col("spread") == 0, F.lit(STEADY_STD)).otherwise(F.col("spread"))
    z = F.abs(F.col(value) - F.col("expected")) / steady
    change = F.try_divide(F.abs(F.col(value) - F.col("baseline")), F.abs(F.col("baseline"))) * 100
    change = F.when((F.col("baseline") == 0) & (F.col(value) != 0), F.lit(float("inf"))).otherwise(change)
    rows = rows.withColumn("z", F.when(F.col("points") >= 2, z)).withColumn("change_pct", change)
    by_z = (F.col("points") >= 2) & (F.col("z") > Z_ALERT)
    by_change = (F.col("points") < 2) & (F.col("change_pct") > ROW_CHANGE_PCT)
    severity = F.when(by_z & (F.col("z") > Z_HIGH), "high").otherwise("medium")
    return rows.where(by_z | by_change).select(
        "snapshot", value, "expected", "z", "points", severity.alias("severity")
    )


def missing_columns(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metric names of the baseline that the current snapshot lacks (frames with a column `metric`)."""
    return baseline.select("metric").distinct().join(current.select("metric").distinct(), "metric", "left_anti")


def new_values(current: DataFrame, baseline: DataFrame, column: str) -> DataFrame:
    """Values present now and never in the baseline."""
    now = current.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    known = baseline.select(F.col(column).alias("value")).distinct()
    return now.join(known, "value", "left_anti")


def null_regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Columns with more nulls than the baseline (frames with columns `column`, `missing`)."""
    before = baseline.select("column", F.col("missing").alias("expected"))
    rows = current.join(before, "column", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return rows.where((F.col("missing") > F.col("expected")) & (F.col("missing") > 0)).select(
        "column", "missing", "expected"
    )


def metric_names(metrics: DataFrame) -> DataFrame:
    """The columns of a wide metric frame that hold a value, as rows."""
    names = [c for c in metrics.columns if c != "snapshot"]
    wide = metrics.agg(*[F.count(c).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in names]
    return wide.select(F.explode(F.array(*cells)).alias("c")).where("c.n > 0").select("c.metric")
