"""Time-series operators over frames with one row per key and date.

`daily` makes such a frame; it is bounded by the calendar (a century of days is 36,525 rows per key), which is what
makes per-key windows safe here however many raw rows a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def daily(df: DataFrame, keys: Sequence[Column], date: Column, value: Column, name: str = "value") -> DataFrame:
    """One row per key and day; combined map-side before the shuffle."""
    return df.groupBy(*keys, F.to_date(date).alias("date")).agg(value.alias(name))


def along(keys: Sequence[str], date: str = "date"):
    return Window.partitionBy(*keys).orderBy(date)


def period_return(series: DataFrame, keys: Sequence[str], value: str, name: str = "ret", date: str = "date"):
    """Change against the previous date of the key; null on the first date and after a zero."""
    previous = F.lag(value).over(along(keys, date))
    return series.withColumn(name, F.try_divide(F.col(value), previous) - 1)


def gap_days(series: DataFrame, keys: Sequence[str], name: str = "gap", date: str = "date") -> DataFrame:
    return series.withColumn(name, F.datediff(F.col(date), F.lag(date).over(along(keys, date))))


def rolling(series: DataFrame, keys: Sequence[str], value: str, length: int, date: str = "date") -> DataFrame:
    """Mean and sample deviation of the last `length` rows, null until that many values are present."""
    frame = along(keys, date).rowsBetween(-(length - 1), 0)
    full = F.count(value).over(frame) == length
    deviation = F.stddev_samp(value).over(frame)
    return series.withColumns(
        {
            "rolling_mean": F.when(full, F.avg(value).over(frame)),
            "rolling_std": F.when(full & (deviation != 0), deviation),
        }
    )


def running_max(series: DataFrame, keys: Sequence[str], value: str, name: str = "peak", date: str = "date"):
    frame = along(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(name, F.max(value).over(frame))


def rebase(series: DataFrame, keys: Sequence[str], value: str, name: str = "indexed", date: str = "date"):
    """Value relative to the first of its key, which becomes 100."""
    frame = along(keys, date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn(name, F.try_divide(F.col(value), F.first(value).over(frame)) * 100)


def fill_series(series: DataFrame, keys: Sequence[str], value: str, direction: str = "forward", date: str = "date"):
    """Fill nulls inside each key's bounded series. For raw tables of any size use `ordered.fill`."""
    order = F.col(date).asc() if direction == "forward" else F.col(date).desc()
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(value, F.last(value, ignorenulls=True).over(frame))


def as_of(series: DataFrame, keys: Sequence[str], value: str, targets: dict[str, Column], date: str = "date"):
    """Last value dated on or before each target, per key, as one grouped aggregate."""
    return series.groupBy(*keys).agg(
        *[F.max_by(value, F.when(F.col(date) <= target, F.col(date))).alias(name) for name, target in targets.items()]
    )


def largest_gap(df: DataFrame, moment: str) -> DataFrame:
    """Longest pause in whole days between consecutive moments of a column, with its ends.

    Reduced to first and last moment per day before any ordering, so the one-task window sees days, not rows.
    """
    days = (
        df.where(F.col(moment).isNotNull())
        .groupBy(F.to_date(moment).alias("day"))
        .agg(F.min(moment).alias("first"), F.max(moment).alias("last"))
    )
    previous = F.lag("last").over(Window.orderBy("day"))
    micros = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    gaps = days.withColumn("before", previous).withColumn("micros", micros)
    widest = F.max(F.struct("micros", (-F.unix_date("day")).alias("earliest"), "before", "first"))
    return gaps.agg(widest.alias("g")).select(
        F.floor(F.col("g.micros") / 86_400_000_000).cast("int").alias("gap_days"),
        F.col("g.before").alias("gap_start"),
        F.col("g.first").alias("gap_end"),
    )
