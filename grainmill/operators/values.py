"""Value counts: many columns in one shuffle, and what follows from them (distinct counts, modes, shares)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.operators.ranking import top_per_group


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value, n) for all named columns, values as text, nulls left out.

    One unpivot and one shuffle for any number of columns, combined map-side.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return (
        df.select(cells.alias("cell"))
        .select("cell.*")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_stats(counts: DataFrame) -> DataFrame:
    """Per column: present values, distinct values, repeated values (surplus copies)."""
    return counts.groupBy("column").agg(
        F.sum("n").alias("present"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.col("n") - 1).alias("repeated"),
    )


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """The `n` most frequent values per column with their share; ties go to the smaller value."""
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    top = top_per_group(counts, ["column"], [F.col("n").desc(), F.col("value").asc()], n)
    return top.join(totals, "column").select(
        "column", "place", "value", "n", (F.col("n") / F.col("total")).alias("share")
    )


def mode_by(df: DataFrame, keys: Sequence[str], column: str, name: str = "mode") -> DataFrame:
    """Most frequent value per key, the smallest among ties.

    Counts per value first, then picks: no task holds a group's values.
    """
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column)))
    return counts.groupBy(*keys).agg(best.alias(name))


def group_share(df: DataFrame, keys: Sequence[str], measure: Column, name: str = "share") -> DataFrame:
    """Sum of a measure per group and its share of the whole table."""
    groups = df.groupBy(*keys).agg(measure.alias("amount"))
    total = groups.agg(F.sum("amount")).scalar()
    return groups.withColumn(name, F.try_divide(F.col("amount"), total))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value; the last bin is closed."""
    v = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("s")).scalar()
    low, high = span.getField("low"), span.getField("high")
    place = F.floor((v - low) * bins / (high - low))
    bin_number = F.when(high == low, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1)))
    counted = df.where(v.isNotNull()).groupBy(bin_number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    return counted.select(
        F.col("bin").cast("long").alias("bin"),
        (low + F.col("bin") * width).alias("from_value"),
        (low + (F.col("bin") + 1) * width).alias("to_value"),
        "n",
    )

