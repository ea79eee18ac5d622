"""Approximate quantiles by mergeable sketches, for those who ask for them.

The exact operators (`quantiles`) are the default at every size; nothing here is chosen by size. A KLL sketch of a few
kilobytes per group is stored once, merges with others in any order, and answers any probability later: quantiles of a
week are merged from seven days without reading their rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 800


def rank_error(k: int = K) -> float:
    """By how much the rank of an estimate may differ from the probability asked for, at 99% confidence."""
    return 2.296 / k**0.9021


def value_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = K) -> DataFrame:
    """Per key: one sketch per column (binary, under the column's name). Nulls and NaN are left out.

    Partial sketches are built where the rows are; one small row per key and task is shuffled.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    return df.groupBy(*keys).agg(*[F.kll_sketch_agg_double(v, F.lit(k)).alias(c) for c, v in values.items()])


def merged(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def rolling(sketches: DataFrame, order: str, columns: Sequence[str], length: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each row's sketches merged with those of up to `length` - 1 rows before it. One row per key and snapshot."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)

    def joined(c: str) -> Column:
        parts = F.collect_list(c).over(frame)
        rest = F.slice(parts, F.lit(2), F.size(parts))
        return F.aggregate(rest, F.get(parts, F.lit(0)), lambda a, b: F.kll_sketch_merge_double(a, b))

    return sketches.withColumns({c: joined(c) for c in columns})


def count(sketch: str) -> Column:
    return F.kll_sketch_get_n_double(sketch)


def estimate(sketch: str, probability: float) -> Column:
    """A value whose rank is about the probability; null for a sketch without values."""
    return F.when(count(sketch) > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(probability))))


def approximate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], k: int = K
) -> DataFrame:
    """Keys, `n` and one column per probability, in one pass over the rows; ranks are off by `rank_error(k)` at most in
    99 of 100 cases. The exact form is `quantiles.quantiles`."""
    rows = value_sketches(df.select(*keys, F.col(value).alias("_v")), keys, ["_v"], k)
    return rows.select(*keys, count("_v").alias("n"), *[estimate("_v", p).alias(name) for name, p in probabilities.items()])
