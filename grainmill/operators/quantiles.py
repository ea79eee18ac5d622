"""Exact quantiles with linear interpolation, per group or over a whole table.

The order statistics are read off the counted positions of the distinct values (`positions`), by one plan for every
size: no group is gathered in a task. Each call runs the job that sorts the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.operators.positions import same_keys, value_positions


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """One row per key with a column per probability. Null values are ignored; a group of nulls gives nulls.

    Values are read as doubles. NaN is a value, larger than infinity.
    """
    keys, names = list(keys), list(names)
    data = df.select(*keys, F.col(value).cast("double").alias("_v"))
    rows = value_positions(data, keys, "_v")
    picked = []
    for i, p in enumerate(probabilities):
        target = F.lit(float(p)) * (F.col("_n") - 1)
        picked += [
            F.min(F.when(F.col("_upto") > F.floor(target), F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_upto") > F.ceil(target), F.col("_v"))).alias(f"_hi{i}"),
            F.first(target - F.floor(target)).alias(f"_f{i}"),
        ]
    found = rows.groupBy(*[F.col(k).alias(f"_q_{k}") for k in keys]).agg(*picked)

    def between(i: int) -> Column:
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when((low == high) | (F.col(f"_f{i}") == 0), low).otherwise(low + (high - low) * F.col(f"_f{i}"))

    found = found.select(*[f"_q_{k}" for k in keys], *[between(i).alias(n) for i, n in enumerate(names)])
    if not keys:
        return found
    everyone = data.select(*keys).distinct()
    return everyone.join(found, same_keys(everyone, found, [(k, f"_q_{k}") for k in keys]), "left").select(*keys, *names)


def aggregate_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    wanted: dict[str, tuple[str, float]],
) -> DataFrame:
    """`groupBy(keys).agg(aggregates)` plus exact quantiles `{name: (value column, probability)}`."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(*aggregates)
    points = sorted({p for _, p in wanted.values()})
    names = [f"_p{i}" for i in range(len(points))]
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    if len(columns) == 1:
        wide = quantiles(df, keys, columns[0], points, names)
        wide = wide.select(*keys, *[F.col(names[points.index(p)]).alias(name) for name, (_, p) in wanted.items()])
    else:
        long = quantiles(_long(df, keys, columns), [*keys, "_c"], "_v", points, names)
        wide = long.groupBy(*keys).agg(
            *[F.max(F.when(F.col("_c") == c, F.col(names[points.index(p)]))).alias(name) for name, (c, p) in wanted.items()]
        )
    if not keys:
        one = base.withColumn("_q", wide.select(F.struct(*wanted).alias("q")).scalar())
        return one.select(*base.columns, *[F.col("_q")[name].alias(name) for name in wanted])
    return base.join(wide, same_keys(base, wide, [(k, k) for k in keys])).select(
        *[base[c] for c in base.columns], *[wide[name] for name in wanted]
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """One row per column (`column`, then one value per name): all columns share the same passes."""
    rows = quantiles(_long(df, [], columns), ["_c"], "_v", list(wanted.values()), list(wanted))
    return rows.withColumnRenamed("_c", "column")


def _long(df: DataFrame, keys: Sequence[str], columns) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("_x"))
    return rows.select(*keys, F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v"))
