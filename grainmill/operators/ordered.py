"""Order-dependent fills over tables of any size.

A fill over a whole column (or over one very large key) is cut into stretches of equal numbers of rows. Each stretch
is filled by its own window; the last known value before a stretch is carried in from a small table with one row per
key and stretch. Only stretches are ever sorted, never a whole key.

The order column must be unique per key (the row id made at ingest).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainmill.functions.text import blank_to_null
from grainmill.operators.positions import value_positions

ROWS_PER_STRETCH = 1_000_000


def with_stretch(df: DataFrame, order: str, rows_per_stretch: int = ROWS_PER_STRETCH, name: str = "_stretch"):
    """Add the number of the stretch each row falls in; stretches follow the order column and hold equal numbers of rows.

    A row belongs to the stretch of its value's counted position, so gaps and far-away values make no stretch larger;
    equal values stay together. Rows without an order value have no stretch. Runs the job that sorts the values.
    """
    places = value_positions(df.select(F.col(order).alias("_order")), [], "_order")
    places = places.select("_order", F.floor((F.col("_upto") - 1) / rows_per_stretch).alias(name))
    return df.join(places, df[order] == places["_order"], "left").drop("_order")


def fill(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    keys: Sequence[str] = (),
    direction: str = "forward",
    rows_per_stretch: int = ROWS_PER_STRETCH,
    blanks: bool = True,
) -> DataFrame:
    """Replace nulls (and blank texts) by the nearest earlier (`forward`) or later (`backward`) value."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction is 'forward' or 'backward'")
    forward = direction == "forward"
    keys = list(keys)
    data = df
    for c in columns:
        if blanks and isinstance(df.schema[c].dataType, T.StringType):
            data = data.withColumn(c, blank_to_null(F.col(c)))
    data = with_stretch(data, order, rows_per_stretch)

    def along(name: str) -> Column:
        # Backward is forward along the falling order: a frame that ends at the last row is computed anew at every row.
        return F.col(name).asc() if forward else F.col(name).desc()

    inside = Window.partitionBy(*keys, "_stretch").orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.max_by if forward else F.min_by
    carried = data.groupBy(*keys, "_stretch").agg(
        *[edge(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_edge_{c}") for c in columns]
    )
    outside = Window.partitionBy(*keys).orderBy(along("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_stretch").alias("_piece"),
        *[F.last(F.col(f"_edge_{c}"), ignorenulls=True).over(outside).alias(f"_carry_{c}") for c in columns],
    )
    on = data["_stretch"] == carried["_piece"]
    for k in keys:
        on = on & data[k].eqNullSafe(carried[f"_key_{k}"])
    joined = data.join(carried, on, "left")
    filled = {c: F.coalesce(F.last(F.col(c), ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)
