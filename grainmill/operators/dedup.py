"""Duplicates: counting, removing, keeping first, last or none.

Every form is a grouped aggregate with map-side combine, so a key repeated across a third of the table shrinks to one
row per task before the shuffle. Rows kept by order are picked by `min_by` / `max_by`, never by sorting a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def cell_hashes(columns: Sequence[str]) -> list[tuple[Column, Column]]:
    """Two independent 64-bit hashes per cell, salted by position so that equal values in two columns differ.

    Nulls hash to the salt alone and stay apart from empty texts.
    """
    return [
        (F.xxhash64(F.lit(i), F.col(c)), F.xxhash64(F.lit(f"second-{i}"), F.col(c))) for i, c in enumerate(columns)
    ]


def _xor(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.lit(0).cast("long"))


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows and surplus copies over the given columns.

    Rows meet by a 128-bit fingerprint, so 16 bytes per row are shuffled however wide the row is.
    """
    hashes = cell_hashes(list(columns or df.columns))
    groups = df.groupBy(_xor([a for a, _ in hashes]).alias("a"), _xor([b for _, b in hashes]).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def near_duplicate_count(
    df: DataFrame, columns: Sequence[str] | None = None, include_exact: bool = False
) -> DataFrame:
    """Per left-out column: surplus copies that appear once that column is ignored, beyond the exact ones.

    With `include_exact` the row for the empty column name holds the exact copies. All columns are tried in one
    shuffle: a row's fingerprint is the exclusive or of its cell hashes, so leaving a column out is one more
    exclusive or, and the work grows with the number of columns, not its square.
    """
    columns = list(columns or df.columns)
    hashes = cell_hashes(columns)
    hashed = df.select(
        _xor([a for a, _ in hashes]).alias("a"),
        _xor([b for _, b in hashes]).alias("b"),
        F.array(*[F.struct(F.lit(i).alias("column"), a.alias("a"), b.alias("b")) for i, (a, b) in enumerate(hashes, 1)]).alias("cells"),
    )
    # Columns go by number through the shuffle, which holds a row for each column of each row; 0 is none.
    names = F.array(*[F.lit(c) for c in ["", *columns]])
    whole = F.struct(F.lit(0).alias("column"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    counts = (
        hashed.select("a", "b", F.explode(F.concat(F.array(whole), F.col("cells"))).alias("c"))
        .groupBy(
            F.col("c.column").alias("column"),
            F.col("a").bitwiseXOR(F.col("c.a")).alias("a"),
            F.col("b").bitwiseXOR(F.col("c.b")).alias("b"),
        )
        .agg((F.count(F.lit(1)) - 1).alias("surplus"))
        .groupBy("column")
        .agg(F.sum("surplus").alias("surplus"))
        .select(F.get(names, F.col("column")).alias("column"), "surplus")
    )
    # At most one row per column is left here, so the comparison with the exact count is a small window.
    exact = F.max(F.when(F.col("column") == "", F.col("surplus"))).over(Window.partitionBy())
    own = F.when(F.col("column") == "", F.col("surplus")).otherwise(F.col("surplus") - exact)
    rows = counts.select("column", own.alias("near_duplicates"))
    return rows if include_exact else rows.where(F.col("column") != "")


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "first",
    order: str | None = None,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Keep one row per key (`first` or `last` by `order`) or only rows without a copy (`none`).

    `ignore` names columns, such as a row id, that do not take part in whole-row comparison.
    """
    keys = [c for c in (subset or df.columns) if c not in ignore and (subset or c != order)]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        if keep == "none":
            groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            return groups.where(F.col("_n") == 1).select(*df.columns)
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*df.columns)
    others = F.struct(*rest)
    if keep == "none":
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(others).alias("_row"))
        groups = groups.where(F.col("_n") == 1)
    elif order is None:
        groups = df.groupBy(*keys).agg(F.min(others).alias("_row"))
    else:
        pick = F.min_by if keep == "first" else F.max_by
        groups = df.groupBy(*keys).agg(pick(others, F.col(order)).alias("_row"))
    taken = {c: F.col("_row")[c].alias(c) for c in rest}
    return groups.select(*[taken.get(c, F.col(c)) for c in df.columns])
