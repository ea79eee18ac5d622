"""Two versions of a table compared by a tree of hashes.

Rows fall into buckets by their id. A bucket's row count and sums of row hashes are partial aggregates, so comparing
all buckets shuffles one row per bucket and task, whatever the rows hold. Only rows of unequal buckets are looked at
again, first in finer buckets, then one by one: a few changed rows among very many cost two scans and a join of a few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of a level; also the bound of what is broadcast of the first level.
BUCKETS = 4096
#: With more unequal buckets than this the versions differ all over, and finer buckets would not leave out much.
FEW = 256

Pairs = Sequence[tuple[str, str]]


def shared_pairs(before: DataFrame, after: DataFrame, row_id: str, renamed: Mapping[str, str] | None = None) -> list[tuple[str, str]]:
    """Columns of both versions, as (old name, new name), without the row id."""
    renamed = dict(renamed or {})
    pairs = [(old, renamed.get(old, old)) for old in before.columns if old != row_id]
    return [(old, new) for old, new in pairs if new in after.columns and new != row_id]


def _sums(df: DataFrame, row_id: str, columns: Sequence[str], keys: dict[str, Column], side: str) -> DataFrame:
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    own = F.col(f"`{row_id}`").cast("string")
    hashes = [F.xxhash64(F.lit(seed), own, *cells).cast("decimal(38,0)") for seed in (1, 2)]
    return df.groupBy(*[key.alias(name) for name, key in keys.items()]).agg(
        F.struct(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes)]).alias(side)
    )


def _levels(row_id: str) -> tuple[Column, Column]:
    h = F.xxhash64(F.col(f"`{row_id}`").cast("string"))
    return F.pmod(h, F.lit(BUCKETS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(BUCKETS)).cast("int")


def _unequal(before: DataFrame, after: DataFrame, row_id: str, pairs: Pairs, keys: dict[str, Column]) -> DataFrame:
    left = _sums(before, row_id, [old for old, _ in pairs], keys, "l")
    right = _sums(after, row_id, [new for _, new in pairs], keys, "r")
    return left.join(right, list(keys), "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys)


def differing(before: DataFrame, after: DataFrame, row_id: str, pairs: Pairs | None = None) -> tuple[DataFrame, DataFrame]:
    """Both versions, each with the rows only whose bucket differs from the other version's.

    All rows that were changed, added or removed are among them, and few others. Cells are compared as text, null as
    ''; ids should be unique. One job runs at once: the first level, of which at most `BUCKETS` numbers are collected.
    """
    pairs = shared_pairs(before, after, row_id) if pairs is None else pairs
    first, second = _levels(row_id)
    found = sorted(r["b1"] for r in _unequal(before, after, row_id, pairs, {"b1": first}).collect())
    if not found:
        return before.where(F.lit(False)), after.where(F.lit(False))
    some = before.sparkSession.createDataFrame([(b,) for b in found], "_b1 int")

    def inside(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(some), first == F.col("_b1"), "left_semi")

    before, after = inside(before), inside(after)
    if len(found) > FEW:
        return before, after
    leaves = _unequal(before, after, row_id, pairs, {"b1": first, "b2": second})
    leaves = F.broadcast(leaves.select(F.col("b1").alias("_b1"), F.col("b2").alias("_b2")))  # at most FEW * BUCKETS rows
    same = (first == F.col("_b1")) & (second == F.col("_b2"))
    return before.join(leaves, same, "left_semi"), after.join(leaves, same, "left_semi")


def row_changes(before: DataFrame, after: DataFrame, row_id: str, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """One row: rows added, removed and changed from one version to the next, by id and shared columns."""
    pairs = shared_pairs(before, after, row_id, renamed)
    left, right = differing(before, after, row_id, pairs)

    def sealed(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
        return df.select(F.col(f"`{row_id}`").alias("id"), F.struct(F.lit(1).alias("here"), *[F.xxhash64(F.lit(s), *cells).alias(f"h{s}") for s in (1, 2)]).alias(side))

    both = sealed(left, [old for old, _ in pairs], "l").join(sealed(right, [new for _, new in pairs], "r"), "id", "full")
    count = lambda test: F.count(F.when(test, 1))
    return both.agg(
        count(F.col("l").isNull()).alias("rows_added"),
        count(F.col("r").isNull()).alias("rows_removed"),
        count(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r"))).alias("rows_changed"),
    )
