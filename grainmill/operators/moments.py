"""Moments of many columns at once, as matrices that merge.

A wide table has too many pairs and triples of columns for one expression each. Here every task turns its rows into
matrices with masks for nulls and gathers all of them by matrix products. Its state is one row per row of the matrix;
states merge pair by pair (means and co-moments by the parallel update), so one scan and one small shuffle serve any
number of columns. The driver sees results only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROWS = 1024
# A constant column's second moment is rounding only.
FLAT = 1e-14

State = np.ndarray  # figures x ... x columns


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values (0 where null) and presence, at most `rows` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            present = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns])
            yield np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns]), present


def gathered(
    df: DataFrame,
    columns: Sequence[str],
    of: Callable[[np.ndarray, np.ndarray], State],
    merge: Callable[[State, State], State],
    finish: Callable[[int, State], list[tuple]],
    schema: str,
    rows: int = ROWS,
) -> DataFrame:
    """`finish(i, state)` of every row i of the states of all rows; `of` makes a state, `merge` joins two."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = [part.split()[0] for part in schema.split(", ")]

    def partial(batches):
        state = None
        for x, present in _matrices(batches, rows):
            more = of(x, present)
            state = more if state is None else merge(state, more)
        if state is not None:
            places = np.arange(state.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places), pa.array([np.ascontiguousarray(state[:, i]).tobytes() for i in places], pa.binary())], names=["i", "state"]
            )

    def whole(batches):
        held: dict[int, State] = {}
        for batch in batches:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("state").to_pylist()):
                state = np.frombuffer(raw, np.float64).reshape(-1, len(columns))
                held[i] = merge(held[i], state) if i in held else state
        found = [row for i in sorted(held) for row in finish(i, held[i])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(values)) for values in zip(*found)], names=names)

    partials = numbers.mapInArrow(partial, "i int, state binary")
    return partials.repartition("i").mapInArrow(whole, schema)


# ---------------------------------------------------------------- pairs


def _parallel(a: State, b: State) -> State:
    """Counts, means, second moments and co-moments of two sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    step, mixed = b[1:3] - a[1:3], a[0] * b[0] / some
    out = np.empty_like(a)
    out[0] = n
    out[1:3] = a[1:3] + step * b[0] / some
    out[3:5] = a[3:5] + b[3:5] + step**2 * mixed
    out[5] = a[5] + b[5] + step[0] * step[1] * mixed
    return out


def _pair_state(x: np.ndarray, present: np.ndarray) -> State:
    """n, means, second moments (of the first and of the second column) and co-moment of every pair of columns."""
    m = present.astype(np.float64)
    wild = ~np.isfinite(x)
    x = np.where(wild, 0.0, x)
    centre = x.sum(0) / np.maximum(m.sum(0), 1)
    x = np.where(present, x - centre, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1)
    first = (x.T @ m) / some
    second = first.T
    square = (x**2).T @ m - n * first**2
    out = np.stack([n, first + centre[:, None], second + centre, square, square.T, x.T @ x - n * first * second])
    if wild.any():
        bad = wild.T.astype(np.float64) @ m > 0
        out[1:, bad | bad.T] = np.nan
    return out


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per pair of columns, over rows where both are present: n, means, sample deviations, correlation.

    The correlation is null where a side is constant or holds a value that is not finite. One scan.
    """
    columns = list(columns)

    def finish(i: int, state: State) -> list[tuple]:
        rows = []
        for j in range(i + 1, len(columns)):
            n, a, b, aa, bb, ab = (float(v) for v in state[:, j])
            if not n:
                continue
            flat = min(aa - n * (FLAT * a) ** 2, bb - n * (FLAT * b) ** 2) <= 0
            r = None if flat or not np.isfinite(ab) else max(-1.0, min(1.0, ab / (aa * bb) ** 0.5))
            spread = lambda v: max(v, 0.0) / (n - 1) if n > 1 else None
            var_a, var_b = spread(aa), spread(bb)
            rows.append((columns[i], columns[j], int(n), a, b, var_a, var_b, r))
        return rows

    schema = "first string, second string, n bigint, mean_first double, mean_second double, var_first double, var_second double, r double"
    return gathered(df, columns, _pair_state, _parallel, finish, schema)


def _ratio_state(x: np.ndarray, present: np.ndarray) -> State:
    """n, mean and second moment of second / first of every pair of columns; first values of 0 are left out."""
    usable = present & (x != 0)
    n = usable.T.astype(np.float64) @ present.astype(np.float64)
    k = x.shape[1]
    mean, square = np.zeros((k, k)), np.zeros((k, k))
    with np.errstate(all="ignore"):
        for i in range(k):
            both = usable[:, i : i + 1] & present
            ratio = np.where(both, x / np.where(usable[:, i], x[:, i], 1)[:, None], 0.0)
            mean[i] = ratio.sum(0) / np.maximum(n[i], 1)
            square[i] = (np.where(both, ratio - mean[i], 0.0) ** 2).sum(0)
    return np.stack([n, mean, square])


def _parallel_one(a: State, b: State) -> State:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    step = b[1] - a[1]
    return np.stack([n, a[1] + step * b[0] / some, a[2] + b[2] + step**2 * a[0] * b[0] / some])


def ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per pair of columns: number, mean and sample deviation of second / first. One scan."""
    columns = list(columns)

    def finish(i: int, state: State) -> list[tuple]:
        rows = []
        for j in range(i + 1, len(columns)):
            n, mean, square = (float(v) for v in state[:, j])
            if n:
                rows.append((columns[i], columns[j], int(n), mean, (square / (n - 1)) ** 0.5 if n > 1 else None))
        return rows

    return gathered(df, columns, _ratio_state, _parallel_one, finish, "source string, derived string, n bigint, factor double, spread double")


# ---------------------------------------------------------------- triples


def _signs(x: np.ndarray) -> np.ndarray:
    """Weights of the rows: all 1, and signs that depend on a row's values in no simple way."""
    with np.errstate(over="ignore", invalid="ignore"):
        mixed = np.zeros(len(x), np.uint64)
        for column in np.ascontiguousarray(x.T):
            mixed = (mixed ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        signs = [1.0 - 2.0 * ((mixed >> np.uint64(bit)) & np.uint64(1)).astype(np.float64) for bit in (3, 17, 41)]
    return np.stack([np.ones(len(x)), *signs])


def _triple_state(x: np.ndarray, present: np.ndarray) -> State:
    """For every pair b, c (rows) and column a, over rows where all three are present: their number, sum of |a|, and
    per weighting w the sums of w * b * c and of w * a."""
    left, right = np.triu_indices(x.shape[1], 1)
    weights = _signs(x)
    both = present[:, left] & present[:, right]
    with np.errstate(all="ignore"):
        product = np.where(both, x[:, left] * x[:, right], 0.0)
    wild, wild_product = ~np.isfinite(x), ~np.isfinite(product)
    x, product = np.where(wild | ~present, 0.0, x), np.where(wild_product, 0.0, product)
    pairs, columns = len(left), x.shape[1]
    if present.all():  # every triple has the same rows
        sums = [np.full((pairs, columns), float(len(x))), np.broadcast_to(np.abs(x).sum(0), (pairs, columns))]
        for w in weights:
            sums += [np.broadcast_to((w @ product)[:, None], (pairs, columns)), np.broadcast_to(w @ x, (pairs, columns))]
    else:
        m, there = present.astype(np.float64), both.T.astype(np.float64)
        sums = [there @ m, there @ np.abs(x)]
        for w in weights:
            sums += [(product * w[:, None]).T @ m, there @ (x * w[:, None])]
    out = np.stack(sums)
    if wild.any() or wild_product.any():
        m, there = present.astype(np.float64), both.T.astype(np.float64)
        bad = (wild_product.T.astype(np.float64) @ m + there @ wild.astype(np.float64)) > 0
        out[1:, bad] = np.nan
    return out


def product_candidates(df: DataFrame, columns: Sequence[str], minimum: int, tolerance: float) -> DataFrame:
    """Triples (derived, left, right) that may satisfy mean |a - b c| < tolerance * mean |a| over their common rows.

    No such triple is missed: with any weights between -1 and 1, the weighted mean of a - b c is no larger than the mean
    of its size. The test is made for equal weights and for three patterns of signs. One scan.
    """
    columns = list(columns)
    pairs = list(combinations(range(len(columns)), 2))

    def finish(i: int, state: State) -> list[tuple]:
        b, c = pairs[i]
        rest = np.ones(len(columns), bool)
        rest[[b, c]] = False
        passed = rest & (state[0] >= minimum) & (state[1] > 0)
        limit = state[1] * (tolerance + 1e-6)  # room for rounding
        with np.errstate(invalid="ignore"):
            for k in range(2, len(state), 2):
                passed &= np.abs(state[k + 1] - state[k]) <= limit
        return [(columns[a], columns[b], columns[c]) for a in np.flatnonzero(passed).tolist()]

    rows = max(16, min(ROWS, 2_000_000 // max(len(pairs), 1)))
    return gathered(df, columns, _triple_state, np.add, finish, "derived string, left string, right string", rows)
