"""Whitening of embeddings by mixed-precision eigenvectors of a distributed covariance.

Entries become whole numbers. Two passes gather exact sums: of every dimension, then of products of entries centred on
the whole number next to their mean; what the rounding of the mean leaves is taken out exactly. Eigenvectors of the
covariance come from single precision and are refined by Ogita and Aishima's iteration: with R = I - X'X and S = X'AX,
both in extended precision, X moves by X E, where E holds (s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where two
eigenvalues are too close to tell. Clusters of such eigenvalues are turned by the eigenvectors of their own small
block. Products in extended precision are sums of exact products of slices (Ozaki), so all heavy work is ordinary
matrix multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, OFFSET = 1024, 100_000
LIMIT = 1 << 40  # entries of greater size are taken at this size, so that sums of products fit 38 digits
ROWS = 4096
COMPONENTS = 8
ROUNDS = 12

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- eigenvectors


def slices(x: np.ndarray, count: int = 3, axis: int = 1) -> list[np.ndarray]:
    """Doubles that sum to `x`, each of so few bits on a common grid per row (or column) that products are exact."""
    bits = (53 - int(np.ceil(np.log2(max(x.shape[axis], 2))))) // 2
    out, rest = [], x.astype(np.longdouble)
    for _ in range(count):
        top = np.abs(rest).max(axis=axis, keepdims=True)
        grid = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) - bits)
        part = np.rint(rest / grid) * grid
        out.append(part.astype(np.float64))
        rest = rest - part
    return out


def product(a: np.ndarray, b: np.ndarray, minus: np.ndarray | None = None) -> np.ndarray:
    """a @ b (minus a matrix) in extended precision, from exact products of slices, largest first."""
    left, right = slices(a, axis=1), slices(b, axis=0)
    out = np.zeros((a.shape[0], b.shape[1]), np.longdouble) if minus is None else -minus.astype(np.longdouble)
    for total in range(2 * len(left) - 1):
        for i in range(len(left)):
            if 0 <= total - i < len(right):
                out = out + left[i] @ right[total - i]
    return out


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of the runs of more than one value whose neighbours lie within `gap`."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(np.abs(np.diff(values[order].astype(np.float64))) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the symmetric `a` (extended precision) from approximate ones."""
    one = np.eye(len(a))
    x, close = x.astype(np.longdouble), len(a) * 2.0**-63
    for _ in range(rounds):
        r = -product(x.T, x, minus=one)
        s = product(x.T, product(a, x))
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        rest, top = (s - np.diag(np.diag(s))).astype(np.float64), np.abs(values).max()
        if np.abs(r).max() < close and np.abs(rest).max() < close * top:
            break
        gap = max(2 * (np.linalg.norm(rest) + top * np.linalg.norm(r.astype(np.float64))), 1e-15 * top)
        apart = values[None, :] - values[:, None]
        step = np.where(np.abs(apart) > gap, (s + values[None, :] * r) / np.where(np.abs(apart) > gap, apart, 1), r / 2)
        x = x + product(x, step)
        for part in clusters(values, gap):
            own = x[:, part]
            inner = product(own.T, product(a, own)) - np.diag(np.full(len(part), values[part].mean()))
            if np.abs(inner - np.diag(np.diag(inner))).max() > close * top:
                turn = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1][:, ::-1]
                x[:, part] = product(own, turn)
    r = -product(x.T, x, minus=one)
    values = np.diag(product(x.T, product(a, x))) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(1 - np.diag(r))[order]
    return values[order], x * np.where(x[np.abs(x).argmax(0), np.arange(len(a))] < 0, -1, 1)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors; the first guess in single precision."""
    top = np.abs(a).max() if a.size else 0
    if not top:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    small = (a / top).astype(np.float32)
    values, x = refine(a / top, np.linalg.eigh(small)[1].astype(np.float64))
    return values * top, x


# ---------------------------------------------------------------- sums over the table


def usable(vector: Column) -> Column:
    """The vector has no null, NaN or infinite entry."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def matrices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number entries of the batch's vectors, equal lengths together."""
    column = batch.column("v")
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values, lengths = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(off)
    for dim in np.unique(lengths):
        which = np.flatnonzero(lengths == dim)
        for at in range(0, len(which), rows):
            part = which[at : at + rows]
            x = values[off[part][:, None] + np.arange(dim)]
            yield part, np.clip(np.floor(x * SCALE) + OFFSET, -LIMIT, LIMIT).astype(np.int64)


class Sums:
    """Whole numbers per length, added up as one machine word while that is exact and as Python integers beyond."""

    def __init__(self):
        self.n: dict[int, int] = {}
        self.totals: dict[int, np.ndarray] = {}

    def add(self, dim: int, rows: int, values: np.ndarray) -> None:
        self.n[dim] = self.n.get(dim, 0) + rows
        self.totals[dim] = values.astype(object) + self.totals.get(dim, 0)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for dim, total in self.totals.items():
            flat = np.concatenate([[self.n[dim]], total.ravel()]).tolist()
            high, low = [int(v) >> 32 for v in flat], [int(v) & 0xFFFFFFFF for v in flat]
            columns = [np.full(len(flat), dim), np.arange(-1, len(flat) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["dim", "at", "high", "low"]
            )


def _gathered(partial: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Count and exact totals per length; one row per entry of a covariance reaches the driver."""
    halves = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    out: dict[int, dict[int, int]] = {}
    for r in partial.groupBy("dim", "at").agg(*halves).collect():
        out.setdefault(r["dim"], {})[r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return {d: (t[-1], np.array([t[i] for i in range(len(t) - 1)], object)) for d, t in out.items()}


def sums(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    def run(batches):
        held = Sums()
        for batch in batches:
            for part, x in matrices(batch):
                held.add(x.shape[1], len(part), x.sum(0))
        yield from held.batches()

    return _gathered(vectors.mapInArrow(run, "dim bigint, at bigint, high bigint, low bigint"))


def cross_products(y: np.ndarray) -> np.ndarray:
    """Y'Y of whole numbers, exact: in doubles while every sum fits 53 bits, else in Python integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64)
    if top < 1 << 26:
        return sum((cross_products(part) for part in np.array_split(y, 2)), np.zeros((), np.int64)) if len(y) > 1 else np.outer(y[0], y[0])
    high, low = y >> 20, y & 0xFFFFF
    mixed = high.astype(object).T @ low.astype(object)
    return (cross_products(high).astype(object) << 40) + ((mixed + mixed.T) << 20) + cross_products(low)


def covariances(vectors: DataFrame, first: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """n² times the covariance of each length, as exact integers: n * sum(yy') - tt', y centred on whole numbers."""
    centres = {d: np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64) for d, (n, total) in first.items()}

    def run(batches):
        held = Sums()
        for batch in batches:
            for part, x in matrices(batch):
                dim = x.shape[1]
                held.add(dim, len(part), cross_products(x - centres[dim]))
        yield from held.batches()

    out = {}
    for dim, (n, products) in _gathered(vectors.mapInArrow(run, "dim bigint, at bigint, high bigint, low bigint")).items():
        left = first[dim][1] - n * centres[dim].astype(object)
        out[dim] = n * products.reshape(dim, dim) - np.outer(left, left)
    return out


def extended(x: np.ndarray) -> np.ndarray:
    """Python integers in extended precision."""
    high = x.astype(np.float64)
    low = np.array([int(v) - int(h) for v, h in zip(x.ravel(), high.ravel())], object).reshape(x.shape)
    return high.astype(np.longdouble) + low.astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """Of one length: rows, sums per dimension, projections (eigenvectors over root eigenvalues), shares of the trace
    and the largest entry of the whitened covariance minus the identity."""

    n: int
    total: np.ndarray
    project: np.ndarray
    explained: np.ndarray
    error: float

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whitened values, and each row's sum of (n x - S)² with a mark of those that fit a long."""
        # n x - S and its squares wrap at 64 bits; the sum is right whenever the true one fits
        with np.errstate(over="ignore"):
            wrapped = x * np.int64(self.n) - np.array([int(s) & 0xFFFFFFFFFFFFFFFF for s in self.total], np.uint64).view(np.int64)
            deviation = (wrapped * wrapped).sum(1)
        mean = np.array([int(s) // self.n for s in self.total], np.int64)
        rest = np.array([int(s) % self.n / self.n for s in self.total])
        centred = (x - mean).astype(np.float64) - rest
        about = (centred**2).sum(1) * float(self.n) ** 2
        fits = about < 2.0**63 * (1 - 1e-6)
        for i in np.flatnonzero(~fits & (about < 2.0**63 * (1 + 1e-6))):
            fits[i] = sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(x[i], self.total)) < 1 << 63
        return centred @ self.project, deviation, fits


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening per length of vector. Two jobs; the driver holds one covariance per length."""
    first = sums(vectors)
    out = {}
    for dim, scaled in covariances(vectors, first).items():
        n, total = first[dim]
        a = extended(scaled)
        values, x = eigen(a)
        count, trace = min(components, dim), np.diag(a).sum()
        e, x = values[:count], x[:, :count]
        alive = e > trace * dim * 2.0**-52
        project = np.where(alive, x / np.sqrt(np.where(alive, e, 1) / np.longdouble(n) ** 2), np.nan).astype(np.float64)
        inside = project[:, alive].astype(np.longdouble)
        rest = product(inside.T, product(a / np.longdouble(n) ** 2, inside), minus=np.eye(int(alive.sum())))
        explained = np.where(alive, e / (trace if trace else 1), 0.0).astype(np.float64)
        out[dim] = Whitening(n, total, project, explained, float(np.abs(rest).max(initial=0)))
    return out


def whiten(
    df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Every usable vector's first `components` whitened values, columns `RESULT` (with the id under its own name).

    Rows whose vector is null or empty, or holds a null, NaN or infinite entry are dropped; null ids and repeated rows
    stay, each a row of its own. Vectors of different lengths have a fit of their own. A vector of fewer dimensions has
    fewer components. A component without variance (a constant table, one row) has a null whitened value and explains
    nothing. `deviation` is null where it passes the range of a long. Other columns are ignored; an empty table gives no
    rows. Two jobs run at once (`fit`); the fit is sent to the tasks, its size is that of `components` vectors.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    vectors = vectors.withColumn("v", F.col("v").cast("array<double>"))
    fits = fit(vectors.select("v"), components)

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for part, x in matrices(batch):
                own = fits[x.shape[1]]
                values, deviation, fitting = own.apply(x)
                count = values.shape[1]
                flat = values.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(part, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(flat), own.n)),
                        pa.array(np.repeat(deviation, count), mask=np.repeat(~fitting, count)),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(np.tile(own.explained, len(part))),
                        pa.array(np.full(len(flat), own.error)),
                    ],
                    names=[field.split()[0] for field in RESULT.split(", ")],
                )

    return vectors.mapInArrow(run, RESULT).withColumnRenamed("vec_id", id_col)
