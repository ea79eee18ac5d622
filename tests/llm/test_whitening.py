"""Whitening against brute force, clustered eigenvalues, and odd vectors."""

import numpy as np
import pytest

from grainmill.llm import whitening

ODD = [
    (1, [1.0, 0.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [0.25, -0.5]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
    (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [-0.5, 0.75]),
]


def brute(vectors):
    """Exact deviations, and whitened values by double-precision eigenvectors."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    deviation = [sum(int(d) ** 2 for d in row) for row in (n * x - total).tolist()]
    y = (n * x - total) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return deviation, y @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def test_query_matches_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    table = frame.toPandas()
    deviation, white, explained = brute(table.embedding.tolist())
    got = whitening.whiten(frame).toPandas()
    assert len(got) == 8 * len(table) and set(got.n) == {len(table)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.allclose(wide * np.sign((wide * white).sum(0)), white, atol=1e-10)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[table.vec_id].tolist() == deviation
    assert np.allclose(got[got.vec_id == table.vec_id[0]].sort_values("component").explained, explained, rtol=1e-9)
    error = got.identity_error.unique()
    assert len(error) == 1 and error[0] < 1e-12
    assert np.abs(wide.T @ wide / len(wide) - np.eye(8)).max() < 1e-12


SPECTRA = {
    "spread": np.linspace(1, 5, 24),
    "pairs 1e-9 apart": np.r_[np.full(8, 3.0), np.full(8, 3 + 1e-9), np.linspace(1, 2, 8)],
    "one large": np.r_[1e6, np.ones(23)],
    "half zero": np.r_[np.ones(12), np.zeros(12)],
    "all within 1e-7": 1 + 4e-9 * np.arange(24),
}


@pytest.mark.parametrize("kind", SPECTRA)
def test_refined_eigenvectors(kind):
    values = SPECTRA[kind]
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(24, 24)))[0]
    a = (q * values) @ q.T
    a = ((a + a.T) / 2).astype(np.longdouble)
    e, x = whitening.eigen(a)
    top = np.abs(values).max()
    assert (np.diff(e) <= 1e-18 * top).all() and np.allclose(e.astype(float), np.sort(values)[::-1], atol=1e-14 * top)
    assert np.abs(whitening.product(a, x) - x * e).max() < 1e-17 * top
    assert np.abs(whitening.product(x.T, x, minus=np.eye(24))).max() < 1e-17


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 20)), rng.normal(size=(20, 20))
    exact = np.array([[sum(np.longdouble(x) * np.longdouble(y) for x, y in zip(r, c)) for c in b.T] for r in a])
    assert np.abs(whitening.product(a, b) - exact).max() < 1e-17
    for top in (100, 1 << 25, 1 << 39):
        y = rng.integers(-top, top, (300, 5))
        assert (whitening.cross_products(y).astype(object) == y.astype(object).T @ y.astype(object)).all()


def test_odd_vectors(spark):
    rows = [(i, v, 1.0, 2) for i, v in ODD]
    odd = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n double, component int")
    got = whitening.whiten(odd).toPandas()
    deviation, white, _ = brute([v for i, v in ODD if i in (1, 2, 3, None)])
    two = got[got.n == 5]
    assert sorted(two.deviation[two.component == 1]) == sorted(deviation)
    assert np.allclose(sorted(two.whitened[two.component == 1].abs()), sorted(np.abs(white[:, 0])), atol=1e-12)
    assert two.vec_id.isna().sum() == 2 and (two.vec_id == 2).sum() == 4
    alone = got[got.n == 1]
    assert len(alone) == 3 and set(alone.vec_id) == {9} and alone.whitened.isna().all() and (alone.deviation == 0).all()
    assert len(got) == len(two) + len(alone)
    empty = whitening.whiten(odd.where("vec_id < 0"))
    assert empty.count() == 0 and empty.columns == got.columns.tolist()


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [3e8, 0.0]), (1, [-3e8, 1.0]), (2, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert got.deviation[got.vec_id != 2].isna().all()
    deviation = brute([v for _, v in rows])[0]
    assert got.deviation[got.vec_id == 2].tolist() == [float(deviation[2])] * 2
