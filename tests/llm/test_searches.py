"""Exact and approximate search against brute force, and on odd vectors."""

import numpy as np
import pytest

from grainmill.llm import ann, topk

ODD = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
    (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [0.0, 0.0]), (None, [1.0, 1.0]), (11, [-1.0, -0.25]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, v, 1.0, 2) for i, v in ODD]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double, id int")


def best(ids, x, q, k):
    scores = x @ x[q]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]]
    return [(int(ids[i]), scores[i]) for i in order[:k]]


@pytest.mark.parametrize("block", [64, 8192])
def test_top_k_matches_brute_force(vectors, block):
    frame = vectors.toPandas()
    x, ids = np.floor(1024 * np.array(frame.embedding.tolist(), float)), frame.vec_id.to_numpy()
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 7, block_rows=block, query_rows=4).toPandas()
    for query, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert list(zip(rows.vec_id, rows.score)) == best(ids, x, int(np.flatnonzero(ids == query)[0]), 7)
        assert rows["rank"].tolist() == list(range(1, 8))


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16)) * 1000
    x = np.floor(centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 5)
    ids = np.arange(4000)
    found, evaluated = topk.search_block(ids, x, ids[:20], x[:20], topk.choose_pivots(x[:512].tolist(), 32), 10)
    assert evaluated < 20 * 4000 / 3
    for q in range(20):
        assert [(i, float(s)) for a, i, s in found if a == q] == best(ids, x, q, 10)


def test_top_k_of_odd_vectors(odd):
    rows = topk.top_k(odd, odd.where("vec_id IN (1, 4, 9, 10)"), 3).toPandas()
    got = {q: list(zip(g.vec_id, g.score)) for q, g in rows.sort_values("rank").groupby("query_id")}
    assert got == {1: [(2, 1048576), (3, 524288), (3, 524288)], 10: [(1, 0), (2, 0), (3, 0)]}
    assert topk.top_k(odd.where("vec_id < 0"), odd, 3).count() == 0


def test_recall_of_nearest(vectors):
    frame = vectors.toPandas()
    x, ids = np.array(frame.embedding.tolist(), float), frame.vec_id.to_numpy()
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, part_rows=50).toPandas()
    hits = 0
    for query, rows in got.groupby("query_id"):
        want = dict(best(ids, x, int(np.flatnonzero(ids == query)[0]), len(ids)))
        rows = rows.sort_values("rank")
        assert len(rows) == 20 and np.allclose(rows.score, [want[i] for i in rows.vec_id], rtol=1e-12)
        assert rows.score.is_monotonic_decreasing
        hits += len(set(rows.vec_id) & set(list(want)[:20]))
    assert hits / len(got) >= 0.9


def test_nearest_of_odd_vectors(odd):
    rows = ann.nearest(odd, odd.where("vec_id IN (1, 4, 9, 10)"), 9).toPandas()
    got = {q: list(zip(g.vec_id, g.score)) for q, g in rows.sort_values("rank").groupby("query_id")}
    assert got == {1: [(2, 1.0), (3, 0.5), (3, 0.5), (11, -1.0)]}
    assert ann.nearest(odd.where("vec_id < 0"), odd, 3).count() == 0
    assert ann.nearest(odd.where("vec_id < 0"), odd, 3).columns == ["query_id", "rank", "vec_id", "score"]


def test_every_length_is_indexed_and_asked(spark):
    rng = np.random.default_rng(9)
    table = [(i, rng.normal(size=2 if i < 100 else 3).tolist()) for i in range(140)] + [(500, [1.0])]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 5).toPandas()
    assert set(got.query_id) == {0, 20, 40, 60, 80, 100, 120}
    for query, rows in got.groupby("query_id"):
        low, high = (0, 100) if query < 100 else (100, 140)
        x, ids = np.array([v for _, v in table[low:high]]), np.arange(low, high)
        assert [(i, pytest.approx(s)) for i, s in best(ids, x, query - low, 5)] == list(zip(rows.vec_id, rows.score))
