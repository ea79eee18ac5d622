"""Moments of many columns against pandas and plain loops; scans counted in the plan."""

import itertools

import numpy as np
import pandas as pd
import pytest

from grainmill.operators import explore, moments


@pytest.fixture(scope="module")
def wide(spark):
    """Fifty columns with nulls, constants, multiples and products, on several partitions."""
    rng = np.random.default_rng(12)
    n = 400
    data = {f"x{i}": rng.normal(i, 1 + i % 5, n) for i in range(44)}
    frame = pd.DataFrame(data)
    frame["flat"] = 7.25
    frame["twice"] = frame.x3 * 2.5
    frame["area"] = frame.x4 * frame.x9
    frame["area_off"] = frame.x5 * frame.x6 * 1.008
    frame["one_off"] = frame.x7 * frame.x8
    frame.loc[3, "one_off"] += 1e9  # least squares would lose it, and so does the mean error
    frame["near"] = frame.x1 + rng.normal(0, 0.1, n)
    for c in ("x2", "x4", "x5", "area"):
        frame.loc[rng.integers(0, n, 60), c] = np.nan
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).repartition(5)


def test_comoments_match_pandas(wide):
    frame, df = wide
    want = frame.corr()
    for r in moments.comoments(df, list(frame)).collect():
        both = frame[[r["first"], r["second"]]].dropna()
        assert r.n == len(both) and r.mean_first == pytest.approx(both.iloc[:, 0].mean(), rel=1e-12)
        assert r.var_second == pytest.approx(both.iloc[:, 1].var(), rel=1e-9, abs=1e-18)
        if "flat" in (r["first"], r["second"]):
            assert r.r is None
        else:
            assert r.r == pytest.approx(want.loc[r["first"], r["second"]], abs=1e-12)


def test_correlations_by_either_way(wide):
    frame, df = wide
    some = list(frame)[:6]
    by_aggregate = {(r["first"], r["second"]): r.r for r in explore.correlation_pairs(df, some).collect()}
    by_matrix = {(r["first"], r["second"]): r.r for r in explore.correlation_pairs(df, list(frame)).collect()}
    assert all(by_matrix[pair] == pytest.approx(r, abs=1e-12) for pair, r in by_aggregate.items())
    assert len(by_matrix) == 49 * 48 // 2  # all pairs without the constant column


def test_proportional_pairs(wide):
    frame, df = wide
    got = {(r.source, r.derived): (r.factor, r.n) for r in explore.proportional_pairs(df, list(frame)).collect()}
    assert got.keys() == {("x3", "twice")} and got["x3", "twice"] == (pytest.approx(2.5), 400)


def brute_triples(frame):
    found = set()
    for a in frame:
        for b, c in itertools.combinations([c for c in frame if c != a], 2):
            rows = frame[[a, b, c]].dropna()
            if len(rows) >= 10 and (rows[a] - rows[b] * rows[c]).abs().mean() < 0.01 * rows[a].abs().mean():
                found.add((a, b, c, len(rows)))
    return found


def test_product_triples_match_brute_force(wide):
    frame, df = wide
    names = list(frame)
    few = names[:10] + names[44:]
    want = brute_triples(frame[few])
    assert {tuple(r) for r in explore.product_triples(df, few).collect()} == want
    assert {t[:3] for t in want} == {("area", "x4", "x9"), ("area_off", "x5", "x6")}
    candidates = moments.product_candidates(df, names, 10, 0.01).collect()
    assert len(candidates) < 60 and {t[:3] for t in want} <= {tuple(r) for r in candidates}
    assert want <= {tuple(r) for r in explore.product_triples(df, names).collect()}


def test_one_scan_and_one_check(wide):
    frame, df = wide
    plan = moments.product_candidates(df, list(frame), 10, 0.01)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    plan = explore.product_triples(df, list(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_values_that_are_not_finite(spark):
    rows = [(float(i), 2.0 * i, 3.0, float("nan") if i == 4 else 6.0 * i, None if i == 4 else 3.0 * i) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    pairs = {(r["first"], r["second"]): r.r for r in moments.comoments(df, list("abcde")).collect()}
    assert pairs["a", "d"] is None and pairs["d", "e"] == pytest.approx(1.0) and pairs["a", "e"] == pytest.approx(1.0)
    triples = {tuple(r)[:3] for r in explore.product_triples(df, list("abcde")).collect()}
    assert triples == {("e", "a", "c")}
    assert moments.comoments(df.limit(0), ["a", "b"]).count() == 0
    assert explore.product_triples(df.limit(0), ["a", "b", "c"]).count() == 0
