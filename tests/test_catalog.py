"""Alike catalog entries by prefix filters: the pairs of a comparison of all, from few candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import changelog

SCHEMA = "dataset string, columns array<string>, column_types map<string,string>"


def score(a, b):
    plain = lambda d: [c for c in d[1] if c.lower() not in changelog.COMMON_NAMES]
    left, right = plain(a), plain(b)
    if not left or not right:
        left, right = a[1], b[1]
    common = set(left) & set(right)
    types = sum(a[2][c] == b[2][c] for c in common) / len(common) if common else 0.0
    base = 0.7 * len(common) / max(len(left), len(right)) + 0.3 * types
    sizes = min(len(a[1]), len(b[1])) / max(len(a[1]), len(b[1]))
    return base * sizes if sizes < 0.7 else base


def catalog(rng, n, families, vocabulary=400):
    """Tables of a few families; everyone has 'customer_id', half have 'id' and 'name' as well."""
    out = []
    for i in range(n):
        f = np.random.default_rng(int(rng.integers(0, families)))
        columns = ["customer_id", *[f"c{k}" for k in f.choice(vocabulary, int(f.integers(2, 12)), replace=False)]]
        if rng.random() < 0.4:
            columns = columns[: int(rng.integers(1, len(columns) + 1))] + [f"own{i}"]
        columns += ["id", "Name"] if rng.random() < 0.5 else []
        if rng.random() < 0.03:
            columns = ["id", "DATE"][: int(rng.integers(1, 3))]
        out.append((f"t{i}", columns, {c: ["numeric", "categorical"][int(rng.random() < 0.1)] for c in columns}))
    return out


@pytest.mark.parametrize("at_least", [0.801, 0.501, 0.951])
def test_pairs_match_comparing_all(spark, at_least):
    entries = catalog(np.random.default_rng(3), 250, 40)
    frame = spark.createDataFrame(entries, SCHEMA)
    want = {}
    for i, a in enumerate(entries):
        for b in entries[i + 1 :]:
            s = score(a, b)
            if s >= at_least:
                want[tuple(sorted((a[0], b[0])))] = s
    got = {(r["first"], r["second"]): r.score for r in changelog.similar_datasets(frame, at_least).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_candidates_are_near_the_results(spark):
    """10,000 tables that all share a column: candidates are few times the results, not all pairs."""
    entries = catalog(np.random.default_rng(4), 10_000, 3000, 20_000)
    frame = spark.createDataFrame(entries, SCHEMA).repartition(8)
    sets = frame.select(F.col("dataset").alias("schema"), F.filter("columns", lambda c: ~F.lower(c).isin(*changelog.COMMON_NAMES)).alias("cs")).where(F.size("cs") > 0)
    prefix = changelog._prefixes(sets, 0.8)
    x, y = prefix.alias("x"), prefix.alias("y")
    candidates = x.join(y, "c").where("x.schema < y.schema").select("x.schema", "y.schema").distinct().count()
    results = changelog.similar_datasets(frame).count()
    assert results > 5000 and candidates < 6 * results
