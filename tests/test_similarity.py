"""Closest spellings by the index against difflib on every name."""

import time
from difflib import get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions.similarity import SpellingIndex, closest


def words(rng, n, signs="abcdefghijklmnopqrstuvwxyz ", low=3, high=14):
    return ["".join(rng.choice(list(signs), int(k))) for k in rng.integers(low, high, n)]


def spoilt(rng, name):
    at = int(rng.integers(0, max(len(name), 1)))
    return [name[:at] + name[at + 1 :], name[:at] + "x" + name[at:], name[:at] + "é" + name[at + 1 :], name[::-1]][int(rng.integers(0, 4))]


@pytest.mark.parametrize("signs", ["ab", "abcdef", "abcdefghijklmnopqrstuvwxyzéß "])
@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.9, 1.0])
def test_same_as_comparing_every_name(signs, cutoff):
    rng = np.random.default_rng(len(signs))
    names = words(rng, 200, signs) + ["", "aaa", "aab"]
    values = words(rng, 60, signs) + [spoilt(rng, names[i]) for i in range(60)] + ["", "q", "aab", "b" * 70, "ab" * 120]
    index = SpellingIndex(names)
    for value in values:
        want = get_close_matches(value, sorted(set(names)), n=1, cutoff=cutoff)
        assert index.closest(value, cutoff)[0] == (want[0] if want else None), value


def test_few_names_are_compared():
    rng = np.random.default_rng(5)
    names = words(rng, 20_000, low=6)
    index, compared, start = SpellingIndex(names), [], time.perf_counter()
    for i in range(200):
        found, n = index.closest(spoilt(rng, names[i]) if i % 4 else names[i][::-1], 0.6)
        compared.append(n)
    assert np.mean(compared) < 60 and time.perf_counter() - start < 20


def test_column(spark):
    rows = spark.createDataFrame([(" Chenai",), ("mumbay",), (None,), ("",), ("zzzz",)], "v string")
    got = {r.v: r.m for r in rows.withColumn("m", closest(F.col("v"), ["chennai", "mumbai", "pune"])).collect()}
    assert got == {" Chenai": "chennai", "mumbay": "mumbai", None: None, "": None, "zzzz": None}
    assert rows.withColumn("m", closest(F.col("v"), [])).where("m IS NOT NULL").count() == 0
