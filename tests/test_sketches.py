"""Sketched quantiles within their bound, however they are merged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(int(d), float(v)) for d in range(12) for v in rng.lognormal(d / 4, 1, 4000)] + [(12, None), (12, float("nan"))]
    return spark.createDataFrame(data, "day int, v double").repartition(7)


def off(values, estimate, p):
    """Distance of the probability from the ranks that the estimate covers."""
    low, high = np.mean(values < estimate), np.mean(values <= estimate)
    return max(low - p, p - high, 0.0)


def test_ranks_are_within_the_bound(rows):
    frame = rows.toPandas()
    found = sketches.approximate_quantiles(rows, ["day"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("day")
    worst = max(off(frame.v[frame.day == d].to_numpy(), found.loc[d, name], p) for d in range(12) for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.99)))
    assert worst < 3 * sketches.rank_error() and sketches.rank_error() < 0.006
    assert found.loc[12, "n"] == 0 and found.loc[12, ["a", "b", "c"]].isna().all()
    coarse = sketches.approximate_quantiles(rows, [], "v", {"b": 0.5}, k=20).first()
    assert coarse["n"] == 48_000 and off(frame.v.dropna().to_numpy(), coarse["b"], 0.5) < 3 * sketches.rank_error(20)


def test_merged_and_rolling_sketches(rows):
    frame = rows.toPandas().dropna()
    days = sketches.value_sketches(rows, ["day"], ["v"])
    halves = sketches.merged(days.withColumn("half", F.col("day") < 6), ["half"], ["v"])
    for r in halves.select("half", sketches.count("v").alias("n"), sketches.estimate("v", 0.75).alias("q")).collect():
        values = frame.v[(frame.day < 6) == r.half].to_numpy()
        assert r.n == len(values) and off(values, r.q, 0.75) < 3 * sketches.rank_error()
    weeks = sketches.rolling(days.where("day < 12"), "day", ["v"], 3)
    for r in weeks.select("day", sketches.count("v").alias("n"), sketches.estimate("v", 0.5).alias("q")).collect():
        values = frame.v[(frame.day <= r.day) & (frame.day > r.day - 3)].to_numpy()
        assert r.n == len(values) and off(values, r.q, 0.5) < 3 * sketches.rank_error()
