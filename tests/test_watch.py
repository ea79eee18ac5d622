"""The stateful watch against the same checks on tables, over restarts, with late changes and several sources."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grainmill.operators import drift
from grainmill.streaming import watch

START = datetime(2024, 1, 1)
EVENTS = "ts timestamp, value double"


def days(first, count, rows=6, level=lambda d: 10.0):
    """Events of `count` days; a day's values lie around its level."""
    return [
        (START + timedelta(days=d, hours=3 * i), level(d) + (i % 3 - 1) * 0.5 + (d * 7 % 5) * 0.1)
        for d in range(first, first + count)
        for i in range(rows + (4 if d == 45 else 0))
    ]


def jump(d):
    return 30.0 if d in (20, 50) else 10.0


@pytest.fixture
def run(spark, tmp_path):
    base = spark.createDataFrame([("all", "row_count", 6.0), ("all", "value_mean", 10.0)], "source string, metric string, value double")

    def step(rows, number):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        events = watch.read_events(spark, f"{tmp_path}/events", EVENTS)
        snapshots = watch.day_snapshots(events, "ts", ["value"], "1 hour")
        watch.write_snapshots(snapshots, f"{tmp_path}/history", f"{tmp_path}/days").awaitTermination()
        stream = watch.read_snapshots(spark, f"{tmp_path}/history", ["value"])
        query = watch.write_checks(
            watch.checked_snapshots(stream, base, ["value"], lateness="1 hour"), f"{tmp_path}/checks", f"{tmp_path}/state"
        )
        query.awaitTermination()
        return query, spark.read.parquet(f"{tmp_path}/checks")

    return step


def expected(spark, rows):
    """The same alerts from a table of all days."""
    frame = spark.createDataFrame(rows, EVENTS)
    daily = drift.number_metrics(frame, F.to_timestamp(F.to_date("ts")), ["value"])
    counts = drift.row_count_changes(daily, F.lit(6.0)).select("snapshot", F.lit("row_count").alias("metric"), "severity")
    means = drift.mean_drift(daily.select("snapshot", "value_mean"), "value_mean", F.lit(10.0))
    both = counts.unionByName(means.select("snapshot", F.lit("value_mean").alias("metric"), "severity"))
    return {tuple(r) for r in both.collect()}


def alerts(checks):
    return {(r.snapshot, r.metric, r.severity) for r in watch.latest_alerts(checks).collect()}


def test_restarts_keep_the_state(spark, run):
    """Three runs from the same checkpoint equal one pass over all days, and a run reads its own days only."""
    rows, read = [], []
    for number, (first, count) in enumerate([(0, 30), (30, 25), (55, 3)]):
        more = days(first, count, level=jump)
        rows += more
        query, checks = run(more, number)
        read.append(sum(p.numInputRows for p in query.recentProgress))
        assert alerts(checks) == expected(spark, rows)
        assert query.exception() is None
    assert read[0] >= 30 > read[1] >= 25 and read[2] <= 4
    final = checks.where("closed").groupBy("snapshot", "metric").count()
    assert final.where("count > 1").count() == 0 and final.count() == 2 * 55
    state = spark.read.format("statestore").option("path", query_state(query)).option("stateVarName", "windows").load()
    assert state.count() <= drift.HISTORY + 3


def query_state(query):
    return query._jsq.streamingQuery().resolvedCheckpointRoot() if hasattr(query._jsq, "streamingQuery") else query._jsq.resolvedCheckpointRoot()


def test_a_day_that_changes_is_checked_anew(spark, run):
    """The open day alone is an alert; with the rest of its rows it is none, and the first alert is superseded."""
    first = days(0, 10) + days(10, 1, rows=2)
    _, checks = run(first, 0)
    assert alerts(checks) == expected(spark, first)
    assert {s.day for s, m, _ in alerts(checks) if m == "row_count"} == {11}
    rest = [(START + timedelta(days=10, hours=12 + i), 10.0) for i in range(4)]
    _, checks = run(rest, 1)
    assert alerts(checks) == expected(spark, first + rest)
    assert not {s for s, m, _ in alerts(checks) if m == "row_count"}


def test_sources_are_watched_apart(spark, tmp_path):
    rows = [(s, START + timedelta(days=d), 10 + 20 * (s == "b" and d == 5), float(s == "a") + d % 2, 0) for s in "ab" for d in range(8)]
    schema = "source string, snapshot timestamp, row_count bigint, value_mean double, batch bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    base = spark.createDataFrame([("a", "row_count", 10.0), ("b", "row_count", 10.0)], "source string, metric string, value double")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = watch.write_checks(watch.checked_snapshots(stream, base, ["value"]), f"{tmp_path}/checks", f"{tmp_path}/state")
    query.awaitTermination()
    found = watch.latest_alerts(spark.read.parquet(f"{tmp_path}/checks")).collect()
    assert {(r.source, r.metric, r.severity) for r in found if r.snapshot == START + timedelta(days=5)} == {("b", "row_count", "high")}
