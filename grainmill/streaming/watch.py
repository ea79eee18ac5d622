"""Drift watch as a stream.

Events become one metric row per event-time day (tumbling window with a watermark, so state stays bounded by the
lateness allowed). Every batch's new or changed days go to a history table, in a folder named by its number, so a
repeated batch overwrites itself. A second stream reads the history as it grows and checks the days against the
baseline and the 30 days before, which it holds as state with timers that close a day (`Checks`).
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from grainmill.operators.drift import HISTORY, ROW_CHANGE_HIGH_PCT, ROW_CHANGE_PCT, STEADY_STD, Z_ALERT, Z_HIGH
from grainmill.operators.explore import melt_row

# Watch intervals by name.
INTERVALS = {"5m": "5 minutes", "30m": "30 minutes", "hourly": "1 hour", "daily": "1 day"}


def interval_trigger(interval: str | None) -> dict:
    """Trigger arguments: a named interval, or one run over what is available."""
    return {"availableNow": True} if interval is None else {"processingTime": INTERVALS[interval]}


def read_events(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def day_snapshots(
    events: DataFrame, moment: str, numbers: Sequence[str], lateness: str = "1 day", length: str = "1 day"
) -> DataFrame:
    """Row count and number statistics per event-time window; works on streams and on tables."""
    timed = events.withColumn("_ts", F.col(moment).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", lateness)
    metrics = timed.groupBy(F.window("_ts", length)).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in numbers],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in numbers],
        *[F.min(F.col(c).cast("double")).alias(f"{c}_min") for c in numbers],
        *[F.max(F.col(c).cast("double")).alias(f"{c}_max") for c in numbers],
    )
    names = [c for c in metrics.columns if c != "window"]
    return metrics.select(F.col("window.start").alias("snapshot"), *names)


def write_snapshots(snapshots: DataFrame, history: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write every batch's new or changed windows, the open one too, to a folder of its own; see `latest_snapshots`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return (
        snapshots.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**interval_trigger(interval))
        .start()
    )


def latest_snapshots(spark: SparkSession, history: str) -> DataFrame:
    """Each window as its last batch left it, with that batch's number."""
    rows = spark.read.parquet(history)
    others = [c for c in rows.columns if c not in ("snapshot", "batch")]
    last = rows.groupBy("snapshot").agg(F.max_by(F.struct("batch", *others), "batch").alias("r"))
    return last.select("snapshot", "r.batch", *[f"r.{c}" for c in others])


def save_baseline(metrics: DataFrame, path: str, source: str) -> None:
    """Store one snapshot's metrics as the baseline of a source; storing again rebaselines it."""
    names = [c for c in metrics.columns if c != "snapshot"]
    wide = metrics.select(*[F.col(c).cast("double").alias(c) for c in names])
    rows = melt_row(wide, {c: {"value": c} for c in names}, "metric").withColumn("source", F.lit(source))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def load_baseline(spark: SparkSession, path: str, source: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("source") == source).select("metric", "value")


def read_snapshots(spark: SparkSession, history: str, numbers: Sequence[str]) -> DataFrame:
    """The written snapshots as a stream; a batch's file is read once."""
    kinds = [f"{c}_{kind} double" for kind in ("mean", "std", "min", "max") for c in numbers]
    return spark.readStream.schema(", ".join(["snapshot timestamp", "row_count bigint", *kinds, "batch bigint"])).parquet(history)


CHECKED = (
    "source string, snapshot timestamp, metric string, value double, expected double, points int, z double, "
    "severity string, batch bigint, closed boolean"
)


CHECK = Row(*[field.split()[0] for field in CHECKED.split(", ")])


class Checks(StatefulProcessor):
    """Checks of one source's windows against its baseline and its last `HISTORY` windows, held as state.

    A window is open until the watermark passes its end. Whenever a batch changes it, it is checked anew; a timer
    closes it, checks it a last time and lets go of closed windows that no open one looks back to. So a batch costs as
    much as the windows that it changes, however long the history is.
    """

    def __init__(self, numbers: Sequence[str], length: int):
        self.numbers, self.length = list(numbers), length

    def init(self, handle) -> None:
        self.handle = handle
        state = "batch bigint, closed boolean, row_count bigint, means array<double>, rows_before double, means_before array<double>"
        self.known = handle.getMapState("windows", "start bigint", state)

    def _windows(self) -> dict[int, tuple]:
        return {key[0]: tuple(value) for key, value in self.known.iterator()}

    def _checks(self, source: str, start: int, windows: dict[int, tuple]):
        batch, closed, rows, means, rows_before, means_before = windows[start]
        head = (source, datetime.fromtimestamp(start / 1e6, timezone.utc))
        severity = None
        if rows_before and rows_before > 0:
            change = abs(rows - rows_before) / rows_before * 100
            if change > ROW_CHANGE_PCT:
                severity = "high" if change > ROW_CHANGE_HIGH_PCT else "medium"
        yield CHECK(*head, "row_count", float(rows), rows_before, None, None, severity, batch, closed)
        earlier = sorted(s for s in windows if s < start)[-HISTORY:]
        for i, name in enumerate(self.numbers):
            value, before = means[i], means_before[i]
            past = [windows[s][3][i] for s in earlier if windows[s][3][i] is not None]
            expected = sum(past) / len(past) if past else None
            z = severity = None
            if value is not None and len(past) >= 2:
                spread = (sum((p - expected) ** 2 for p in past) / (len(past) - 1)) ** 0.5
                z = abs(value - expected) / (spread or STEADY_STD)
                severity = "high" if z > Z_HIGH else "medium" if z > Z_ALERT else None
            elif value is not None and before is not None:
                moved = abs(value - before) / abs(before) * 100 if before else float("inf") if value else 0.0
                severity = "medium" if moved > ROW_CHANGE_PCT else None
            yield CHECK(*head, f"{name}_mean", value, expected, len(past), z, severity, batch, closed)

    def handleInputRows(self, key, rows, timerValues):
        windows, changed = self._windows(), set()
        for r in sorted(rows, key=lambda r: r.batch):
            start = round(r.snapshot.timestamp() * 1e6)
            if start in windows and (windows[start][1] or windows[start][0] > r.batch):
                continue  # closed, or a batch's file read again
            if start not in windows:
                self.handle.registerTimer(start // 1000 + self.length)
            values = (r.batch, False, r.row_count, [r[f"{n}_mean"] for n in self.numbers], r.rows_before, list(r.means_before))
            windows[start] = values
            changed.add(start)
        for start in changed:
            self.known.updateValue((start,), windows[start])
        for start in sorted(changed):
            yield from self._checks(key[0], start, windows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        windows, now = self._windows(), timerValues.getCurrentWatermarkInMs()
        done = [s for s, w in sorted(windows.items()) if not w[1] and s // 1000 + self.length <= now]
        for start in done:
            windows[start] = (windows[start][0], True, *windows[start][2:])
            self.known.updateValue((start,), windows[start])
            yield from self._checks(key[0], start, windows)
        oldest = min((s for s, w in windows.items() if not w[1]), default=None)
        closed = sorted(s for s, w in windows.items() if w[1] and (oldest is None or s < oldest))
        for start in closed[:-HISTORY]:
            self.known.removeKey((start,))

    def close(self) -> None:
        pass


def checked_snapshots(
    snapshots: DataFrame, baseline: DataFrame, numbers: Sequence[str], length: str = "1 day", lateness: str = "1 day", source: str = "source"
) -> DataFrame:
    """A stream of checks, columns `CHECKED`, from a stream of snapshots: source, snapshot, row_count, means, batch.

    `baseline` is a table (source, metric, value). A check without alert has a null severity, so that it supersedes an
    alert of an earlier batch. Snapshots without `source` belong to the source "all".
    """
    if source not in snapshots.columns:
        snapshots = snapshots.withColumn(source, F.lit("all"))
    wanted = F.array(*[F.col("m")[f"{n}_mean"] for n in numbers])
    wide = baseline.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    wide = wide.select(F.col("source").alias(source), F.col("m")["row_count"].alias("rows_before"), wanted.alias("means_before"))
    none = F.array(*[F.lit(None).cast("double") for _ in numbers])
    rows = (
        snapshots.withWatermark("snapshot", f"{_seconds(length) + _seconds(lateness)} seconds")
        .join(F.broadcast(wide), source, "left")  # one row per source
        .withColumn("means_before", F.coalesce("means_before", none))
    )
    keep = [source, "snapshot", "row_count", *[f"{n}_mean" for n in numbers], "batch", "rows_before", "means_before"]
    return rows.select(*keep).groupBy(source).transformWithState(
        Checks(numbers, _seconds(length) * 1000), CHECKED, "Append", "EventTime"
    )


def _seconds(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Stateful processors keep their state in RocksDB; a query takes the setting when it starts."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def write_checks(checks: DataFrame, folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the checks of every batch to `folder`; see `latest_alerts`."""
    with rocksdb_state(checks.sparkSession):
        return (
            checks.writeStream.outputMode("append")
            .format("parquet")
            .option("path", folder)
            .option("checkpointLocation", checkpoint)
            .trigger(**interval_trigger(interval))
            .start()
        )


def latest_alerts(checks: DataFrame) -> DataFrame:
    """Alerts of every window's last check."""
    rest = [c for c in checks.columns if c not in ("source", "snapshot", "metric")]
    last = checks.groupBy("source", "snapshot", "metric").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("closed").cast("int"), "batch")).alias("c")
    )
    return last.where("c.severity IS NOT NULL").select("source", "snapshot", "metric", *[f"c.{c}" for c in rest])
