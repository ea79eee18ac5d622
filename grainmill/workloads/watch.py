"""Drift watch on events by day, as tables and as a stream."""

from functools import reduce

from pyspark.sql import Window, functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import drift, sketches
from grainmill.operators.explore import missing_per_column
from grainmill.streaming import watch
from grainmill.workloads.loading import scratch
from grainmill.workloads.registry import SCHEMAS, Tables, fx, query

# Values tripled on the last two days; one new event type on the last day.
DRIFT = """lim AS (SELECT MAX(CAST(ts AS DATE)) AS d FROM events),
ev AS (SELECT CAST(ts AS DATE) AS day, ts, value * CASE WHEN CAST(ts AS DATE) >= d - 1 THEN 3 ELSE 1 END AS value, user_id,
  CASE WHEN CAST(ts AS DATE) = d AND event_type = 'error' THEN 'crash' ELSE event_type END AS event_type FROM events, lim),
days AS (SELECT day, COUNT(*) AS n, AVG(value) AS m, STDDEV_SAMP(value) AS s, MIN(value) AS lo, MAX(value) AS hi FROM ev GROUP BY 1)"""


def drifted(t: Tables):
    last = t.events.agg(F.max(F.to_date("ts"))).scalar()
    day = F.to_date("ts")
    return t.events.select(
        day.alias("day"),
        "ts",
        "user_id",
        (F.col("value") * F.when(day >= F.date_sub(last, 1), 3).otherwise(1)).alias("value"),
        F.when((day == last) & (F.col("event_type") == "error"), "crash").otherwise(F.col("event_type")).alias("event_type"),
    )


def daily(t: Tables):
    return drift.number_metrics(drifted(t), F.col("day"), ["value"])


def snapshot(rows, *columns):
    return rows.select(F.col("snapshot").cast("string").alias("snapshot"), *columns)


@query(
    "z01_day_metrics",
    f"""WITH {DRIFT} SELECT CAST(day AS VARCHAR) AS snapshot, n AS row_count, {fx('m', 5)} AS value_mean, {fx('COALESCE(s, 0)', 5)} AS value_std,
    {fx('lo', 4)} AS value_min, {fx('hi', 4)} AS value_max FROM days""",
)
def _(t):
    digits = {"value_mean": 5, "value_std": 5, "value_min": 4, "value_max": 4}
    return snapshot(daily(t), "row_count", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "z01_category_shares",
    f"""WITH {DRIFT}, c AS (SELECT day, event_type AS value, COUNT(*) AS n FROM ev GROUP BY 1, 2)
    SELECT CAST(day AS VARCHAR) AS snapshot, value, {fx('n / SUM(n) OVER (PARTITION BY day)', 6)} AS share FROM c""",
)
def _(t):
    rows = drift.category_shares(drifted(t), F.col("day"), "event_type")
    return snapshot(rows, "value", fixed(F.col("share"), 6).alias("share"))


@query(
    "z01_streamed_day_metrics",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot, COUNT(*) AS row_count, {fx('AVG(value)', 5)} AS value_mean FROM events GROUP BY 1""",
)
def _(t):
    folder = scratch(t, "stream")
    events = watch.read_events(t.spark, t.folder, SCHEMAS["events"], "events.parquet")
    snapshots = watch.day_snapshots(events, "ts", ["value"], lateness="1 hour")
    watch.write_snapshots(snapshots, f"{folder}/history", f"{folder}/checkpoint").awaitTermination()
    rows = watch.latest_snapshots(t.spark, f"{folder}/history")
    day = F.to_date("snapshot").cast("string").alias("snapshot")
    return rows.select(day, "row_count", fixed(F.col("value_mean"), 5).alias("value_mean"))


PROBABILITIES = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def ranks_hold(estimates, values, on):
    """Whether every estimate's exact rank among the values is as near to its probability as the sketch promises."""
    slack = 3 * sketches.rank_error()  # three times the bound of 99 cases in 100
    rows = estimates.join(values, on)
    tests = [
        (F.avg((F.col("v") < F.col(name)).cast("double")) <= p + slack) & (F.avg((F.col("v") <= F.col(name)).cast("double")) >= p - slack)
        for name, p in PROBABILITIES.items()
    ]
    return rows.groupBy(*on, "n").agg(reduce(lambda a, b: a & b, tests).alias("within"))


@query(
    "z01_sketched_days",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot, COUNT(value) AS n, COUNT(value) > 0 AS within FROM events GROUP BY 1",
)
def _(t):
    """Approximate quantiles of every day from one pass, held against the exact ranks."""
    rows = t.events.select(F.to_date("ts").cast("string").alias("snapshot"), F.col("value").alias("v"))
    return ranks_hold(sketches.approximate_quantiles(rows, ["snapshot"], "v", PROBABILITIES), rows, ["snapshot"])


@query(
    "k05_sketched_weeks",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(value) AS n FROM events GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS snapshot, CAST(SUM(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS n, n > 0 AS within FROM d""",
)
def _(t):
    """Sketches stored per day; each seven days' quantiles are merged from them without reading events again."""
    folder, day = scratch(t, "sketches"), F.to_date("ts")
    sketches.value_sketches(t.events.withColumn("day", day), ["day"], ["value"]).write.parquet(folder)
    weeks = sketches.rolling(t.spark.read.parquet(folder), "day", ["value"], 7)
    found = weeks.select(F.col("day").cast("string").alias("snapshot"), sketches.count("value").alias("n"), *[sketches.estimate("value", p).alias(n) for n, p in PROBABILITIES.items()])
    days = t.events.select(day.alias("day")).distinct()
    place = days.select("day", F.row_number().over(Window.orderBy("day")).alias("at"))  # one row per day
    spread = place.select(F.col("day").alias("_day"), F.explode(F.sequence("at", F.col("at") + 6)).alias("at")).join(place, "at")
    values = t.events.join(spread, day == F.col("_day")).select(F.col("day").cast("string").alias("snapshot"), F.col("value").alias("v"))
    return ranks_hold(found, values, ["snapshot"])


@query(
    "z02_baseline_store",
    f"""WITH {DRIFT}, f AS (SELECT * FROM days ORDER BY day LIMIT 1)
    SELECT 'row_count' AS metric, n * 1.0::DOUBLE AS value FROM f UNION ALL SELECT 'value_mean', {fx('m', 5)} FROM f""",
)
def _(t):
    path = scratch(t, "baseline")
    metrics = daily(t).select("snapshot", "row_count", "value_mean")
    first = metrics.agg(F.min("snapshot")).scalar()
    watch.save_baseline(metrics.where(F.col("snapshot") > first).limit(1), path, "events")
    watch.save_baseline(metrics.where(F.col("snapshot") == first), path, "events")  # rebaseline
    rows = watch.load_baseline(t.spark, path, "events")
    return rows.withColumn("value", fixed(F.col("value"), 5))


@query(
    "z03_row_count_changes",
    f"""WITH {DRIFT}, b AS (SELECT AVG(n) * 0.8 AS b FROM days), c AS (SELECT day, n, b, ABS(n - b) / b * 100 AS p FROM days, b)
    SELECT CAST(day AS VARCHAR) AS snapshot, n AS row_count, {fx('p', 5)} AS change_pct, CASE WHEN p > 50 THEN 'high' ELSE 'medium' END AS severity FROM c WHERE p > 20""",
)
def _(t):
    metrics = daily(t)
    base = metrics.agg(F.avg("row_count") * 0.8).scalar()
    return snapshot(drift.row_count_changes(metrics, base), "row_count", fixed(F.col("change_pct"), 5).alias("change_pct"), "severity")


def _drift_sql(frame: str) -> str:
    w = f"OVER (ORDER BY day ROWS BETWEEN {frame})"
    return f"""WITH {DRIFT}, h AS (SELECT day, m, COUNT(m) {w} AS k, AVG(m) {w} AS e, STDDEV_SAMP(m) {w} AS sd, FIRST_VALUE(m) OVER (ORDER BY day) AS b FROM days),
    z AS (SELECT *, ABS(m - e) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS z, ABS(m - b) / ABS(b) * 100 AS p FROM h)
    SELECT CAST(day AS VARCHAR) AS snapshot, {fx('m', 5)} AS value_mean, {fx('e', 5)} AS expected, {fx('CASE WHEN k >= 2 THEN z END', 4)} AS z, k AS points,
    CASE WHEN k >= 2 AND z > 3 THEN 'high' ELSE 'medium' END AS severity FROM z WHERE (k >= 2 AND z > 2) OR (k < 2 AND p > 20)"""


def _drift(name: str, frame: str, include: bool):
    @query(name, _drift_sql(frame))
    def _(t):
        rows = drift.mean_drift(daily(t).select("snapshot", "value_mean"), "value_mean", include_current=include)
        digits = {"value_mean": 5, "expected": 5, "z": 4}
        return snapshot(rows, *[fixed(F.col(c), d).alias(c) for c, d in digits.items()], "points", "severity")


_drift("z04_mean_drift", "30 PRECEDING AND 1 PRECEDING", False)
_drift("w11_z_score_with_current", "29 PRECEDING AND CURRENT ROW", True)


@query("z05_missing_columns", "SELECT 'value_mean' AS metric FROM events HAVING COUNT(value) > 0")
def _(t):
    base = drift.metric_names(daily(t).select("snapshot", "row_count", "value_mean"))
    gone = drifted(t).withColumn("value", F.lit(None).cast("double"))
    now = drift.metric_names(drift.number_metrics(gone, F.col("day"), ["value"]).select("snapshot", "row_count", "value_mean"))
    return drift.missing_columns(now, base)


@query("z06_new_values", f"WITH {DRIFT} SELECT DISTINCT event_type AS value FROM ev, lim WHERE day = d AND event_type NOT IN (SELECT event_type FROM ev, lim WHERE day < d)")
def _(t):
    rows = drifted(t)
    last = t.events.agg(F.max(F.to_date("ts"))).scalar()
    return drift.new_values(rows.where(F.col("day") == last), rows.where(F.col("day") < last), "event_type")


@query(
    "z07_null_regressions",
    """SELECT 'value' AS "column", COUNT(*) FILTER (WHERE event_id % 9 = 0) AS missing, CAST(0 AS BIGINT) AS expected FROM events HAVING COUNT(*) FILTER (WHERE event_id % 9 = 0) > 0""",
)
def _(t):
    holes = t.events.withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return drift.null_regressions(missing_per_column(holes), missing_per_column(t.events))


@query(
    "z08_streamed_watch",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, AVG(value) AS m FROM events GROUP BY 1),
    b AS (SELECT n AS bn, m AS bm FROM d ORDER BY day LIMIT 1),
    h AS (SELECT day, n, m, COUNT(m) OVER w AS k, AVG(m) OVER w AS e, STDDEV_SAMP(m) OVER w AS sd FROM d
        WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, ABS(m - e) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS z, ABS(m - bm) / ABS(bm) * 100 AS p FROM h, b)
    SELECT COUNT(*) AS days, COUNT(*) FILTER (WHERE ABS(n - bn) * 100.0 / bn > 20)
        + COUNT(*) FILTER (WHERE (k >= 2 AND z > 2) OR (k < 2 AND p > 20)) AS alerts FROM z""",
)
def _(t):
    folder = scratch(t, "watch")
    metrics = drift.number_metrics(t.events, F.to_date("ts"), ["value"])
    first = metrics.agg(F.min("snapshot")).scalar()
    watch.save_baseline(metrics.where(F.col("snapshot") == first), f"{folder}/baseline", "events")
    baseline = t.spark.read.parquet(f"{folder}/baseline")
    events = watch.read_events(t.spark, t.folder, SCHEMAS["events"], "events.parquet")
    days = watch.day_snapshots(events, "ts", ["value"], "1 hour")
    watch.write_snapshots(days, f"{folder}/history", f"{folder}/days").awaitTermination()
    snapshots = watch.read_snapshots(t.spark, f"{folder}/history", ["value"]).withColumn("source", F.lit("events"))
    checks = watch.checked_snapshots(snapshots, baseline, ["value"], lateness="1 hour")
    watch.write_checks(checks, f"{folder}/checks", f"{folder}/state").awaitTermination()
    history = watch.latest_snapshots(t.spark, f"{folder}/history").agg(F.count(F.lit(1))).scalar()
    return watch.latest_alerts(t.spark.read.parquet(f"{folder}/checks")).agg(history.alias("days"), F.count(F.lit(1)).alias("alerts"))
