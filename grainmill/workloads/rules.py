"""Domain rules on events, orders and order lines."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import rules
from grainmill.sources import files
from grainmill.workloads.loading import scratch
from grainmill.workloads.registry import Tables, fx, query

LIMIT_SQL = " OR ".join(f"(v >= {limit} * 0.95 AND v < {limit})" for limit in rules.LIMITS)


@query(
    "b01_just_under_limits",
    f"""SELECT COUNT(*) FILTER (WHERE {LIMIT_SQL}) AS affected_rows, {fx(f'COUNT(*) FILTER (WHERE {LIMIT_SQL}) * 100.0 / COUNT(*)', 5)} AS pct,
    MIN(v) FILTER (WHERE {LIMIT_SQL}) AS smallest, MAX(v) FILTER (WHERE {LIMIT_SQL}) AS largest FROM (SELECT o_totalprice AS v FROM orders)""",
)
def _(t):
    return rules.just_under_limits(t.orders, "o_totalprice").withColumn("pct", fixed(F.col("pct"), 5))


@query(
    "b02_night_accounts",
    """SELECT user_id, COUNT(*) FILTER (WHERE HOUR(ts) >= 23 OR HOUR(ts) < 4) AS night_rows, COUNT(*) AS rows FROM events GROUP BY 1
    HAVING COUNT(*) >= 5 AND COUNT(*) FILTER (WHERE HOUR(ts) >= 23 OR HOUR(ts) < 4) / COUNT(*) > 0.3""",
)
def _(t):
    return rules.night_accounts(t.events, "ts", "user_id")


WEEKS = """w AS (SELECT o_custkey AS account, {week} AS wk, COUNT(*) AS n FROM orders, UNNEST(RANGE(CASE WHEN o_orderkey % 97 = 0 THEN 6 ELSE 1 END)) u(i) GROUP BY 1, 2)"""


def bursts(t: Tables):
    copies = F.when(F.col("o_orderkey") % 97 == 0, 6).otherwise(1)
    return t.orders.withColumn("_c", F.explode(F.sequence(F.lit(1), copies)))


def _weeks(name: str, week: str, by_year: bool):
    @query(
        name,
        f"WITH {WEEKS.format(week=week)} SELECT account AS o_custkey, MAX(n) AS peak, {fx('AVG(n)', 6)} AS mean FROM w GROUP BY 1 HAVING MAX(n) > 3 * AVG(n)",
    )
    def _(t):
        rows = rules.busy_weeks(bursts(t), "o_orderdate", "o_custkey", by_year)
        return rows.withColumn("mean", fixed(F.col("mean"), 6))


_weeks("b03_busy_weeks", "ISOYEAR(o_orderdate) * 100 + WEEKOFYEAR(o_orderdate)", True)
_weeks("b03_busy_weeks_all_years", "WEEKOFYEAR(o_orderdate)", False)


@query(
    "b04_round_amounts",
    f"""WITH x AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN FLOOR(o_totalprice / 1000) * 1000 ELSE o_totalprice END AS v FROM orders),
    c AS (SELECT v, COUNT(*) AS n FROM x GROUP BY 1)
    SELECT CAST(SUM(n) FILTER (WHERE v % 100 = 0) AS BIGINT) AS affected_rows, CAST(SUM(n) AS BIGINT) AS rows,
    (SELECT v FROM c WHERE v % 100 = 0 ORDER BY n DESC, v LIMIT 1) AS most_frequent, {fx('SUM(n) FILTER (WHERE v % 100 = 0) / SUM(n)', 6)} AS share FROM c""",
)
def _(t):
    v = F.when(F.col("o_orderkey") % 5 == 0, (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("double")).otherwise(F.col("o_totalprice"))
    return rules.round_amounts(t.orders.select(v.alias("v")), "v").withColumn("share", fixed(F.col("share"), 6))


STOCK = """stock AS (SELECT l_partkey AS sku, CASE WHEN (l_orderkey + l_linenumber) % 8 = 0 THEN 0 ELSE l_quantity END AS qty, l_linenumber * 1.0 AS demand, l_shipdate AS day FROM lineitem)"""


def stock(t: Tables):
    out = (F.col("l_orderkey") + F.col("l_linenumber")) % 8 == 0
    return t.lineitem.select(
        F.col("l_partkey").alias("sku"),
        F.when(out, 0.0).otherwise(F.col("l_quantity")).alias("qty"),
        F.col("l_linenumber").cast("double").alias("demand"),
        F.col("l_shipdate").alias("day"),
    )


@query(
    "b05_stockouts",
    f"""WITH {STOCK} SELECT COUNT(*) FILTER (WHERE qty = 0) AS affected_rows, {fx('COUNT(*) FILTER (WHERE qty = 0) * 100.0 / COUNT(*)', 5)} AS pct,
    (SELECT sku FROM stock WHERE qty = 0 GROUP BY 1 ORDER BY COUNT(*) DESC, sku LIMIT 1) AS top_sku, {fx('SUM(demand) FILTER (WHERE qty = 0)', 1)} AS open_demand,
    CASE WHEN COUNT(*) FILTER (WHERE qty = 0) * 100.0 / COUNT(*) > 10 THEN 'high' ELSE 'medium' END AS severity FROM stock""",
)
def _(t):
    rows = rules.stockouts(stock(t), "qty", "sku", "demand")
    return rows.withColumns({"pct": fixed(F.col("pct"), 5), "open_demand": fixed(F.col("open_demand"), 1)})


@query(
    "b06_slow_and_fast_movers",
    f"""WITH {STOCK}, g AS (SELECT sku, SUM(qty) AS total FROM stock GROUP BY 1), q AS (SELECT QUANTILE_CONT(total, 0.25) AS a, QUANTILE_CONT(total, 0.75) AS b FROM g)
    SELECT sku, {fx('total', 1)} AS total, CASE WHEN total <= a THEN 'slow' ELSE 'fast' END AS speed FROM g, q WHERE total <= a OR total >= b""",
)
def _(t):
    return rules.movers(stock(t), "qty", "sku").withColumn("total", fixed(F.col("total"), 1))


@query(
    "b07_reorder_points",
    f"""WITH {STOCK}, s AS (SELECT FLOOR(EPOCH(MAX(day) - MIN(day)) / 86400) AS d FROM stock), g AS (SELECT sku, SUM(qty) / (SELECT d FROM s) AS r FROM stock GROUP BY 1)
    SELECT sku, {fx('r', 6)} AS daily_rate, {fx('r * 7', 6)} AS reorder_at FROM g ORDER BY r DESC, sku LIMIT 3""",
)
def _(t):
    rows = rules.reorder_points(stock(t), "qty", "sku", "day")
    return rows.withColumns({c: fixed(F.col(c), 6) for c in ("daily_rate", "reorder_at")})


SPEND = """spend AS (SELECT event_type AS channel, user_id, ts, value * CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 0.5 ELSE 1 END AS cost FROM events)"""


def spend(t: Tables):
    kind = F.col("event_type")
    factor = F.when(kind == "click", 4.0).when(kind == "view", 0.5).otherwise(1.0)
    return t.events.select(kind.alias("channel"), "user_id", "ts", (F.col("value") * factor).alias("cost"))


@query(
    "b08_acquisition_cost",
    f"""WITH {SPEND}, g AS (SELECT channel, SUM(cost) AS c, COUNT(DISTINCT user_id) AS n FROM spend GROUP BY 1), e AS (SELECT MAX(c / n) / MIN(c / n) AS ratio FROM g)
    SELECT channel, {fx('c', 2)} AS total_cost, n AS customers, {fx('c / n', 5)} AS cpa, {fx('ratio', 5)} AS ratio FROM g, e WHERE ratio >= 2""",
)
def _(t):
    rows = rules.acquisition_cost(spend(t), "channel", "cost", "user_id")
    return rows.withColumns({"total_cost": fixed(F.col("total_cost"), 2), "cpa": fixed(F.col("cpa"), 5), "ratio": fixed(F.col("ratio"), 5)})


REPEAT = "vis AS (SELECT o_orderpriority AS channel, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 > 0 THEN -o_orderkey ELSE o_custkey END AS who FROM orders)"


@query(
    "b09_repeat_rates",
    f"""WITH {REPEAT}, o AS (SELECT channel, who, COUNT(*) AS n FROM vis GROUP BY 1, 2), r AS (SELECT channel, COUNT(*) FILTER (WHERE n > 1) AS repeaters, COUNT(*) AS customers FROM o GROUP BY 1),
    p AS (SELECT *, repeaters * 100.0 / customers AS pct FROM r WHERE repeaters > 0)
    SELECT channel, repeaters, customers, {fx('pct', 5)} AS repeat_pct FROM p WHERE (SELECT MAX(pct) - MIN(pct) FROM p) >= 10""",
)
def _(t):
    once = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 3 > 0)
    who = F.when(once, -F.col("o_orderkey")).otherwise(F.col("o_custkey"))
    rows = rules.repeat_rates(t.orders.select(F.col("o_orderpriority").alias("channel"), who.alias("who")), "channel", "who")
    return rows.withColumn("repeat_pct", fixed(F.col("repeat_pct"), 5))


@query(
    "b10_seasonal_swing",
    f"""WITH x AS (SELECT MONTH(o_orderdate) AS m, SUM(o_totalprice * CASE WHEN MONTH(o_orderdate) = 12 THEN 2 ELSE 1 END) AS v FROM orders GROUP BY 1)
    SELECT CAST((SELECT m FROM x ORDER BY v DESC, m LIMIT 1) AS INTEGER) AS peak_month, CAST((SELECT m FROM x ORDER BY v, m LIMIT 1) AS INTEGER) AS low_month,
    {fx('MAX(v)', 1)} AS peak_value, {fx('MIN(v)', 1)} AS low_value, {fx('MAX(v) / MIN(v)', 5)} AS ratio FROM x HAVING MAX(v) / MIN(v) >= 1.5 AND COUNT(*) >= 3""",
)
def _(t):
    factor = F.when(F.month("o_orderdate") == 12, 2).otherwise(1)
    rows = rules.seasonal_swing(t.orders.withColumn("v", F.col("o_totalprice") * factor), "o_orderdate", "v")
    digits = {"peak_value": 1, "low_value": 1, "ratio": 5}
    return rows.withColumns({c: fixed(F.col(c), d) for c, d in digits.items()})


@query(
    "b11_busy_but_poor",
    f"""WITH g AS (SELECT event_type, COUNT(*) AS n, AVG(value) AS m FROM events GROUP BY 1), b AS (SELECT * FROM g WHERE n > (SELECT QUANTILE_CONT(n, 0.6) FROM g))
    SELECT event_type, n AS rows, {fx('m', 5)} AS mean_value FROM b WHERE m < (SELECT QUANTILE_CONT(m, 0.4) FROM b)""",
)
def _(t):
    return rules.busy_but_poor(t.events, "event_type", "value").withColumn("mean_value", fixed(F.col("mean_value"), 5))


@query(
    "b12_role_discovery",
    """SELECT 'amount' AS role, 'value' AS "column", COUNT(value) AS present FROM events UNION ALL SELECT 'account', 'event_id', COUNT(event_id) FROM events
    UNION ALL SELECT 'moment', 'event_time', COUNT(ts) FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "value", F.col("ts").alias("event_time"))
    roles = rules.find_roles(rows, "fraud")
    cells = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(f"n_{r}").alias("present")) for r, c in roles.items() if c]
    counts = rows.agg(*[F.count(c).alias(f"n_{r}") for r, c in roles.items() if c])
    return counts.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


@query(
    "b13_applicable_rules",
    """SELECT * FROM (SELECT rule, ok AS applicable, m AS missing, (SELECT COUNT(*) FROM lineitem) AS rows FROM (VALUES ('stockout_patterns', TRUE, ''),
    ('slow_fast_mover', FALSE, 'sku'), ('reorder_suggestion', FALSE, 'sku')) v(rule, ok, m))""",
)
def _(t):
    folder = scratch(t, "rules")
    files.write_csv(t.lineitem.select("l_quantity", "l_shipdate", "l_tax"), folder)
    rows = files.infer_types(files.read_csv(t.spark, folder))
    n = rows.agg(F.count(F.lit(1))).scalar()
    return rules.applicable(rows, "inventory").withColumn("rows", n)


@query("b01_b04_fraud_findings")
def _(t):
    roles = {"amount": "o_totalprice", "account": "o_custkey", "moment": "o_orderdate"}
    return rules.all_fraud_findings(t.orders, roles)
