"""Fund and investor measures. Daily order totals per priority stand in for fund values, all orders for the index."""

from pyspark.sql import functions as F

from grainmill.operators import funds as fa
from grainmill.operators.quantiles import aggregate_with_quantiles
from grainmill.functions.distributions import t_two_sided
from grainmill.functions.numbers import fixed
from grainmill.operators.series import daily, period_return
from grainmill.workloads.registry import Tables, fx, query


def nav(t: Tables):
    return daily(t.orders, [F.col("o_orderpriority").alias("fund")], F.col("o_orderdate"), F.sum("o_totalprice"))


def indices(t: Tables):
    both = F.array(F.lit("ALL"), F.when(F.col("o_orderstatus") == "O", F.lit("OPEN")))
    rows = t.orders.withColumn("index", F.explode(F.array_compact(both)))
    return daily(rows, [F.col("index")], F.col("o_orderdate"), F.sum("o_totalprice"))


def index_returns(t: Tables):
    whole = daily(t.orders, [F.lit("ALL").alias("index")], F.col("o_orderdate"), F.sum("o_totalprice"))
    return period_return(whole, ["index"], "value", "index_ret").select("date", "index_ret")


NAV = """nav AS (SELECT o_orderpriority AS fund, CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""
RETS = NAV + """, r0 AS (SELECT *, value / LAG(value) OVER (PARTITION BY fund ORDER BY date) - 1 AS ret FROM nav),
rets AS (SELECT * FROM r0 WHERE ret IS NOT NULL)"""
IDX = """idx AS (SELECT date, value / LAG(value) OVER (ORDER BY date) - 1 AS index_ret FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS value FROM orders GROUP BY 1))"""
SHARPE = """sh AS (SELECT fund, AVG(ret) * 252 AS ann_return, STDDEV_SAMP(ret) * SQRT(252) AS ann_vol
  FROM rets GROUP BY fund HAVING COUNT(ret) >= 252)"""
CAGR = """ends AS (SELECT fund, MAX(date) AS e FROM rets GROUP BY fund),
cg AS (SELECT r.fund,
  ARG_MAX(r.value, r.date) AS v,
  ARG_MAX(r.value, r.date) FILTER (WHERE r.date <= e.e - INTERVAL 1 YEAR) AS s1,
  ARG_MAX(r.value, r.date) FILTER (WHERE r.date <= e.e - INTERVAL 3 YEAR) AS s3,
  ARG_MAX(r.value, r.date) FILTER (WHERE r.date <= e.e - INTERVAL 5 YEAR) AS s5
  FROM rets r JOIN ends e ON r.fund = e.fund GROUP BY r.fund)"""
DRAW = """dd0 AS (SELECT *, MAX(value) OVER (PARTITION BY fund ORDER BY date) AS peak FROM rets),
dd1 AS (SELECT *, value / peak - 1 AS dd FROM dd0),
trough AS (SELECT fund, MIN(dd) AS max_dd FROM dd1 GROUP BY fund),
tr AS (SELECT d.fund, t.max_dd, MIN(d.date) AS trough_date, ARG_MIN(d.peak, d.date) AS peak
  FROM dd1 d JOIN trough t ON d.fund = t.fund AND d.dd = t.max_dd GROUP BY d.fund, t.max_dd),
dds AS (SELECT tr.fund, tr.max_dd, tr.trough_date,
  MAX(d.date) FILTER (WHERE d.date <= tr.trough_date AND d.value = tr.peak) AS peak_date,
  MIN(d.date) FILTER (WHERE d.date > tr.trough_date AND d.value >= tr.peak) AS recovery_date
  FROM tr JOIN dd1 d ON d.fund = tr.fund GROUP BY 1, 2, 3)"""


def rets(t: Tables):
    return fa.with_returns(nav(t), "fund")


def text_date(name: str):
    return F.col(name).cast("string").alias(name)


@query(
    "w01_period_return",
    f"WITH {RETS} SELECT fund, CAST(date AS VARCHAR) AS date, {fx('ret', 6)} AS ret FROM rets",
)
def _(t):
    return rets(t).select("fund", text_date("date"), fixed(F.col("ret"), 6).alias("ret"))


@query(
    "fa01_return_statistics",
    f"""WITH {RETS} SELECT fund, {fx('AVG(ret)', 6)} AS mean, {fx('STDDEV_SAMP(ret)', 6)} AS std,
    {fx('MIN(ret)', 6)} AS min, {fx('MAX(ret)', 6)} AS max, COUNT(ret) AS count,
    {fx('QUANTILE_CONT(ret, 0.5)', 6)} AS median FROM rets GROUP BY fund""",
)
def _(t):
    rows = fa.return_statistics(rets(t), "fund")
    return rows.select(
        "fund", "count", *[fixed(F.col(c), 6).alias(c) for c in ("mean", "std", "min", "max", "median")]
    )


@query(
    "fa02_cagr_ranked",
    f"""WITH {RETS}, {CAGR}, g AS (SELECT fund, v / s1 - 1 AS c1, POW(v / s3, 1.0 / 3) - 1 AS c3,
    POW(v / s5, 1.0 / 5) - 1 AS c5 FROM cg)
    SELECT fund, {fx('c1', 6)} AS cagr_1y, {fx('c3', 6)} AS cagr_3y, {fx('c5', 6)} AS cagr_5y,
    CASE WHEN c3 IS NOT NULL THEN RANK() OVER (ORDER BY c3 DESC NULLS LAST)
      + (COUNT(*) OVER (PARTITION BY c3) - 1) / 2.0 END AS cagr_3y_rank FROM g""",
)
def _(t):
    rows = fa.add_average_rank(fa.cagr(rets(t), "fund"), "cagr_3y", "cagr_3y_rank", descending=True)
    return rows.select(
        "fund", *[fixed(F.col(c), 6).alias(c) for c in ("cagr_1y", "cagr_3y", "cagr_5y")], "cagr_3y_rank"
    )


@query(
    "fa03_sharpe",
    f"""WITH {RETS}, {SHARPE} SELECT fund, {fx('ann_return', 6)} AS ann_return, {fx('ann_vol', 6)} AS ann_vol,
    {fx('CASE WHEN ann_vol > 0 THEN (ann_return - 0.065) / ann_vol END', 6)} AS sharpe FROM sh""",
)
def _(t):
    rows = fa.sharpe(rets(t), "fund")
    return rows.select("fund", *[fixed(F.col(c), 6).alias(c) for c in ("ann_return", "ann_vol", "sharpe")])


@query(
    "fa04_sortino",
    f"""WITH {RETS}, s AS (SELECT fund, AVG(ret) * 252 AS a,
    SQRT(AVG(ret * ret) FILTER (WHERE ret < 0)) * SQRT(252) AS d FROM rets GROUP BY fund HAVING COUNT(ret) >= 252)
    SELECT fund, {fx('a', 6)} AS ann_return, {fx('CASE WHEN d > 0 THEN (a - 0.065) / d END', 6)} AS sortino FROM s""",
)
def _(t):
    rows = fa.sortino(rets(t), "fund")
    return rows.select("fund", *[fixed(F.col(c), 6).alias(c) for c in ("ann_return", "sortino")])


@query(
    "fa05_alpha_beta",
    f"""WITH {RETS}, {IDX}, j AS (SELECT r.fund, r.ret AS y, i.index_ret AS x FROM rets r JOIN idx i ON r.date = i.date
      WHERE i.index_ret IS NOT NULL),
    m AS (SELECT fund, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_R2(y, x) AS r2, REGR_SXX(y, x) AS sxx,
      REGR_SYY(y, x) AS syy, COUNT(*) AS n FROM j GROUP BY fund HAVING COUNT(*) >= 30)
    SELECT fund, {fx('a * 252', 5)} AS alpha, {fx('b', 6)} AS beta, {fx('r2', 6)} AS r_squared,
    {fx('SQRT((1 - r2) * syy / sxx / (n - 2))', 6)} AS std_error, n FROM m""",
)
def _(t):
    rows = fa.alpha_beta(rets(t), index_returns(t), "fund")
    return rows.select(
        "fund",
        fixed(F.col("alpha"), 5).alias("alpha"),
        *[fixed(F.col(c), 6).alias(c) for c in ("beta", "r_squared", "std_error")],
        "n",
    )


@query(
    "u02_alpha_beta_p_value",
    # P(|T| <= t) is an integral of a power of the cosine up to atan(t / sqrt(df)), here by Simpson's rule.
    f"""WITH {RETS}, {IDX}, j AS (SELECT r.fund, r.ret AS y, i.index_ret AS x FROM rets r JOIN idx i ON r.date = i.date
      WHERE i.index_ret IS NOT NULL),
    m AS (SELECT fund, REGR_SLOPE(y, x) AS b, REGR_R2(y, x) AS r2, REGR_SXX(y, x) AS sxx, REGR_SYY(y, x) AS syy, COUNT(*) AS n
      FROM j GROUP BY fund HAVING COUNT(*) >= 30),
    t AS (SELECT fund, b, b / SQRT((1 - r2) * syy / sxx / (n - 2)) AS t, n - 2 AS df FROM m),
    s AS (SELECT fund, ATAN(ABS(t) / SQRT(df)) / 2000 AS h, SUM(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * POW(COS(i * ATAN(ABS(t) / SQRT(df)) / 2000), df - 1)) AS w FROM t, UNNEST(RANGE(2001)) u(i) GROUP BY ALL)
    SELECT fund, {fx('b', 6)} AS beta, {fx('t', 4)} AS t_value,
    {fx('1 - 2 * EXP(LGAMMA((df + 1) / 2) - LGAMMA(df / 2)) / SQRT(PI()) * w * h / 3', 6)} AS p_value FROM t JOIN s USING (fund)""",
)
def _(t):
    rows = fa.alpha_beta(rets(t), index_returns(t), "fund")
    p = t_two_sided(F.col("t_value"), (F.col("n") - 2).cast("double"))
    digits = {"beta": F.col("beta"), "t_value": F.col("t_value"), "p_value": p}
    return rows.select("fund", *[fixed(c, 4 if name == "t_value" else 6).alias(name) for name, c in digits.items()])


@query(
    "fa06_max_drawdown",
    f"""WITH {RETS}, {DRAW} SELECT fund, {fx('max_dd', 6)} AS max_drawdown,
    CAST(peak_date AS VARCHAR) AS peak_date, CAST(trough_date AS VARCHAR) AS trough_date,
    CAST(recovery_date AS VARCHAR) AS recovery_date,
    CAST(DATEDIFF('day', peak_date, trough_date) AS INTEGER) AS period_days FROM dds""",
)
def _(t):
    rows = fa.drawdown(rets(t), "fund")
    return rows.select(
        "fund",
        fixed(F.col("max_drawdown"), 6).alias("max_drawdown"),
        *[text_date(c) for c in ("peak_date", "trough_date", "recovery_date")],
        "period_days",
    )


EXPENSE = "ex AS (SELECT o_orderpriority AS fund, AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS e FROM orders GROUP BY 1)"


def measures(t: Tables):
    """The five scorecard measures per fund; the share of finished orders stands in for the expense ratio."""
    finished = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    expense = t.orders.groupBy(F.col("o_orderpriority").alias("fund")).agg(F.avg(finished).alias("expense"))
    return fa.measures(rets(t), index_returns(t), "fund").join(expense, "fund", "left")


def scorecard(t: Tables):
    rows = fa.scorecard(measures(t), "fund")
    scores = [f"{name}_score" for name in fa.SCORE_WEIGHTS] + ["final_score"]
    return rows.select("fund", *[fixed(F.col(c), 4).alias(c) for c in scores], "overall_rank")


def _pct(column: str, descending: bool = False) -> str:
    way = "DESC" if descending else "ASC"
    return f"(RANK() OVER (ORDER BY {column} {way}) + (COUNT(*) OVER (PARTITION BY {column}) - 1) / 2.0) / COUNT(*) OVER ()"


MEASURES = f"""{RETS}, {IDX}, {SHARPE}, {CAGR}, {DRAW}, {EXPENSE},
ab AS (SELECT r.fund, REGR_INTERCEPT(r.ret, i.index_ret) * 252 AS alpha FROM rets r JOIN idx i ON r.date = i.date
  WHERE i.index_ret IS NOT NULL GROUP BY r.fund HAVING COUNT(*) >= 30),
ms AS (SELECT cg.fund, POW(cg.v / cg.s3, 1.0 / 3) - 1 AS cagr,
  CASE WHEN sh.ann_vol > 0 THEN (sh.ann_return - 0.065) / sh.ann_vol END AS sharpe, ab.alpha, ex.e AS expense,
  dds.max_dd AS drawdown
  FROM cg LEFT JOIN sh ON cg.fund = sh.fund LEFT JOIN ab ON cg.fund = ab.fund LEFT JOIN ex ON cg.fund = ex.fund
  LEFT JOIN dds ON cg.fund = dds.fund),
ok AS (SELECT * FROM ms WHERE cagr IS NOT NULL AND sharpe IS NOT NULL AND alpha IS NOT NULL AND expense IS NOT NULL
  AND drawdown IS NOT NULL),
pc AS (SELECT fund, {_pct('cagr')} AS c, {_pct('sharpe')} AS s, {_pct('alpha')} AS a, {_pct('expense', True)} AS e,
  {_pct('drawdown')} AS d FROM ok),
sc AS (SELECT *, ROUND((0.30 * c + 0.25 * s + 0.20 * a + 0.15 * e + 0.10 * d) * 100, 9) AS f FROM pc),
card AS (SELECT fund, {fx('c * 100', 4)} AS cagr_score, {fx('s * 100', 4)} AS sharpe_score,
  {fx('a * 100', 4)} AS alpha_score, {fx('e * 100', 4)} AS expense_score, {fx('d * 100', 4)} AS drawdown_score,
  {fx('f', 4)} AS final_score,
  CAST(FLOOR(RANK() OVER (ORDER BY f DESC) + (COUNT(*) OVER (PARTITION BY f) - 1) / 2.0) AS INTEGER) AS overall_rank
  FROM sc)"""


@query("fa07_scorecard", f"WITH {MEASURES} SELECT * FROM card")
def _(t):
    return scorecard(t)


@query(
    "fa08_top_funds",
    f"WITH {MEASURES} SELECT fund, final_score, overall_rank FROM card ORDER BY final_score DESC, fund LIMIT 3",
)
def _(t):
    rows = scorecard(t).select("fund", "final_score", "overall_rank")
    return rows.orderBy(F.col("final_score").desc(), "fund").limit(3)


@query(
    "fa09_base_hundred",
    f"""WITH {RETS}, s AS (SELECT fund, date, value FROM rets
      WHERE date >= (SELECT MAX(date) - INTERVAL 3 YEAR FROM rets))
    SELECT fund, CAST(date AS VARCHAR) AS date,
    {fx('value / FIRST_VALUE(value) OVER (PARTITION BY fund ORDER BY date) * 100', 4)} AS indexed FROM s""",
)
def _(t):
    rows = fa.base_hundred(rets(t), "fund")
    return rows.select("fund", text_date("date"), fixed(F.col("indexed"), 4).alias("indexed"))


@query(
    "w09_base_hundred_indices",
    """WITH i AS (SELECT 'ALL' AS index, CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS value FROM orders GROUP BY 2
      UNION ALL SELECT 'OPEN', CAST(o_orderdate AS DATE), SUM(o_totalprice) FROM orders WHERE o_orderstatus = 'O' GROUP BY 2),
    s AS (SELECT * FROM i WHERE date >= (SELECT MAX(date) - INTERVAL 3 YEAR FROM i))
    SELECT index, CAST(date AS VARCHAR) AS date, """
    + fx("value / FIRST_VALUE(value) OVER (PARTITION BY index ORDER BY date) * 100", 4)
    + " AS indexed FROM s",
)
def _(t):
    rows = fa.base_hundred(indices(t), "index")
    return rows.select("index", text_date("date"), fixed(F.col("indexed"), 4).alias("indexed"))


@query(
    "fa10_tracking_error",
    f"""WITH {RETS}, lim AS (SELECT MAX(date) - INTERVAL 3 YEAR AS d FROM rets),
    a AS (SELECT CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS v FROM orders, lim
      WHERE CAST(o_orderdate AS DATE) >= lim.d GROUP BY 1),
    o AS (SELECT CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS v FROM orders, lim
      WHERE CAST(o_orderdate AS DATE) >= lim.d AND o_orderstatus = 'O' GROUP BY 1),
    ar AS (SELECT date, v / LAG(v) OVER (ORDER BY date) - 1 AS ra FROM a),
    orr AS (SELECT date, v / LAG(v) OVER (ORDER BY date) - 1 AS ro FROM o),
    j AS (SELECT r.fund, r.ret - ar.ra AS da, r.ret - orr.ro AS d_o FROM rets r JOIN ar ON r.date = ar.date
      JOIN orr ON r.date = orr.date WHERE ra IS NOT NULL AND ro IS NOT NULL)
    SELECT fund, 'ALL' AS index, {fx('STDDEV_POP(da) * SQRT(252)', 6)} AS tracking_error FROM j GROUP BY fund
    UNION ALL SELECT fund, 'OPEN', {fx('STDDEV_POP(d_o) * SQRT(252)', 6)} FROM j GROUP BY fund""",
)
def _(t):
    rows = fa.tracking_error(rets(t), indices(t), "fund")
    return rows.select("fund", "index", fixed(F.col("tracking_error"), 6).alias("tracking_error"))


@query(
    "fa11_value_at_risk",
    f"""WITH {RETS}, q AS (SELECT fund, QUANTILE_CONT(ret, 0.05) AS v FROM rets GROUP BY fund)
    SELECT r.fund, {fx('MIN(q.v)', 6)} AS var, {fx('AVG(r.ret) FILTER (WHERE r.ret <= q.v)', 6)} AS cvar,
    {fx('AVG(r.ret)', 6)} AS mean_return, {fx('STDDEV_SAMP(r.ret)', 6)} AS volatility
    FROM rets r JOIN q ON r.fund = q.fund GROUP BY r.fund HAVING COUNT(r.ret) >= 90""",
)
def _(t):
    rows = fa.value_at_risk(rets(t), "fund")
    return rows.select("fund", *[fixed(F.col(c), 6).alias(c) for c in ("var", "cvar", "mean_return", "volatility")])


def _roll(value: str) -> str:
    return f"OVER (PARTITION BY fund ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"


ROLL = f"""roll AS (SELECT fund, date, CASE WHEN COUNT(ret) {_roll('ret')} = 90 THEN AVG(ret) {_roll('ret')} END AS m,
  CASE WHEN COUNT(ret) {_roll('ret')} = 90 THEN NULLIF(STDDEV_SAMP(ret) {_roll('ret')}, 0) END AS s FROM r0)"""


@query(
    "fa12_rolling_sharpe",
    f"""WITH {RETS}, {ROLL} SELECT fund, CAST(date AS VARCHAR) AS date, {fx('m / s * SQRT(252)', 4)} AS rolling_sharpe
    FROM roll""",
)
def _(t):
    rows = fa.rolling_sharpe(period_return(nav(t), ["fund"], "value"), "fund")
    return rows.select("fund", text_date("date"), fixed(F.col("rolling_sharpe"), 4).alias("rolling_sharpe"))


@query(
    "w03_rolling_mean_std",
    f"WITH {RETS}, {ROLL} SELECT fund, CAST(date AS VARCHAR) AS date, {fx('m', 6)} AS rolling_mean, {fx('s', 6)} AS rolling_std FROM roll",
)
def _(t):
    rows = fa.rolling(period_return(nav(t), ["fund"], "value"), ["fund"], "ret", 90)
    return rows.select(
        "fund", text_date("date"), *[fixed(F.col(c), 6).alias(c) for c in ("rolling_mean", "rolling_std")]
    )


def fund_performance(t: Tables):
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("fund")).agg(F.sum("o_totalprice").alias("size"))
    grade = F.substring("fund", 1, 1).cast("int")
    return rows.withColumn("risk", F.get(F.array(*[F.lit(r) for r in fa.RISK_ORDER]), grade))


@query(
    "fa12_representative_funds",
    f"""WITH {RETS}, {ROLL}, ms AS (SELECT fund, AVG(m / s * SQRT(252)) AS v FROM roll GROUP BY fund HAVING v IS NOT NULL),
    p AS (SELECT o_orderpriority AS fund, SUM(o_totalprice) AS size, CAST(SUBSTR(o_orderpriority, 1, 1) AS INTEGER) AS g
      FROM orders GROUP BY 1)
    (SELECT 'highest_ratio' AS role, fund FROM ms ORDER BY v DESC, fund LIMIT 1) UNION ALL
    (SELECT 'lowest_ratio', fund FROM ms ORDER BY v, fund LIMIT 1) UNION ALL
    (SELECT 'largest', fund FROM p ORDER BY size DESC, fund LIMIT 1) UNION ALL
    (SELECT 'lowest_risk', fund FROM p ORDER BY g, fund LIMIT 1) UNION ALL
    (SELECT 'highest_risk', fund FROM p ORDER BY g DESC, fund LIMIT 1)""",
)
def _(t):
    rolled = fa.rolling_sharpe(period_return(nav(t), ["fund"], "value"), "fund")
    return fa.representatives(rolled, fund_performance(t), "fund")


TXN = """tx AS (SELECT o.o_custkey AS investor, o.o_orderdate AS moment, o.o_orderstatus AS kind, o.o_totalprice AS amount,
  o.o_orderpriority AS product, c.c_mktsegment AS segment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def transactions(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("investor"),
        F.col("o_orderdate").alias("moment"),
        F.col("o_orderstatus").alias("kind"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("product"),
        F.col("c_mktsegment").alias("segment"),
    )


@query(
    "fa13_cohorts",
    f"""WITH {TXN}, f AS (SELECT investor, MIN(YEAR(moment)) AS cohort FROM tx GROUP BY 1),
    j AS (SELECT tx.*, f.cohort FROM tx JOIN f ON tx.investor = f.investor),
    pc AS (SELECT cohort, product, COUNT(*) AS n FROM j GROUP BY 1, 2),
    pr AS (SELECT cohort, product FROM pc QUALIFY ROW_NUMBER() OVER (PARTITION BY cohort ORDER BY n DESC, product) = 1),
    ag AS (SELECT cohort, COALESCE(AVG(amount) FILTER (WHERE kind = 'F'), 0) AS a, SUM(amount) AS s,
      COUNT(*) FILTER (WHERE kind = 'F') AS p, COUNT(DISTINCT investor) AS n FROM j GROUP BY 1)
    SELECT CAST(ag.cohort AS INTEGER) AS cohort, n AS investors, {fx('a', 4)} AS avg_plan_amount,
    {fx('s', 2)} AS total_invested, p AS plan_transactions, pr.product AS preferred_product
    FROM ag JOIN pr ON ag.cohort = pr.cohort""",
)
def _(t):
    rows = fa.cohorts(transactions(t), "investor", "moment", "kind", "F", "amount", "product")
    return rows.select(
        "cohort",
        "investors",
        fixed(F.col("avg_plan_amount"), 4).alias("avg_plan_amount"),
        fixed(F.col("total_invested"), 2).alias("total_invested"),
        "plan_transactions",
        "preferred_product",
    )


GAPS = """g0 AS (SELECT investor, DATEDIFF('day', LAG(CAST(moment AS DATE)) OVER (PARTITION BY investor ORDER BY moment),
  CAST(moment AS DATE)) AS gap FROM tx WHERE kind = 'F'),
g1 AS (SELECT investor, COUNT(*) AS payments, AVG(gap) AS mean_gap FROM g0 GROUP BY 1 HAVING COUNT(*) >= 6)"""


@query(
    "fa14_plan_continuity",
    f"""WITH {TXN}, {GAPS} SELECT investor, payments, {fx('mean_gap', 6)} AS mean_gap,
    CASE WHEN mean_gap <= 35 THEN 'Healthy' ELSE 'At-Risk' END AS status FROM g1""",
)
def _(t):
    rows = fa.plan_continuity(transactions(t).where(F.col("kind") == "F"), "investor", "moment")
    return rows.select("investor", "payments", fixed(F.col("mean_gap"), 6).alias("mean_gap"), "status")


@query(
    "fa14_continuity_rate",
    f"""WITH {TXN}, {GAPS} SELECT COUNT(*) FILTER (WHERE mean_gap <= 35) AS healthy,
    COUNT(*) FILTER (WHERE NOT COALESCE(mean_gap <= 35, FALSE)) AS at_risk,
    {fx('COALESCE(COUNT(*) FILTER (WHERE mean_gap <= 35) / NULLIF(COUNT(*), 0), 0)', 6)} AS continuity_rate FROM g1""",
)
def _(t):
    investors = fa.plan_continuity(transactions(t).where(F.col("kind") == "F"), "investor", "moment")
    rows = fa.continuity_rate(investors)
    return rows.select("healthy", "at_risk", fixed(F.col("continuity_rate"), 6).alias("continuity_rate"))


@query(
    "fa15_concentration",
    f"""WITH h0 AS (SELECT l_suppkey, l_partkey, SUM(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
    h AS (SELECT l_suppkey, v / SUM(v) OVER (PARTITION BY l_suppkey) * 100 AS w FROM h0),
    c AS (SELECT l_suppkey, SUM((w / 100) * (w / 100)) AS hhi, COUNT(*) AS n, MAX(w) AS top FROM h GROUP BY 1)
    SELECT l_suppkey AS fund, {fx('hhi', 8)} AS hhi, n AS holdings, {fx('top', 6)} AS top_weight,
    CASE WHEN hhi < 0.10 THEN 'Diversified' WHEN hhi <= 0.18 THEN 'Moderate' ELSE 'Concentrated' END AS category FROM c""",
)
def _(t):
    held = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    totals = held.groupBy(F.col("l_suppkey").alias("fund")).agg(F.sum("v").alias("total"))
    holdings = held.join(totals, F.col("l_suppkey") == F.col("fund")).select(
        "fund", (F.col("v") / F.col("total") * 100).alias("weight")
    )
    rows = fa.concentration(holdings, "fund", "weight")
    return rows.select(
        "fund",
        fixed(F.col("hhi"), 8).alias("hhi"),
        "holdings",
        fixed(F.col("top_weight"), 6).alias("top_weight"),
        "category",
    )


def supplier_performance(t: Tables):
    stats = t.lineitem.groupBy(F.col("l_suppkey").alias("fund")).agg(
        F.round(F.avg("l_extendedprice") / F.stddev_samp("l_extendedprice"), 9).alias("sharpe"),
        F.round(F.sum("l_extendedprice") / 1e6, 9).alias("return_1y"),
        F.round(F.avg("l_tax") * 100, 9).alias("expense"),
    )
    return stats.join(t.supplier, F.col("fund") == F.col("s_suppkey")).select(
        "fund", F.col("s_name").alias("name"), "sharpe", "return_1y", "expense"
    )


def supplier_master(t: Tables):
    names = F.array(*[F.lit(r) for r in fa.RISK_ORDER])
    return t.supplier.select(F.col("s_suppkey").alias("fund"), F.get(names, F.col("s_nationkey") % 6).alias("risk"))


def _recommend_sql(appetite: str) -> str:
    grades = {"low": "0, 1", "moderate": "2, 3", "high": "4, 5"}[appetite]
    names = ", ".join(f"'{r}'" for r in fa.RISK_ORDER)
    return f"""WITH p AS (SELECT l_suppkey AS fund, ROUND(AVG(l_extendedprice) / STDDEV_SAMP(l_extendedprice), 9) AS sharpe,
      ROUND(SUM(l_extendedprice) / 1e6, 9) AS return_1y, ROUND(AVG(l_tax) * 100, 9) AS expense FROM lineitem GROUP BY 1),
    f AS (SELECT p.*, s.s_name AS name, (ARRAY[{names}])[s.s_nationkey % 6 + 1] AS risk FROM p
      JOIN supplier s ON p.fund = s.s_suppkey WHERE s.s_nationkey % 6 IN ({grades}))
    SELECT name, risk, {fx('sharpe', 6)} AS sharpe, {fx('return_1y', 4)} AS return_1y, {fx('expense', 4)} AS expense,
    {fx('sharpe / (SELECT MAX(sharpe) FROM f) * 10', 4)} AS score FROM f
    ORDER BY f.sharpe DESC, f.return_1y DESC, f.expense, f.fund LIMIT 3"""


def _recommend(appetite: str):
    @query(f"fa16_recommend_{appetite}", _recommend_sql(appetite))
    def _(t):
        rows = fa.recommend(supplier_performance(t), supplier_master(t), "fund", appetite)
        digits = {"sharpe": 6, "return_1y": 4, "expense": 4, "score": 4}
        return rows.select("name", "risk", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


for _appetite in ("low", "moderate", "high"):
    _recommend(_appetite)


@query(
    "i07_scorecard_checks",
    f"""WITH {MEASURES} SELECT COUNT(*) FILTER (WHERE final_score < 0 OR final_score > 100) AS out_of_range,
    COUNT(*) - COUNT(DISTINCT overall_rank) AS repeated_ranks,
    (SELECT COUNT(*) FROM (SELECT final_score - LAG(final_score) OVER (ORDER BY overall_rank) AS d FROM card) WHERE d > 0)
      AS order_breaks FROM card""",
)
def _(t):
    from grainmill.operators.integrity import ranking_checks

    return ranking_checks(scorecard(t), "final_score", "overall_rank", 0.0, 100.0)


@query(
    "w04_running_maximum",
    f"""WITH {NAV} SELECT fund, CAST(date AS VARCHAR) AS date,
    {fx('MAX(value) OVER (PARTITION BY fund ORDER BY date)', 2)} AS peak FROM nav""",
)
def _(t):
    rows = fa.running_max(nav(t), ["fund"], "value")
    return rows.select("fund", text_date("date"), fixed(F.col("peak"), 2).alias("peak"))


@query(
    "a12_regression_by_group",
    f"""SELECT l_returnflag, {fx('REGR_SLOPE(l_extendedprice, l_quantity)', 4)} AS slope,
    {fx('REGR_INTERCEPT(l_extendedprice, l_quantity)', 3)} AS intercept,
    {fx('REGR_R2(l_extendedprice, l_quantity)', 6)} AS r_squared, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n
    FROM lineitem GROUP BY 1""",
)
def _(t):
    fit = fa.regression(F.col("l_extendedprice"), F.col("l_quantity"))
    digits = {"slope": 4, "intercept": 3, "r_squared": 6}
    rows = t.lineitem.groupBy("l_returnflag").agg(*[fit[c].alias(c) for c in (*digits, "n")])
    return rows.select("l_returnflag", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()], "n")


@query(
    "a07_quantile_list",
    f"""SELECT flag AS l_returnflag, {fx('QUANTILE_CONT(v, 0.05)', 4)} AS p05,
    {fx('QUANTILE_CONT(v, 0.25)', 4)} AS p25, {fx('QUANTILE_CONT(v, 0.5)', 4)} AS p50,
    {fx('QUANTILE_CONT(v, 0.95)', 4)} AS p95, COUNT(*) AS n
    FROM (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem) GROUP BY 1""",
)
def _(t):
    wanted = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95}
    rows = aggregate_with_quantiles(
        t.lineitem.select("l_returnflag", "l_extendedprice"),
        ["l_returnflag"],
        [F.count(F.lit(1)).alias("n")],
        {name: ("l_extendedprice", p) for name, p in wanted.items()},
    )
    return rows.select("l_returnflag", *[fixed(F.col(c), 4).alias(c) for c in wanted], "n")
