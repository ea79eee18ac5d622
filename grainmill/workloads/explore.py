"""Exploratory profiles, relationships, geography, pivots, comparisons, findings and what-ifs."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import explore, geo
from grainmill.workloads.registry import Tables, fx, query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e01_overview", "SELECT COUNT(*) AS rows, 11 AS columns FROM lineitem")
def _(t):
    return explore.overview(t.lineitem)


def _profile_sql() -> str:
    parts = []
    for c in NUMBERS:
        parts.append(
            f"""SELECT '{c}' AS "column", {fx(f'AVG({c})', 5)} AS mean, {fx(f'MEDIAN({c})', 5)} AS median, {fx(f'STDDEV_SAMP({c})', 5)} AS std,
            {fx(f'MIN({c})', 5)} AS min, {fx(f'MAX({c})', 5)} AS max, COUNT(*) - COUNT({c}) AS missing, {fx(f'SKEWNESS({c})', 5)} AS skew,
            CASE WHEN SKEWNESS({c}) > 1 THEN 'highly right-skewed' WHEN SKEWNESS({c}) >= 0.5 THEN 'moderately right-skewed'
            WHEN SKEWNESS({c}) >= -0.5 THEN 'normal' WHEN SKEWNESS({c}) >= -1 THEN 'moderately left-skewed' ELSE 'highly left-skewed' END AS skew_label FROM lineitem"""
        )
    return " UNION ALL ".join(parts)


@query("e02_numeric_profile", _profile_sql())
def _(t):
    rows = explore.numeric_profile(t.lineitem, NUMBERS)
    digits = ("mean", "median", "std", "min", "max", "skew")
    return rows.select("column", *[fixed(F.col(c), 5).alias(c) for c in digits], "missing", "skew_label")


@query(
    "e03_categorical_profile",
    f"""WITH v AS (SELECT 'p_brand' AS col, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part),
    c AS (SELECT col, v, COUNT(*) AS n FROM v GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, v) AS place, COUNT(*) OVER (PARTITION BY col) AS k, SUM(n) OVER (PARTITION BY col) AS total FROM c)
    SELECT col AS "column", CAST(place AS INTEGER) AS place, v AS value, {fx('n / total', 6)} AS share, k AS distinct_values FROM r WHERE place <= 5""",
)
def _(t):
    rows = explore.categorical_profile(t.part, ["p_brand", "p_type"])
    return rows.select("column", "place", "value", fixed(F.col("share"), 6).alias("share"), "distinct_values")


def _datetime_sql(table: str, c: str) -> str:
    return f"""WITH m AS (SELECT STRFTIME({c}, '%Y-%m') AS u, COUNT(*) AS n FROM {table} GROUP BY 1), d AS (SELECT DAYNAME({c}) AS u, COUNT(*) AS n FROM {table} GROUP BY 1),
    g AS (SELECT {c} AS e, LAG({c}) OVER (ORDER BY {c}) AS s FROM {table}),
    w AS (SELECT s, e FROM g WHERE s IS NOT NULL ORDER BY e - s DESC, e LIMIT 1)
    SELECT '{c}' AS "column", CAST(MIN({c}) AS VARCHAR) AS earliest, CAST(MAX({c}) AS VARCHAR) AS latest, (SELECT u FROM m ORDER BY n DESC, u LIMIT 1) AS peak_month,
    (SELECT u FROM d ORDER BY n DESC, u LIMIT 1) AS busiest_day, {fx('(SELECT MAX(n) FROM d) * 100.0 / COUNT(*)', 4)} AS busiest_pct,
    CAST((SELECT FLOOR(EPOCH(e - s) / 86400) FROM w) AS INTEGER) AS gap_days FROM {table}"""


@query("e04_datetime_profile", _datetime_sql("orders", "o_orderdate"))
def _(t):
    rows = explore.datetime_profile(t.orders, "o_orderdate")
    return rows.select(
        "column", F.col("earliest").cast("string").alias("earliest"), F.col("latest").cast("string").alias("latest"),
        "peak_month", "busiest_day", fixed(F.col("busiest_pct"), 4).alias("busiest_pct"), "gap_days",
    )


@query(
    "e04_datetime_profile_events",
    _datetime_sql("events", "ts").replace("CAST(MIN(ts) AS VARCHAR)", "STRFTIME(MIN(ts), '%Y-%m-%d %H:%M:%S')").replace("CAST(MAX(ts) AS VARCHAR)", "STRFTIME(MAX(ts), '%Y-%m-%d %H:%M:%S')"),
)
def _(t):
    rows = explore.datetime_profile(t.events, "ts")
    second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select(
        "column", second("earliest"), second("latest"), "peak_month", "busiest_day",
        fixed(F.col("busiest_pct"), 4).alias("busiest_pct"), "gap_days",
    )


@query(
    "e05_correlation_summary",
    f"""WITH x AS (SELECT o_totalprice AS a, 500000 - o_totalprice + o_orderkey % 7 AS b, CAST(o_custkey AS DOUBLE) AS c FROM orders),
    r AS (SELECT 'a' AS first, 'b' AS second, CORR(a, b) AS r FROM x UNION ALL SELECT 'a', 'c', CORR(a, c) FROM x UNION ALL SELECT 'b', 'c', CORR(b, c) FROM x)
    SELECT first, second, {fx('r', 6)} AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM r WHERE ABS(r) > 0.3""",
)
def _(t):
    price = F.col("o_totalprice")
    rows = t.orders.select(
        price.alias("a"), (500000 - price + F.col("o_orderkey") % 7).alias("b"), F.col("o_custkey").cast("double").alias("c")
    )
    found = explore.correlation_pairs(rows, ["a", "b", "c"], 0.30)
    return found.select("first", "second", fixed(F.col("r"), 6).alias("r"), "direction")


@query(
    "e06_column_detail",
    f"""SELECT COUNT(o_totalprice) AS count, COUNT(DISTINCT o_totalprice) AS distinct_values, {fx('AVG(o_totalprice)', 4)} AS mean, {fx('MEDIAN(o_totalprice)', 4)} AS median FROM orders""",
)
def _(t):
    rows = explore.column_detail(t.orders, "o_totalprice")
    return rows.select("count", "distinct_values", fixed(F.col("mean"), 4).alias("mean"), fixed(F.col("median"), 4).alias("median"))


# ---------------------------------------------------------------- relationships


@query(
    "r01_correlation_strength",
    f"""WITH x AS (SELECT l_quantity AS a, l_quantity * 3 + l_tax AS b, l_extendedprice AS c FROM lineitem),
    r AS (SELECT 'a' AS first, 'b' AS second, CORR(a, b) AS r FROM x UNION ALL SELECT 'a', 'c', CORR(a, c) FROM x UNION ALL SELECT 'b', 'c', CORR(b, c) FROM x)
    SELECT first, second, {fx('r', 6)} AS r, CASE WHEN ABS(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM r WHERE ABS(r) > 0.3""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_quantity").alias("a"), (F.col("l_quantity") * 3 + F.col("l_tax")).alias("b"), F.col("l_extendedprice").alias("c")
    )
    found = explore.correlation_pairs(rows, ["a", "b", "c"], 0.30)
    return found.select("first", "second", fixed(F.col("r"), 6).alias("r"), "strength")


DERIVED = """x AS (SELECT o_totalprice AS net, o_totalprice * 1.19 AS gross, CAST(o_orderkey % 7 AS DOUBLE) AS units, o_totalprice * (o_orderkey % 7) AS total FROM orders)"""


def derived(t: Tables):
    units = (F.col("o_orderkey") % 7).cast("double")
    return t.orders.select(
        F.col("o_totalprice").alias("net"), (F.col("o_totalprice") * 1.19).alias("gross"), units.alias("units"),
        (F.col("o_totalprice") * units).alias("total"),
    )


def _proportional_sql() -> str:
    names = ["net", "gross", "units", "total"]
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            parts.append(f"SELECT '{a}' AS source, '{b}' AS derived, COUNT({b} / NULLIF({a}, 0)) AS n, AVG({b} / NULLIF({a}, 0)) AS f, STDDEV_SAMP({b} / NULLIF({a}, 0)) AS s FROM x")
    return f"WITH {DERIVED} SELECT source, derived, {fx('f', 4)} AS factor, n FROM ({' UNION ALL '.join(parts)}) WHERE n >= 10 AND s < 0.01 * ABS(f) AND f <> 0"


@query("r02_proportional_columns", _proportional_sql())
def _(t):
    rows = explore.proportional_pairs(derived(t), ["net", "gross", "units", "total"])
    return rows.withColumn("factor", fixed(F.col("factor"), 4))


def _product_sql() -> str:
    names = ["net", "gross", "units", "total"]
    parts = []
    for a in names:
        rest = [n for n in names if n != a]
        for i, b in enumerate(rest):
            for c in rest[i + 1 :]:
                parts.append(f"SELECT '{a}' AS derived, '{b}' AS \"left\", '{c}' AS \"right\", COUNT(*) AS n, AVG(ABS({a} - {b} * {c})) AS e, AVG(ABS({a})) AS m FROM x")
    return f"WITH {DERIVED} SELECT derived, \"left\", \"right\", n FROM ({' UNION ALL '.join(parts)}) WHERE n >= 10 AND e < 0.01 * m"


@query("r03_product_columns", _product_sql())
def _(t):
    return explore.product_triples(derived(t), ["net", "gross", "units", "total"])


@query(
    "r04_join_candidates",
    f"""WITH o AS (SELECT COUNT(DISTINCT o_custkey) AS a, (SELECT COUNT(*) FROM customer) AS b, (SELECT COUNT(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS c FROM orders)
    SELECT 'o_custkey' AS left_column, 'c_custkey' AS right_column, a AS left_keys, b AS right_keys, c AS common_keys, {fx('c / GREATEST(a, b)', 6)} AS overlap FROM o WHERE c / GREATEST(a, b) > 0.6""",
)
def _(t):
    pairs = [("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey"), ("o_custkey", "c_nationkey")]
    rows = explore.join_candidates(t.orders, t.customer, pairs)
    return rows.withColumn("overlap", fixed(F.col("overlap"), 6))


# ---------------------------------------------------------------- geography

PLACE_NAMES = ["Delhi", "Mumbai ", "BANGALORE", "Pune", "Patna", "Atlantis", "Chenai", "Indore"]
PLACED = "placed AS (SELECT c_custkey AS id, c_acctbal, (ARRAY[" + ", ".join(f"'{p}'" for p in PLACE_NAMES) + "])[c_custkey % 9 + 1] AS city FROM customer)"
CITY_ROWS = ", ".join(f"('{n}', '{s.replace(chr(39), chr(39) * 2)}', '{r}', {tier})" for n, s, r, tier in geo.places("city"))
CITY_SQL = f"cities AS (SELECT * FROM (VALUES {CITY_ROWS}) v(name, state, region, tier))"


def placed(t: Tables):
    names = F.array(*[F.lit(p) for p in PLACE_NAMES])
    return t.customer.select(
        F.col("c_custkey").alias("id"), "c_acctbal", F.get(names, (F.col("c_custkey") % 9).cast("int")).alias("city")
    )


@query(
    "g01_enriched_places",
    f"""WITH {PLACED}, {CITY_SQL} SELECT id, COALESCE(state, 'Unrecognized') AS geo_state, COALESCE(region, 'Unrecognized') AS geo_region,
    COALESCE('Tier ' || tier, 'Unrecognized') AS geo_tier FROM placed LEFT JOIN cities ON LOWER(TRIM(city)) = name""",
)
def _(t):
    rows = placed(t)
    return geo.enrich(rows, "city", geo.choose_kind(rows, "city")).select("id", "geo_state", "geo_region", "geo_tier")


@query("g02_suggestions", f"WITH {PLACED} SELECT DISTINCT city AS original, 'chennai' AS suggested FROM placed WHERE city = 'Chenai'")
def _(t):
    return geo.suggestions(placed(t), "city", "city")


@query(
    "g02_corrected_places",
    f"""WITH {PLACED}, {CITY_SQL}, f AS (SELECT CASE WHEN city = 'Chenai' THEN 'chennai' ELSE city END AS city FROM placed)
    SELECT city, COALESCE(state, 'Unrecognized') AS geo_state, COUNT(*) AS rows FROM f LEFT JOIN cities ON LOWER(TRIM(city)) = name GROUP BY 1, 2""",
)
def _(t):
    fixed_names = geo.correct(placed(t), "city", "city")
    return geo.enrich(fixed_names, "city", "city").groupBy("city", "geo_state").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "g03_region_breakdown",
    f"""WITH {PLACED}, {CITY_SQL} SELECT COALESCE(region, 'Unrecognized') AS region, COUNT(*) AS rows, {fx('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM placed)', 5)} AS pct,
    {fx('AVG(c_acctbal)', 4)} AS metric FROM placed LEFT JOIN cities ON LOWER(TRIM(city)) = name GROUP BY 1""",
)
def _(t):
    rows = geo.region_breakdown(geo.enrich(placed(t), "city", "city"), "c_acctbal")
    return rows.withColumns({"pct": fixed(F.col("pct"), 5), "metric": fixed(F.col("metric"), 4)})


# ---------------------------------------------------------------- pivots and comparisons


@query(
    "v01_pivot_builder",
    "SELECT l_returnflag, " + ", ".join(f"COALESCE({fx(f'AVG(l_quantity) FILTER (WHERE l_linenumber = {i})', 5)}, 0.0) AS \"{i}\"" for i in range(1, 8)) + " FROM lineitem GROUP BY 1",
)
def _(t):
    rows = explore.pivot_table(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity", "mean", list(range(1, 8)))
    return rows.select("l_returnflag", *[fixed(F.col(f"`{i}`"), 5).alias(str(i)) for i in range(1, 8)])


DIFF = f"""SELECT name, {fx('a', 3)} AS val_a, {fx('b', 3)} AS val_b, {fx('b - a', 3)} AS change, {fx('(b - a) / NULLIF(a, 0) * 100', 4)} AS pct_change FROM d"""


def difference(rows):
    digits = {"val_a": 3, "val_b": 3, "change": 3, "pct_change": 4}
    return rows.select("name", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "v02_compare_halves",
    f"""WITH m AS (SELECT QUANTILE_CONT(EPOCH_US(ts), 0.5) AS m FROM events), x AS (SELECT value, user_id, EPOCH_US(ts) <= m AS first FROM events, m),
    d AS (SELECT 'Row count' AS name, COUNT(*) FILTER (WHERE first) AS a, COUNT(*) FILTER (WHERE NOT first) AS b FROM x
    UNION ALL SELECT 'value (mean)', AVG(value) FILTER (WHERE first), AVG(value) FILTER (WHERE NOT first) FROM x
    UNION ALL SELECT 'value (sum)', SUM(value) FILTER (WHERE first), SUM(value) FILTER (WHERE NOT first) FROM x) {DIFF}""",
)
def _(t):
    return difference(explore.compare_halves(t.events, "ts", ["value"]))


@query(
    "v03_compare_segments",
    f"""WITH d AS (SELECT 'Row count' AS name, COUNT(*) FILTER (WHERE event_type = 'view') AS a, COUNT(*) FILTER (WHERE event_type = 'purchase') AS b FROM events
    UNION ALL SELECT 'value (mean)', AVG(value) FILTER (WHERE event_type = 'view'), AVG(value) FILTER (WHERE event_type = 'purchase') FROM events) {DIFF}""",
)
def _(t):
    return difference(explore.compare_segments(t.events, "event_type", "view", "purchase", ["value"]))


@query(
    "v04_compare_tables",
    f"""WITH d AS (SELECT 'Row count' AS name, (SELECT COUNT(*) FROM customer) AS a, (SELECT COUNT(*) FROM supplier) AS b
    UNION ALL SELECT 'balance (mean)', (SELECT AVG(c_acctbal) FROM customer), (SELECT AVG(s_acctbal) FROM supplier)) {DIFF}""",
)
def _(t):
    a = t.customer.select(F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"))
    return difference(explore.compare_tables(a, b, ["balance"]))


@query(
    "v05_strongest_changes",
    f"""WITH d AS (SELECT 'l_quantity (mean)' AS name, AVG(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, AVG(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem
    UNION ALL SELECT 'l_tax (mean)', AVG(l_tax) FILTER (WHERE l_returnflag = 'A'), AVG(l_tax) FILTER (WHERE l_returnflag = 'R') FROM lineitem
    UNION ALL SELECT 'l_extendedprice (mean)', AVG(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), AVG(l_extendedprice) FILTER (WHERE l_returnflag = 'R') FROM lineitem
    UNION ALL SELECT 'Row count', COUNT(*) FILTER (WHERE l_returnflag = 'A'), COUNT(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem)
    SELECT name, {fx('(b - a) / a * 100', 4)} AS pct_change FROM d ORDER BY ABS((b - a) / a) DESC, name LIMIT 2""",
)
def _(t):
    rows = explore.compare_segments(t.lineitem, "l_returnflag", "A", "R", ["l_quantity", "l_tax", "l_extendedprice"])
    return explore.strongest_changes(rows, 2).select("name", fixed(F.col("pct_change"), 4).alias("pct_change"))


# ---------------------------------------------------------------- findings


@query(
    "h01_seasonality",
    f"SELECT CAST(QUARTER(ts) AS INTEGER) AS quarter, {fx('COUNT(*) / (SELECT COUNT(*) FROM events)', 6)} AS share FROM events GROUP BY 1 HAVING COUNT(*) / (SELECT COUNT(*) FROM events) > 0.4",
)
def _(t):
    return explore.seasonality(t.events, "ts").select("quarter", fixed(F.col("share"), 6).alias("share"))


PREMIUM = """x AS (SELECT o_orderpriority AS segment, o_totalprice * CASE WHEN o_orderpriority = '1-URGENT' THEN 9 ELSE 1 END AS v FROM orders)"""


def premium(t: Tables):
    factor = F.when(F.col("o_orderpriority") == "1-URGENT", 9).otherwise(1)
    return t.orders.select(F.col("o_orderpriority").alias("segment"), (F.col("o_totalprice") * factor).alias("v"))


@query(
    "h02_premium_segments",
    f"""WITH {PREMIUM}, g AS (SELECT segment, SUM(v) AS v, COUNT(*) AS n FROM x GROUP BY 1), s AS (SELECT segment, v / SUM(v) OVER () AS a, n / SUM(n) OVER () AS b FROM g)
    SELECT segment, {fx('a', 6)} AS value_share, {fx('b', 6)} AS row_share FROM s WHERE a > 2 * b AND a > 0.15""",
)
def _(t):
    rows = explore.premium_segments(premium(t), "segment", "v")
    return rows.select("segment", *[fixed(F.col(c), 6).alias(c) for c in ("value_share", "row_share")])


@query(
    "h03_single_purchases",
    f"""WITH g AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE n = 1) AS single FROM g)
    SELECT customers, single, {fx('single / customers', 6)} AS share FROM s WHERE single / customers > 0.2""",
)
def _(t):
    buyers = t.orders.select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("buyer"))
    return explore.single_purchases(buyers, "buyer").withColumn("share", fixed(F.col("share"), 6))


@query(
    "h04_customer_concentration",
    f"""WITH g AS (SELECT l_suppkey % 20 AS buyer, SUM(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT SUM(v) AS v FROM (SELECT v FROM g ORDER BY v DESC LIMIT 10))
    SELECT {fx('t.v / (SELECT SUM(v) FROM g)', 6)} AS share, (SELECT COUNT(*) FROM g) AS customers FROM t WHERE t.v / (SELECT SUM(v) FROM g) > 0.3""",
)
def _(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 20).alias("buyer"), "l_extendedprice")
    return explore.customer_concentration(rows, "buyer", "l_extendedprice").withColumn("share", fixed(F.col("share"), 6))


@query(
    "h05_discount_effect",
    f"""WITH x AS (SELECT l_discount AS d, 100 - 500 * l_discount + l_tax AS v FROM lineitem)
    SELECT {fx('CORR(d, v)', 6)} AS r, COUNT(*) AS n FROM x HAVING CORR(d, v) < -0.5""",
)
def _(t):
    rows = t.lineitem.select(F.col("l_discount").alias("d"), (100 - 500 * F.col("l_discount") + F.col("l_tax")).alias("v"))
    return explore.discount_effect(rows, "d", "v").withColumn("r", fixed(F.col("r"), 6))


@query(
    "h06_weekday_skew",
    f"""WITH p AS (SELECT COUNT(*) FILTER (WHERE ISODOW(o_orderdate) <= 5) * 100.0 / COUNT(*) AS p FROM orders)
    SELECT {fx('p', 5)} AS weekday_pct, CASE WHEN p > 70 THEN 'weekday' ELSE 'weekend' END AS pattern FROM p WHERE p > 70 OR 100 - p > 70""",
)
def _(t):
    return explore.weekday_skew(t.orders, "o_orderdate").withColumn("weekday_pct", fixed(F.col("weekday_pct"), 5))


@query(
    "h07_place_concentration",
    f"""WITH c AS (SELECT lang, COUNT(*) AS n FROM documents GROUP BY 1), r AS (SELECT lang, n, ROW_NUMBER() OVER (ORDER BY n DESC, lang) AS p FROM c)
    SELECT {fx('SUM(n) / (SELECT SUM(n) FROM c)', 6)} AS share, MAX(lang) FILTER (WHERE p = 1) AS first, MAX(lang) FILTER (WHERE p = 2) AS second FROM r WHERE p <= 2
    HAVING SUM(n) / (SELECT SUM(n) FROM c) > 0.5""",
)
def _(t):
    return explore.place_concentration(t.documents, "lang").withColumn("share", fixed(F.col("share"), 6))


@query(
    "h08_date_gap",
    """WITH x AS (SELECT DISTINCT CASE WHEN MONTH(o_orderdate) NOT BETWEEN 3 AND 5 THEN o_orderdate END AS d FROM orders), g AS (SELECT d AS e, LAG(d) OVER (ORDER BY d) AS s FROM x WHERE d IS NOT NULL)
    SELECT CAST(DATEDIFF('day', s, e) AS INTEGER) AS gap_days, STRFTIME(s, '%Y-%m-%d') AS gap_start, STRFTIME(e, '%Y-%m-%d') AS gap_end FROM g WHERE DATEDIFF('day', s, e) > 30
    ORDER BY DATEDIFF('day', s, e) DESC, e LIMIT 1""",
)
def _(t):
    rows = t.orders.select(F.when(~F.month("o_orderdate").between(3, 5), F.col("o_orderdate")).alias("d"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return explore.date_gap(rows, "d").select("gap_days", day("gap_start"), day("gap_end"))


@query(
    "h09_zero_values",
    f"""SELECT 'l_discount' AS "column", COUNT(*) FILTER (WHERE l_discount = 0) AS zeros, COUNT(*) AS rows, {fx('COUNT(*) FILTER (WHERE l_discount = 0) * 100.0 / COUNT(*)', 5)} AS zero_pct FROM lineitem
    UNION ALL SELECT 'l_tax', COUNT(*) FILTER (WHERE l_tax = 0), COUNT(*), {fx('COUNT(*) FILTER (WHERE l_tax = 0) * 100.0 / COUNT(*)', 5)} FROM lineitem""",
)
def _(t):
    rows = explore.zero_values(t.lineitem, ["l_discount", "l_tax", "l_quantity"])
    return rows.withColumn("zero_pct", fixed(F.col("zero_pct"), 5))


@query(
    "h10_rapid_growth",
    f"""WITH x AS (SELECT CASE WHEN o_orderdate >= DATE '1999-01-01' THEN '1999-02' ELSE STRFTIME(o_orderdate, '%Y-%m') END AS month FROM orders), m AS (SELECT month, COUNT(*) AS n FROM x GROUP BY 1),
    l AS (SELECT month, n, LAG(n) OVER (ORDER BY month) AS p FROM m ORDER BY month DESC LIMIT 1)
    SELECT n AS latest, p AS previous, month, {fx('n / p', 5)} AS ratio FROM l WHERE n > 1.5 * p""",
)
def _(t):
    # Everything from 1999 on is moved into one month, which makes a surge.
    late = F.when(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("1999-02-01").cast("timestamp_ntz"))
    rows = t.orders.select(F.coalesce(late, "o_orderdate").alias("moment"))
    return explore.rapid_growth(rows, "moment").withColumn("ratio", fixed(F.col("ratio"), 5))


@query(
    "h11_dominant_values",
    f"""WITH x AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderstatus ELSE 'N' END AS kind FROM orders), c AS (SELECT kind, COUNT(*) AS n FROM x GROUP BY 1)
    SELECT 'kind' AS "column", kind AS value, n, {fx('n / (SELECT SUM(n) FROM c)', 6)} AS share FROM c WHERE n / (SELECT SUM(n) FROM c) > 0.8""",
)
def _(t):
    kind = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderstatus")).otherwise("N")
    rows = explore.dominant_values(t.orders.select(kind.alias("kind"), "o_orderpriority"), ["kind", "o_orderpriority"])
    return rows.withColumn("share", fixed(F.col("share"), 6))


@query(
    "h12_segment_outliers",
    f"""WITH {PREMIUM}, g AS (SELECT segment, AVG(v) AS mean, COUNT(*) AS n FROM x GROUP BY 1), r AS (SELECT *, mean / (SELECT AVG(v) FROM x) AS ratio FROM g)
    SELECT segment, n, {fx('mean', 3)} AS mean, {fx('ratio', 6)} AS ratio, CASE WHEN ratio > 1.5 THEN 'high' ELSE 'low' END AS kind FROM r WHERE n >= 5 AND (ratio > 1.5 OR ratio < 0.5)""",
)
def _(t):
    rows = explore.segment_outliers(premium(t), "segment", "v")
    return rows.select("segment", "n", fixed(F.col("mean"), 3).alias("mean"), fixed(F.col("ratio"), 6).alias("ratio"), "kind")


# ---------------------------------------------------------------- what-ifs


@query(
    "m01_scale_column",
    f"""SELECT {fx('SUM(o_totalprice)', 1)} AS total_before, {fx('SUM(o_totalprice) * 1.15', 1)} AS total_after, {fx('AVG(o_totalprice)', 4)} AS mean_before,
    {fx('AVG(o_totalprice) * 1.15', 4)} AS mean_after, {fx('STDDEV_SAMP(o_totalprice) / AVG(o_totalprice) * 100', 5)} AS variation_pct FROM orders""",
)
def _(t):
    digits = {"total_before": 1, "total_after": 1, "mean_before": 4, "mean_after": 4, "variation_pct": 5}
    rows = explore.scale_column(t.orders, "o_totalprice", 15.0)
    return rows.select(*[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


def _effect_sql(kept: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {kept}) AS rows_after, {fx(f'SUM({c})', 1)} AS total_before,
        {fx(f'SUM({c}) FILTER (WHERE {kept})', 1)} AS total_after, {fx(f'(SUM({c}) - SUM({c}) FILTER (WHERE {kept})) / SUM({c}) * 100', 4)} AS lost_pct FROM {table}"""
        for c in columns
    )


def effect(rows):
    digits = {"total_before": 1, "total_after": 1, "lost_pct": 4}
    return rows.withColumns({c: fixed(F.col(c), d) for c, d in digits.items()})


@query("m02_remove_segment", _effect_sql("LOWER(l_returnflag) <> 'a'", "lineitem", ["l_quantity", "l_extendedprice"]))
def _(t):
    return effect(explore.remove_segment(t.lineitem, "l_returnflag", "a", ["l_quantity", "l_extendedprice"]))


@query("m03_keep_above", _effect_sql("o_totalprice > 250000", "orders", ["o_totalprice"]))
def _(t):
    return effect(explore.keep_above(t.orders, "o_totalprice", 250000, ["o_totalprice"]))


