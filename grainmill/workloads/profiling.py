"""Quality detectors, health score and column reports on dirty customers, orders, pages and documents."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import profile
from grainmill.operators.dedup import duplicate_count, near_duplicate_count
from grainmill.operators.recommend import actions_for, preview, recommendations
from grainmill.session import set_down
from grainmill.sources import files
from grainmill.workloads.fixtures import (
    DIRTY_CUSTOMER,
    DIRTY_ORDERS,
    dirty_customer,
    dirty_orders,
    sql_date,
    sql_number,
    sql_squeeze,
    sql_strip,
)
from grainmill.workloads.loading import scratch, with_header
from grainmill.workloads.registry import fx, query

C = f"WITH {DIRTY_CUSTOMER}"
O = f"WITH {DIRTY_ORDERS}"  # noqa: E741
COLUMNS = ["id", "name", "segment", "balance", "email", "phone", "active", "age", "amount"]
TEXTS = ["name", "segment", "balance", "email", "phone", "active"]


def _per_column(test: str, columns: list[str], source: str = "dirty") -> str:
    parts = [f"""SELECT '{c}' AS "column", COUNT(*) FILTER (WHERE {test.format(c=c, s=sql_strip(c))}) AS n FROM {source}""" for c in columns]
    return " UNION ALL ".join(parts)


def _detector(name: str, measure: str, test: str, columns: list[str]):
    @query(name, f"""{C} SELECT "column", n FROM ({_per_column(test, columns)}) WHERE n > 0""")
    def _(t):
        rows = profile.column_counts(dirty_customer(t), columns)
        return rows.where(F.col(measure) > 0).select("column", F.col(measure).alias("n"))


_detector("d01_missing_values", "missing", "{c} IS NULL", COLUMNS)
_detector("d02_blank_strings", "blanks", "{s} = ''", TEXTS)
_detector("d09_leading_trailing_spaces", "spaced", "{s} <> {c}", TEXTS)
_detector("d10_multiple_spaces", "multi_spaced", r"regexp_matches({c}, '\s\s')", TEXTS)
_detector("d17_email_pattern", "bad_emails", "NOT regexp_full_match({c}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')", ["email"])
_detector("d18_phone_pattern", "bad_phones", r"NOT regexp_full_match({c}, '\+?[\d\s\-()]{{7,20}}')", ["phone"])
_detector("d21_business_rules", "negatives", "{c} < 0", ["age"])


@query("d03_duplicate_rows", f"{O} SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates FROM dirty")
def _(t):
    return duplicate_count(dirty_orders(t))


ORDER_COLUMNS = ["id", "customer", "order_date", "status", "amount", "priority"]


def _near_sql() -> str:
    total = "(SELECT COUNT(*) FROM dirty)"
    exact = f"({total} - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)))"
    parts = []
    for c in ORDER_COLUMNS:
        rest = ", ".join(x for x in ORDER_COLUMNS if x != c)
        parts.append(f"""SELECT '{c}' AS "column", {total} - (SELECT COUNT(*) FROM (SELECT DISTINCT {rest} FROM dirty)) - {exact} AS near_duplicates""")
    return " UNION ALL ".join(parts)


@query("d04_near_duplicates", f"{O} {_near_sql()}")
def _(t):
    return near_duplicate_count(dirty_orders(t))


@query(
    "d05_mixed_types",
    f"""{C} SELECT 'balance' AS "column", COUNT(DISTINCT CASE WHEN regexp_full_match(LOWER({sql_strip('balance')}), '[+-]?\\d+') THEN 'int'
      WHEN regexp_full_match(LOWER({sql_strip('balance')}), '[+-]?(\\d+\\.\\d*|\\.\\d+)') THEN 'float' ELSE 'text' END) AS kinds FROM dirty
    UNION ALL SELECT 'active', COUNT(DISTINCT CASE WHEN {sql_strip('active')} IN ('1') THEN 'int'
      WHEN LOWER({sql_strip('active')}) IN ('yes', 'no', 'true', 'false') THEN 'bool' WHEN active IS NOT NULL THEN 'text' END) FROM dirty""",
)
def _(t):
    return profile.column_counts(dirty_customer(t), ["balance", "active"]).select("column", "kinds")


@query(
    "d06_invalid_dates",
    f"{O} SELECT 'order_date' AS \"column\", COUNT(*) FILTER (WHERE {sql_date('order_date')} IS NULL) AS bad_dates, COUNT(*) FILTER (WHERE YEAR({sql_date('order_date')}) NOT BETWEEN 1800 AND 2100) AS odd_years FROM dirty",
)
def _(t):
    return profile.column_counts(dirty_orders(t), ["order_date"]).select("column", "bad_dates", "odd_years")


@query(
    "d07_numeric_failures",
    f"""{C}, n AS (SELECT COUNT(active) AS present, COUNT(TRY_CAST({sql_strip('active')} AS DOUBLE)) AS ok, MIN(active) FILTER
    (WHERE TRY_CAST({sql_strip('active')} AS DOUBLE) IS NULL) AS e FROM dirty)
    SELECT 'active' AS "column", present - ok AS failures FROM n WHERE ok > 0 AND ok < 0.95 * present""",
)
def _(t):
    found = profile.issues(dirty_customer(t).select("active", "id"))
    return found.where("id = 'numeric_failures'").select("column", F.col("affected_count").alias("failures"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _outlier_sql() -> str:
    parts = []
    for c in NUMBERS:
        parts.append(
            f"""SELECT '{c}' AS "column", {fx('MIN(lo)', 4)} AS low, {fx('MIN(hi)', 4)} AS high,
            COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outside FROM lineitem,
            (SELECT q1 - 0.4 * (q3 - q1) AS lo, q3 + 0.4 * (q3 - q1) AS hi FROM
              (SELECT QUANTILE_CONT({c}, 0.25) AS q1, QUANTILE_CONT({c}, 0.75) AS q3 FROM lineitem))"""
        )
    return " UNION ALL ".join(parts)


@query("d08_outliers", _outlier_sql())
def _(t):
    rows = profile.outlier_counts(t.lineitem, NUMBERS, 0.4)
    return rows.select("column", fixed(F.col("low"), 4).alias("low"), fixed(F.col("high"), 4).alias("high"), "outside")


@query(
    "d11_case_variants",
    f"""{C} SELECT 'segment' AS "column", COUNT(DISTINCT {sql_strip('segment')}) - COUNT(DISTINCT LOWER({sql_strip('segment')})) AS case_variants FROM dirty
    UNION ALL SELECT 'active', COUNT(DISTINCT {sql_strip('active')}) - COUNT(DISTINCT LOWER({sql_strip('active')})) FROM dirty""",
)
def _(t):
    return profile.value_stats(dirty_customer(t), ["segment", "active"]).select("column", "case_variants")


@query(
    "d12_control_characters",
    r"""SELECT 'text' AS "column", COUNT(*) FILTER (WHERE regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]')) AS control FROM documents""",
)
def _(t):
    return profile.column_counts(t.documents, ["text"]).select("column", "control")


HOLLOW = "hollow AS (SELECT CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS balance, CAST(NULL AS VARCHAR) AS nothing FROM customer)"


def hollow(t):
    kept = F.col("c_custkey") % 6 != 0
    return t.customer.select(
        F.when(kept, F.col("c_name")).alias("name"),
        F.when(kept, F.col("c_acctbal")).alias("balance"),
        F.lit(None).cast("string").alias("nothing"),
    )


@query("d13_empty_rows", f"WITH {HOLLOW} SELECT COUNT(*) AS empty_rows FROM hollow WHERE COALESCE(name, CAST(balance AS VARCHAR), nothing) IS NULL")
def _(t):
    return profile.row_counts(hollow(t)).select("empty_rows")


@query("d14_empty_columns", f"WITH {HOLLOW} SELECT 'nothing' AS \"column\", COUNT(*) AS affected_count FROM hollow HAVING COUNT(nothing) = 0")
def _(t):
    return profile.issues(hollow(t)).where("id = 'empty_columns'").select("column", "affected_count")


@query("d15_repeated_header", "SELECT 'duplicate_columns' AS id, CAST(2 AS BIGINT) AS affected_count FROM customer LIMIT 1")
def _(t):
    path = with_header(t, t.customer, "key,name,nation,key,name.1")
    header = next(iter(files.headers(t.spark, path).values()))
    rows = files.read_csv(t.spark, path)
    rows = profile.issues(rows.toDF(*[c.replace(".", "_") for c in rows.columns]), header=header)
    return rows.where("id = 'duplicate_columns'").select("id", "affected_count")


@query(
    "d16_uniqueness",
    """SELECT 'o_custkey' AS "column", COUNT(o_custkey) - COUNT(DISTINCT o_custkey) AS repeated FROM orders
    UNION ALL SELECT 'o_orderkey', COUNT(o_orderkey) - COUNT(DISTINCT o_orderkey) FROM orders""",
)
def _(t):
    keys = profile.named(t.orders.columns, profile.KEY_WORDS)
    return profile.value_stats(t.orders, [k for k in keys if k.endswith("key")]).select("column", "repeated")


@query(
    "d19_url_pattern",
    r"""SELECT 'url' AS "column", COUNT(*) FILTER (WHERE NOT regexp_full_match(url, 'https?://[^\s/$.?#].[^\s]*')) AS bad_urls FROM pages""",
)
def _(t):
    return profile.column_counts(t.pages, ["url"]).select("column", "bad_urls")


@query(
    "d20_category_typos",
    """WITH v AS (SELECT DISTINCT p_brand AS x FROM part UNION SELECT DISTINCT p_type || CASE WHEN p_size > 45 THEN 's' ELSE '' END FROM part)
    SELECT a.x AS first, b.x AS second FROM v a JOIN v b ON a.x < b.x WHERE LEVENSHTEIN(LOWER(a.x), LOWER(b.x)) = 1""",
)
def _(t):
    plural = F.concat("p_type", F.when(F.col("p_size") > 45, F.lit("s")).otherwise(F.lit("")))
    rows = t.part.select(F.explode(F.array(F.col("p_brand"), plural)).alias("label"))
    return profile.typo_pairs(rows, ["label"]).select("first", "second")


# The same issues written out in SQL for a table with few columns.
ISSUES = f"""{O}, n AS (SELECT COUNT(*) AS n FROM dirty),
dup AS (SELECT n - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM n),
near AS (SELECT SUM(CASE WHEN near_duplicates > 0 THEN near_duplicates ELSE 0 END) AS d FROM ({_near_sql()})),
q AS (SELECT QUANTILE_CONT(amount, 0.25) AS q1, QUANTILE_CONT(amount, 0.75) AS q3 FROM dirty),
cat AS (SELECT DISTINCT col, x FROM (SELECT UNNEST(['order_date', 'status', 'priority']) AS col,
  UNNEST([{sql_strip('order_date')}, {sql_strip('status')}, {sql_strip('priority')}]) AS x FROM dirty) WHERE x IS NOT NULL),
typos AS (SELECT a.col, COUNT(*) AS n, (SELECT COUNT(*) FROM cat c WHERE c.col = a.col) AS k FROM cat a JOIN cat b
  ON a.col = b.col AND a.x < b.x AND ABS(LENGTH(a.x) - LENGTH(b.x)) <= 1 AND LEVENSHTEIN(LOWER(a.x), LOWER(b.x)) = 1 GROUP BY 1),
i AS (
  SELECT 'duplicate_rows' AS id, NULL AS col, CASE WHEN d * 100.0 / n > 20 THEN 'critical' ELSE 'warning' END AS severity, d AS c, d * 100.0 / n AS pct FROM dup, n
  UNION ALL SELECT 'near_duplicates', NULL, 'warning', d, d * 100.0 / n FROM near, n
  UNION ALL SELECT 'mixed_types', 'order_date', 'critical', 2, 2 * 100.0 / 6 FROM n
  UNION ALL SELECT 'invalid_dates', 'order_date', 'warning', COUNT(*) FILTER (WHERE {sql_date('order_date')} IS NULL), COUNT(*) FILTER (WHERE {sql_date('order_date')} IS NULL) * 100.0 / COUNT(*) FROM dirty
  UNION ALL SELECT 'whitespace_ends', 'status', 'warning', COUNT(*) FILTER (WHERE {sql_strip('status')} <> status), COUNT(*) FILTER (WHERE {sql_strip('status')} <> status) * 100.0 / COUNT(*) FROM dirty
  UNION ALL SELECT 'case_inconsistent', 'status', 'warning', COUNT(DISTINCT {sql_strip('status')}) - COUNT(DISTINCT LOWER({sql_strip('status')})),
    (COUNT(DISTINCT {sql_strip('status')}) - COUNT(DISTINCT LOWER({sql_strip('status')}))) * 100.0 / COUNT(DISTINCT {sql_strip('status')}) FROM dirty
  UNION ALL SELECT 'uniqueness_violations', 'id', 'critical', COUNT(id) - COUNT(DISTINCT id), (COUNT(id) - COUNT(DISTINCT id)) * 100.0 / COUNT(*) FROM dirty
  UNION ALL SELECT 'outliers', 'amount', 'warning', COUNT(*) FILTER (WHERE amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)),
    COUNT(*) FILTER (WHERE amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)) * 100.0 / COUNT(*) FROM dirty, q
  UNION ALL SELECT 'category_inconsistent', col, 'warning', n, n * 100.0 / k FROM typos
), iss AS (SELECT id, col, severity, CAST(c AS BIGINT) AS c, pct FROM i WHERE c > 0)"""


@query("d22_issue_rows", f"""{ISSUES} SELECT id, col AS "column", severity, c AS affected_count, {fx('pct', 4)} AS affected_pct FROM iss""")
def _(t):
    rows = profile.issues(dirty_orders(t))
    return rows.select("id", "column", "severity", "affected_count", fixed(F.col("affected_pct"), 4).alias("affected_pct"))


SCORE = """CAST(GREATEST(0, LEAST(100, TRUNC(100 - ROUND(SUM(GREATEST(
  CASE severity WHEN 'critical' THEN 15.0 WHEN 'warning' THEN 5.0 ELSE 1.0 END * ROUND(pct, 1) / 100.0,
  CASE severity WHEN 'critical' THEN 1.5 WHEN 'warning' THEN 0.5 ELSE 0.1 END)), 9)))) AS INTEGER)"""


@query("d22_health_score", f"{ISSUES} SELECT {SCORE} AS health_score FROM iss")
def _(t):
    return profile.health_score(profile.issues(dirty_orders(t)))


@query(
    "d23_run_metrics",
    f"""{ISSUES} SELECT (SELECT n FROM n) AS rows, 6 AS columns, (SELECT n * 6 FROM n) AS total_cells,
    COUNT(*) FILTER (WHERE severity = 'critical') AS critical_count, COUNT(*) FILTER (WHERE severity = 'warning') AS warning_count,
    COUNT(*) FILTER (WHERE severity = 'info') AS info_count, COUNT(*) AS total_issues FROM iss""",
)
def _(t):
    rows = dirty_orders(t)
    return profile.run_metrics(rows, profile.issues(rows))


@query(
    "d24_health_before_after",
    f"""SELECT was.health_score AS before, now.health_score AS after, now.health_score - was.health_score AS gain
    FROM ({ISSUES} SELECT {SCORE} AS health_score FROM iss) was,
    ({ISSUES.replace("WITH dirty AS", "WITH raw AS").replace(", n AS (SELECT COUNT(*) AS n FROM dirty)", ", dirty AS (SELECT DISTINCT * FROM raw), n AS (SELECT COUNT(*) AS n FROM dirty)", 1)}
      SELECT {SCORE} AS health_score FROM iss) now""",
)
def _(t):
    from grainmill.operators.clean import remove_duplicates

    rows = dirty_orders(t)
    kept = set_down(remove_duplicates(rows).df, "distinct")  # every check would remove them again
    return profile.compare_health(profile.issues(rows), profile.issues(kept))


def _type_sql(column: str, source: str) -> str:
    """The type decision of one text column."""
    low = f"LOWER({sql_strip(column)})"
    date = f"COALESCE(TRY_STRPTIME({column}, '%Y/%m/%d'), TRY_STRPTIME({column}, '%Y-%m-%d'))"
    bools = "('true', 'false', 'yes', 'no', 't', 'f', 'y', 'n', '1', '0', '1.0', '0.0')"
    number = f"TRY_CAST({sql_strip(column)} AS DOUBLE)"
    marked = f"BOOL_OR(regexp_matches({column}, '[-/:]'))"
    return f"""SELECT '{column}' AS "column", CASE WHEN COUNT({column}) = 0 THEN 'empty'
      WHEN COUNT(*) FILTER (WHERE {low} IN {bools}) = COUNT({column}) THEN 'boolean'
      WHEN COUNT({number}) = COUNT({column}) THEN 'number'
      WHEN {marked} AND COUNT({date}) = COUNT({column}) THEN 'date' WHEN COUNT({number}) > 0 THEN 'mixed'
      WHEN {marked} AND COUNT({date}) > 0 THEN 'mixed' ELSE 'text' END AS detected FROM {source}"""


@query(
    "p01_detected_types",
    f"{C} " + " UNION ALL ".join(_type_sql(c, "dirty") for c in TEXTS)
    + "".join(f""" UNION ALL SELECT '{c}', CASE WHEN COUNT({c}) = 0 THEN 'empty' ELSE 'number' END FROM dirty""" for c in ("id", "age", "amount")),
)
def _(t):
    return profile.detected_types(dirty_customer(t)).select("column", "detected")


TYPED = """typed AS (SELECT STRFTIME(o_orderdate, '%Y/%m/%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS flag,
  CAST(o_orderkey AS VARCHAR) AS tally, CAST(NULL AS VARCHAR) AS hollow FROM orders)"""


@query(
    "p01_detected_date_and_boolean",
    f"WITH {TYPED} " + " UNION ALL ".join(_type_sql(c, "typed") for c in ("day", "flag", "tally", "hollow")),
)
def _(t):
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Yes")).otherwise(F.lit("no")).alias("flag"),
        F.col("o_orderkey").cast("string").alias("tally"),
        F.lit(None).cast("string").alias("hollow"),
    )
    return profile.detected_types(rows).select("column", "detected")


def _report_sql() -> str:
    types = dict.fromkeys(ORDER_COLUMNS, "number") | {"order_date": "mixed", "status": "text", "priority": "text"}
    parts = []
    for c in ORDER_COLUMNS:
        missing = f"COUNT(*) FILTER (WHERE {c} IS NULL" + (f" OR {sql_strip(c)} = '')" if types[c] != "number" else ")")
        parts.append(
            f"""SELECT '{c}' AS "column", '{types[c]}' AS detected, {missing} AS missing,
            COUNT({c}) - COUNT(DISTINCT {c}) AS duplicate_values,
            (SELECT COUNT(*) FROM iss WHERE col = '{c}') AS issues FROM dirty"""
        )
    return f"""{ISSUES} SELECT *, CASE WHEN issues > 0 THEN 'attention' ELSE 'clean' END AS status FROM ({' UNION ALL '.join(parts)})"""


@query("p02_column_report", _report_sql())
def _(t):
    rows = dirty_orders(t)
    return profile.column_report(rows).drop("missing_pct")


def _text_role(c: str) -> str:
    words = rf"LENGTH(REGEXP_SPLIT_TO_ARRAY({sql_strip(c)}, '[ \t\n\x0B\f\r]+'))"
    return f"""SELECT '{c}' AS "column", CASE WHEN AVG({words}) > 3 OR (AVG(LENGTH({sql_strip(c)})) > 30
      AND COUNT(DISTINCT {c}) > 0.5 * COUNT(*)) THEN 'text' ELSE 'categorical' END AS role FROM documents"""


@query(
    "p03_classify_columns",
    " UNION ALL ".join(_text_role(c) for c in ("text", "lang", "source"))
    + """ UNION ALL SELECT 'doc_id', CASE WHEN COUNT(DISTINCT doc_id) >= 0.9 * COUNT(*) THEN 'identifier' ELSE 'numeric' END FROM documents
    UNION ALL SELECT 'n_chars', 'numeric' FROM documents GROUP BY 2""",
)
def _(t):
    return profile.classify_columns(t.documents)


@query(
    "p04_schema_roles",
    """SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'datetime'), ('user_id', 'numeric'), ('event_type', 'categorical'),
    ('value', 'numeric'), ('props', 'categorical')) v("column", role)""",
)
def _(t):
    # Names and kinds come from a written file, kinds from all its values.
    folder = scratch(t, "roles")
    files.write_csv(t.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), folder)
    events = files.infer_types(files.read_csv(t.spark, folder))
    roles = profile.schema_roles(events)
    counts = profile.column_counts(events).where(F.col("rows") > F.col("missing"))
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])[F.col("column")]
    return counts.select("column", role.alias("role"))


@query(
    "p05_geo_columns",
    """SELECT 'c_region' AS "column", COUNT(*) AS rows FROM customer UNION ALL SELECT 'city_name', COUNT(*) FROM customer""",
)
def _(t):
    from grainmill.operators.geo import geo_columns

    rows = files.read_csv(t.spark, with_header(t, t.customer.select("c_custkey", "c_nationkey", "c_name"), "c_custkey,c_region,city_name"))
    names = geo_columns(rows)
    return profile.column_counts(rows, names).select("column", "rows")


@query(
    "p06_recommendations",
    f"""{ISSUES}, m AS (SELECT * FROM (VALUES ('duplicate_rows', 'fix_duplicates', NULL, 'High'), ('near_duplicates', 'fix_near_duplicates', 'warning', 'Low'),
      ('mixed_types', 'fix_mixed_types', 'critical', 'Low'), ('invalid_dates', 'fix_dates', 'warning', 'Medium'),
      ('whitespace_ends', 'fix_whitespace', 'warning', 'High'), ('case_inconsistent', 'fix_case', 'warning', 'High'),
      ('uniqueness_violations', 'fix_uniqueness', 'critical', 'Low'), ('outliers', 'fix_outliers', 'warning', 'Medium'),
      ('category_inconsistent', 'fix_categories', 'warning', 'Low')) v(id, fix, fixed_severity, confidence))
    SELECT fix, MAX(COALESCE(fixed_severity, severity)) AS severity, CAST(SUM(c) AS BIGINT) AS affected_count,
    COALESCE(STRING_AGG(DISTINCT col, ', ' ORDER BY col), '') AS columns, confidence
    FROM iss JOIN m ON iss.id = m.id GROUP BY fix, confidence""",
)
def _(t):
    rows = dirty_orders(t)
    n = rows.agg(F.count(F.lit(1))).scalar()
    found = recommendations(profile.issues(rows), n, n * len(rows.columns))
    return found.select("fix", "severity", "affected_count", "columns", "confidence")


@query("p07_fix_actions_applied", f"{O} SELECT id, STRFTIME({sql_date('order_date')}, '%Y-%m-%d') AS order_date, {sql_strip('status')} AS status FROM dirty")
def _(t):
    from grainmill.plans.cleaning import Action, apply_plan

    rows = dirty_orders(t).select("id", "order_date", "status")
    actions = actions_for("fix_dates", rows, ["order_date"]) + actions_for("fix_whitespace", rows, ["status"])
    return apply_plan(rows, [Action(name, params) for name, params in actions]).df


@query(
    "p08_fix_preview",
    f"""{C}, a AS (SELECT 'name' AS "column", name AS before, {sql_squeeze('name')} AS after FROM dirty WHERE name IS DISTINCT FROM {sql_squeeze('name')} ORDER BY id LIMIT 5),
    b AS (SELECT 'balance' AS "column", balance AS before, CAST({sql_number('balance')} AS VARCHAR) AS after FROM dirty
        WHERE balance IS DISTINCT FROM CAST({sql_number('balance')} AS VARCHAR) ORDER BY id LIMIT 5) FROM a UNION ALL FROM b""",
)
def _(t):
    return preview(dirty_customer(t), "fix_whitespace", "name", "id").unionByName(
        preview(dirty_customer(t), "fix_numeric", "balance", "id")
    )


@query(
    "k13_duplicates_with_nulls",
    f"""{C}, k AS (SELECT segment, active FROM dirty) SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM k)) AS distinct_rows,
    COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM k)) AS duplicates FROM k""",
)
def _(t):
    return duplicate_count(dirty_customer(t), ["segment", "active"])

