"""Inspection findings, plans built from them, and learned-rule proposals."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import inspect
from grainmill.plans.cleaning import apply_plan, build_plan
from grainmill.sources import files
from grainmill.workloads.cleaning import TAILED, tailed
from grainmill.workloads.fixtures import (
    DIRTY_CUSTOMER,
    DIRTY_ORDERS,
    dirty_customer,
    dirty_orders,
    sql_date,
    sql_number,
    sql_strip,
)
from grainmill.workloads.loading import with_header
from grainmill.workloads.profiling import HOLLOW, hollow
from grainmill.workloads.registry import fx, query

C = f"WITH {DIRTY_CUSTOMER}"
O = f"WITH {DIRTY_ORDERS}"  # noqa: E741
NOW = "2000-01-01"
SHORT = ["severity", "column", "issue", "count"]


@query(
    "n01_unnamed_columns",
    """SELECT 'moderate' AS severity, 'All columns' AS "column", 'unnamed_columns' AS issue, CAST(2 AS BIGINT) AS count,
    'Unnamed: 1, Column3' AS details FROM region LIMIT 1""",
)
def _(t):
    path = with_header(t, t.customer.select("c_custkey", "c_name", "c_nationkey"), "id,,Column3")
    rows = files.read_csv(t.spark, path)
    return inspect.structural(rows).select(*SHORT, "details")


@query(
    "n02_trailing_empty_rows",
    f"""WITH {TAILED} SELECT 'minor' AS severity, 'All columns' AS "column", 'trailing_empty_rows' AS issue,
    COUNT(*) FILTER (WHERE id > (SELECT MAX(id) FROM tailed WHERE name IS NOT NULL)) AS count FROM tailed""",
)
def _(t):
    return inspect.structural(tailed(t), "id").select(*SHORT)


@query(
    "n03_embedded_headers",
    """SELECT 'moderate' AS severity, 'All columns' AS "column", 'embedded_headers' AS issue, COUNT(*) AS count FROM nation WHERE n_nationkey % 10 = 0""",
)
def _(t):
    header = F.col("n_nationkey") % 10 == 0
    rows = t.nation.select(
        F.when(header, F.lit("key")).otherwise(F.col("n_nationkey").cast("string")).alias("key"),
        F.when(header, F.lit("Name ")).otherwise(F.col("n_name")).alias("name"),
    )
    return inspect.structural(rows).select(*SHORT)


def _missing_sql(columns: list[str], texts: list[str], source: str) -> str:
    parts = []
    for c in columns:
        test = f"{c} IS NULL" + (f" OR {sql_strip(c)} = ''" if c in texts else "")
        parts.append(f"""SELECT '{c}' AS col, COUNT(*) FILTER (WHERE {test}) AS m, COUNT(*) AS n FROM {source}""")
    return f"""SELECT CASE WHEN m = n OR m * 100.0 / n > 50 THEN 'critical' WHEN m * 100.0 / n > 10 THEN 'moderate' ELSE 'minor' END AS severity,
    col AS "column", CASE WHEN m = n THEN 'empty_column' ELSE 'missing_values' END AS issue, m AS count,
    {fx('m * 100.0 / n', 4)} AS percentage FROM ({' UNION ALL '.join(parts)}) WHERE m > 0"""


@query(
    "n04_completeness",
    f"{C} {_missing_sql(['id', 'name', 'segment', 'balance', 'email', 'phone', 'active', 'age', 'amount'], ['name', 'segment', 'balance', 'email', 'phone', 'active'], 'dirty')}",
)
def _(t):
    return inspect.completeness(dirty_customer(t)).select(*SHORT, fixed(F.col("percentage"), 4).alias("percentage"))


@query(
    "n05_mostly_missing_rows",
    f"""WITH {HOLLOW} SELECT 'moderate' AS severity, 'All columns' AS "column", 'mostly_missing_rows' AS issue,
    COUNT(*) FILTER (WHERE (name IS NULL)::INT + (balance IS NULL)::INT + (nothing IS NULL)::INT > 1.5) AS count FROM hollow""",
)
def _(t):
    return inspect.completeness(hollow(t)).where("issue = 'mostly_missing_rows'").select(*SHORT)


@query(
    "n06_duplicates",
    f"""{O} SELECT 'critical' AS severity, 'All columns' AS "column", 'duplicate_rows' AS issue, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS count FROM dirty
    UNION ALL SELECT 'critical', 'id', 'duplicate_unique_values', COUNT(id) - COUNT(DISTINCT id) FROM dirty""",
)
def _(t):
    return inspect.duplicates(dirty_orders(t)).select(*SHORT)


@query(
    "n07_numbers_in_text",
    rf"""{C}, x AS (SELECT balance, CAST(age AS VARCHAR) || '%' AS rate, CAST(id * 1000 AS VARCHAR) || ',5' AS big FROM dirty)
    SELECT 'moderate' AS severity, 'balance' AS "column", 'numeric_with_symbols' AS issue, COUNT(*) FILTER (WHERE CONTAINS(balance, '$')) AS count FROM x
    UNION ALL SELECT 'moderate', 'rate', 'numeric_with_percent', COUNT(*) FILTER (WHERE regexp_full_match(rate, '\s*-?\d+\.?\d*\s*%\s*')) FROM x
    UNION ALL SELECT 'moderate', 'big', 'numeric_with_commas', COUNT(*) FILTER (WHERE CONTAINS(big, ',')) FROM x""",
)
def _(t):
    rows = dirty_customer(t).select(
        "balance",
        F.concat(F.col("age").cast("string"), F.lit("%")).alias("rate"),
        F.concat((F.col("id") * 1000).cast("string"), F.lit(",5")).alias("big"),
    )
    return inspect.text_types(rows).select(*SHORT)


@query(
    "n08_dates_in_text",
    f"""{O} SELECT 'moderate' AS severity, 'order_date' AS "column", 'inconsistent_dates' AS issue, COUNT(order_date) AS count, 'MM/DD/YYYY, YYYY-MM-DD' AS details FROM dirty
    UNION ALL SELECT 'minor', 'iso', 'date_as_text', COUNT(*), 'YYYY-MM-DD' FROM dirty""",
)
def _(t):
    rows = dirty_orders(t).select("order_date", F.lit("2001-02-03").alias("iso"))
    return inspect.text_types(rows).select(*SHORT, "details")


@query(
    "n09_boolean_inconsistency",
    """SELECT 'moderate' AS severity, 'flag' AS "column", 'boolean_inconsistency' AS issue, COUNT(*) AS count, 'no, true, yes' AS details FROM orders""",
)
def _(t):
    word = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", " no").otherwise("TRUE")
    return inspect.text_types(t.orders.select(word.alias("flag"))).select(*SHORT, "details")


@query(
    "n10_mixed_types",
    f"""{C}, x AS (SELECT CASE WHEN id % 3 = 0 THEN 'unknown place' ELSE CAST(age AS VARCHAR) END AS v FROM dirty)
    SELECT 'moderate' AS severity, 'v' AS "column", 'mixed_types' AS issue, COUNT(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NULL) AS count FROM x""",
)
def _(t):
    v = F.when(F.col("id") % 3 == 0, "unknown place").otherwise(F.col("age").cast("string"))
    return inspect.text_types(dirty_customer(t).select(v.alias("v"))).select(*SHORT)


@query(
    "n11_formatting",
    f"""{C} SELECT 'minor' AS severity, 'name' AS "column", 'whitespace' AS issue, COUNT(*) FILTER (WHERE name <> {sql_strip('name')}) AS count FROM dirty
    UNION ALL SELECT 'minor', 'active', 'whitespace', COUNT(*) FILTER (WHERE active <> {sql_strip('active')}) FROM dirty
    UNION ALL SELECT 'moderate', 'segment', 'inconsistent_casing', COUNT(DISTINCT {sql_strip('segment')}) - COUNT(DISTINCT LOWER({sql_strip('segment')})) FROM dirty""",
)
def _(t):
    return inspect.formatting(dirty_customer(t).select("name", "active", "segment")).select(*SHORT)


def _sigma(column: str, value: str) -> str:
    return f"""(SELECT COUNT(*) FILTER (WHERE ABS(x - m) > 3 * s) FROM (SELECT {value} AS x FROM dirty),
    (SELECT AVG({value}) AS m, STDDEV_SAMP({value}) AS s FROM dirty))"""


@query(
    "n12_sigma_outliers",
    f"""{C}, f AS (SELECT 'spend' AS col, {_sigma('spend', 'POW(GREATEST(amount, 1) / 1000, 6)')} AS n)
    SELECT 'outlier' AS severity, col AS "column", 'statistical_outlier' AS issue, n AS count FROM f WHERE n > 0""",
)
def _(t):
    spend = F.pow(F.when(F.col("amount").isNotNull(), F.greatest("amount", F.lit(1.0))).otherwise(1.0) / 1000, 6.0)
    return inspect.outliers(dirty_customer(t).select(spend.alias("spend"))).select(*SHORT)


@query(
    "n13_negatives",
    f"""{C} SELECT 'outlier' AS severity, 'age' AS "column", 'negative_in_positive' AS issue, COUNT(*) FILTER (WHERE age < 0) AS count FROM dirty
    UNION ALL SELECT 'outlier', 'total', 'negative_in_positive', COUNT(*) FILTER (WHERE {sql_number('balance')} < 0) FROM dirty""",
)
def _(t):
    rows = dirty_customer(t).select("age", F.col("balance").alias("total"))
    return inspect.outliers(rows).where("issue = 'negative_in_positive'").select(*SHORT)


@query(
    "n14_date_outliers",
    f"""{O} SELECT 'outlier' AS severity, 'order_date' AS "column", 'future_dates' AS issue, COUNT(*) FILTER (WHERE {sql_date('order_date')} > DATE '{NOW}') AS count FROM dirty
    UNION ALL SELECT 'outlier', 'old', 'ancient_dates', COUNT(*) FROM dirty""",
)
def _(t):
    rows = dirty_orders(t).select("order_date", F.lit("1850-06-01").alias("old"))
    return inspect.date_outliers(rows, NOW).select(*SHORT)


@query("n15_plan_from_findings", f"""{O} SELECT DISTINCT id, STRFTIME({sql_date('order_date')}, '%Y-%m-%d') AS order_date FROM dirty""")
def _(t):
    rows = dirty_orders(t).select("id", "order_date")
    return apply_plan(rows, build_plan(inspect.duplicates(rows).unionByName(inspect.text_types(rows)))).df


@query("n15_full_inspection")
def _(t):
    return inspect.inspect(dirty_customer(t), NOW)


@query(
    "n16_clean_columns",
    """SELECT * FROM (VALUES ('amount'), ('customer'), ('priority')) v("column") WHERE EXISTS (SELECT 1 FROM orders)""",
)
def _(t):
    rows = dirty_orders(t)
    found = inspect.duplicates(rows).unionByName(inspect.text_types(rows)).unionByName(inspect.formatting(rows))
    return inspect.clean_columns(rows, found)


CODES = """codes AS (SELECT CAST(p_partkey AS VARCHAR) AS zip_code, CASE WHEN p_partkey % 7 = 0 THEN ' TBD' ELSE p_name END AS label,
  STRFTIME(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%Y%m%d') AS created FROM part)"""


@query(
    "n17_rule_proposals",
    f"""WITH {CODES}, l AS (SELECT LENGTH(zip_code) AS l, COUNT(*) AS n FROM codes GROUP BY 1),
    m AS (SELECT SUM(n) AS total, MAX(n) AS top, (SELECT l FROM l ORDER BY n DESC, l LIMIT 1) AS modal FROM l)
    SELECT 'leading_zero_postal_code' AS rule, 'zip_code' AS "column", {fx('(total - top) / total', 6)} AS share, CAST(modal AS VARCHAR) AS detail FROM m
    UNION ALL SELECT 'sentinel_value', 'label', {fx("COUNT(*) FILTER (WHERE LOWER(TRIM(label)) = 'tbd') / COUNT(*)", 6)}, 'tbd' FROM codes
    UNION ALL SELECT 'exotic_date_format', 'created', 1.0, 'yyyyMMdd' FROM (SELECT 1)""",
)
def _(t):
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("zip_code"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(" TBD")).otherwise(F.col("p_name")).alias("label"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "yyyyMMdd").alias("created"),
    )
    found = inspect.propose_rules(rows)
    return found.select("rule", "column", fixed(F.col("share"), 6).alias("share"), "detail")
