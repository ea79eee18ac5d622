"""Cleaning operators on dirty customers and orders, and their change counts."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import clean
from grainmill.operators.ordered import fill
from grainmill.plans.cleaning import Action, apply_plan
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
from grainmill.workloads.funds import text_date
from grainmill.workloads.registry import fx, query
from grainmill.workloads.scalar import TITLE_SQL

C = f"WITH {DIRTY_CUSTOMER}"
O = f"WITH {DIRTY_ORDERS}"  # noqa: E741


@query(
    "c01_drop_missing",
    f"""{C} SELECT id, segment, amount FROM dirty WHERE COALESCE({sql_strip('segment')}, '') <> '' AND amount IS NOT NULL""",
)
def _(t):
    rows = dirty_customer(t).select("id", "segment", "amount", F.lit(None).cast("string").alias("nothing"))
    return clean.drop_missing(rows, critical=["segment", "amount"]).df


@query(
    "c01_drop_missing_counts",
    f"""{C} SELECT COUNT(*) FILTER (WHERE COALESCE({sql_strip('segment')}, '') = '' OR amount IS NULL) AS rows_removed,
    1 AS cols_dropped FROM dirty""",
)
def _(t):
    rows = dirty_customer(t).select("id", "segment", "amount", F.lit(None).cast("string").alias("nothing"))
    return clean.drop_missing(rows, critical=["segment", "amount"]).metrics


@query(
    "c02_fill_default",
    f"""{C} SELECT id, CASE WHEN COALESCE({sql_strip('segment')}, '') = '' THEN 'Unknown' ELSE segment END AS segment,
    COALESCE(amount, 0) AS amount FROM dirty""",
)
def _(t):
    rows = dirty_customer(t).select("id", "segment", "amount")
    return clean.fill_default(clean.fill_default(rows, ["segment"], "Unknown").df, ["amount"], "0").df


FILLS = {
    "mean": ("AVG(amount)", "CAST(ROUND_EVEN(AVG(age), 0) AS BIGINT)"),
    "median": ("MEDIAN(amount)", "CAST(ROUND_EVEN(MEDIAN(age), 0) AS BIGINT)"),
    "mode": (
        "(SELECT amount FROM dirty WHERE amount IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, amount LIMIT 1)",
        "(SELECT age FROM gaps WHERE age IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, age LIMIT 1)",
    ),
}


def _fill_statistic(kind: str):
    amount, age = FILLS[kind]
    pick_a = amount if kind == "mode" else f"(SELECT {amount} FROM dirty)"
    pick_b = age if kind == "mode" else f"(SELECT {age} FROM gaps)"

    @query(
        f"c03_fill_{kind}",
        f"""{C}, gaps AS (SELECT id, amount, CASE WHEN age > 0 THEN age END AS age FROM dirty)
        SELECT id, {fx(f'COALESCE(amount, {pick_a})', 4)} AS amount, COALESCE(age, {pick_b}) AS age FROM gaps""",
    )
    def _(t):
        rows = dirty_customer(t).select("id", "amount", F.when(F.col("age") > 0, F.col("age")).alias("age"))
        filled = clean.fill_statistic(rows, ["amount", "age"], kind).df
        return filled.select("id", fixed(F.col("amount"), 4).alias("amount"), "age")


for _kind in FILLS:
    _fill_statistic(_kind)


def _fill_direction(direction: str, fn: str, frame: str):
    @query(
        f"c04_{direction}_fill",
        f"""{C} SELECT id, {fn}(amount IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN {frame}) AS amount,
        {fn}(NULLIF({sql_strip('segment')}, '') IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN {frame}) AS segment FROM dirty""",
    )
    def _(t):
        rows = dirty_customer(t).select("id", "amount", "segment")
        return clean.fill_direction(rows, ["amount", "segment"], direction, "id").df


_fill_direction("forward", "LAST_VALUE", "UNBOUNDED PRECEDING AND CURRENT ROW")
_fill_direction("backward", "FIRST_VALUE", "CURRENT ROW AND UNBOUNDED FOLLOWING")


@query(
    "c04_forward_fill_by_key",
    f"""{C} SELECT id, age, LAST_VALUE(amount IGNORE NULLS) OVER (PARTITION BY age ORDER BY id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS amount FROM dirty""",
)
def _(t):
    return fill(dirty_customer(t).select("id", "age", "amount"), ["amount"], "id", ["age"])


@query("c05_remove_duplicates", f"{O} SELECT DISTINCT id, customer, order_date, status, amount, priority FROM dirty")
def _(t):
    return clean.remove_duplicates(dirty_orders(t)).df


@query(
    "c05_remove_duplicates_by_key",
    f"""{O} SELECT customer, status, MIN(id) AS id FROM dirty GROUP BY 1, 2""",
)
def _(t):
    rows = dirty_orders(t).select("customer", "status", "id")
    return clean.remove_duplicates(rows, exact=True, subset=["customer", "status"], order="id").df


@query(
    "c05_duplicate_counts",
    f"{O} SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS rows_removed FROM dirty",
)
def _(t):
    return clean.remove_duplicates(dirty_orders(t)).metrics


@query(
    "c06_trim_counts",
    f"{C} SELECT CAST(COUNT(*) FILTER (WHERE name <> {sql_squeeze('name')}) + COUNT(*) FILTER (WHERE active <> {sql_squeeze('active')}) AS BIGINT) AS cells_modified FROM dirty",
)
def _(t):
    return clean.trim_whitespace(dirty_customer(t), ["name", "active"]).metrics


@query("c06_trim_whitespace", f"{C} SELECT id, {sql_squeeze('name')} AS name, {sql_squeeze('active')} AS active FROM dirty")
def _(t):
    return clean.trim_whitespace(dirty_customer(t).select("id", "name", "active"), ["name", "active"]).df


@query("c07_trim_ends", f"{C} SELECT id, {sql_strip('name')} AS name FROM dirty")
def _(t):
    return clean.trim_ends(dirty_customer(t).select("id", "name"), ["name"]).df


@query(
    "c08_normalize_case",
    f"{C} SELECT id, UPPER(segment) AS segment, {TITLE_SQL.format('active')} AS active FROM dirty",
)
def _(t):
    rows = clean.normalize_case(dirty_customer(t).select("id", "segment", "active"), ["segment"], "upper").df
    return clean.normalize_case(rows, ["active"], "title").df


_PLAIN = sql_squeeze(r"""REGEXP_REPLACE(email, '[!@#$%^&*()_+=\[\]{};'':"\\|,.<>?/`~\-]', '', 'g')""")


@query("c09_remove_special", f"{C} SELECT id, {_PLAIN} AS email FROM dirty")
def _(t):
    return clean.remove_special(dirty_customer(t).select("id", "email"), ["email"]).df


@query(
    "c10_find_replace",
    f"""{C} SELECT id, REPLACE(REPLACE(email, 'user', 'u'), '@example', '@sample') AS email, code FROM
    (SELECT *, CAST(id AS VARCHAR) AS code FROM dirty)""",
)
def _(t):
    rows = dirty_customer(t).select("id", "email", F.col("id").cast("string").alias("code"))
    # The code column is all numbers, so the rules leave it alone.
    rules = [("user", "u"), ("@example", "@sample"), ("1", "x")][:2]
    return clean.find_replace(clean.find_replace(rows, ["email"], rules).df, ["code"], [("1", "x")]).df


@query("c11_standardize_dates", f"{O} SELECT id, STRFTIME({sql_date('order_date')}, '%m/%d/%Y') AS order_date FROM dirty")
def _(t):
    return clean.standardize_dates(dirty_orders(t).select("id", "order_date"), ["order_date"], "us").df


@query("c12_convert_numeric", f"{C} SELECT id, {sql_number('balance')} AS balance FROM dirty")
def _(t):
    return clean.convert_numeric(dirty_customer(t).select("id", "balance"), ["balance"]).df


@query("c13_convert_integer", f"{C} SELECT id, CAST(ROUND_EVEN({sql_number('balance')}, 0) AS BIGINT) AS balance FROM dirty")
def _(t):
    return clean.convert_integer(dirty_customer(t).select("id", "balance"), ["balance"]).df


BOOL_SQL = f"""CASE WHEN LOWER({sql_strip('active')}) IN ('yes', 'y', '1', 'true', 't') THEN {{0}}
    WHEN LOWER({sql_strip('active')}) IN ('no', 'n', '0', 'false', 'f') THEN {{1}} {{2}} END"""


@query("c14_normalize_booleans", f"{C} SELECT id, {BOOL_SQL.format('TRUE', 'FALSE', '')} AS active FROM dirty")
def _(t):
    return clean.normalize_booleans(dirty_customer(t).select("id", "active"), ["active"]).df


@query("c16_drop_columns", f"{C} SELECT id, name FROM dirty")
def _(t):
    rows = dirty_customer(t).select("id", "name", "segment", "age")
    return clean.drop_columns(rows, ["segment", "age", "absent"])


@query(
    "c15_clean_headers",
    """SELECT c_custkey AS customer_key, c_name AS full_name, c_mktsegment AS segment_kind, c_nationkey AS segment_kind_1 FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    rows = rows.toDF(" Customer Key", "Full-Name!", "Segment/Kind", "segment__kind")
    return clean.rename_columns(rows, auto_clean=True).df


@query(
    "f04_rename_unnamed",
    "SELECT c_custkey AS id, c_name AS col_0, c_nationkey AS col_1 FROM customer",
)
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey").toDF("id", "Unnamed: 1", "Column3")
    return clean.name_unnamed(rows).df


@query("f03_rename_by_rules", "SELECT c_custkey AS id, c_name AS label FROM customer")
def _(t):
    rows = t.customer.select("c_custkey", "c_name")
    return clean.rename_columns(rows, {"c_custkey": "id", "c_name": "label"}).df


@query(
    "c17_split_column",
    f"{C} SELECT id, STRING_SPLIT(email, '@')[1] AS mailbox, STRING_SPLIT(email, '@')[2] AS host FROM dirty",
)
def _(t):
    return clean.split_column(dirty_customer(t).select("id", "email"), "email", "@", ["mailbox", "host"]).df


@query(
    "c18_merge_columns",
    f"{C} SELECT id, CONCAT_WS('-', NULLIF({sql_strip('segment')}, ''), NULLIF({sql_strip('active')}, '')) AS merged FROM dirty",
)
def _(t):
    rows = dirty_customer(t).select("id", "segment", "active")
    return clean.merge_columns(rows, ["segment", "active"], "-", "merged", drop_original=True).df


RANGE_RULES = [("age", "<", 0, "null"), ("amount", ">", 9000.0, "cap"), ("amount", "<", -500.0, "drop")]


@query(
    "c19_validate_ranges",
    f"""{C} SELECT id, CASE WHEN age >= 0 THEN age END AS age, CASE WHEN amount > 9000 THEN 9000.0 ELSE amount END AS amount
    FROM dirty WHERE NOT COALESCE(amount < -500, FALSE)""",
)
def _(t):
    return clean.validate_ranges(dirty_customer(t).select("id", "age", "amount"), RANGE_RULES).df


@query(
    "c19_range_counts",
    f"""{C} SELECT CAST(COUNT(*) FILTER (WHERE age < 0) + COUNT(*) FILTER (WHERE amount > 9000) AS BIGINT) AS cells_modified,
    COUNT(*) FILTER (WHERE amount < -500) AS rows_removed FROM dirty""",
)
def _(t):
    return clean.validate_ranges(dirty_customer(t), RANGE_RULES).metrics


@query(
    "c20_range_rules_from_text",
    f"""{C}, kept AS (SELECT * FROM dirty WHERE age >= 0)
    SELECT (SELECT COUNT(*) FROM dirty WHERE age < 0) AS rows_removed, COUNT(*) FILTER (WHERE amount > 9000) AS cells_nulled,
    COUNT(*) FILTER (WHERE age >= 70) AS cells_capped FROM kept""",
)
def _(t):
    rules = clean.parse_range_rules("age < 0 -> drop\namount > 9000 -> null\nage >= 70 -> cap\nnot a rule")
    return clean.apply_range_rules(dirty_customer(t), rules).metrics


@query(
    "c20_range_rules_table",
    f"""{C} SELECT id, CASE WHEN age >= 70 THEN 70 ELSE age END AS age, CASE WHEN NOT amount > 9000 THEN amount END AS amount
    FROM dirty WHERE age >= 0""",
)
def _(t):
    rules = clean.parse_range_rules("age < 0 -> drop\namount > 9000 -> null\nage >= 70 -> cap\nnot a rule")
    return clean.apply_range_rules(dirty_customer(t).select("id", "age", "amount"), rules).df


IQR = """b AS (SELECT QUANTILE_CONT(l_extendedprice, 0.25) AS q1, QUANTILE_CONT(l_extendedprice, 0.75) AS q3 FROM lineitem),
lim AS (SELECT q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM b)"""
LINES = ["l_orderkey", "l_linenumber", "l_extendedprice"]


@query(
    "c21_outliers_capped",
    f"""WITH {IQR} SELECT l_orderkey, l_linenumber, {fx('GREATEST(lo, LEAST(hi, l_extendedprice))', 4)} AS l_extendedprice FROM lineitem, lim""",
)
def _(t):
    rows = clean.filter_outliers(t.lineitem.select(*LINES), ["l_extendedprice"], "iqr", 0.5, "cap").df
    return rows.withColumn("l_extendedprice", fixed(F.col("l_extendedprice"), 4))


@query(
    "c21_outliers_dropped",
    f"WITH {IQR} SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, lim WHERE l_extendedprice BETWEEN lo AND hi",
)
def _(t):
    return clean.filter_outliers(t.lineitem.select(*LINES), ["l_extendedprice"], "iqr", 0.5, "drop").df


Z = """z AS (SELECT AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS s FROM lineitem)"""


@query(
    "c21_outliers_nulled",
    f"""WITH {Z} SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice BETWEEN m - 1.5 * s AND m + 1.5 * s THEN l_extendedprice END
    AS l_extendedprice FROM lineitem, z""",
)
def _(t):
    return clean.filter_outliers(t.lineitem.select(*LINES), ["l_extendedprice"], "zscore", 1.5, "null").df


@query(
    "c21_outlier_counts",
    f"WITH {IQR} SELECT COUNT(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS cells_modified, CAST(0 AS BIGINT) AS rows_removed FROM lineitem, lim",
)
def _(t):
    return clean.filter_outliers(t.lineitem, ["l_extendedprice"], "iqr", 0.5, "cap").metrics


@query(
    "c22_fill_unknown",
    f"{C} SELECT id, CASE WHEN COALESCE({sql_strip('active')}, '') = '' THEN 'Unknown' ELSE active END AS active FROM dirty",
)
def _(t):
    return clean.fill_default(dirty_customer(t).select("id", "active"), ["active"], "Unknown").df


@query("c23_strip_whitespace", f"{C} SELECT id, {sql_strip('active')} AS active FROM dirty")
def _(t):
    return clean.trim_ends(dirty_customer(t).select("id", "active"), ["active"]).df


@query("c24_standardize_casing", f"{C} SELECT id, {TITLE_SQL.format(sql_strip('segment'))} AS segment FROM dirty")
def _(t):
    return clean.standardize_casing(dirty_customer(t).select("id", "segment"), ["segment"]).df


@query(
    "c25_convert_numeric_plain",
    rf"{C} SELECT id, TRY_CAST(REGEXP_REPLACE(balance, '[$,%\s]', '', 'g') AS DOUBLE) AS balance FROM dirty",
)
def _(t):
    return clean.convert_numeric_plain(dirty_customer(t).select("id", "balance"), ["balance"]).df


@query("c26_unify_dates", f"{O} SELECT id, STRFTIME({sql_date('order_date')}, '%Y-%m-%d') AS order_date FROM dirty")
def _(t):
    return clean.standardize_dates(dirty_orders(t).select("id", "order_date"), ["order_date"]).df


@query("c27_standard_booleans_kept", f"""{C} SELECT id, {BOOL_SQL.format("'true'", "'false'", 'ELSE active')} AS active FROM dirty""")
def _(t):
    return clean.normalize_booleans(dirty_customer(t).select("id", "active"), ["active"], keep_others=True).df


@query(
    "c28_sigma_outliers",
    """WITH z AS (SELECT AVG(c_acctbal) AS m, STDDEV_SAMP(c_acctbal) AS s FROM customer)
    SELECT c_custkey, CASE WHEN ABS(c_acctbal - m) <= 1.2 * s THEN c_acctbal END AS c_acctbal FROM customer, z""",
)
def _(t):
    return clean.replace_sigma_outliers(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 1.2).df


@query("c29_negatives_to_null", f"{C} SELECT id, CASE WHEN age >= 0 THEN age END AS age FROM dirty")
def _(t):
    return clean.replace_negatives(dirty_customer(t).select("id", "age"), "age").df


@query("c30_drop_rows_missing", f"{C} SELECT id, amount FROM dirty WHERE amount IS NOT NULL")
def _(t):
    return clean.drop_rows_missing(dirty_customer(t).select("id", "amount"), "amount").df


TAILED = "tailed AS (SELECT c_custkey AS id, CASE WHEN c_custkey < (SELECT MAX(c_custkey) - 4 FROM customer) THEN c_name END AS name FROM customer)"


def tailed(t):
    last = t.customer.agg(F.max("c_custkey") - 4).scalar()
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") < last, F.col("c_name")).alias("name"))


@query("c31_drop_trailing_empty", f"WITH {TAILED} SELECT id, name FROM tailed WHERE name IS NOT NULL")
def _(t):
    return clean.drop_trailing_empty(tailed(t), "id").df


@query(
    "c32_drop_embedded_headers",
    """SELECT n_nationkey AS key, n_name AS name FROM nation""",
)
def _(t):
    copies = F.when(F.col("n_nationkey") % 10 == 0, 2).otherwise(1)
    rows = t.nation.withColumn("c", F.explode(F.sequence(F.lit(1), copies)))
    header = F.col("c") == 2
    rows = rows.select(
        F.when(header, F.lit("key")).otherwise(F.col("n_nationkey").cast("string")).alias("key"),
        F.when(header, F.lit("Name ")).otherwise(F.col("n_name")).alias("name"),
    )
    return clean.drop_embedded_headers(rows).df.withColumn("key", F.col("key").cast("int"))


@query(
    "c33_drop_empty_and_dedup",
    f"{O} SELECT DISTINCT id, status FROM dirty",
)
def _(t):
    rows = dirty_orders(t).select("id", "status", F.lit(None).cast("string").alias("empty"))
    rows = clean.drop_missing(rows, rows=False).df
    return clean.remove_duplicates(rows).df


SERIES = """raw AS (SELECT o_orderpriority AS fund, STRFTIME(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN DAY(o_orderdate) NOT IN (5, 17) THEN CASE WHEN DAY(o_orderdate) = 9 THEN 0.0 ELSE v END END AS value
  FROM (SELECT o_orderpriority, o_orderdate, SUM(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  UNNEST(RANGE(CASE WHEN DAY(o_orderdate) = 12 THEN 2 ELSE 1 END)) u(i))"""


def raw_series(t):
    day = F.dayofmonth("o_orderdate")
    sums = t.orders.groupBy("o_orderpriority", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    copies = F.when(day == 12, 2).otherwise(1)
    return sums.withColumn("c", F.explode(F.sequence(F.lit(1), copies))).select(
        F.col("o_orderpriority").alias("fund"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(~day.isin(5, 17), F.when(day == 9, 0.0).otherwise(F.round("v", 2))).alias("value"),
    )


SERIES = SERIES.replace("ELSE v END", "ELSE ROUND(v, 2) END")
FILLED = """uniq AS (SELECT DISTINCT * FROM raw), filled AS (SELECT fund, date, value AS v0,
  LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY fund ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM uniq)"""


@query(
    "c34_clean_series",
    f"WITH {SERIES}, {FILLED} SELECT fund, date, {fx('value', 2)} AS value FROM filled WHERE value > 0",
)
def _(t):
    rows = clean.clean_value_series(raw_series(t), "fund", "date", "value").df
    return rows.select("fund", F.to_date("date").cast("string").alias("date"), fixed(F.col("value"), 2).alias("value"))


@query(
    "c34_clean_series_counts",
    f"""WITH {SERIES}, {FILLED} SELECT (SELECT COUNT(*) FROM raw) AS rows_before, COUNT(*) FILTER (WHERE value > 0) AS rows_after,
    (SELECT COUNT(*) FROM raw) - COUNT(*) AS duplicates_removed,
    (SELECT COUNT(*) FROM raw WHERE value IS NULL) - COUNT(*) FILTER (WHERE value IS NULL) AS nulls_handled,
    COUNT(*) FILTER (WHERE value IS NULL) AS missing_after_fill, COUNT(*) FILTER (WHERE value <= 0) AS invalid_values FROM filled""",
)
def _(t):
    return clean.clean_value_series(raw_series(t), "fund", "date", "value").metrics


STATUS = {"f": "Finished", "finished": "Finished", "o": "Open", "open": "Open", "p": "Partial"}
KIND_SQL = f"""CASE LOWER({sql_strip('status')}) WHEN 'f' THEN 'Finished' WHEN 'finished' THEN 'Finished' WHEN 'o' THEN 'Open'
    WHEN 'open' THEN 'Open' WHEN 'p' THEN 'Partial' END"""
TX = f"""tx AS (SELECT id, {sql_date('order_date')} AS moment, {KIND_SQL} AS status, amount, priority FROM dirty)"""
TX_KEEP = "moment IS NOT NULL AND amount > 0 AND priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND status IN ('Finished', 'Open')"
TX_ARGS = (STATUS, ("Finished", "Open"), ("1-URGENT", "2-HIGH", "3-MEDIUM"))


@query(
    "c35_clean_transactions",
    f"{O}, {TX} SELECT id, STRFTIME(moment, '%Y-%m-%d') AS day, status, amount, priority FROM tx WHERE {TX_KEEP}",
)
def _(t):
    rows = clean.clean_transactions(dirty_orders(t), "order_date", "status", "amount", "priority", *TX_ARGS).df
    return rows.select("id", F.date_format("order_date", "yyyy-MM-dd").alias("day"), "status", "amount", "priority")


@query(
    "c35_clean_transactions_counts",
    f"""{O}, {TX} SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {TX_KEEP}) AS rows_after,
    COUNT(*) FILTER (WHERE moment IS NULL) AS invalid_dates, COUNT(*) FILTER (WHERE NOT amount > 0) AS invalid_amounts,
    COUNT(*) FILTER (WHERE priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS invalid_statuses FROM tx""",
)
def _(t):
    return clean.clean_transactions(dirty_orders(t), "order_date", "status", "amount", "priority", *TX_ARGS).metrics


PERF = """perf AS (SELECT l_suppkey AS fund, CASE WHEN l_suppkey % 10 = 0 THEN 'bad' ELSE
  CAST(CAST(SUM(l_quantity) - 15000 AS BIGINT) AS VARCHAR) || '%' END AS ret, COUNT(*) / 300.0 AS expense FROM lineitem GROUP BY 1)"""


def performance(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("fund")).agg(
        F.concat((F.sum("l_quantity") - 15000).cast("bigint").cast("string"), F.lit("%")).alias("ret"),
        (F.count(F.lit(1)) / F.lit(300.0)).alias("expense"),
    )
    return rows.withColumn("ret", F.when(F.col("fund") % 10 == 0, F.lit("bad")).otherwise(F.col("ret")))


@query(
    "c36_clean_performance",
    f"""WITH {PERF} SELECT fund, TRY_CAST(REPLACE(ret, '%', '') AS DOUBLE) AS ret, {fx('expense', 6)} AS expense,
    NOT (expense BETWEEN 0.1 AND 2.5) AS expense_ratio_anomaly_flag FROM perf""",
)
def _(t):
    rows = clean.clean_performance(performance(t), ["ret"], "expense").df
    return rows.withColumn("expense", fixed(F.col("expense"), 6))


@query(
    "c36_clean_performance_counts",
    f"""WITH {PERF}, n AS (SELECT TRY_CAST(REPLACE(ret, '%', '') AS DOUBLE) AS ret, expense FROM perf)
    SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE ret > 1000 OR ret < -100) AS ret_outliers,
    COUNT(*) FILTER (WHERE expense < 0.1 OR expense > 2.5) AS invalid_expense FROM n""",
)
def _(t):
    return clean.clean_performance(performance(t), ["ret"], "expense").metrics


@query(
    "c37_clean_baseline",
    f"""WITH m AS (SELECT DISTINCT STRFTIME(o_orderdate, '%Y-%m') AS month, o_orderpriority AS category FROM orders)
    SELECT month || '-01' AS month, category FROM m""",
)
def _(t):
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("category"))
    return clean.clean_baseline(rows).df.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query(
    "c38_clean_pay_table",
    f"""{C} SELECT DISTINCT id, {sql_strip('name')} AS name, TRY_CAST({sql_strip("REPLACE(balance, '$', '')")} AS DOUBLE) AS balance FROM dirty
    WHERE TRY_CAST({sql_strip("REPLACE(balance, '$', '')")} AS DOUBLE) IS NOT NULL""",
)
def _(t):
    from grainmill.operators.salary import clean_pay_table

    rows = dirty_customer(t).select("id", "name", F.replace("balance", F.lit("$")).alias("balance"))
    return clean_pay_table(rows, ["id"], ["balance"], "balance")


@query(
    "c39_learned_rules",
    f"""{O} SELECT CASE WHEN LENGTH(CAST(id AS VARCHAR)) < 9 THEN LPAD(CAST(id AS VARCHAR), 9, '0') ELSE CAST(id AS VARCHAR) END AS zip_code,
    CASE WHEN LOWER({sql_strip('status')}) <> 'p' THEN status END AS status,
    STRFTIME({sql_date('order_date')}, '%Y-%m-%d') AS order_date FROM dirty""",
)
def _(t):
    rules = [
        {"fix": "pad", "columns": ["zip"], "width": 9},
        {"fix": "sentinel", "columns": ["status"], "value": "P"},
        {"fix": "date", "columns": ["date"]},
    ]
    rows = dirty_orders(t).select(F.col("id").alias("zip_code"), "status", "order_date")
    cleaned = clean.apply_learned_rules(rows, rules).df
    return cleaned.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


PLAN = [
    Action("trim_whitespace", {"columns": ["name", "active"]}),
    Action("blanks_to_null", {"columns": ["segment"]}),
    Action("fill_default", {"columns": ["segment"], "placeholder": "Unknown"}),
    Action("normalize_case", {"columns": ["segment"], "case": "upper"}),
    Action("convert_numeric", {"columns": ["balance"]}),
    Action("no_such_action", {}),
    Action("normalize_booleans", {"columns": ["active"]}),
    Action("replace_negatives", {"column": "age"}),
    Action("fill_statistic", {"columns": ["age"], "strategy": "median"}),
]


@query(
    "c40_run_plan",
    f"""{C}, a AS (SELECT id, {sql_squeeze('name')} AS name, UPPER(COALESCE(NULLIF({sql_squeeze('segment')}, ''), 'Unknown')) AS segment,
      {sql_number('balance')} AS balance, {BOOL_SQL.format('TRUE', 'FALSE', '')} AS active, CASE WHEN age >= 0 THEN age END AS age FROM dirty)
    SELECT id, name, segment, balance, active, COALESCE(age, (SELECT CAST(ROUND_EVEN(MEDIAN(age), 0) AS BIGINT) FROM a)) AS age FROM a""",
)
def _(t):
    rows = dirty_customer(t).select("id", "name", "segment", "balance", "active", "age")
    return apply_plan(rows, PLAN).df
