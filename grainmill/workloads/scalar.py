"""Scalar functions on whole tables and texts."""

from pyspark.sql import functions as F

from grainmill.functions import dates, mapping, numbers, text
from grainmill.functions.numbers import fixed
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
from grainmill.workloads.registry import fx, query

TITLE_SQL = (
    "ARRAY_TO_STRING(LIST_TRANSFORM(REGEXP_EXTRACT_ALL({0}, '[A-Za-z]+|[^A-Za-z]+'),"
    " LAMBDA w: UPPER(w[1]) || LOWER(w[2:])), '')"
)


@query("x01_strip_and_squeeze", f"WITH {DIRTY_CUSTOMER} SELECT id, {sql_squeeze('name')} AS name FROM dirty")
def _(t):
    return dirty_customer(t).select("id", text.squeeze(F.col("name")).alias("name"))


@query(
    "x01_squeeze_documents",
    rf"""SELECT doc_id, MD5(REGEXP_REPLACE({sql_strip('text')}, '[ \t\n\x0B\f\r]{{2,}}', ' ', 'g')) AS digest FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("digest"))


@query(
    "x02_upper_lower_title",
    f"""SELECT o_orderkey, UPPER(o_orderpriority) AS up, LOWER(o_orderpriority) AS low,
    {TITLE_SQL.format('o_orderpriority')} AS title FROM orders""",
)
def _(t):
    c = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", F.upper(c).alias("up"), F.lower(c).alias("low"), text.title_case(c).alias("title")
    )


_ALNUM = sql_squeeze(r"REGEXP_REPLACE(url, '[^A-Za-z0-9\s]', '', 'g')")
_PUNCT = sql_squeeze(r"""REGEXP_REPLACE(url, '[!@#$%^&*()_+=\[\]{};'':"\\|,.<>?/`~\-]', '', 'g')""")


@query("x03_remove_characters", f"SELECT page_id, {_ALNUM} AS letters, {_PUNCT} AS plain FROM pages")
def _(t):
    c = F.col("url")
    return t.pages.select(
        "page_id",
        text.remove_characters(c, "alphanumeric").alias("letters"),
        text.remove_characters(c, "punctuation").alias("plain"),
    )


@query(
    "x03_control_characters",
    rf"""SELECT doc_id, LENGTH({sql_squeeze(r"REGEXP_REPLACE(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]', '', 'g')")}) AS kept FROM documents""",
)
def _(t):
    kept = F.length(text.remove_characters(F.col("text"), "control"))
    return t.documents.select("doc_id", kept.cast("bigint").alias("kept"))


@query(
    "x04_find_and_replace",
    r"""SELECT page_id, REGEXP_REPLACE(REPLACE(url, 'http://', 'https://'), 'EXAMPLE', 'sample', 'gi') AS url,
    REGEXP_REPLACE(url, '\d+', '#', 'g') AS masked FROM pages""",
)
def _(t):
    c = text.find_replace(F.col("url"), [("http://", "https://")])
    c = text.find_replace(c, [("EXAMPLE", "sample")], case_sensitive=False)
    masked = text.find_replace(F.col("url"), [(r"\d+", "#")], use_regex=True)
    return t.pages.select("page_id", c.alias("url"), masked.alias("masked"))


@query(
    "x05_split_on_delimiter",
    """SELECT c_custkey, STRING_SPLIT(c_name, '#')[1] AS label, STRING_SPLIT(c_name, '#')[2] AS number,
    STRING_SPLIT(c_name, '#')[3] AS extra FROM customer""",
)
def _(t):
    c = F.col("c_name")
    return t.customer.select(
        "c_custkey", *[text.split_part(c, "#", i).alias(n) for i, n in enumerate(("label", "number", "extra"))]
    )


@query(
    "x06_merge_parts",
    f"""WITH {DIRTY_CUSTOMER} SELECT id, CONCAT_WS(' / ', NULLIF({sql_strip('name')}, ''), NULLIF({sql_strip('segment')}, ''),
    NULLIF({sql_strip('active')}, '')) AS merged FROM dirty""",
)
def _(t):
    cols = [F.col(c) for c in ("name", "segment", "active")]
    return dirty_customer(t).select("id", text.merge_parts(cols, " / ").alias("merged"))


@query(
    "x07_zero_pad",
    "SELECT p_partkey, CASE WHEN LENGTH(CAST(p_partkey AS VARCHAR)) < 8 THEN LPAD(CAST(p_partkey AS VARCHAR), 8, '0') ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part",
)
def _(t):
    return t.part.select("p_partkey", text.zero_pad(F.col("p_partkey").cast("string"), 8).alias("code"))


@query(
    "x08_length_and_words",
    rf"""SELECT doc_id, LENGTH(text) AS chars, CASE WHEN {sql_strip('text')} = '' THEN 0 ELSE
    LENGTH(REGEXP_SPLIT_TO_ARRAY({sql_strip('text')}, '[ \t\n\x0B\f\r]+')) END AS words FROM documents""",
)
def _(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", F.length(c).cast("bigint").alias("chars"), text.word_count(c).cast("bigint").alias("words")
    )


@query(
    "x09_edit_distance",
    """SELECT p_partkey, LEVENSHTEIN(LOWER(p_brand), 'brand#1') = 1 AS near FROM part""",
)
def _(t):
    return t.part.select("p_partkey", text.within_one_edit(F.col("p_brand"), F.lit("brand#1")).alias("near"))


@query(
    "x10_closest_spelling",
    f"WITH {DIRTY_CUSTOMER} SELECT DISTINCT SUBSTR(segment, 2, 20) AS word, LOWER(segment) AS match FROM dirty WHERE SUBSTR(segment, 2, 20) <> ''",
)
def _(t):
    from grainmill.functions.similarity import closest

    known = ["automobile", "building", "furniture", "household", "machinery"]
    words = dirty_customer(t).select(F.substring("segment", 2, 20).alias("word")).where(F.col("word") != "").distinct()
    return words.withColumn("match", closest(F.col("word"), known))


@query("x11_text_to_number", f"WITH {DIRTY_CUSTOMER} SELECT id, {sql_number('balance')} AS balance FROM dirty")
def _(t):
    return dirty_customer(t).select("id", numbers.to_number(F.col("balance")).alias("balance"))


@query(
    "x12_text_to_boolean",
    f"""WITH {DIRTY_CUSTOMER} SELECT id, CASE WHEN LOWER({sql_strip('active')}) IN ('yes', 'y', '1', 'true', 't') THEN TRUE
    WHEN LOWER({sql_strip('active')}) IN ('no', 'n', '0', 'false', 'f') THEN FALSE END AS active FROM dirty""",
)
def _(t):
    return dirty_customer(t).select("id", numbers.to_boolean(F.col("active")).alias("active"))


@query(
    "x13_synonyms",
    f"""WITH {DIRTY_ORDERS} SELECT id, CASE LOWER({sql_strip('status')}) WHEN 'f' THEN 'Finished' WHEN 'open' THEN 'Open'
    WHEN 'o' THEN 'Open' ELSE UPPER({sql_strip('status')}[1]) || LOWER({sql_strip('status')}[2:]) END AS status FROM dirty""",
)
def _(t):
    from grainmill.operators.clean import standard_kind

    kind = standard_kind(F.col("status"), {"f": "Finished", "open": "Open", "o": "Open"})
    return dirty_orders(t).select("id", kind.alias("status"))


@query(
    "x14_ordinal_mapping",
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3
    WHEN '1-URGENT' THEN 4 ELSE 0 END AS INTEGER) AS place FROM orders""",
)
def _(t):
    places = {"5-LOW": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}
    return t.orders.select("o_orderkey", mapping.map_values(F.col("o_orderpriority"), places, 0).alias("place"))


@query(
    "x15_bands",
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN NULL WHEN o_totalprice <= 50000 THEN '<50K'
    WHEN o_totalprice <= 100000 THEN '50K-100K' WHEN o_totalprice <= 150000 THEN '100K-150K'
    WHEN o_totalprice <= 200000 THEN '150K-200K' WHEN o_totalprice <= 300000 THEN '200K-300K' ELSE '300K+' END AS band FROM orders""",
)
def _(t):
    from grainmill.operators.salary import BAND_EDGES, BAND_LABELS

    return t.orders.select("o_orderkey", numbers.band(F.col("o_totalprice"), BAND_EDGES, BAND_LABELS).alias("band"))


@query(
    "x16_rare_to_other",
    """WITH k AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY COUNT(*) DESC, c_nationkey LIMIT 10)
    SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT c_nationkey FROM k) THEN CAST(c_nationkey AS VARCHAR) ELSE 'Other' END AS grp
    FROM customer""",
)
def _(t):
    top = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = top.orderBy(F.col("n").desc(), "k").limit(10).select("k")
    joined = t.customer.join(F.broadcast(top), F.col("c_nationkey") == F.col("k"), "left")
    return joined.select("c_custkey", F.coalesce(F.col("k").cast("string"), F.lit("Other")).alias("grp"))


@query(
    "x17_date_parts",
    """SELECT event_id, CAST(YEAR(ts) AS INTEGER) AS year, CAST(QUARTER(ts) AS INTEGER) AS quarter, CAST(MONTH(ts) AS INTEGER) AS month,
    CAST(DAY(ts) AS INTEGER) AS day, CAST(HOUR(ts) AS INTEGER) AS hour, CAST((ISODOW(ts) - 1) AS INTEGER) AS weekday,
    ISODOW(ts) >= 6 AS is_weekend, CAST(WEEKOFYEAR(ts) AS INTEGER) AS iso_week, MONTHNAME(ts) AS month_name, DAYNAME(ts) AS day_name FROM events""",
)
def _(t):
    return t.events.select("event_id", *[c.alias(n) for n, c in dates.date_parts(F.col("ts")).items()])


@query(
    "x18_format_dates",
    f"""WITH {DIRTY_ORDERS} SELECT id, STRFTIME({sql_date('order_date')}, '%d/%m/%Y') AS european,
    STRFTIME({sql_date('order_date')}, '%Y/%m/%d') AS slash FROM dirty""",
)
def _(t):
    moment = dates.parse_mixed(F.col("order_date"))
    return dirty_orders(t).select(
        "id",
        F.date_format(moment, dates.TARGET_FORMATS["european"]).alias("european"),
        F.date_format(moment, dates.TARGET_FORMATS["slash"]).alias("slash"),
    )


@query(
    "x19_years_before",
    "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR AS DATE) AS VARCHAR) AS earlier FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", dates.years_before(F.to_date("o_orderdate"), 3).cast("string").alias("earlier"))


@query(
    "x20_powers_and_roots",
    f"""SELECT p_partkey, {fx('POW(p_retailprice / 900, 1.0 / 3) - 1', 6)} AS growth, {fx('SQRT(p_size)', 6)} AS root FROM part""",
)
def _(t):
    growth = F.pow(F.col("p_retailprice") / 900, F.lit(1.0) / 3) - 1
    return t.part.select("p_partkey", fixed(growth, 6).alias("growth"), fixed(F.sqrt("p_size"), 6).alias("root"))


@query("x21_modulo", "SELECT l_orderkey, l_linenumber, l_quantity % 5 = 0 AS fives FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 5 == 0).alias("fives"))


@query(
    "x22_clip",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS balance FROM customer",
)
def _(t):
    bounded = numbers.clip(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0))
    return t.customer.select("c_custkey", bounded.alias("balance"))


@query(
    "x23_null_if_sentinel",
    f"WITH {DIRTY_CUSTOMER} SELECT id, CASE WHEN LOWER({sql_strip('balance')}) NOT IN ('n/a', 'tbd') THEN balance END AS balance FROM dirty",
)
def _(t):
    return dirty_customer(t).select("id", text.null_if_sentinel(F.col("balance"), ["N/A", "tbd"]).alias("balance"))


@query("x24_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    "x25_date_form_names",
    r"""WITH """
    + DIRTY_ORDERS
    + r""" SELECT id, CASE WHEN regexp_full_match(order_date, '\d{4}-\d{2}-\d{2}') THEN 'YYYY-MM-DD'
    WHEN regexp_full_match(order_date, '\d{2}/\d{2}/\d{4}') THEN 'MM/DD/YYYY' END AS form FROM dirty""",
)
def _(t):
    return dirty_orders(t).select("id", dates.format_name(F.col("order_date")).alias("form"))


@query(
    "k12_mixed_dates",
    f"WITH {DIRTY_ORDERS} SELECT id, STRFTIME({sql_date('order_date')}, '%Y-%m-%d') AS day FROM dirty",
)
def _(t):
    return dirty_orders(t).select("id", F.date_format(dates.parse_mixed(F.col("order_date")), "yyyy-MM-dd").alias("day"))


@query(
    "k06_skew",
    f"SELECT l_returnflag, {fx('SKEWNESS(l_extendedprice)', 6)} AS skew FROM lineitem GROUP BY 1",
)
def _(t):
    from grainmill.functions.stats import skew

    return t.lineitem.groupBy("l_returnflag").agg(fixed(skew(F.col("l_extendedprice")), 6).alias("skew"))
