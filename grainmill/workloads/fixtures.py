"""Dirty inputs made from the clean tables by fixed rules, written once for Spark and once for SQL."""

from pyspark.sql import functions as F

from grainmill.workloads.registry import Tables

DIRTY_CUSTOMER = """dirty AS (SELECT c_custkey AS id,
  CASE WHEN c_custkey % 5 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN LOWER(c_mktsegment)
    ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 13 = 0 THEN 'n/a' WHEN c_acctbal < 0 THEN '(' || PRINTF('%.2f', -c_acctbal) || ')'
    ELSE '$' || PRINTF('%.2f', c_acctbal) END AS balance,
  CASE WHEN c_custkey % 9 = 0 THEN 'bad.address' ELSE 'user' || c_custkey || '@example.com' END AS email,
  CASE WHEN c_custkey % 10 = 0 THEN '12-AB' ELSE '+1 555 ' || LPAD(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone,
  CASE c_custkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f' WHEN 4 THEN '1'
    WHEN 5 THEN 'maybe' WHEN 7 THEN ' Y ' END AS active,
  CASE WHEN c_custkey % 50 = 0 THEN -5 ELSE 20 + c_custkey % 60 END AS age,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS amount
  FROM customer)"""


def dirty_customer(t: Tables):
    k, name, seg, bal = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal")
    words = {0: "Yes", 1: "no", 2: "TRUE", 3: "f", 4: "1", 5: "maybe", 7: " Y "}
    active = F.lit(None).cast("string")
    for rest, word in words.items():
        active = F.when(k % 8 == rest, word).otherwise(active)
    return t.customer.select(
        k.alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name).alias("name"),
        F.when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.lower(seg)).otherwise(seg).alias("segment"),
        F.when(k % 13 == 0, F.lit("n/a"))
        .when(bal < 0, F.concat(F.lit("("), F.format_string("%.2f", -bal), F.lit(")")))
        .otherwise(F.concat(F.lit("$"), F.format_string("%.2f", bal)))
        .alias("balance"),
        F.when(k % 9 == 0, F.lit("bad.address")).otherwise(F.concat(F.lit("user"), k, F.lit("@example.com"))).alias("email"),
        F.when(k % 10 == 0, F.lit("12-AB")).otherwise(F.concat(F.lit("+1 555 "), F.lpad(k.cast("string"), 7, "0"))).alias("phone"),
        active.alias("active"),
        F.when(k % 50 == 0, F.lit(-5).cast("bigint")).otherwise(k % 60 + 20).alias("age"),
        F.when(k % 4 != 0, bal).alias("amount"),
    )


DIRTY_ORDERS = """dirty AS (SELECT o_orderkey AS id, o_custkey AS customer,
  CASE WHEN o_orderkey % 50 = 0 THEN 'not a date' WHEN o_orderkey % 2 = 1 THEN STRFTIME(o_orderdate, '%m/%d/%Y')
    ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS order_date,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN ' OPEN'
    ELSE 'p' END AS status,
  o_totalprice * CASE WHEN o_orderkey % 100 = 7 THEN -1 ELSE 1 END AS amount, o_orderpriority AS priority
  FROM orders o, UNNEST(RANGE(CASE WHEN o.o_orderkey % 20 = 0 THEN 2 ELSE 1 END)) u(i))"""


def dirty_orders(t: Tables):
    k, d, s = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    copies = F.when(k % 20 == 0, 2).otherwise(1)
    return t.orders.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(
        k.alias("id"),
        F.col("o_custkey").alias("customer"),
        F.when(k % 50 == 0, F.lit("not a date"))
        .when(k % 2 == 1, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(k % 4 != 0, s).when(s == "F", F.lit("finished")).when(s == "O", F.lit(" OPEN")).otherwise(F.lit("p")).alias("status"),
        (F.col("o_totalprice") * F.when(k % 100 == 7, -1).otherwise(1)).alias("amount"),
        F.col("o_orderpriority").alias("priority"),
    )


# SQL pieces used with the dirty tables.
TRIM = "TRIM({}, ' ' || CHR(9) || CHR(10) || CHR(13) || CHR(12) || CHR(11))"


def sql_strip(c: str) -> str:
    return TRIM.format(c)


def sql_squeeze(c: str) -> str:
    return rf"REGEXP_REPLACE({sql_strip(c)}, '\s{{2,}}', ' ', 'g')"


def sql_date(c: str) -> str:
    """A dirty order date as a timestamp."""
    return f"COALESCE(TRY_STRPTIME({c}, '%Y-%m-%d'), TRY_STRPTIME({c}, '%m/%d/%Y'))"


def sql_number(c: str) -> str:
    """A dirty balance as a double."""
    return rf"TRY_CAST(REGEXP_REPLACE(REGEXP_REPLACE({c}, '[$,%\s]', '', 'g'), '^\((.*)\)$', '-\1') AS DOUBLE)"
