"""Change tracking between dirty and cleaned customers, and the dataset registry."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import changelog, clean, profile, versions
from grainmill.plans.cleaning import Action, apply_plan, run_plan
from grainmill.session import set_down
from grainmill.sources import files
from grainmill.workloads.fixtures import DIRTY_CUSTOMER, dirty_customer, dirty_orders, sql_number, sql_squeeze, sql_strip
from grainmill.workloads.loading import scratch
from grainmill.workloads.registry import Tables, fx, query

C = f"WITH {DIRTY_CUSTOMER}"
KEPT = ["id", "name", "segment", "balance", "age"]
PLAN = [
    Action("trim_whitespace", {"columns": ["name"]}),
    Action("normalize_case", {"columns": ["segment"], "case": "upper"}),
    Action("fill_default", {"columns": ["segment"], "placeholder": "Unknown"}),
    Action("convert_numeric", {"columns": ["balance"]}),
    Action("replace_negatives", {"column": "age"}),
]

# The balance is compared as a rounded number, so that both engines write it alike.
BEFORE_AFTER = f"""b AS (SELECT id, name, segment, balance, CAST(age AS VARCHAR) AS age FROM dirty),
a AS (SELECT id, {sql_squeeze('name')} AS name, CASE WHEN COALESCE({sql_strip('segment')}, '') = '' THEN 'Unknown' ELSE UPPER(segment) END AS segment,
  CAST(CAST(ROUND({sql_number('balance')}) AS BIGINT) AS VARCHAR) AS balance, CAST(CASE WHEN age >= 0 THEN age END AS VARCHAR) AS age FROM dirty),
c AS (SELECT b.id, 'name' AS col, b.name AS x, a.name AS y FROM b JOIN a ON a.id = b.id UNION ALL SELECT b.id, 'segment', b.segment, a.segment FROM b JOIN a ON a.id = b.id
  UNION ALL SELECT b.id, 'amount', b.balance, a.balance FROM b JOIN a ON a.id = b.id UNION ALL SELECT b.id, 'age', b.age, a.age FROM b JOIN a ON a.id = b.id),
ch AS (SELECT *, CASE WHEN x IS NULL AND y IS NOT NULL THEN 'impute_defaults' WHEN x IS NOT NULL AND y IS NULL THEN 'set_null'
  WHEN {sql_strip('x')} = {sql_strip('y')} AND x <> y THEN 'trim_whitespace' WHEN LOWER({sql_strip('x')}) = LOWER({sql_strip('y')}) THEN 'normalize_case'
  WHEN TRY_CAST(REGEXP_REPLACE({sql_strip('x')}, '[,$%]', '', 'g') AS DOUBLE) IS NOT NULL THEN 'convert_numeric' ELSE 'find_replace' END AS op
  FROM c WHERE COALESCE(x, '') <> COALESCE(y, '')),
cat AS (SELECT *, CASE op WHEN 'impute_defaults' THEN 'Missing Data' WHEN 'set_null' THEN 'Missing Data' WHEN 'convert_numeric' THEN 'Type Conversion' ELSE 'Text Cleaning' END AS grp FROM ch)"""
RENAMED = {"balance": "amount"}


def before(t: Tables):
    return dirty_customer(t).select(*KEPT)


def after(t: Tables):
    rows = apply_plan(before(t), PLAN).df
    return rows.withColumn("balance", F.round("balance").cast("bigint")).withColumnsRenamed(RENAMED)


def changes(t: Tables):
    return changelog.cell_changes(before(t), after(t), "id", RENAMED)


@query(
    "t01_cell_changes",
    f"""{C}, {BEFORE_AFTER} SELECT id, col AS "column", x AS before, y AS after FROM ch""",
)
def _(t):
    return changes(t).select("id", "column", "before", "after")


@query(
    "j11_before_after_join",
    f"""{C}, {BEFORE_AFTER} SELECT col AS "column", COUNT(*) AS cells FROM ch GROUP BY 1""",
)
def _(t):
    return changes(t).groupBy("column").agg(F.count(F.lit(1)).alias("cells"))


NEWER = """newer AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2003 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 1009 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3001 <> 0
    UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4001 = 0)"""


def order_versions(t: Tables):
    """Orders, and a later version of them: a few prices and states changed, a few rows gone, a few new."""
    older = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    changed = older.where(key % 3001 != 0).withColumns(
        {
            "o_orderstatus": F.when(key % 2003 == 0, "X").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(key % 1009 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        }
    )
    return older, changed.unionByName(older.where(key % 4001 == 0).withColumn("o_orderkey", -key))


@query(
    "t01_few_changes",
    f"""WITH {NEWER}, c AS (SELECT o.o_orderkey, 'o_orderstatus' AS "column", o.o_orderstatus AS before, n.o_orderstatus AS after, CAST(NULL AS DOUBLE) AS moved FROM orders o JOIN newer n USING (o_orderkey)
      UNION ALL SELECT o.o_orderkey, 'o_totalprice', '', '', n.o_totalprice - o.o_totalprice FROM orders o JOIN newer n USING (o_orderkey))
    SELECT o_orderkey, "column", CASE WHEN "column" = 'o_totalprice' THEN '' ELSE before END AS before, CASE WHEN "column" = 'o_totalprice' THEN '' ELSE after END AS after
    FROM c WHERE before <> after OR moved <> 0""",
)
def _(t):
    older, newer = order_versions(t)
    rows = changelog.cell_changes(older, newer, "o_orderkey", few=True)
    price = F.col("column") == "o_totalprice"  # both engines write large doubles in forms of their own
    return rows.select("o_orderkey", "column", *[F.when(price, "").otherwise(F.col(c)).alias(c) for c in ("before", "after")])


@query(
    "s19_row_changes",
    f"""WITH {NEWER} SELECT COUNT(*) FILTER (WHERE o.o_orderkey IS NULL) AS rows_added, COUNT(*) FILTER (WHERE n.o_orderkey IS NULL) AS rows_removed,
    COUNT(*) FILTER (WHERE o.o_orderstatus <> n.o_orderstatus OR o.o_totalprice <> n.o_totalprice) AS rows_changed
    FROM orders o FULL JOIN newer n ON o.o_orderkey = n.o_orderkey""",
)
def _(t):
    return versions.row_changes(*order_versions(t), "o_orderkey")


@query("t04_few_removed_rows", f"WITH {NEWER} SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newer)")
def _(t):
    return changelog.removed_rows(*order_versions(t), "o_orderkey", few=True).select("o_orderkey", "o_custkey")


@query("t02_inferred_operations", f"""{C}, {BEFORE_AFTER} SELECT id, col AS "column", op AS operation FROM ch""")
def _(t):
    return changes(t).select("id", "column", "operation")


@query("t03_change_groups", f"{C}, {BEFORE_AFTER} SELECT grp AS category, COUNT(*) AS cells FROM cat GROUP BY 1")
def _(t):
    return changelog.change_groups(changes(t))


@query(
    "t03_column_impact",
    f"""{C}, {BEFORE_AFTER} SELECT col AS "column", COUNT(*) AS cells_modified, STRING_AGG(DISTINCT grp, ', ' ORDER BY grp) AS change_types,
    {fx('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM dirty)', 4)} AS pct FROM cat GROUP BY 1""",
)
def _(t):
    total = before(t).agg(F.count(F.lit(1))).scalar()
    return changelog.column_impact(changes(t), total).withColumn("pct", fixed(F.col("pct"), 4))


@query("t04_removed_rows", f"{C} SELECT id, name FROM dirty WHERE amount IS NULL")
def _(t):
    rows = dirty_customer(t).select("id", "name", "amount")
    return changelog.removed_rows(rows, clean.drop_rows_missing(rows, "amount").df, "id").select("id", "name")


TIMELINE = f"""s AS (SELECT UPPER(segment) AS u FROM dirty), steps AS (
    SELECT 1 AS step, 'trim_whitespace' AS operation, 'cells_modified' AS kind, COUNT(*) AS n FROM dirty WHERE name <> {sql_squeeze('name')}
    UNION ALL SELECT 2, 'normalize_case', 'cells_modified', COUNT(*) FROM dirty WHERE segment <> UPPER(segment)
    UNION ALL SELECT 3, 'fill_default', 'cells_filled', COUNT(*) FROM s WHERE COALESCE({sql_strip('u')}, '') = ''
    UNION ALL SELECT 4, 'convert_numeric', 'cells_modified', COUNT(*) FROM dirty WHERE TRY_CAST(balance AS DOUBLE) IS DISTINCT FROM {sql_number('balance')} OR {sql_number('balance')} IS NULL
    UNION ALL SELECT 5, 'replace_negatives', 'cells_modified', COUNT(*) FROM dirty WHERE age < 0)"""


@query(
    "t05_timeline_totals",
    f"""{C}, {TIMELINE} SELECT CAST(SUM(n) AS BIGINT) AS cells_modified, CAST(SUM(n) FILTER (WHERE kind = 'cells_filled') AS BIGINT) AS missing_filled,
    CAST(0 AS BIGINT) AS rows_removed, 0 AS cols_dropped, 1 AS cols_renamed FROM steps""",
)
def _(t):
    run = run_plan(before(t), PLAN)
    return changelog.summary_totals(run.timeline(), before(t), run.df.withColumnsRenamed(RENAMED), RENAMED)


@query(
    "t05_timeline",
    f"""{C}, {TIMELINE} SELECT step, operation, '{{"' || kind || '":' || n || CASE step WHEN 4 THEN ',"columns_converted":1' WHEN 5 THEN ',"rows_removed":0' ELSE '' END || '}}' AS detail FROM steps""",
)
def _(t):
    return run_plan(before(t), PLAN).timeline()


@query(
    "t06_change_log",
    f"""{C}, {BEFORE_AFTER} SELECT id AS row, col AS "column", op AS operation, grp AS category, COALESCE(x, '') AS before, COALESCE(y, '') AS after FROM cat""",
)
def _(t):
    return changelog.change_log(changes(t), "id")


@query(
    "s18_audit_package",
    f"""{C}, {BEFORE_AFTER} SELECT (SELECT COUNT(*) FROM dirty) AS data, CAST(3 AS BIGINT) AS sections, COUNT(*) AS changes,
    (SELECT COUNT(*) FROM a WHERE balance IS NULL) AS missing_amounts, (SELECT COUNT(*) FROM a WHERE age IS NULL) AS missing_ages,
    (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT DISTINCT LOWER({sql_strip('segment')}) AS x FROM a) x JOIN (SELECT DISTINCT LOWER({sql_strip('segment')}) AS y FROM a) y
      ON x < y AND LEVENSHTEIN(x, y) = 1) AS segment_typos,
    (SELECT COUNT(*) FROM (SELECT DISTINCT LOWER({sql_strip('name')}) AS x FROM a) x JOIN (SELECT DISTINCT LOWER({sql_strip('name')}) AS y FROM a) y
      ON x < y AND LEVENSHTEIN(x, y) = 1) AS name_typos FROM ch""",
)
def _(t):
    """The package of a cleaned table with the issues of all its columns, written and read back section by section."""
    folder = scratch(t, "audit")
    # Cleaned once for all checks and sections, and by all tasks: a small file is read by one.
    rows = set_down(after(t).repartition("id"), "cleaned")
    log = changelog.change_log(changelog.cell_changes(before(t), rows, "id", RENAMED), "id")
    files.write_audit_package(rows, profile.issues(rows), log, folder)
    read = t.spark.read
    data = read.parquet(f"{folder}/data").agg(F.count(F.lit(1))).scalar()
    found = read.parquet(f"{folder}/issues")

    def affected(issue: str, column: str):
        counts = F.sum(F.when((F.col("id") == issue) & (F.col("column") == column), F.col("affected_count")))
        return F.coalesce(counts, F.lit(0))

    wanted = {
        "missing_amounts": ("missing_values", "amount"),
        "missing_ages": ("missing_values", "age"),
        "segment_typos": ("category_inconsistent", "segment"),
        "name_typos": ("category_inconsistent", "name"),
    }
    issues = found.agg(F.struct(*[affected(*what).alias(name) for name, what in wanted.items()]).alias("s")).scalar()
    return read.parquet(f"{folder}/change_log").agg(
        data.alias("data"),
        F.lit(len(files.list_files(t.spark, folder, ""))).cast("bigint").alias("sections"),
        F.count(F.lit(1)).alias("changes"),
        *[issues.getField(name).alias(name) for name in wanted],
    )


@query(
    "t07_issue_report",
    """SELECT 'o_custkey' AS "column", 'attention' AS status FROM orders HAVING COUNT(*) > COUNT(DISTINCT o_custkey)
    UNION ALL SELECT 'label', 'critical' FROM orders HAVING COUNT(*) FILTER (WHERE o_orderkey % 3 > 0) * 100.0 / COUNT(*) > 30""",
)
def _(t):
    label = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    rows = t.orders.select("o_custkey", "o_totalprice", label.alias("label"))
    return changelog.issue_report(profile.column_report(rows)).select("column", "status")


@query(
    "t08_fingerprint",
    """SELECT 'orders' AS dataset, 'o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice' AS columns, 'datetime' AS date_kind,
    CAST(FLOOR(COUNT(*) * 0.8) AS BIGINT) AS rows_low, CAST(FLOOR(COUNT(*) * 1.2) AS BIGINT) AS rows_high FROM orders""",
)
def _(t):
    rows = changelog.fingerprint(t.orders, "orders")
    names = F.array_join(F.array_sort("columns"), ", ")
    kind = F.col("column_types")["o_orderdate"]
    return rows.select("dataset", names.alias("columns"), kind.alias("date_kind"), "rows_low", "rows_high")


def catalog(t: Tables):
    entries = [
        changelog.fingerprint(t.orders, "orders"),
        changelog.fingerprint(t.orders.withColumn("flag", F.lit(True)), "orders_flagged"),
        changelog.fingerprint(t.orders.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice")), "orders_small"),
        changelog.fingerprint(t.customer, "customer"),
        changelog.fingerprint(dirty_orders(t), "dirty"),
    ]
    rows = entries[0]
    for entry in entries[1:]:
        rows = rows.unionByName(entry)
    return rows


@query(
    "t09_similar_datasets",
    f"SELECT 'orders' AS first, 'orders_flagged' AS second, {fx('0.7 * 6 / 7 + 0.3', 6)} AS score FROM orders HAVING COUNT(*) > 0",
)
def _(t):
    return changelog.similar_datasets(catalog(t)).withColumn("score", fixed(F.col("score"), 6))


@query(
    "t09_similar_catalog_entries",
    f"""WITH e AS (SELECT c_nationkey || '-' || c_mktsegment AS dataset, STRFTIME(o_orderdate, 'm%Y') || (EXTRACT(MONTH FROM o_orderdate) + 1) // 2 AS c, COUNT(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    d AS (SELECT dataset, LIST(c ORDER BY c) AS cs, MAP(LIST(c ORDER BY c), LIST(CASE WHEN n % 5 > 0 THEN 'numeric' ELSE 'categorical' END ORDER BY c)) AS ts FROM e GROUP BY 1),
    p AS (SELECT a.dataset AS first, b.dataset AS second, LIST_INTERSECT(a.cs, b.cs) AS x, LEN(a.cs) AS m, LEN(b.cs) AS k, a.ts AS ta, b.ts AS tb FROM d a JOIN d b ON a.dataset < b.dataset),
    q AS (SELECT *, 0.7 * LEN(x) / GREATEST(m, k) + 0.3 * COALESCE(LEN([c FOR c IN x IF ta[c] = tb[c]]) / NULLIF(LEN(x), 0), 0) AS base, LEAST(m, k) / GREATEST(m, k) AS sizes FROM p)
    SELECT first, second, {fx('CASE WHEN sizes < 0.7 THEN base * sizes ELSE base END', 6)} AS score FROM q WHERE CASE WHEN sizes < 0.7 THEN base * sizes ELSE base END >= 0.8""",
)
def _(t):
    """A written catalog of tables, read back: one per nation and segment, a column per two months with orders."""
    folder, day = scratch(t, "catalog"), F.col("o_orderdate")
    part = F.concat(F.date_format(day, "'m'yyyy"), F.floor((F.month(day) + 1) / 2).cast("string"))
    cells = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("dataset"), part.alias("c"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kind = F.when(F.col("n") % 5 > 0, "numeric").otherwise("categorical").alias("kind")
    entries = cells.select("dataset", F.struct("c", kind).alias("e")).groupBy("dataset").agg(F.array_sort(F.collect_list("e")).alias("es"))
    entries.select("dataset", F.col("es.c").alias("columns"), F.map_from_entries("es").alias("column_types")).write.parquet(folder)
    rows = changelog.similar_datasets(t.spark.read.parquet(folder))
    return rows.withColumn("score", fixed(F.col("score"), 6))


@query(
    "t10_recurring_insights",
    """SELECT LOWER(event_type) || ' drives most value' AS pattern, COUNT(DISTINCT user_id) AS datasets FROM events GROUP BY 1 HAVING COUNT(DISTINCT user_id) >= 3""",
)
def _(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("dataset"), "event_type").distinct()
    insight = F.array(F.concat(F.initcap("event_type"), F.lit(" drives most value ")))
    return changelog.recurring_insights(rows.select("dataset", insight.alias("insights")))


@query("t11_report_sections", "SELECT 'overview' AS section, CAST(1 AS BIGINT) AS rows FROM (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'values', (SELECT COUNT(DISTINCT o_orderstatus) FROM orders)")
def _(t):
    from grainmill.operators import explore
    from grainmill.operators.values import value_counts

    folder = scratch(t, "report")
    files.write_sections({"overview": explore.overview(t.orders), "values": value_counts(t.orders, ["o_orderstatus"])}, folder)
    parts = [t.spark.read.parquet(f"{folder}/{s}").agg(F.lit(s).alias("section"), F.count(F.lit(1)).alias("rows")) for s in ("overview", "values")]
    return parts[0].unionByName(parts[1])


@query(
    "t12_registry",
    """WITH e AS (SELECT user_id AS name, event_id, ts FROM events), n AS (SELECT name, ARG_MAX(event_id, ts) AS entry, MAX(ts) AS moment FROM e GROUP BY 1)
    SELECT name, entry FROM n""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("name"), F.col("event_id").alias("entry"), F.col("ts").alias("moment"))
    last = t.events.agg(F.max(F.to_date("ts"))).scalar()
    older = rows.where(F.to_date("moment") < last)
    return changelog.append_registry(older, rows.where(F.to_date("moment") >= last), "name", "moment").select("name", "entry")
