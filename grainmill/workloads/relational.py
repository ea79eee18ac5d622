"""Projections, filters, joins, aggregates, windows, sorts and set operations on the provided tables."""

from pyspark.sql import Window, functions as F

from grainmill.functions.dates import years_before
from grainmill.functions.numbers import compare, fixed, ratio
from grainmill.functions.stats import avg_if, count_if, share
from grainmill.operators import ranking, series, values
from grainmill.operators.dedup import drop_duplicates
from grainmill.operators.explore import correlation_pairs, describe, missing_per_column, similar_pairs
from grainmill.operators.quantiles import aggregate_with_quantiles, quantiles
from grainmill.workloads.funds import NAV, nav, text_date
from grainmill.workloads.registry import fx, missing_sql, query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def day(name: str):
    return F.to_date(name).cast("string")


# ---------------------------------------------------------------- projections and filters


@query("f01_column_subset", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")


@query("f02_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(t):
    from grainmill.operators.clean import drop_columns

    return drop_columns(t.customer, ["c_name", "c_acctbal", "no_such_column"])


@query("f05_reorder_relabel", 'SELECT c_mktsegment AS "Segment", c_custkey AS "Customer" FROM customer')
def _(t):
    return t.customer.select(F.col("c_mktsegment").alias("Segment"), F.col("c_custkey").alias("Customer"))


@query(
    "f06_in_list_filters",
    """SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 4, 5, 6, 7)""",
)
def _(t):
    orders = t.orders.where(
        F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    customers = t.customer.where(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(1, 2, 3, 4, 5, 6, 7)
    ).select("c_custkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "f07_comparisons",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.02
    AND l_tax <= 0.06 AND l_linenumber <> 4""",
)
def _(t):
    rules = [("l_quantity", ">=", 10), ("l_quantity", "<", 40), ("l_discount", ">", 0.02), ("l_tax", "<=", 0.06)]
    kept = compare(F.col("l_linenumber"), "!=", 4)
    for name, op, limit in rules:
        kept = kept & compare(F.col(name), op, limit)
    return t.lineitem.where(kept).select("l_orderkey", "l_linenumber")


@query(
    "f08_outside_range",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 OR c_acctbal < 0",
)
def _(t):
    return t.customer.where(~F.col("c_acctbal").between(0, 9000)).select("c_custkey", "c_acctbal")


@query(
    "f09_enum_membership",
    "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
)
def _(t):
    rows = t.orders.where(F.col("o_orderstatus").isin("F", "P"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f10_not_null",
    "SELECT * FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer) WHERE balance IS NOT NULL",
)
def _(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return rows.dropna(subset=["balance"])


@query("f11_text_equality", "SELECT c_custkey FROM customer WHERE LOWER(c_mktsegment) = LOWER('Building')")
def _(t):
    return t.customer.where(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey")


@query(
    "f12_regex",
    r"""SELECT COUNT(*) FILTER (WHERE regexp_matches(url, 'page=\d+')) AS paged,
    COUNT(*) FILTER (WHERE regexp_full_match(url, 'https?://[^\s]+')) AS web,
    COUNT(*) AS pages FROM pages""",
)
def _(t):
    return t.pages.agg(
        count_if(F.col("url").rlike(r"page=\d+")).alias("paged"),
        count_if(F.col("url").rlike(r"^https?://[^\s]+$")).alias("web"),
        F.count(F.lit(1)).alias("pages"),
    )


@query(
    "f13_date_cut_off",
    """SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >=
    (SELECT MAX(CAST(o_orderdate AS DATE)) - INTERVAL 3 YEAR FROM orders)""",
)
def _(t):
    cut = t.orders.agg(years_before(F.max(F.to_date("o_orderdate")), 3)).scalar()
    return t.orders.where(F.to_date("o_orderdate") >= cut).select("o_orderkey")


@query("f14_positive_only", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0")
def _(t):
    return t.lineitem.where(F.col("l_discount") > 0).select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "f15_filter_by_aggregate",
    f"SELECT o_custkey, COUNT(*) AS n, {fx('AVG(o_totalprice)', 4)} AS mean FROM orders GROUP BY 1 HAVING COUNT(*) >= 5",
)
def _(t):
    rows = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
    return rows.where(F.col("n") >= 5).withColumn("mean", fixed(F.col("mean"), 4))


@query(
    "f16_flag_column",
    "SELECT l_orderkey, l_linenumber, NOT (l_tax BETWEEN 0.01 AND 0.07) AS tax_flag FROM lineitem",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (~F.col("l_tax").between(0.01, 0.07)).alias("tax_flag"))


# ---------------------------------------------------------------- joins


@query(
    "j01_inner_join",
    f"""SELECT n_name, COUNT(*) AS orders, {fx('SUM(o_totalprice)', 2)} AS total FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("orders"), fixed(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "j02_left_join",
    """SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN
    (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey""",
)
def _(t):
    large = t.orders.where(F.col("o_totalprice") > 400000).select("o_custkey", "o_orderkey")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", "o_orderkey"
    )


@query(
    "j03_shifted_self_join",
    f"""WITH y AS (SELECT YEAR(o_orderdate) AS year, SUM(o_totalprice) AS total, COUNT(*) AS n FROM orders
      WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT CAST(a.year AS INTEGER) AS year, {fx('a.total', 2)} AS total, a.n, {fx('b.total', 2)} AS previous_total,
    {fx('(a.total - b.total) / b.total * 100', 6)} AS growth_pct FROM y a LEFT JOIN y b ON a.year = b.year + 1""",
)
def _(t):
    from grainmill.operators.star import yearly_growth

    rows = yearly_growth(t.orders.where(F.col("o_orderstatus") == "F"), "o_orderdate", "o_totalprice")
    return rows.select(
        "year",
        fixed(F.col("total"), 2).alias("total"),
        "n",
        fixed(F.col("previous_total"), 2).alias("previous_total"),
        fixed(F.col("growth_pct"), 6).alias("growth_pct"),
    )


@query(
    "j04_series_alignment",
    f"""WITH {NAV}, a AS (SELECT CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS v FROM orders GROUP BY 1),
    s AS (SELECT CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT fund, CAST(nav.date AS VARCHAR) AS date, {fx('value', 2)} AS value, {fx('v', 2)} AS index_value,
    {fx('q', 2)} AS shipped FROM nav JOIN a ON nav.date = a.date JOIN s ON nav.date = s.date""",
)
def _(t):
    whole = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("index_value"))
    shipped = t.lineitem.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("shipped"))
    rows = nav(t).join(whole, "date").join(shipped, "date")
    return rows.select(
        "fund", text_date("date"), *[fixed(F.col(c), 2).alias(c) for c in ("value", "index_value", "shipped")]
    )


@query(
    "j05_aggregate_joined_back",
    """SELECT o_orderkey, CAST(MIN(YEAR(o_orderdate)) OVER (PARTITION BY o_custkey) AS INTEGER) AS first_year FROM orders""",
)
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_year"))
    return t.orders.select("o_orderkey", "o_custkey").join(first, "o_custkey").select("o_orderkey", "first_year")


@query(
    "j06_semi_join",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def _(t):
    rich = t.customer.where(F.col("c_acctbal") > 5000)
    return t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query(
    "j07_anti_join_both_ways",
    """SELECT 'customer without large order' AS kind, c_custkey AS key FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    UNION ALL SELECT 'order without solvent customer', o_orderkey FROM orders
      WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_acctbal > 0)""",
)
def _(t):
    on = F.col("o_custkey") == F.col("c_custkey")
    idle = t.customer.join(t.orders.where(F.col("o_totalprice") > 400000), on, "left_anti").select(
        F.lit("customer without large order").alias("kind"), F.col("c_custkey").alias("key")
    )
    orphan = t.orders.join(t.customer.where(F.col("c_acctbal") > 0), on, "left_anti").select(
        F.lit("order without solvent customer").alias("kind"), F.col("o_orderkey").alias("key")
    )
    return idle.unionByName(orphan)


@query(
    "j08_as_of_lookup",
    f"""WITH {NAV} SELECT fund, {fx("ARG_MAX(value, date) FILTER (WHERE date <= DATE '1996-01-01')", 2)} AS at_1996,
    {fx("ARG_MAX(value, date) FILTER (WHERE date <= DATE '1999-07-04')", 2)} AS at_1999 FROM nav GROUP BY fund""",
)
def _(t):
    targets = {"at_1996": F.lit("1996-01-01").cast("date"), "at_1999": F.lit("1999-07-04").cast("date")}
    rows = series.as_of(nav(t), ["fund"], "value", targets)
    return rows.select("fund", *[fixed(F.col(c), 2).alias(c) for c in targets])


@query(
    "j09_dictionary_mapping",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status_name,
    n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    from grainmill.functions.mapping import map_values

    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    name = map_values(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other")
    return rows.select("o_orderkey", name.alias("status_name"), F.col("n_name").alias("nation"))


@query(
    "j10_similar_value_pairs",
    """WITH v AS (SELECT DISTINCT p_name AS x FROM part UNION SELECT DISTINCT p_brand FROM part)
    SELECT a.x AS first, b.x AS second FROM v a JOIN v b ON a.x < b.x
    WHERE LEVENSHTEIN(LOWER(a.x), LOWER(b.x)) = 1""",
)
def _(t):
    names = t.part.select(F.explode(F.array("p_name", "p_brand")).alias("value"))
    return similar_pairs(names.distinct(), [], "value").select("first", "second")


@query(
    "j12_key_overlap",
    f"""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem), b AS (SELECT DISTINCT p_partkey AS k FROM part)
    SELECT (SELECT COUNT(*) FROM a) AS left_keys, (SELECT COUNT(*) FROM b) AS right_keys,
    (SELECT COUNT(*) FROM a JOIN b ON a.k = b.k) AS common_keys""",
)
def _(t):
    from grainmill.operators.explore import key_overlap

    return key_overlap(t.lineitem, "l_partkey", t.part, "p_partkey").select("left_keys", "right_keys", "common_keys")


# ---------------------------------------------------------------- aggregates


@query(
    "a01_group_statistics",
    f"""SELECT c_mktsegment, {fx('AVG(c_acctbal)', 4)} AS mean, {fx('MEDIAN(c_acctbal)', 4)} AS median,
    {fx('MIN(c_acctbal)', 4)} AS min, {fx('MAX(c_acctbal)', 4)} AS max, {fx('STDDEV_SAMP(c_acctbal)', 4)} AS std,
    COUNT(c_acctbal) AS count FROM customer GROUP BY 1""",
)
def _(t):
    from grainmill.operators.salary import group_statistics

    rows = group_statistics(t.customer, ["c_mktsegment"], "c_acctbal")
    stats = ("mean", "median", "min", "max", "std")
    return rows.select("c_mktsegment", *[fixed(F.col(c), 4).alias(c) for c in stats], "count")


@query(
    "a02_sum_avg_count",
    f"""SELECT l_returnflag, l_linestatus, {fx('SUM(l_quantity)', 2)} AS sum_qty, {fx('AVG(l_extendedprice)', 4)} AS avg_price,
    {fx('SUM(l_extendedprice * (1 - l_discount))', 2)} AS revenue, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        fixed(F.sum("l_quantity"), 2).alias("sum_qty"),
        fixed(F.avg("l_extendedprice"), 4).alias("avg_price"),
        fixed(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "a03_count_distinct_and_count",
    "SELECT o_orderpriority, o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(o_orderkey) AS orders FROM orders GROUP BY 1, 2",
)
def _(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count("o_orderkey").alias("orders")
    )


@query(
    "a04_distinct_counts",
    "SELECT COUNT(DISTINCT p_brand) AS brands, COUNT(DISTINCT p_type) AS types, COUNT(DISTINCT p_name) AS names FROM part",
)
def _(t):
    stats = values.distinct_stats(values.value_counts(t.part, ["p_brand", "p_type", "p_name"]))
    names = {"p_brand": "brands", "p_type": "types", "p_name": "names"}
    return stats.agg(
        *[F.max(F.when(F.col("column") == c, F.col("distinct_values"))).alias(n) for c, n in names.items()]
    )


@query(
    "a05_value_counts",
    f"""WITH c AS (SELECT p_brand AS value, COUNT(*) AS n FROM part GROUP BY 1)
    SELECT value, n, {fx('n / SUM(n) OVER ()', 6)} AS share FROM c ORDER BY n DESC, value LIMIT 10""",
)
def _(t):
    top = values.top_values(values.value_counts(t.part, ["p_brand"]), 10)
    return top.select("value", "n", fixed(F.col("share"), 6).alias("share"))


@query(
    "a06_mode",
    """WITH c AS (SELECT p_type, p_brand, COUNT(*) AS n FROM part GROUP BY 1, 2)
    SELECT p_type, p_brand AS common_brand FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) = 1""",
)
def _(t):
    return values.mode_by(t.part, ["p_type"], "p_brand", "common_brand")


@query(
    "a08_conditional_share",
    f"""SELECT {fx("AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END)", 6)} AS finished_share,
    {fx("AVG(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END)", 6)} AS urgent_share FROM orders""",
)
def _(t):
    return t.orders.agg(
        fixed(share(F.col("o_orderstatus") == "F"), 6).alias("finished_share"),
        fixed(share(F.col("o_orderpriority") == "1-URGENT"), 6).alias("urgent_share"),
    )


@query(
    "a09_best_and_worst_group",
    f"""WITH g AS (SELECT c_mktsegment AS s, AVG(c_acctbal) AS m FROM customer GROUP BY 1)
    SELECT ARG_MAX(s, m) AS best, ARG_MIN(s, m) AS worst, {fx('MAX(m)', 4)} AS best_mean, {fx('MIN(m)', 4)} AS worst_mean FROM g""",
)
def _(t):
    groups = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    return groups.agg(
        F.max_by("c_mktsegment", "m").alias("best"),
        F.min_by("c_mktsegment", "m").alias("worst"),
        fixed(F.max("m"), 4).alias("best_mean"),
        fixed(F.min("m"), 4).alias("worst_mean"),
    )


@query(
    "a10_conditional_aggregates",
    f"""SELECT l_returnflag, {fx("AVG(l_extendedprice) FILTER (WHERE l_linestatus = 'F')", 4)} AS finished_mean,
    {fx('SUM(l_extendedprice)', 2)} AS total, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS finished FROM lineitem GROUP BY 1""",
)
def _(t):
    done = F.col("l_linestatus") == "F"
    return t.lineitem.groupBy("l_returnflag").agg(
        fixed(avg_if(done, F.col("l_extendedprice")), 4).alias("finished_mean"),
        fixed(F.sum("l_extendedprice"), 2).alias("total"),
        count_if(done).alias("finished"),
    )


def _pivot_sql(aggregate: str, digits: int, zero: bool = True) -> str:
    cells = []
    for s in STATUSES:
        cell = fx(aggregate.format(f"FILTER (WHERE o_orderstatus = '{s}')"), digits)
        cells.append(f'COALESCE({cell}, 0.0) AS "{s}"' if zero else f'{cell} AS "{s}"')
    return f"SELECT o_orderpriority, {', '.join(cells)} FROM orders GROUP BY 1"


PIVOT_SQL = {
    "sum": ("SUM(o_totalprice) {}", 2),
    "mean": ("AVG(o_totalprice) {}", 4),
    "count": ("COUNT(o_totalprice) {}", 0),
    "max": ("MAX(o_totalprice) {}", 2),
    "min": ("MIN(o_totalprice) {}", 2),
    "nunique": ("COUNT(DISTINCT o_totalprice) {}", 0),
}


def _pivot(kind: str):
    aggregate, digits = PIVOT_SQL[kind]

    @query(f"a13_pivot_{kind}", _pivot_sql(aggregate, digits))
    def _(t):
        from grainmill.operators.explore import pivot_table

        rows = pivot_table(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", kind, STATUSES)
        return rows.select("o_orderpriority", *[fixed(F.col(s), digits).alias(s) for s in STATUSES])


for _kind in PIVOT_SQL:
    _pivot(_kind)


@query(
    "a15_unpivot",
    """SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount + 0.0 AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax + 0.0 FROM lineitem""",
)
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax")
    )
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "value")


@query(
    "a16_two_level_sum",
    f"""SELECT o_orderpriority, o_orderstatus, {fx('SUM(o_totalprice)', 2)} AS total FROM orders
    GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
)
def _(t):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(fixed(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "a17_histogram",
    f"""WITH s AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders)
    SELECT CAST(LEAST(FLOOR((o_totalprice - lo) * 50 / (hi - lo)), 49) AS BIGINT) AS bin, COUNT(*) AS n FROM orders, s GROUP BY 1""",
)
def _(t):
    return values.histogram(t.orders, "o_totalprice", 50).select("bin", "n")


@query(
    "a18_five_numbers",
    f"""SELECT o_orderpriority, {fx('MIN(o_totalprice)', 3)} AS low, {fx('QUANTILE_CONT(o_totalprice, 0.25)', 3)} AS q1,
    {fx('MEDIAN(o_totalprice)', 3)} AS median, {fx('QUANTILE_CONT(o_totalprice, 0.75)', 3)} AS q3,
    {fx('MAX(o_totalprice)', 3)} AS high FROM orders GROUP BY 1""",
)
def _(t):
    names = ["low", "q1", "median", "q3", "high"]
    rows = quantiles(t.orders, ["o_orderpriority"], "o_totalprice", [0.0, 0.25, 0.5, 0.75, 1.0], names)
    return rows.select("o_orderpriority", *[fixed(F.col(c), 3).alias(c) for c in names])


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "net", "charge"]
PRICED = """(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity * 100 - l_extendedprice / 100 AS charge FROM lineitem)"""


def priced(lines):
    return lines.withColumns(
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "charge": F.col("l_quantity") * 100 - F.col("l_extendedprice") / 100,
        }
    )


def _correlation_sql(limit: float) -> str:
    parts = []
    for i, a in enumerate(LINE_NUMBERS):
        for b in LINE_NUMBERS[i + 1 :]:
            parts.append(f"SELECT '{a}' AS first, '{b}' AS second, CORR({a}, {b}) AS r FROM {PRICED}")
    return f"SELECT first, second, {fx('r', 6)} AS r FROM ({' UNION ALL '.join(parts)}) WHERE ABS(r) > {limit}"


@query("a19_correlation_matrix", _correlation_sql(0.30))
def _(t):
    rows = correlation_pairs(priced(t.lineitem), LINE_NUMBERS, 0.30)
    return rows.select("first", "second", fixed(F.col("r"), 6).alias("r"))


DOUBLED = "(SELECT o.* FROM orders o, UNNEST(RANGE(CASE WHEN o.o_orderkey % 20 = 0 THEN 2 ELSE 1 END)) u(i))"


def doubled(orders):
    """Every twentieth order twice."""
    copies = F.when(F.col("o_orderkey") % 20 == 0, 2).otherwise(1)
    return orders.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


@query("a20_dedup_whole_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    rows = doubled(t.orders).drop("copy")
    return drop_duplicates(rows).select("o_orderkey", "o_custkey", "o_totalprice")


def _dedup(keep: str, way: str):
    @query(
        f"a20_dedup_keep_{keep}",
        f"""SELECT o_custkey, o_orderstatus, o_orderkey FROM orders
        QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey {way}) = 1""",
    )
    def _(t):
        rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey")
        return drop_duplicates(rows, ["o_custkey", "o_orderstatus"], keep, "o_orderkey")


_dedup("first", "ASC")
_dedup("last", "DESC")


@query(
    "a20_dedup_keep_none",
    "SELECT o_custkey, o_orderstatus, MIN(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2 HAVING COUNT(*) = 1",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey")
    return drop_duplicates(rows, ["o_custkey", "o_orderstatus"], "none")


def _describe_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_discount"):
        parts.append(
            f"""SELECT '{c}' AS "column", COUNT({c}) AS count, {fx(f'AVG({c})', 5)} AS mean, {fx(f'STDDEV_SAMP({c})', 5)} AS std,
            {fx(f'MIN({c})', 5)} AS min, {fx(f'QUANTILE_CONT({c}, 0.25)', 5)} AS q25, {fx(f'MEDIAN({c})', 5)} AS median,
            {fx(f'QUANTILE_CONT({c}, 0.75)', 5)} AS q75, {fx(f'MAX({c})', 5)} AS max FROM lineitem"""
        )
    return " UNION ALL ".join(parts)


@query("a21_describe_numbers", _describe_sql())
def _(t):
    rows = describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    stats = ("mean", "std", "min", "q25", "median", "q75", "max")
    return rows.select("column", "count", *[fixed(F.col(c), 5).alias(c) for c in stats])


@query(
    "a21_describe_texts",
    """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part),
    c AS (SELECT "column", v, COUNT(*) AS n FROM v GROUP BY 1, 2),
    t AS (SELECT "column", v AS top, n AS freq FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, v) = 1),
    s AS (SELECT "column", CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS "unique" FROM c GROUP BY 1)
    SELECT s."column", count, "unique", top, freq FROM s JOIN t ON s."column" = t."column" """,
)
def _(t):
    from grainmill.operators.explore import describe_texts

    return describe_texts(t.part, ["p_brand", "p_type"])


MARKED = """(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer)"""


def marked(customer):
    return customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
    )


@query("a22_missing_per_column", missing_sql(MARKED, ["c_custkey", "segment", "balance"]))
def _(t):
    rows = missing_per_column(marked(t.customer))
    return rows.select("column", "missing", fixed(F.col("missing_pct"), 5).alias("missing_pct"))


# ---------------------------------------------------------------- windows


@query(
    "w02_gap_days",
    f"""WITH {NAV} SELECT fund, CAST(date AS VARCHAR) AS date,
    CAST(DATEDIFF('day', LAG(date) OVER (PARTITION BY fund ORDER BY date), date) AS INTEGER) AS gap FROM nav""",
)
def _(t):
    return series.gap_days(nav(t), ["fund"]).select("fund", text_date("date"), "gap")


def _rank_sql(expression: str, ties: str) -> str:
    return f"(RANK() OVER (ORDER BY {expression}) + (COUNT(*) OVER (PARTITION BY {ties}) - 1) / 2.0)"


@query(
    "w05_average_rank",
    f"""WITH b AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, {_rank_sql('n DESC', 'n')} AS place FROM b""",
)
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return ranking.add_average_rank(counts, "n", "place", descending=True)


@query(
    "w06_percent_rank",
    f"""WITH b AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, {fx(_rank_sql('n', 'n') + ' / COUNT(*) OVER ()', 6)} AS pct FROM b""",
)
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = ranking.add_average_rank(counts, "n", "pct", percent=True)
    return rows.select("o_custkey", "n", fixed(F.col("pct"), 6).alias("pct"))


GAPPY = f"""WITH {NAV}, g AS (SELECT fund, date, CASE WHEN DAY(date) NOT IN (5, 17) THEN value END AS value FROM nav)"""


def gappy(t):
    return nav(t).withColumn("value", F.when(~F.dayofmonth("date").isin(5, 17), F.col("value")))


def _fill(number: str, direction: str, fn: str, frame: str):
    @query(
        f"{number}_{direction}_fill_series",
        f"""{GAPPY} SELECT fund, CAST(date AS VARCHAR) AS date, {fx(f'{fn}(value IGNORE NULLS) OVER (PARTITION BY fund ORDER BY date ROWS BETWEEN {frame})', 2)} AS value FROM g""",
    )
    def _(t):
        rows = series.fill_series(gappy(t), ["fund"], "value", direction)
        return rows.select("fund", text_date("date"), fixed(F.col("value"), 2).alias("value"))


_fill("w07", "forward", "LAST_VALUE", "UNBOUNDED PRECEDING AND CURRENT ROW")
_fill("w08", "backward", "FIRST_VALUE", "CURRENT ROW AND UNBOUNDED FOLLOWING")


@query(
    "w10_share_of_total",
    f"""WITH g AS (SELECT c_nationkey, SUM(c_acctbal) AS s FROM customer GROUP BY 1)
    SELECT c_nationkey, {fx('s', 2)} AS amount, {fx('s / SUM(s) OVER ()', 6)} AS share FROM g""",
)
def _(t):
    rows = values.group_share(t.customer, ["c_nationkey"], F.sum("c_acctbal"))
    return rows.select(
        "c_nationkey", fixed(F.col("amount"), 2).alias("amount"), fixed(F.col("share"), 6).alias("share")
    )


@query(
    "w12_surrogate_key",
    "SELECT CAST(ROW_NUMBER() OVER (ORDER BY p_brand) AS INTEGER) AS brand_id, p_brand FROM (SELECT DISTINCT p_brand FROM part)",
)
def _(t):
    from grainmill.operators.star import entity_dimension

    return entity_dimension([t.part.select("p_brand")], "p_brand", "brand_id")


# ---------------------------------------------------------------- sorts and top lists


@query(
    "o01_multi_key_sort",
    """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC NULLS LAST,
    o_orderstatus NULLS LAST, o_totalprice DESC NULLS LAST""",
)
def _(t):
    return t.orders.orderBy(
        F.col("o_orderpriority").desc_nulls_last(),
        F.col("o_orderstatus").asc_nulls_last(),
        F.col("o_totalprice").desc_nulls_last(),
    ).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "o02_order_and_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


def _top_sql(way: str) -> str:
    return f"""SELECT o_custkey, COUNT(*) AS count, {fx('MEDIAN(o_totalprice)', 4)} AS median FROM orders GROUP BY 1
    HAVING COUNT(*) >= 5 ORDER BY MEDIAN(o_totalprice) {way}, o_custkey LIMIT 10"""


def _top(name: str, descending: bool):
    @query(f"o03_{name}_groups_with_support", _top_sql("DESC" if descending else "ASC"))
    def _(t):
        from grainmill.operators.salary import top_groups

        rows = top_groups(t.orders, "o_custkey", "o_totalprice", 10, "median", descending)
        return rows.select("o_custkey", "count", fixed(F.col("median"), 4).alias("median"))


_top("top", True)
_top("bottom", False)


@query(
    "o04_largest_n",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3",
)
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(3)


@query(
    "o05_custom_order",
    """SELECT o_orderpriority, COUNT(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2
    WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS BIGINT) AS place FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1""",
)
def _(t):
    order = F.array(*[F.lit(v) for v in ("5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT")])
    groups = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    placed = groups.withColumn("place", F.array_position(order, F.col("o_orderpriority")))
    return placed.where(F.col("place") > 0).orderBy("place")


@query(
    "o06_restrict_to_top_keys",
    f"""WITH k AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY COUNT(*) DESC, c_nationkey LIMIT 5)
    SELECT c_nationkey, COUNT(*) AS n, {fx('AVG(c_acctbal)', 4)} AS mean FROM customer
    WHERE c_nationkey IN (SELECT c_nationkey FROM k) GROUP BY 1""",
)
def _(t):
    from grainmill.operators.salary import restrict_to_top

    kept = restrict_to_top(t.customer, "c_nationkey", 5)
    return kept.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("c_acctbal"), 4).alias("mean")
    )


# ---------------------------------------------------------------- set operations


@query(
    "so1_union_of_dates",
    """SELECT CAST(d AS VARCHAR) AS date FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders
    UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events)""",
)
def _(t):
    from grainmill.operators.star import distinct_dates

    sources = [(t.orders, "o_orderdate"), (t.lineitem, "l_shipdate"), (t.events, "ts")]
    return distinct_dates(sources).select(text_date("date"))


@query("so2_union_of_names", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def _(t):
    return t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).distinct()


@query(
    "so3_difference_and_intersection",
    """SELECT 'customer only' AS part, COUNT(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'both', COUNT(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""",
)
def _(t):
    only = t.customer.select("c_nationkey").subtract(t.supplier.select("s_nationkey"))
    both = t.customer.select("c_custkey").intersect(t.orders.select("o_custkey"))
    return only.agg(F.lit("customer only").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        both.agg(F.lit("both").alias("part"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "so4_new_values",
    """SELECT DISTINCT event_type AS value FROM (SELECT ts, CASE WHEN CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events)
      AND event_type = 'error' THEN 'crash' ELSE event_type END AS event_type FROM events)
    WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events)
    AND event_type NOT IN (SELECT event_type FROM events)""",
)
def _(t):
    from grainmill.operators.drift import new_values

    last = t.events.agg(F.max(F.to_date("ts"))).scalar()
    today = t.events.where(F.to_date("ts") == last).withColumn(
        "event_type", F.when(F.col("event_type") == "error", "crash").otherwise(F.col("event_type"))
    )
    return new_values(today, t.events, "event_type")
