"""What cleaning changed: cell differences, removed rows, impact per column, run timeline, dataset registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.text import strip
from grainmill.operators import versions
from grainmill.operators.explore import moment_columns, numeric_columns

# Group name of each kind of change.
CATEGORIES = {
    "impute_defaults": "Missing Data",
    "set_null": "Missing Data",
    "trim_whitespace": "Text Cleaning",
    "normalize_case": "Text Cleaning",
    "convert_numeric": "Type Conversion",
    "find_replace": "Text Cleaning",
}


def cell_changes(
    before: DataFrame, after: DataFrame, row_id: str, renamed: Mapping[str, str] | None = None, few: bool = False
) -> DataFrame:
    """Rows (row id, column, before, after, operation) for every cell that differs; null compares as ''.

    `renamed` maps old to new column names. One join on the row id, both sides pruned to the shared columns. With `few`,
    where most rows are expected to be the same, only rows of unequal hash buckets are joined (`versions.differing`,
    which runs a job); the result is the same.
    """
    pairs = versions.shared_pairs(before, after, row_id, renamed)
    if few:
        before, after = versions.differing(before, after, row_id, pairs)
    left = before.select(row_id, *[F.col(old).cast("string").alias(f"_b{i}") for i, (old, _) in enumerate(pairs)])
    right = after.select(row_id, *[F.col(new).cast("string").alias(f"_a{i}") for i, (_, new) in enumerate(pairs)])
    cells = [
        F.when(
            F.coalesce(f"_b{i}", F.lit("")) != F.coalesce(f"_a{i}", F.lit("")),
            F.struct(F.lit(new).alias("column"), F.col(f"_b{i}").alias("before"), F.col(f"_a{i}").alias("after")),
        )
        for i, (_, new) in enumerate(pairs)
    ]
    changed = left.join(right, row_id).select(row_id, F.explode(F.array_compact(F.array(*cells))).alias("c"))
    rows = changed.select(row_id, "c.column", "c.before", "c.after")
    return rows.withColumn("operation", infer_operation(F.col("before"), F.col("after")))


def infer_operation(before: Column, after: Column) -> Column:
    """The kind of cleaning that explains one changed cell."""
    b, a = strip(before), strip(after)
    number = F.regexp_replace(b, r"[,$%\s]", "").try_cast("double")
    return (
        F.when(before.isNull() & after.isNotNull(), "impute_defaults")
        .when(before.isNotNull() & after.isNull(), "set_null")
        .when((b == a) & (before != after), "trim_whitespace")
        .when((F.lower(b) == F.lower(a)) & (b != a), "normalize_case")
        .when(number.isNotNull(), "convert_numeric")
        .otherwise("find_replace")
    )


def category(operation: Column) -> Column:
    pairs = [F.lit(x) for pair in CATEGORIES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[operation], F.lit("Other"))


def change_groups(changes: DataFrame) -> DataFrame:
    return changes.groupBy(category(F.col("operation")).alias("category")).agg(F.count(F.lit(1)).alias("cells"))


def column_impact(changes: DataFrame, total_rows: Column) -> DataFrame:
    """Per column: changed cells, kinds of change, share of rows. At most six kinds, so the set stays small."""
    kinds = F.array_join(F.array_sort(F.collect_set(category(F.col("operation")))), ", ")
    rows = changes.groupBy("column").agg(F.count(F.lit(1)).alias("cells_modified"), kinds.alias("change_types"))
    return rows.withColumn("pct", F.try_divide(F.col("cells_modified") * 100.0, total_rows))


def removed_rows(before: DataFrame, after: DataFrame, row_id: str, few: bool = False) -> DataFrame:
    """Rows whose id is gone; `few` as in `cell_changes`."""
    if few:
        before, after = versions.differing(before, after, row_id)
    return before.join(after.select(row_id), row_id, "left_anti")


def timeline(metrics: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Step, operation and its counts from a cleaning run's metric frames."""
    parts = [
        frame.select(
            F.lit(i + 1).alias("step"),
            F.lit(name).alias("operation"),
            F.to_json(F.struct(*frame.columns)).alias("detail"),
        )
        for i, (name, frame) in enumerate(metrics)
    ]
    return reduce(DataFrame.unionByName, parts)


def summary_totals(steps: DataFrame, before: DataFrame, after: DataFrame, renamed: Mapping[str, str] | None = None):
    """Totals over a timeline: cells changed, cells filled, rows removed, columns dropped and renamed."""
    def counted(name: str) -> Column:
        return F.coalesce(F.sum(F.get_json_object("detail", f"$.{name}").cast("long")), F.lit(0))

    renamed = dict(renamed or {})
    gone = [c for c in before.columns if renamed.get(c, c) not in after.columns]
    return steps.agg(
        (counted("cells_modified") + counted("cells_filled")).alias("cells_modified"),
        counted("cells_filled").alias("missing_filled"),
        counted("rows_removed").alias("rows_removed"),
        F.lit(len(gone)).alias("cols_dropped"),
        F.lit(len(renamed)).alias("cols_renamed"),
    )


# ---------------------------------------------------------------- dataset registry


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Columns, column kinds and the row count give or take a fifth."""
    numbers, moments = numeric_columns(df), moment_columns(df)
    kinds = {c: "numeric" if c in numbers else "datetime" if c in moments else "categorical" for c in df.columns}
    pairs = [F.lit(x) for pair in kinds.items() for x in pair]
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("dataset"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*pairs).alias("column_types"),
        F.floor(F.col("n") * 0.8).alias("rows_low"),
        F.floor(F.col("n") * 1.2).alias("rows_high"),
    )


# Column names too common to tell datasets apart, weights of the similarity.
COMMON_NAMES = ("id", "name", "date", "value")
COLUMN_WEIGHT, TYPE_WEIGHT = 0.70, 0.30


def _least_overlap(at_least: float) -> float:
    """The share of common columns below which no score reaches `at_least`: types give at most their weight."""
    return max((at_least - TYPE_WEIGHT) / COLUMN_WEIGHT, 0.0)


def _prefixes(sets: DataFrame, at_least: float) -> DataFrame:
    """(schema, size, c): each set's rarest columns, as many as two sets that are alike enough cannot both lack.

    Sets whose common part is at least the share t of the larger one agree in one of their first n - ceil(t n) + 1
    columns in any common order; by rarity, that column is a rare one.
    """
    cells = sets.select("schema", F.size("cs").alias("size"), F.explode("cs").alias("c"))
    often = cells.groupBy("c").agg(F.count(F.lit(1)).alias("often"))
    ranked = cells.join(often, "c").groupBy("schema", "size").agg(F.array_sort(F.collect_list(F.struct("often", "c"))).alias("r"))
    needed = F.greatest(F.ceil(F.col("size") * _least_overlap(at_least) - 1e-9), F.lit(1)).cast("int")
    return ranked.select("schema", "size", F.explode(F.slice("r", F.lit(1), F.col("size") - needed + 1)).alias("r")).select("schema", "size", "r.c")


def similar_schemas(catalog: DataFrame, at_least: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """Distinct schemas (schema, columns, column_types, datasets), and pairs of them that are alike (first, second,
    score; a schema of several datasets is a pair with itself).

    Candidates meet on their rarest columns (`_prefixes`), so a column that most tables have brings nobody together.
    """
    entries = F.sort_array(F.map_entries("column_types"))
    keyed = catalog.select("dataset", "columns", "column_types", F.to_json(F.struct(F.array_sort("columns"), entries)).alias("_k"))
    schemas = keyed.groupBy(F.sha2("_k", 256).alias("schema")).agg(
        F.first("columns").alias("columns"), F.first("column_types").alias("column_types"), F.count(F.lit(1)).alias("datasets")
    )
    rows = schemas.withColumn("kept", F.filter("columns", lambda c: ~F.lower(c).isin(*COMMON_NAMES)))
    # A pair is compared on kept names, or on all names where one side has no kept one.
    lonely = F.size("kept") == 0
    kept = _prefixes(rows.where(~lonely).select("schema", F.array_distinct("kept").alias("cs")), at_least)
    whole = _prefixes(rows.select("schema", F.array_distinct("columns").alias("cs")), at_least)
    alone = rows.where(lonely).select("schema")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        least, most = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
        both = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.schema") != F.col("y.schema")) & (least >= most * _least_overlap(at_least) - 1e-9))
        a, b = F.col("x.schema"), F.col("y.schema")
        return both.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))

    pairs = meet(kept, kept).unionByName(meet(whole.join(alone, "schema", "left_semi"), whole)).distinct()
    itself = schemas.where("datasets > 1").select(F.col("schema").alias("first"), F.col("schema").alias("second"))
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    both = pairs.unionByName(itself).join(a, F.col("first") == F.col("a_schema")).join(b, F.col("second") == F.col("b_schema"))
    some = (F.size("a_kept") == 0) | (F.size("b_kept") == 0)
    left = F.when(some, F.col("a_columns")).otherwise(F.col("a_kept"))
    right = F.when(some, F.col("b_columns")).otherwise(F.col("b_kept"))
    both = both.withColumns({"_l": left, "_r": right}).withColumn("_common", F.array_intersect("_l", "_r"))
    same = F.size(F.filter("_common", lambda c: F.col("a_column_types")[c] == F.col("b_column_types")[c]))
    overlap = F.size("_common") / F.greatest(F.size("_l"), F.size("_r"))
    types = F.coalesce(F.try_divide(same, F.size("_common")), F.lit(0.0))
    base = COLUMN_WEIGHT * overlap + TYPE_WEIGHT * types
    sizes = F.least(F.size("a_columns"), F.size("b_columns")) / F.greatest(F.size("a_columns"), F.size("b_columns"))
    score = F.when(sizes < 0.7, base * sizes).otherwise(base)
    alike = both.select("first", "second", score.alias("score")).where(F.col("score") >= at_least)
    members = keyed.select("dataset", F.sha2("_k", 256).alias("schema"))
    return members, alike


def similar_datasets(catalog: DataFrame, at_least: float = 0.80) -> DataFrame:
    """Pairs of catalog entries with alike columns and types; a size difference over 30% lowers the score.

    The work is done on distinct schemas (`similar_schemas`); every pair of datasets of alike schemas is a row.
    """
    members, alike = similar_schemas(catalog, at_least)
    a = members.select(F.col("schema").alias("first"), F.col("dataset").alias("_a"))
    b = members.select(F.col("schema").alias("second"), F.col("dataset").alias("_b"))
    rows = alike.join(a, "first").join(b, "second")
    rows = rows.where((F.col("first") != F.col("second")) | (F.col("_a") < F.col("_b")))
    return rows.select(F.least("_a", "_b").alias("first"), F.greatest("_a", "_b").alias("second"), "score")


def recurring_insights(registry: DataFrame, at_least: int = 3, prefix: int | None = None) -> DataFrame:
    """First insights that several datasets share (columns dataset, insights array), or share in their first `prefix`
    characters."""
    insight = F.get("insights", F.lit(0))
    first = F.trim(F.lower(insight if prefix is None else F.substring(insight, 1, prefix)))
    rows = registry.select("dataset", first.alias("pattern")).where(F.col("pattern").isNotNull())
    counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("datasets"))
    return counts.where(F.col("datasets") >= at_least)


def append_registry(registry: DataFrame, entries: DataFrame, name: str, moment: str, keep: int | None = None) -> DataFrame:
    """Replace entries of the same name by the newest; with `keep`, only so many newest entries stay."""
    rows = registry.unionByName(entries)
    others = [c for c in rows.columns if c != name]
    newest = rows.groupBy(name).agg(F.max_by(F.struct(*others), F.col(moment)).alias("_e"))
    unique = newest.select(*[F.col("_e")[c].alias(c) if c != name else F.col(name) for c in rows.columns])
    return unique if keep is None else unique.orderBy(F.col(moment).desc(), name).limit(keep)


def change_log(changes: DataFrame, row_id: str) -> DataFrame:
    """The exported form of the cell changes."""
    return changes.select(
        F.col(row_id).alias("row"),
        "column",
        "operation",
        category(F.col("operation")).alias("category"),
        F.coalesce("before", F.lit("")).alias("before"),
        F.coalesce("after", F.lit("")).alias("after"),
    )


def issue_report(report: DataFrame) -> DataFrame:
    """Columns of a column report that need attention."""
    return report.where(F.col("status") != "clean")


