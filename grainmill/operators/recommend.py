"""From issues to fixes: one recommendation per kind of issue, its cleaning actions, and a preview of its effect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.functions import numbers, text
from grainmill.functions.dates import parse_mixed
from grainmill.operators.explore import numeric_columns

# Fix, its title, confidence, category, severity (None: as found) and the issues it answers.
FIXES = (
    ("fix_missing_values", "Fill Missing Values", "High", "Missing Data", None, ("missing_values",)),
    ("fix_blank_strings", "Clean Blank Strings", "High", "Text Quality", "warning", ("blank_strings",)),
    ("fix_duplicates", "Remove Duplicate Records", "High", "Duplicates", None, ("duplicate_rows",)),
    ("fix_near_duplicates", "Review Near Duplicates", "Low", "Duplicates", "warning", ("near_duplicates",)),
    ("fix_whitespace", "Trim Whitespace", "High", "Text Quality", "warning", ("whitespace_ends", "whitespace_multiple")),
    ("fix_case", "Normalize Text Case", "High", "Text Quality", "warning", ("case_inconsistent",)),
    ("fix_special_chars", "Remove Special Characters", "Medium", "Text Quality", "warning", ("special_characters",)),
    ("fix_dates", "Standardize Dates", "Medium", "Data Types", "warning", ("invalid_dates",)),
    ("fix_numeric", "Convert to Numbers", "High", "Data Types", "warning", ("numeric_failures",)),
    ("fix_outliers", "Handle Statistical Outliers", "Medium", "Data Quality", "warning", ("outliers",)),
    ("fix_empty_rows", "Remove Empty Rows", "High", "Structure", "critical", ("empty_rows",)),
    ("fix_empty_cols", "Remove Empty Columns", "High", "Structure", "critical", ("empty_columns",)),
    ("fix_business_rules", "Fix Range Violations", "Medium", "Data Quality", "warning", ("business_rules",)),
    ("fix_mixed_types", "Resolve Mixed Data Types", "Low", "Data Quality", "critical", ("mixed_types",)),
    ("fix_categories", "Standardize Categories", "Low", "Text Quality", "warning", ("category_inconsistent",)),
    ("fix_uniqueness", "Fix Duplicate Keys", "Low", "Data Quality", "critical", ("uniqueness_violations",)),
)

# Expected gain in points of fixes whose gain does not depend on the data.
GAINS = {
    "fix_blank_strings": 3, "fix_near_duplicates": 2, "fix_whitespace": 3, "fix_case": 3, "fix_special_chars": 2,
    "fix_dates": 3, "fix_numeric": 3, "fix_outliers": 2, "fix_empty_rows": 5, "fix_empty_cols": 5,
    "fix_business_rules": 2, "fix_mixed_types": 1, "fix_categories": 2, "fix_uniqueness": 3,
}

SEVERITY_ORDER = ("critical", "warning", "info")


def fix_table(spark: SparkSession) -> DataFrame:
    """The fixes as rows, one per issue kind. Fixed and tiny."""
    rows = [
        (fix, title, confidence, category, severity, issue, GAINS.get(fix))
        for fix, title, confidence, category, severity, found in FIXES
        for issue in found
    ]
    return spark.createDataFrame(
        rows, "fix string, title string, confidence string, category string, fixed_severity string, id string, gain int"
    )


def recommendations(found: DataFrame, rows: Column, cells: Column) -> DataFrame:
    """One row per fix with severity, affected cells and columns, expected gain; critical first, then by gain.

    `rows` and `cells` are the table's sizes. Issue rows number at most kinds times columns.
    """
    joined = found.join(F.broadcast(fix_table(found.sparkSession)), "id")
    grouped = joined.groupBy("fix", "title", "confidence", "category", "gain").agg(
        F.max(F.coalesce("fixed_severity", F.when(F.col("severity") == "critical", "critical"))).alias("s"),
        F.sum("affected_count").alias("affected_count"),
        F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("columns"),
        F.min("fixed_severity").alias("f"),
    )
    severity = F.coalesce("f", F.when(F.col("s") == "critical", "critical"), F.lit("warning"))
    share = F.when(F.col("fix") == "fix_missing_values", F.least(F.lit(15), F.floor(F.col("affected_count") * 100 / F.greatest(cells, F.lit(1)))))
    share = share.when(F.col("fix") == "fix_duplicates", F.least(F.lit(10), F.floor(F.col("affected_count") * 100 / F.greatest(rows, F.lit(1)))))
    placed = grouped.select(
        "fix",
        "title",
        severity.alias("severity"),
        "affected_count",
        "columns",
        "confidence",
        "category",
        F.coalesce("gain", share).cast("int").alias("gain"),
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return placed.orderBy(order, F.col("gain").desc(), "fix")


def actions_for(
    fix: str, df: DataFrame, columns: Sequence[str], options: Mapping[str, object] | None = None
) -> list[tuple[str, dict]]:
    """Cleaning actions (name, arguments) of a fix. `options` picks among the strategies of the fix."""
    o = dict(options or {})
    columns = [c for c in columns if c in df.columns]
    if fix == "fix_missing_values":
        strategy = o.get("strategy", "smart")
        number = [c for c in columns if c in numeric_columns(df)]
        other = [c for c in columns if c not in number]
        actions: list[tuple[str, dict]] = []
        if strategy == "custom":
            actions.append(("fill_default", {"columns": columns, "placeholder": o.get("value", "Unknown")}))
        else:
            if number:
                kind = {"smart": "mean", "mean": "mean", "median": "median", "mode": "mode"}[strategy]
                actions.append(("fill_statistic", {"columns": number, "strategy": kind}))
            if other:
                actions.append(("fill_default", {"columns": other, "placeholder": "Unknown"}))
        if o.get("drop_rows", True) or o.get("drop_columns", True) or o.get("critical"):
            actions.append(
                (
                    "drop_missing",
                    {
                        "rows": o.get("drop_rows", True),
                        "columns": o.get("drop_columns", True),
                        "critical": o.get("critical", []),
                    },
                )
            )
        return actions
    if fix == "fix_blank_strings":
        return [] if o.get("strategy") == "keep" else [("blanks_to_null", {"columns": columns})]
    if fix == "fix_duplicates":
        keep = {"first": "first", "last": "last", "all": "none"}[o.get("strategy", "first")]
        return [("remove_duplicates", {"exact": o.get("exact", True), "subset": o.get("subset", []), "keep": keep})]
    if fix == "fix_whitespace":
        name = "trim_whitespace" if o.get("strategy", "trim_all") == "trim_all" else "trim_ends"
        return [(name, {"columns": columns})]
    if fix == "fix_case":
        return [("normalize_case", {"columns": columns, "case": o.get("strategy", "title")})]
    if fix == "fix_special_chars":
        # The detector looks for control characters, so they are what the default removes.
        return [("remove_special", {"columns": columns, "mode": o.get("strategy", "control")})]
    if fix == "fix_dates":
        return [("standardize_dates", {"columns": columns, "target": o.get("strategy", "iso")})]
    if fix == "fix_numeric":
        name = "convert_numeric" if o.get("strategy", "standard") == "standard" else "convert_integer"
        return [(name, {"columns": columns})]
    if fix == "fix_outliers":
        return [
            (
                "filter_outliers",
                {
                    "columns": columns,
                    "method": o.get("method", "iqr"),
                    "threshold": o.get("threshold", 1.5),
                    "action": o.get("strategy", "cap"),
                },
            )
        ]
    if fix == "fix_empty_rows":
        return [] if o.get("strategy") == "keep" else [("drop_missing", {"rows": True, "columns": False})]
    if fix == "fix_empty_cols":
        return [] if o.get("strategy") == "keep" else [("drop_missing", {"rows": False, "columns": True})]
    if fix == "fix_business_rules":
        rules = o.get("rules") or [(c, "<", 0, o.get("strategy", "null")) for c in columns]
        return [("apply_range_rules", {"rules": rules})]
    return []


def preview(df: DataFrame, fix: str, column: str, order: str, n: int = 5) -> DataFrame:
    """First `n` cells of a column, along the row id `order`, that a fix would change, before and after.

    The limit is the preview itself.
    """
    c = F.col(column)
    after = {
        "fix_missing_values": F.coalesce(c.cast("string"), F.lit("Unknown")),
        "fix_blank_strings": text.blank_to_null(c.cast("string")),
        "fix_whitespace": text.squeeze(c.cast("string")),
        "fix_case": text.title_case(c.cast("string")),
        "fix_special_chars": text.remove_characters(c.cast("string"), "control"),
        "fix_dates": F.date_format(parse_mixed(c.cast("string")), "yyyy-MM-dd"),
        "fix_numeric": numbers.to_number(c.cast("string")).cast("string"),
        "fix_business_rules": F.when(~numbers.compare(c.try_cast("double"), "<", 0), c.cast("string")),
    }[fix]
    before = c.cast("string")
    rows = df.where(~before.eqNullSafe(after)).orderBy(order).limit(n)
    return rows.select(F.lit(column).alias("column"), before.alias("before"), after.alias("after"))


