"""JSON records: root lists, dotted flattening, child lists with their parents' fields, nesting depth."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def depth(kind: T.DataType) -> int:
    """Levels of objects and lists below a value."""
    if isinstance(kind, T.StructType):
        return 1 + max((depth(f.dataType) for f in kind.fields), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + depth(kind.elementType)
    return 0


def child_lists(df: DataFrame) -> list[str]:
    """Dotted names of all lists of objects."""
    found: list[str] = []

    def walk(kind: T.DataType, prefix: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found.append(prefix)

    walk(df.schema, "")
    return found


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to columns with dotted names; lists stay as they are."""
    columns = []

    def walk(kind: T.DataType, path: str, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.`{f.name}`", f"{name}.{f.name}")
        else:
            columns.append(F.col(path).alias(name))

    for f in df.schema.fields:
        walk(f.dataType, f"`{f.name}`", f.name)
    return df.select(*columns)


def records(df: DataFrame) -> DataFrame:
    """The rows of a JSON document: its first list of objects, or the document itself."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return df.select(F.explode(f"`{f.name}`").alias("r")).select("r.*")
    return df


def explode_children(df: DataFrame, child: str) -> DataFrame:
    """One row per child of a list column, with the parent's plain fields in front as `parent.<name>`."""
    parents = [
        F.col(f"`{f.name}`").alias(f"parent.{f.name}")
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    ]
    rows = df.select(*parents, F.explode(child).alias("_child"))
    names = [f"`{c}`" for c in rows.columns if c != "_child"]
    return flatten(rows.select(*names, "_child.*"))


def read_records(spark: SparkSession, path: str, multi_line: bool = True, root_list: bool = True) -> DataFrame:
    """JSON files to a flat table: children when the nesting is deep, dotted names.

    With `root_list` a file is one document whose first list holds the records; without it (JSON lines, or a file
    that is a list) every object is a record.
    """
    document = spark.read.option("multiLine", multi_line).json(path)
    rows = records(document) if root_list else document
    lists = [c for c in child_lists(rows) if "." not in c]
    if depth(rows.schema) >= 3 and lists:
        return explode_children(rows, lists[0])
    return flatten(rows)


class Landed(NamedTuple):
    """Rows of the readable files, and the others with what is wrong with them."""

    rows: DataFrame
    quarantine: DataFrame

    def counts(self, key: str) -> DataFrame:
        """One row: keys with rows, rows, keys in quarantine."""
        broken = self.quarantine.agg(F.count_distinct(key)).scalar()
        return self.rows.agg(F.count_distinct(key).alias("keys"), F.count(F.lit(1)).alias("rows")).select("*", broken.alias("quarantined"))


def read_landed(
    spark: SparkSession, path: str, schema: str, key: str = "scheme_code", pattern: str = r"([^/]+)\.json$", field: str = "data"
) -> Landed:
    """Landed JSON files of one document per key: rows (key and `schema`) of the list `field`, and a quarantine.

    The key is the first group of `pattern` in the file's path. A file that is no JSON document, or whose list is
    missing, empty or of another form, does not stop the others: it goes to the quarantine (key, path, reason, text).
    Every file is either read or quarantined.
    """
    kind = f"`{field}` array<struct<{schema}>>, _broken string"
    reader = spark.read.schema(kind).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken")
    place = F.col("_metadata.file_path")
    found = reader.option("recursiveFileLookup", True).json(path).select(
        F.regexp_extract(place, pattern, 1).alias(key), place.alias("path"), F.col(f"`{field}`").alias("_list"), "_broken"
    )
    return _sorted_out(found, key)


def parse_landed(documents: DataFrame, schema: str, key: str, text: str, field: str = "data") -> Landed:
    """As `read_landed`, for landed documents kept as rows of a table, each with its key and whole text.

    A file to itself costs a document a folder, a listing and an open, so very many small ones are packed.
    """
    kind = f"`{field}` array<struct<{schema}>>, _broken string"
    parsed = F.from_json(text, kind, {"columnNameOfCorruptRecord": "_broken"})
    read = documents.withColumn("_read", parsed).select(
        F.col(key).cast("string").alias(key),
        F.col("_metadata.file_path").alias("path"),
        F.col(f"_read.`{field}`").alias("_list"),
        F.when(F.col("_read").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.col("_read._broken")).alias("_broken"),
    )
    return _sorted_out(read, key)


def _sorted_out(found: DataFrame, key: str) -> Landed:
    """Key, path, `_list` and `_broken` text of every document, as rows and quarantine."""
    reason = (
        F.when(F.col("_broken").isNotNull(), "unreadable")
        .when(F.col("_list").isNull(), "no list")
        .when(F.size("_list") == 0, "empty list")
    )
    marked = found.withColumn("reason", reason)
    rows = marked.where("reason IS NULL").select(key, F.explode("_list").alias("_r")).select(key, "_r.*")
    return Landed(rows, marked.where("reason IS NOT NULL").select(key, "path", "reason", F.col("_broken").alias("text")))


def parse_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Replace a JSON text column by its fields, named `<column>.<field>`."""
    parsed = df.withColumn(column, F.from_json(column, schema))
    return flatten(parsed)
