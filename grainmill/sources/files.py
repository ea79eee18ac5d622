"""Reading delimited text and JSON files, writing tables and run packages."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from grainmill.operators.clean import unique_names

# Separators tried by the sniffer, in order of preference.
SEPARATORS = (",", ";", "\t")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Most frequent separator of a file or folder, a comma when none occurs. Counts over the whole text in one job."""
    line = F.col("value")
    counted = spark.read.text(path).agg(
        *[F.sum(F.length(line) - F.length(F.translate(line, s, ""))).alias(str(i)) for i, s in enumerate(SEPARATORS)]
    )
    counts = [n or 0 for n in counted.first()]
    best = max(range(len(SEPARATORS)), key=lambda i: counts[i])
    return SEPARATORS[best] if counts[best] else ","


WHOLE = 1 << 50  # larger than any file: a file is one partition, and no two share one


@contextmanager
def _file_per_partition(spark: SparkSession):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, str(WHOLE))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def first_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> list[tuple[str, str]]:
    """Path and first line of every file under the paths that has a line, in the order of the paths. One job.

    Every file is a task that stops at its first line, so a large file costs no more than a small one.
    """
    name = encoding.upper().replace("_", "-")
    width = 2 if name.startswith("UTF-16") else 4 if name.startswith("UTF-32") else 1
    reader = spark.read
    if width > 1 and name.endswith(("LE", "BE")):
        reader = reader.option("encoding", encoding).option("lineSep", "\n")  # line ends of several bytes
    lines = reader.text([paths] if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line")
    )

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    with _file_per_partition(spark):
        found = lines.mapInArrow(first, "path string, line binary").collect()

    def decoded(line: bytes) -> str:
        # Where a mark at the file's start tells the byte order, lines end at a byte; what is left of the sign goes.
        return line[: len(line) // width * width].decode(encoding, "replace").lstrip("\ufeff").rstrip("\r\n")

    return sorted((r["path"], decoded(bytes(r["line"]))) for r in found)


def headers(
    spark: SparkSession, paths: str | Sequence[str], separator: str = ",", encoding: str = "UTF-8"
) -> dict[str, tuple[str, ...]]:
    """The raw header of every file under the paths, repeats and empty names as they are; see `first_lines`.

    Files without a line are left out.
    """
    lines = first_lines(spark, paths, encoding)
    return {path: tuple(next(csv.reader([line], delimiter=separator), [])) for path, line in lines}


def by_header(found: Mapping[str, tuple[str, ...]]) -> dict[tuple[str, ...], list[str]]:
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in found.items():
        if names:
            groups.setdefault(names, []).append(path)
    return groups


def resolved_names(raw: Sequence[str]) -> list[str]:
    """Names for a raw header: empty ones `Unnamed: i`, repeats `name_1`, `name_2`, ..."""
    return unique_names([n if n.strip() else f"Unnamed: {i}" for i, n in enumerate(raw)])


def read_delimited(
    spark: SparkSession, path: str, separator: str | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Delimited text with a header, every column as text. The separator is sniffed when not given.

    Files of a folder with different headers are read by their own ones and put together by name.
    """
    separator = separator or sniff_separator(spark, path)
    return _read_groups(spark, by_header(headers(spark, path, separator, encoding)), separator, encoding)


def _read_groups(spark: SparkSession, groups: dict, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """One scan for the files of each header; columns that a file lacks are null."""
    frames = []
    for header, members in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in resolved_names(header)])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        frames.append(reader.option("sep", separator).option("encoding", encoding).csv(members))
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return read_delimited(spark, path, ",", encoding)


def read_tsv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return read_delimited(spark, path, "\t", encoding)


def read_typed(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Known columns with their types; dates are parsed while scanning."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path)


KINDS = ("whole", "number", "moment")
SAMPLED_ROWS = 100  # rows asked first; they only rule kinds out


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns that read whole as long, double or date. Runs one aggregate job over the file, and one over a
    few rows before: a kind that one value fails is not tried on the others."""
    from grainmill.functions.dates import parse_mixed
    from grainmill.functions.numbers import read_double
    from grainmill.functions.text import blank_to_null, strip

    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    values = {c: blank_to_null(strip(F.col(c))) for c in texts}

    def counts(rows: DataFrame, kinds: dict[str, list[str]]) -> dict[str, dict]:
        reads = {"whole": lambda v: v.try_cast("bigint"), "number": read_double, "moment": parse_mixed}
        found = rows.agg(
            *[F.struct(F.count(v).alias("n"), *[F.count(reads[k](v)).alias(k) for k in kinds[c]]).alias(c) for c, v in values.items()]
        ).first()
        return {c: found[c].asDict() for c in texts}

    few = counts(df.limit(SAMPLED_ROWS), {c: list(KINDS) for c in texts})
    found = counts(df, {c: [k for k in KINDS if few[c][k] == few[c]["n"]] for c in texts})
    casts = {}
    for c in texts:
        n = found[c]["n"]
        if n == 0:
            continue
        if found[c].get("whole") == n:
            casts[c] = values[c].cast("bigint")
        elif found[c].get("number") == n:
            casts[c] = values[c].cast("double")
        elif found[c].get("moment") == n:
            casts[c] = parse_mixed(values[c])
    return df.withColumns(casts) if casts else df


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several files as one table; columns a file lacks are null. Files with one header are read in one scan."""
    return _read_groups(spark, by_header(headers(spark, paths)))


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Paths under a folder on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if str(s.getPath()).endswith(suffix))


def catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every delimited file of a folder by name, for `integrity.inventory` and friends."""
    paths = list_files(spark, folder)
    found = headers(spark, paths) if paths else {}
    return {p.rsplit("/", 1)[-1]: _read_groups(spark, by_header({p: h})) for p, h in found.items()}


def file_inventory(spark: SparkSession, paths: str | Sequence[str], words: Sequence[str], separator: str = ",") -> DataFrame:
    """Per file: name, rows, columns, percent of missing cells, key-like columns. A scan and one grouped aggregate per
    distinct header, whatever the number of files."""
    frames = []
    for header, members in by_header(headers(spark, paths, separator)).items():
        names = resolved_names(header)
        rows = _read_groups(spark, {header: members}, separator).withColumn("_file", F.col("_metadata.file_name"))
        missing = reduce(lambda a, b: a + b, [F.sum(F.col(f"`{n}`").isNull().cast("long")) for n in names])
        keys = ", ".join(n for n in names if any(w in n.lower() for w in words)) or "None"
        frames.append(
            rows.groupBy(F.col("_file").alias("dataset")).agg(
                F.count(F.lit(1)).alias("rows"),
                F.lit(len(names)).alias("columns"),
                F.coalesce(F.try_divide(missing * 100.0, F.count(F.lit(1)) * len(names)), F.lit(0.0)).alias("missing_pct"),
                F.lit(keys).alias("candidate_keys"),
            )
        )
    kind = "dataset string, rows bigint, columns int, missing_pct double, candidate_keys string"
    return reduce(DataFrame.unionByName, frames, spark.createDataFrame([], kind))


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_table(df: DataFrame, path: str, table: str | None = None) -> None:
    """Append to a star-schema table kept as Parquet; `table` names its definition."""
    from grainmill.operators.star import conform

    rows = conform(df, table) if table else df
    rows.write.mode("append").parquet(path)


def write_sections(sections: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """One table per report section, `<folder>/<section>`."""
    for name, frame in sections.items():
        writer = frame.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{folder}/{name}")


def write_audit_package(cleaned: DataFrame, issues: DataFrame, changes: DataFrame, folder: str) -> None:
    """Cleaned data, issue report and change log of one run under one folder."""
    write_sections({"data": cleaned, "issues": issues, "change_log": changes}, folder)
