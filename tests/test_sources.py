"""First lines of files in one job, inventories, landed files with a quarantine."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.sources import files, nested


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03}.csv").write_text("" if i == 7 else f"id,c{i % 3},id\n" + "1,2,3\n" * (i % 5))
    found, count = jobs(spark, "headers", lambda: files.headers(spark, str(tmp_path)))
    assert count == 1 and len(found) == 299
    assert {p.rsplit("/", 1)[-1]: h for p, h in found.items()}["f010.csv"] == ("id", "c1", "id")


def test_a_large_file_is_not_read_whole(spark, tmp_path):
    """A header in front of 60 MB: the reading task stops early."""
    with open(tmp_path / "large.csv", "w") as f:
        f.write("a;b\n")
        for _ in range(60):
            f.write("1234567;abcdefgh\n" * 60_000)
    reads = spark.sparkContext.accumulator(0)
    lines = spark.read.text(str(tmp_path / "large.csv"))

    def first(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch.slice(0, 1)
            return

    with files._file_per_partition(spark):
        lines.mapInArrow(first, "value string").collect()
    assert 0 < reads.value <= 10_000  # of 3,600,001 lines
    assert list(files.headers(spark, str(tmp_path), ";").values()) == [("a", "b")]
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(files.WHOLE)


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1", "cp1250", "UTF-16", "UTF-16LE", "UTF-32"])
def test_headers_in_other_encodings(spark, tmp_path, encoding):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_bytes(f"straße{i},été\r\n1,2\r\n".encode(encoding))
    found, count = jobs(spark, f"enc-{encoding}", lambda: files.headers(spark, str(tmp_path), encoding=encoding))
    assert count == 1 and list(found.values()) == [(f"straße{i}", "été") for i in range(3)]


def test_inventory_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,x\n1,\n2,5\n")
    (tmp_path / "b.csv").write_text("user_id,x\n3,4\n")
    (tmp_path / "c.csv").write_text("y\n")
    (tmp_path / "d.csv").write_text("z\n7\n")
    got = {r.dataset: (r.rows, r["columns"], r.missing_pct, r.candidate_keys) for r in files.file_inventory(spark, str(tmp_path), ["id"]).collect()}
    assert got == {"a.csv": (2, 2, 25.0, "user_id"), "b.csv": (1, 2, 0.0, "user_id"), "d.csv": (1, 1, 0.0, "None")}


def test_landed_files_and_quarantine(spark, tmp_path):
    good = {"meta": {"x": 1}, "data": [{"date": "2024-01-01", "nav": "1.5"}, {"date": "2024-01-02", "nav": None}]}
    (tmp_path / "100.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "200.json").write_text(json.dumps(good)[:-20])
    (tmp_path / "300.json").write_text(json.dumps({"status": "error"}))
    (tmp_path / "400.json").write_text(json.dumps({"data": []}))
    (tmp_path / "500.json").write_text("")
    landed = nested.read_landed(spark, str(tmp_path), "date string, nav string")
    assert sorted(map(tuple, landed.rows.collect())) == [("100", "2024-01-01", "1.5"), ("100", "2024-01-02", None)]
    bad = {r.scheme_code: r.reason for r in landed.quarantine.collect()}
    assert {k: bad[k] for k in ("200", "300", "400")} == {"200": "unreadable", "300": "no list", "400": "empty list"}
    assert landed.quarantine.where("scheme_code = '200'").first()["text"].startswith("{")
    counts = landed.counts("scheme_code").first()
    assert (counts["keys"], counts["rows"]) == (1, 2) and counts["keys"] + counts["quarantined"] == 1 + len(bad)


def test_landed_documents_of_a_table_are_sorted_out_as_files_are(spark, tmp_path):
    texts = {"100": '{"data": [{"date": "2024-01-01", "nav": "1.5"}, {"date": "2024-01-02"}]}', "200": '{"data": [{"date": ', "300": '{"status": "error"}', "400": '{"data": []}', "500": ""}
    spark.createDataFrame(list(texts.items()), "scheme_code string, text string").coalesce(1).write.parquet(str(tmp_path / "packed"))
    landed = nested.parse_landed(spark.read.parquet(str(tmp_path / "packed")), "date string, nav string", "scheme_code", "text")
    assert sorted(map(tuple, landed.rows.collect())) == [("100", "2024-01-01", "1.5"), ("100", "2024-01-02", None)]
    bad = {r.scheme_code: (r.reason, r.text) for r in landed.quarantine.collect()}
    assert bad == {"200": ("unreadable", texts["200"]), "300": ("no list", None), "400": ("empty list", None), "500": ("unreadable", "")}


def test_landing_of_many_documents_makes_few_files(spark):
    from pathlib import Path

    from grainmill import session
    from grainmill.workloads import QUERIES, load_all

    load_all()
    rows = QUERIES["s13_landed_rows"](spark, "/root/testdata/sf0.01")
    folder = next(f for f in reversed(session._SCRATCH) if "grainmill-landed" in f)
    assert rows.select("user").distinct().count() > 100
    assert len(list(Path(folder.removeprefix("file:")).rglob("*.parquet"))) <= 8


def test_inferred_types_try_no_kind_that_a_value_has_failed(spark, monkeypatch):
    from grainmill.functions import dates

    tried = []
    real = dates.parse_mixed
    monkeypatch.setattr(dates, "parse_mixed", lambda c: tried.append(1) or real(c))
    rows = spark.range(300).select(
        (F.col("id") + 0.5).cast("string").alias("part"),
        F.when(F.col("id") == 299, "x").otherwise(F.col("id").cast("string")).alias("late"),
        F.lit("2024-01-05").alias("day"),
        F.lit(" 7 ").alias("seven"),
        F.lit(None).cast("string").alias("none"),
    )
    kinds = dict(files.infer_types(rows).dtypes)
    assert kinds == {"part": "double", "late": "string", "day": "timestamp_ntz", "seven": "bigint", "none": "string"}
    assert len(tried) == 5 + 2 + 1  # the few rows; `day` and `none` over all rows; the cast of `day`
