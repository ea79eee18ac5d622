"""Plans that count while they run: the same figures as the lazy metrics, one read of the source, recorded errors."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import changelog, clean
from grainmill.plans import cleaning
from grainmill.plans.cleaning import Action, apply_plan, run_plan

PLAN = [
    Action("trim_whitespace", {"columns": ["a"]}),
    Action("fill_default", {"columns": ["a"], "placeholder": "none"}),
    Action("convert_numeric", {"columns": ["b"]}),
    Action("validate_ranges", {"rules": [("b", ">", 90, "drop"), ("b", "<", 5, "cap")]}),
    Action("filter_outliers", {"columns": ["b"], "method": "zscore", "threshold": 0.8, "action": "null"}),
    Action("rename_columns", {"rules": {"a": "label"}}),
]


@pytest.fixture
def rows(spark):
    data = [(i, [" x ", None, "y  z", "", "w"][i % 5], ["12", "$5", "bad", "97", None, "3"][i % 6]) for i in range(200)]
    return spark.createDataFrame(data, "id int, a string, b string").repartition(4)


def counted(spark, df):
    """The frame, and how many rows have been read from it so far."""
    reads = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return df.mapInArrow(through, df.schema), reads


def test_measured_like_the_lazy_metrics(spark, rows):
    lazy = apply_plan(rows, PLAN, cut_every=0)
    measured = run_plan(rows, PLAN)
    assert not measured.errors
    want = [json.loads(r.detail) for r in changelog.timeline(lazy.metrics).orderBy("step").collect()]
    assert [json.loads(r.detail) for r in measured.timeline().orderBy("step").collect()] == want
    assert sorted(map(str, measured.df.collect())) == sorted(map(str, lazy.df.collect()))
    assert want[3]["rows_removed"] > 0 and want[4]["cells_modified"] > 0


def test_the_source_is_read_once(spark, rows):
    narrow = [a for a in PLAN if a.kind != "filter_outliers"]  # which looks at the whole column first
    source, reads = counted(spark, rows)
    run_plan(source, narrow)
    assert reads.value == 200
    source, reads = counted(spark, rows)
    run = run_plan(source, [*narrow[:3], Action("remove_duplicates", {"subset": ["a", "b"]}), *narrow[3:]])
    assert reads.value == 200 and run.steps[3][1]["rows_removed"] > 0


def test_copies_are_counted_on_what_the_steps_before_left(spark, rows):
    plan = [PLAN[0], Action("remove_duplicates", {}), Action("drop_columns", {"columns": ["b"]})]
    doubled = rows.unionByName(rows.withColumn("a", F.concat("a", F.lit(" "))))
    run = run_plan(doubled, plan)
    trimmed = clean.trim_whitespace(doubled, ["a"]).df
    assert run.steps[1] == ("remove_duplicates", {"rows_removed": 400 - trimmed.distinct().count()})
    assert run.df.columns == ["id", "a"] and run.df.count() == trimmed.distinct().count()


def test_errors_are_recorded_and_the_rest_goes_on(spark, rows, monkeypatch):
    def broken(df):
        return clean.measured(df, df.withColumn("a", F.raise_error(F.lit("no good")).cast("string")), {"cells_modified": F.count("a")})

    monkeypatch.setitem(cleaning.OPERATIONS, "broken", broken)
    plan = [PLAN[0], Action("broken"), Action("filter_outliers", {"columns": ["b"], "method": "unheard of"}), PLAN[1]]
    run = run_plan(rows, plan)
    assert [name for name, _ in run.errors] == ["filter_outliers", "broken"] and "no good" in run.errors[1][1]
    assert [name for name, _ in run.steps] == ["trim_whitespace", "fill_default"]
    want = apply_plan(rows, [PLAN[0], PLAN[1]]).df
    assert sorted(map(str, run.df.collect())) == sorted(map(str, want.collect()))


def test_plans_without_rows_or_steps(spark, rows):
    assert run_plan(rows, []).df.count() == 200
    run = run_plan(rows.limit(0), PLAN[:3])
    assert [counts for _, counts in run.steps] == [{"cells_modified": 0}, {"cells_filled": 0}, {"cells_modified": 0, "columns_converted": 1}]
