"""Versions compared by hash buckets: the same changes as the whole join, from few rows."""

import pytest
from pyspark.sql import functions as F

from grainmill.operators import changelog, versions

SCHEMA = "id bigint, a string, b double, c string"


@pytest.fixture(scope="module")
def older(spark):
    rows = [(i, None if i % 7 == 0 else f"n{i % 50}", i / 3, "" if i % 11 == 0 else "x") for i in range(20_000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def edited(df, where, **new):
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def as_rows(df):
    return sorted(map(str, df.collect()))


def test_few_changes_touch_few_rows(older):
    newer = edited(older, F.col("id").isin(*range(100, 110)), a=F.lit("new"), b=F.lit(None)).where("id NOT IN (7, 8)")
    newer = newer.unionByName(older.where("id = 5").withColumn("id", F.lit(-1).cast("long")))
    left, right = versions.differing(older, newer, "id")
    assert left.count() < 40 and right.count() < 40  # of 20,000: the changed rows and their bucket mates
    assert as_rows(changelog.cell_changes(older, newer, "id", few=True)) == as_rows(changelog.cell_changes(older, newer, "id"))
    assert sorted(r.id for r in changelog.removed_rows(older, newer, "id", few=True).collect()) == [7, 8]
    assert versions.row_changes(older, newer, "id").first().asDict() == {"rows_added": 1, "rows_removed": 2, "rows_changed": 10}


def test_changes_all_over(older):
    newer = edited(older, F.col("id") % 2 == 0, c=F.lit("y")).withColumnRenamed("a", "name")
    names = {"a": "name"}
    assert as_rows(changelog.cell_changes(older, newer, "id", names, few=True)) == as_rows(changelog.cell_changes(older, newer, "id", names))
    assert versions.row_changes(older, newer, "id", names).first()["rows_changed"] == 10_000


def test_equal_versions_and_empty_ones(older):
    same = edited(older, F.col("a").isNull(), a=F.lit(""))  # null compares as ''
    assert changelog.cell_changes(older, same, "id", few=True).count() == 0
    assert versions.row_changes(older, older.repartition(3), "id").first().asDict() == {"rows_added": 0, "rows_removed": 0, "rows_changed": 0}
    none = older.limit(0)
    assert versions.row_changes(none, older, "id").first()["rows_added"] == 20_000
    assert versions.row_changes(older, none, "id").first()["rows_removed"] == 20_000
    assert versions.row_changes(none, none, "id").first()["rows_changed"] == 0


def test_the_first_level_shuffles_buckets_only(older):
    """Both sides are aggregated before their shuffle: at most one row per bucket and task."""
    plan = versions._unequal(older, older, "id", [("a", "a"), ("b", "b")], {"b1": versions._levels("id")[0]})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("partial_sum") >= 2
