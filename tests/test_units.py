"""Operators on small fixtures, against pandas, numpy, known values or brute force."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.functions import dates, distributions, numbers, text
from grainmill.operators import changelog, clean, dedup, drift, explore, geo, inspect, integrity, ml, ordered, profile, series
from grainmill.operators.quantiles import aggregate_with_quantiles, column_quantiles, quantiles
from grainmill.operators.ranking import add_average_rank, percent_ranks
from grainmill.operators.star import entity_dimension, number_in_order
from grainmill.plans.cleaning import Action, apply_plan, build_plan
from grainmill.sources import databases, files, nested, rowid


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


# ---------------------------------------------------------------- functions


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2024-02-29", "2024-02-29"),
        ("02/13/2024", "2024-02-13"),
        ("13/02/2024", "2024-02-13"),
        (" 5-Jan-2024 ", "2024-01-05"),
        ("20240105", "2024-01-05"),
        ("January 5, 2024", "2024-01-05"),
        ("Jan 5 2024", "2024-01-05"),
        ("5 January 2024", "2024-01-05"),
        ("2024/01/05", "2024-01-05"),
        ("05.01.2024", "2024-05-01"),
        ("2023-02-29", None),
        ("soon", None),
        (None, None),
    ],
)
def test_mixed_dates(spark, value, expected):
    got = one(spark, F.date_format(dates.parse_mixed(F.lit(value).cast("string")), "yyyy-MM-dd"))
    assert got == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("$1,250.50", 1250.5), ("(1,250.50)", -1250.5), ("12%", 12.0), ("€ 7", 7.0), ("-3", -3.0), ("abc", None), ("", None)],
)
def test_text_to_number(spark, value, expected):
    assert one(spark, numbers.to_number(F.lit(value))) == expected


@pytest.mark.parametrize("value", ["mid-cap FUND", "o'neil x2y", "don't STOP", "ÉCOLE d'été"])
def test_title_case_follows_letters(spark, value):
    assert one(spark, text.title_case(F.lit(value))) == value.title()


def test_text_helpers(spark):
    assert one(spark, text.squeeze(F.lit(" a \t b\n"))) == "a b"
    assert one(spark, text.remove_characters(F.lit("hi \U0001f600 there!"), "emoji")) == "hi there!"
    assert one(spark, text.find_replace(F.lit("a.c abc"), [("A.C", "$1")], case_sensitive=False)) == "$1 abc"
    assert one(spark, text.split_part(F.lit("a|b"), "|", 1)) == "b"
    assert one(spark, text.split_part(F.lit("a|b"), "|", 2)) is None
    assert one(spark, text.zero_pad(F.lit("123456"), 4)) == "123456"
    assert one(spark, text.within_one_edit(F.lit("Brand"), F.lit("brands"))) is True


def test_bands_are_right_closed(spark):
    edges, labels = (0, 10, 20), ("low", "mid", "high")
    got = [one(spark, numbers.band(F.lit(float(v)), edges, labels)) for v in (0, 10, 10.5, 20, 21)]
    assert got == [None, "low", "mid", "mid", "high"]


def test_tail_probabilities():
    t = distributions._t_tail(np.array([2.0, 12.706204736432095]), np.array([10.0, 1.0]))
    assert np.allclose(t, [0.07338803477074, 0.05], atol=1e-10)
    f = distributions._f_tail(np.array([4.102821015], dtype=float), np.array([2.0]), np.array([10.0]))
    assert np.allclose(f, [0.05], atol=1e-7)


# ---------------------------------------------------------------- quantiles and ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; another has few; values with ties and nulls."""
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(30_000) < 0.7, "hot", rng.choice(["a", "b"], 30_000))
    values = np.round(rng.lognormal(3, 1, 30_000), 1)
    values[rng.random(30_000) < 0.05] = np.nan
    pdf = pd.DataFrame({"k": list(keys) + ["tiny"] * 3, "v": list(values) + [5.0, 1.0, 9.0]})
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_quantiles_match_pandas(spark, skewed):
    pdf, df = skewed
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(6)]
    got = quantiles(df, ["k"], "v", probabilities, names).toPandas().set_index("k")
    want = pdf.groupby("k")["v"].quantile(probabilities).unstack()
    for key in want.index:
        assert np.allclose(got.loc[key, names].astype(float), want.loc[key], rtol=1e-12)
    whole = quantiles(df, [], "v", [0.5], ["m"]).first()["m"]
    assert np.isclose(whole, pdf["v"].median())
    wide = aggregate_with_quantiles(df.withColumn("w", F.col("v") * 2), ["k"], [F.count("v").alias("n")], {"a": ("v", 0.5), "b": ("w", 0.25)})
    row = wide.where("k = 'hot'").first()
    assert np.isclose(row["b"], pdf[pdf.k == "hot"]["v"].quantile(0.25) * 2)
    columns = column_quantiles(df.withColumn("w", -F.col("v")), ["v", "w"], {"m": 0.5}).toPandas().set_index("column")["m"]
    assert np.isclose(columns["v"], -columns["w"])


def test_ranks_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(2000), "a": rng.integers(0, 300, 2000).astype(float), "b": rng.normal(size=2000)})
    df = spark.createDataFrame(pdf)
    got = add_average_rank(df, "a", "r", descending=True).toPandas().sort_values("id")["r"].to_numpy()
    assert np.allclose(got, pdf["a"].rank(ascending=False))
    pct = percent_ranks(df, "id", {"a": False, "b": True}).toPandas().sort_values("id")
    assert np.allclose(pct["a_pct"], pdf["a"].rank(pct=True))
    assert np.allclose(pct["b_pct"], pdf["b"].rank(pct=True, ascending=False))


def test_quantiles_of_odd_values(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [("n", 1.0), ("n", nan), ("n", nan), ("i", -inf), ("i", 2.0), ("i", inf), ("z", None), (None, 3.0), (None, 5.0)]
    spark.createDataFrame(rows, "k string, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in quantiles(df, ["k"], "v", [0.0, 0.5, 1.0], ["lo", "mid", "hi"]).collect()}
    assert got["n"][0] == 1.0 and np.isnan(got["n"][1]) and np.isnan(got["n"][2])
    assert got["i"] == (-inf, 2.0, inf)
    assert got["z"] == (None, None, None) and got[None] == (3.0, 4.0, 5.0)


def test_ranks_use_the_columns_own_type(spark, tmp_path):
    big = 2**53
    spark.createDataFrame(
        [(1, big, "b", None), (2, big + 1, "a", 1.0), (3, big + 1, "b", float("nan")), (4, None, None, 7.0)],
        "id int, n bigint, s string, v double",
    ).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id"))).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for column, want in {"n": [1, 2.5, 2.5, None], "s": [2.5, 1, 2.5, None], "v": [None, 1, 3, 2], "d": [1, 2, 3, 4]}.items():
        got = {r["id"]: r["r"] for r in add_average_rank(df, column, "r").collect()}
        assert [got[i] for i in (1, 2, 3, 4)] == want, column


# ---------------------------------------------------------------- order, duplicates


def test_stretches_hold_equal_numbers_of_rows(spark):
    far = spark.range(10).select((F.col("id") * 10**15 + 10**16).alias("id"))
    df = spark.range(20_000).unionByName(far)
    sizes = ordered.with_stretch(df, "id", rows_per_stretch=1000).groupBy("_stretch").count().collect()
    assert max(r["count"] for r in sizes) <= 2000 and len(sizes) == 21


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("keyed", [False, True])
def test_fill_across_stretches(spark, direction, keyed):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(5000), "k": np.where(rng.random(5000) < 0.8, "hot", "cold")})
    pdf["v"] = np.where(rng.random(5000) < 0.98, np.nan, rng.random(5000))
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    keys = ["k"] if keyed else []
    got = ordered.fill(df, ["v"], "id", keys, direction, rows_per_stretch=137).toPandas().sort_values("id")["v"]
    series = pdf.groupby("k")["v"] if keyed else pdf["v"]
    want = series.ffill() if direction == "forward" else series.bfill()
    assert np.allclose(got.to_numpy(dtype=float), want, equal_nan=True)


@pytest.mark.parametrize("keep", ["first", "last", "none"])
def test_dedup_matches_pandas(spark, keep):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": range(3000), "a": rng.integers(0, 40, 3000), "b": rng.integers(0, 40, 3000)})
    df = spark.createDataFrame(pdf)
    got = dedup.drop_duplicates(df, ["a", "b"], keep, "id").toPandas()["id"].sort_values().tolist()
    want = pdf.drop_duplicates(["a", "b"], keep=False if keep == "none" else keep)["id"].tolist()
    assert got == want
    exact = dedup.drop_duplicates(df, None, keep, "id", ignore=["id"]).toPandas()["id"].sort_values().tolist()
    assert exact == want


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 6, (400, 4)), columns=list("abcd"))
    pdf["e"] = np.where(pdf["a"] == 0, None, "x")
    got = {r["column"]: r["near_duplicates"] for r in dedup.near_duplicate_count(spark.createDataFrame(pdf)).collect()}
    exact = pdf.duplicated().sum()
    assert got == {c: pdf.drop(columns=c).duplicated().sum() - exact for c in pdf.columns}


def test_numbering_is_consecutive_and_ordered(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("s")).repartition(7)
    got = number_in_order(df, ["s"], "n").toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(1, 5001))
    assert got["s"].is_monotonic_increasing
    names = entity_dimension([df], "s", "n").toPandas().sort_values("n")
    assert names["n"].tolist() == list(range(1, 5001))


def test_row_ids_follow_files(spark, tmp_path):
    for part in (2, 1):
        with open(tmp_path / f"f{part}.csv", "w") as f:
            f.write("v\n" + "\n".join(str(part * 1000 + i) for i in range(500)) + "\n")
    df = spark.read.schema("v long").option("header", True).csv(str(tmp_path))
    got = rowid.number_file_rows(df).toPandas().sort_values(rowid.ROW_ID)
    assert got[rowid.ROW_ID].tolist() == list(range(1000))
    assert got["v"].tolist() == [1000 + i for i in range(500)] + [2000 + i for i in range(500)]


def test_similar_pairs_match_brute_force(spark):
    words = ["cat", "cats", "bat", "Cat", "c", "ca", "dog", "dig", "d", "xyz"]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = {(r["first"], r["second"]) for r in explore.similar_pairs(df, [], "value").collect()}

    def distance(a, b):
        table = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            previous, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                previous, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, previous + (x != y))
        return table[-1]

    want = {(a, b) for a in words for b in words if a < b and distance(a.lower(), b.lower()) == 1}
    assert got == want


# ---------------------------------------------------------------- cleaning

SAMPLE = [
    ("1", " Ann ", "a@x.com", "NEW york", "34", "$1,200.50", "2024-01-05", "Yes"),
    ("2", "Bob", None, "new york", "999", "$300", "02/13/2024", "no"),
    ("2", "Bob", None, "new york", "999", "$300", "02/13/2024", "no"),
    ("3", "Cy", "bad", " Delhi", "-5", "($45)", "2024-03-01", "1"),
    ("4", "Dee", "d@x.org", "delhi", "41", "n/a", "2099-12-31", "TRUE"),
    ("5", "Eve", "e@x.org", "Delhi", "29", "$80", "2024-05-05", "0"),
    ("id", "name", "email", "city", "age", "price", "signup_date", "active"),
    (None, None, None, None, None, None, None, None),
]
COLUMNS = ["id", "name", "email", "city", "age", "price", "signup_date", "active"]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(i, *r) for i, r in enumerate(SAMPLE)]
    return spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"{c} string" for c in COLUMNS))


def test_inspect_plan_and_clean(spark, sample):
    found = inspect.inspect(sample, datetime.datetime(2025, 1, 1), "_row_id")
    kinds = {r["issue"] for r in found.collect()}
    assert {"duplicate_rows", "embedded_headers", "trailing_empty_rows", "inconsistent_casing", "whitespace", "future_dates"} <= kinds
    plan = build_plan(found, "_row_id")
    order = [a.kind for a in plan]
    assert order.index("remove_duplicates") < order.index("drop_trailing_empty") < order.index("drop_embedded_headers")
    run = apply_plan(sample, plan)
    assert not run.errors
    rows = run.df.orderBy("_row_id").collect()
    assert [r["id"] for r in rows] == ["1", "2", "3", "4", "5"]
    assert {r["city"] for r in rows} == {"New York", "Delhi"}
    changes = changelog.cell_changes(sample, run.df, "_row_id")
    assert changes.where("column = 'city' AND operation = 'normalize_case'").count() >= 2
    gone = changelog.removed_rows(sample, run.df, "_row_id")
    assert sorted(r["_row_id"] for r in gone.collect()) == [2, 6, 7]


def test_failing_action_is_recorded(sample):
    run = apply_plan(sample, [Action("nothing"), Action("trim_ends", {"columns": ["name"]})])
    assert [e[0] for e in run.errors] == ["nothing"]
    assert run.metrics[0][1].first()["cells_modified"] == 1


def test_range_rules_see_earlier_results(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, 500.0)], "id int, v double")
    out = clean.validate_ranges(df, [("v", ">", 100.0, "cap"), ("v", "==", 100.0, "null"), ("id", "==", 1, "drop")])
    assert [tuple(r) for r in out.df.orderBy("id").collect()] == [(2, 50.0), (3, None)]
    assert out.metrics.first().asDict() == {"cells_modified": 2, "rows_removed": 1}


def test_header_names():
    assert clean.unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert clean.clean_name(" Net Price/(EUR) ") == "net_price_eur"
    assert files.resolved_names(["a", "", "a"]) == ["a", "Unnamed: 1", "a_1"]


def test_profile_and_health(sample):
    data = sample.drop("_row_id")
    found = profile.issues(data)
    ids = {r["id"] for r in found.collect()}
    assert {"missing_values", "duplicate_rows", "empty_rows", "whitespace_ends", "case_inconsistent", "email_pattern", "uniqueness_violations"} <= ids
    assert 0 <= profile.health_score(found).first()["health_score"] < 100


def test_health_score_of_clean_table(spark):
    # Words far apart: names one edit from each other would be reported as likely typos.
    words = ["amber", "birch", "copper", "dunes", "elm"]
    df = spark.createDataFrame(list(enumerate(words)), "a int, b string")
    assert profile.health_score(profile.issues(df)).first()["health_score"] == 100


def test_typos_in_columns_of_many_values(spark):
    """150 categories, one of them with a misspelt twin: reported as it would be among ten."""
    names = [f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4}" for i in range(150)] + ["aaaaaab"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "a int, b string")
    found = {r["id"]: r for r in profile.issues(rows).collect()}
    assert found["category_inconsistent"]["affected_count"] == 1
    assert found["category_inconsistent"]["example"] == "aaaaaaa vs aaaaaab"
    assert "category_inconsistent" not in {r["id"] for r in profile.issues(rows, categories=100).collect()}


# ---------------------------------------------------------------- sources


def test_delimited_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("a;a;b\n1;2;2024-01-05\n3;;2024-02-05\n")
    assert files.sniff_separator(spark, path) == ";"
    df = files.read_delimited(spark, path)
    assert df.columns == ["a", "a_1", "b"]
    typed = dict(files.infer_types(df).dtypes)
    assert typed == {"a": "bigint", "a_1": "bigint", "b": "timestamp_ntz"}


def test_nested_json(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    with open(path, "w") as f:
        f.write('{"meta": "x", "data": [{"k": 1, "p": {"q": 2}}, {"k": 3, "p": {"q": 4}}]}')
    df = nested.read_records(spark, path)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)]
    assert df.columns == ["k", "p.q"]
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "119551.json").write_text('{"data": [{"date": "05-01-2024", "nav": "10.5"}]}')
    rows = nested.read_landed(spark, str(landed), "date string, nav string").rows
    assert [tuple(r) for r in rows.collect()] == [("119551", "05-01-2024", "10.5")]


def test_database_guard():
    assert databases.read_only("SELECT replace(a, 'drop table', '') FROM t;") == "SELECT replace(a, 'drop table', '') FROM t"
    assert databases.bounded("SELECT 1", 5) == "SELECT 1 LIMIT 5"
    assert databases.table_query("sales") == "SELECT * FROM sales"
    for bad in ("DELETE FROM t", "select 1; drop table t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", ""):
        with pytest.raises(ValueError):
            databases.read_only(bad)


# ---------------------------------------------------------------- others


def test_geography(spark):
    df = spark.createDataFrame([("Mumbai",), ("Chenai",), ("Nowhere at all",), (None,)], "city string")
    assert geo.choose_kind(df, "city") == "city"
    got = {r["original"]: r["suggested"] for r in geo.suggestions(df, "city", "city").collect()}
    assert got["Chenai"] == "chennai"
    fixed = geo.enrich(geo.correct(df, "city", "city"), "city", "city")
    assert {r["geo_region"] for r in fixed.collect()} == {"West India", "South India", "Unrecognized"}


def test_mean_drift_reports_a_jump(spark):
    # The widest swing comes first, so that no early day lies outside the two or three days before it.
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=i), 10.0 + ((i + 2) % 3) * 0.1) for i in range(20)]
    rows.append((datetime.date(2024, 1, 21), 30.0))
    df = spark.createDataFrame(rows, "snapshot date, m double")
    found = drift.mean_drift(df, "m").collect()
    assert [r["snapshot"] for r in found] == [datetime.date(2024, 1, 21)]
    assert found[0]["severity"] == "high"


def test_preconditions_raise(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "v double")
    with pytest.raises(ValueError, match="positive"):
        integrity.require(df, {"positive": F.col("v") > 0})


def test_normal_equations_match_least_squares(spark):
    """Weights and the scores of every fold, one scan for all; a dependent feature does no harm."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    x[:, 2] = 2 * x[:, 0]
    y = 1e6 + x @ [3.0, -2.0, 0.0] + rng.normal(0, 0.5, 300)
    pdf = pd.DataFrame({"id": range(300), "a_enc": x[:, 0], "b_enc": x[:, 1], "c_enc": x[:, 2], "label": y})
    data = spark.createDataFrame(pdf).repartition(4)
    model = ml.NormalEquations().fit(data)
    a = np.column_stack([np.ones(300), x])
    fitted = {r.id: r.prediction for r in model.transform(data).collect()}
    assert np.allclose([fitted[i] for i in range(300)], a @ np.linalg.lstsq(a, y, rcond=None)[0], rtol=1e-12)
    scored = ml.evaluate("Linear Regression", ml.NormalEquations(), data, "id", 4)[1].first()
    fold = np.array([r.fold for r in ml.folds(data, "id", 4).orderBy("id").collect()])
    r2 = []
    for k in range(4):
        w = np.linalg.lstsq(a[fold != k], y[fold != k], rcond=None)[0]
        own = y[fold == k]
        r2.append(1 - ((own - a[fold == k] @ w) ** 2).sum() / ((own - own.mean()) ** 2).sum())
    assert scored.cv_r2_mean == pytest.approx(np.mean(r2), abs=1e-8) and scored.cv_r2_std == pytest.approx(np.std(r2), abs=1e-8)
    test = {r.id for r in ml.split(data, "id")[1].collect()}
    held = np.array([i in test for i in range(300)])
    w = np.linalg.lstsq(a[~held], y[~held], rcond=None)[0]
    assert scored.mae == pytest.approx(np.abs(y[held] - a[held] @ w).mean(), rel=1e-9)


def test_models_small(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(400), "a": rng.choice(["x", "y", "z"], 400), "b": rng.choice(["p", "q"], 400)})
    pdf["pay"] = pdf["a"].map({"x": 1.0, "y": 2.0, "z": 3.0}) * 10 + rng.normal(0, 0.1, 400)
    rows = ml.model_rows(spark.createDataFrame(pdf), ["a", "b"], "pay", "id")
    encoder = ml.Encoder(rows, ["a", "b"])
    data = encoder.transform(rows).persist()
    fast = ml.regressors(forest={"numTrees": 5, "maxDepth": 3}, boosted={"maxIter": 5, "maxDepth": 2, "stepSize": 0.5})
    scores = [ml.evaluate(name, model, data, "id", k=2)[1].first() for name, model in fast.items()]
    assert all(s["test_r2"] > 0.9 for s in scores)
    model = fast["Random Forest"].fit(data)
    assert ml.importances(model, ["a", "b"], spark).first()["feature"] == "a"
    unseen = spark.createDataFrame([(1, "new", "p"), (2, None, "q")], "id long, a string, b string")
    assert ml.predict(model, encoder, unseen).where("predicted >= 0").count() == 2


@pytest.mark.parametrize("operator", ["ordered", "series"])
def test_backward_fill_reads_each_row_once(spark, operator):
    # A frame from the current row to the last one is computed anew at every row.
    df = spark.range(40).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    if operator == "ordered":
        filled = ordered.fill(df, ["v"], "id", direction="backward", rows_per_stretch=9)
    else:
        filled = series.fill_series(df, ["k"], "v", "backward", date="id")
    plan = filled._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
    got = {r.id: r.v for r in filled.collect()}
    assert got == {i: next((j for j in range(i, 40) if j % 7 == 3), None) for i in range(40)}


def unsteady(spark, n):
    """Positive doubles that differ in their last digits whenever they are computed."""
    @F.udf("double")
    def shaken(x):
        import os

        return x + int.from_bytes(os.urandom(3), "big") * 1e-12

    return spark.range(1, n + 1).select("id", shaken.asNondeterministic()(F.col("id").cast("double")).alias("x"))


def test_average_rank_of_values_that_change_when_computed_again(spark):
    ranks = {r.id: r["rank"] for r in add_average_rank(unsteady(spark, 50), "x", "rank", descending=True).collect()}
    assert ranks == {i: 51.0 - i for i in range(1, 51)}


def test_percent_ranks_of_values_that_change_when_computed_again(spark):
    ranks = {r.id: r.x_pct for r in percent_ranks(unsteady(spark, 50), "id", {"x": False}).collect()}
    assert ranks == {i: i / 50 for i in range(1, 51)}


def test_trees_train_on_counted_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(1200), "a": rng.choice(list("uvwxyz"), 1200), "b": rng.choice(list("pqr"), 1200)})
    pdf["pay"] = pdf["a"].map(dict(zip("uvwxyz", (5.0, 1, 4, 2, 9, 3)))) + (pdf["b"] == "q") * 2.0 + rng.normal(0, 1, 1200)
    rows = ml.model_rows(spark.createDataFrame(pdf), ["a", "b"], "pay", "id")
    data = ml.Encoder(rows, ["a", "b"]).transform(rows).persist()
    forest, boosted = (ml.regressors(boosted={"maxIter": 4, "maxDepth": 3, "minInstancesPerNode": 5})[m] for m in ("Random Forest", "Gradient Boosting"))
    sizes = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def fit(self, df, params=None):
            sizes.append(df.count())
            return self.inner.fit(df, params)

    small = forest.copy({forest.numTrees: 3, forest.maxDepth: 3})
    ml.evaluate("forest", Counting(small), data, "id", 2)
    assert len(sizes) == 3 and max(sizes) <= 18 * ml.BLOCKS
    whole = {r["features"]: r.prediction for r in boosted.fit(data).transform(data.select("features").distinct()).collect()}
    counted = ml.with_predictions(ml.fit(boosted, data, "id"), data)
    assert all(abs(r.prediction - whole[r["features"]]) < 1e-9 for r in counted.collect())


def test_boosting_uses_few_tasks_and_scores_from_counts(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(900), "a": rng.choice(list("uvwxyz"), 900), "b": rng.choice(list("pqr"), 900)})
    pdf["pay"] = 1e5 + pdf["a"].map(dict(zip("uvwxyz", (5.0, 1, 4, 2, 9, 3)))) + rng.normal(0, 1, 900)
    rows = ml.model_rows(spark.createDataFrame(pdf), ["a", "b"], "pay", "id")
    data = ml.Encoder(rows, ["a", "b"]).transform(rows).persist()
    boosted = ml.regressors(boosted={"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 5})["Gradient Boosting"]
    marked = ml.folds(data, "id", 2)
    counted = ml.parts(marked, "id", {"train": ml.in_train("id"), "fold": F.col("fold")})
    assert ml.boosting_rows(counted, 5).rdd.getNumPartitions() == 1
    model = ml.fit_trees(boosted, counted.where("train"))
    train, test = ml.split(data, "id")
    assert abs(ml.counted_r2(model, counted.where("train")) - ml.score(model, train)["r2"]) < 1e-9
    got = ml.evaluate("boosted", boosted, data, "id", 2)[1].first()
    per_fold = [ml.score(ml.fit_trees(boosted, counted.where(f"fold != {i}")), marked.where(f"fold = {i}"))["r2"] for i in (0, 1)]
    wanted = [ml.score(model, train)["r2"], *[ml.score(model, test)[m] for m in ("r2", "mae", "rmse")], sum(per_fold) / 2]
    assert np.allclose([got.train_r2, got.test_r2, got.mae, got.rmse, got.cv_r2_mean], wanted, rtol=1e-9)


def test_typos_are_counted_without_their_pairs(spark):
    rng = np.random.default_rng(3)
    odd = ["", "a", "A", "b", "aa", "AA", "aB", "ab", "abb", "x", "x\x01", "x vs a", "x vs b", "x y", "zÄ", "zä", "İ", "i", None, " a "]
    words = ["".join(rng.choice(list("aAbB1 "), rng.integers(0, 5))) for _ in range(300)]
    rows = [(v, w, str(i), "one") for i, (v, w) in enumerate(zip([*odd, *words], [*words, *odd]))]
    for part in (rows, [(v, None, "x vs " + c, None) for v, c in zip(["x", "xy", "x vs a", "x vs b", "x\x01", "x\x02"], "abcdef")]):
        df = spark.createDataFrame(part, "p string, q string, r string, s string")
        for most in (None, 30):
            pairs = profile.typo_pairs(df, most=most).groupBy("column", "k").agg(
                F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(" vs ", "first", "second")).alias("e")
            )
            got = {r["column"]: (r.k, r.n, r.e) for r in profile.typo_counts(df, most=most).collect()}
            assert got == {r["column"]: (r.k, r.n, r.e) for r in pairs.collect()}


def test_typo_issues_make_no_pairs_of_running_numbers(spark, monkeypatch):
    monkeypatch.setattr(profile, "similar_pairs", None)
    rows = profile._typo_issues(spark.range(1000).select(F.col("id").cast("string").alias("key")), None).collect()
    texts = [str(i) for i in range(1000)]
    forms = [{t[:i] + t[i + 1 :] for i in range(len(t))} - {""} for t in texts]
    pairs = sum(len(f & set(texts)) for f in forms) + 45 * 1 + 90 * 9 // 2 + 90 * 8 // 2 + 900 * 8 // 2 + 900 * 9
    assert [(r.column, r.affected_count, r.example) for r in rows] == [("key", pairs, "0 vs 1")]


def test_keys_without_text_are_counted_by_hashes(spark):
    from grainmill.session import set_down

    kind = "row_id long, some_code double, name string"
    df = spark.createDataFrame([(1, 0.5, " a"), (1, None, "A"), (2, 0.5, "b"), (None, -0.0, "b"), (3, 0.0, None)], kind)
    for rows in (df, df.drop("name"), set_down(df, "test")):
        names = ["column", "present", "distinct_values", "repeated"]
        whole = profile.value_stats(rows, profile.valued_columns(rows)).select(names)
        assert sorted(profile._valued_stats(rows).select(names).collect()) == sorted(whole.collect())
        found = {(r.id, r.column): r.affected_count for r in profile.issues(rows).collect()}
        assert found["uniqueness_violations", "row_id"] == 1 and found["uniqueness_violations", "some_code"] == 1
    plan = profile._valued_stats(df.drop("name"))._jdf.queryExecution().toString()
    assert "btrim" not in plan.lower()
