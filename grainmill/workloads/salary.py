"""Pay statistics on parts (retail price as pay), hypothesis tests, and pay models."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from grainmill.functions.numbers import fixed
from grainmill.operators import ml, salary
from grainmill.workloads.registry import Tables, fx, query

LEVELS = ("Entry-level", "Mid-level", "Senior", "Executive")
JOBS = """jobs AS (SELECT p_partkey AS id, p_brand AS job_title, p_type AS job_category, p_retailprice * 100 AS salary,
  (ARRAY['Entry-level', 'Mid-level', 'Senior', 'Executive'])[p_size % 4 + 1] AS experience_level,
  (ARRAY['Remote', 'In-person', 'Hybrid'])[p_size % 3 + 1] AS work_setting, (ARRAY['S', 'M', 'L'])[p_size % 5 + 1] AS company_size,
  'C' || CAST(p_partkey % 13 AS VARCHAR) AS company_location, 2020 + p_size % 4 AS work_year FROM part)"""


def jobs(t: Tables):
    size = F.col("p_size")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("job_title"),
        F.col("p_type").alias("job_category"),
        (F.col("p_retailprice") * 100).alias("salary"),
        pick(LEVELS, size % 4).alias("experience_level"),
        pick(("Remote", "In-person", "Hybrid"), size % 3).alias("work_setting"),
        pick(("S", "M", "L"), size % 5).alias("company_size"),
        F.concat(F.lit("C"), F.col("p_partkey") % 13).alias("company_location"),
        (size % 4 + 2020).alias("work_year"),
    )


STATS = f"""{fx('AVG(salary)', 3)} AS mean, {fx('MEDIAN(salary)', 3)} AS median, {fx('MIN(salary)', 3)} AS min, {fx('MAX(salary)', 3)} AS max,
  {fx('STDDEV_SAMP(salary)', 3)} AS std, COUNT(salary) AS count"""


def stats(rows, *keys: str):
    return rows.select(*keys, *[fixed(F.col(c), 3).alias(c) for c in ("mean", "median", "min", "max", "std")], "count")


BANDS = "CASE WHEN salary <= 0 THEN NULL WHEN salary <= 100000 THEN '<100K' WHEN salary <= 130000 THEN '100K-130K' ELSE '130K+' END"


@query(
    "l01_features",
    f"""WITH {JOBS}, top AS (SELECT company_location FROM jobs GROUP BY 1 ORDER BY COUNT(*) DESC, company_location LIMIT 10)
    SELECT id, CAST(CASE experience_level WHEN 'Entry-level' THEN 1 WHEN 'Mid-level' THEN 2 WHEN 'Senior' THEN 3 WHEN 'Executive' THEN 4 ELSE 0 END AS INTEGER) AS experience_rank,
    {BANDS} AS salary_band, CASE company_size WHEN 'S' THEN 'Small' WHEN 'M' THEN 'Medium' WHEN 'L' THEN 'Large' ELSE 'Unknown' END AS company_size_label,
    CASE WHEN company_location IN (SELECT company_location FROM top) THEN company_location ELSE 'Other' END AS country_group,
    CASE WHEN company_location = 'C1' THEN 1 ELSE 0 END AS is_us, CAST(work_year AS VARCHAR) AS work_year_str FROM jobs""",
)
def _(t):
    rows = salary.features(
        jobs(t), "experience_level", "salary", "company_size", "company_location", "work_year", "C1",
        edges=(0, 100000, 130000), labels=("<100K", "100K-130K", "130K+"),
    )
    return rows.select(
        "id", "experience_rank", "salary_band", "company_size_label", "country_group", "is_us", "work_year_str"
    )


@query(
    "l02_summary",
    f"""WITH {JOBS} SELECT COUNT(*) AS total_jobs, COUNT(DISTINCT job_title) AS unique_titles, COUNT(DISTINCT job_category) AS unique_categories,
    COUNT(DISTINCT company_location) AS unique_countries, {fx('AVG(salary)', 3)} AS avg_salary, {fx('MEDIAN(salary)', 3)} AS median_salary,
    {fx('MIN(salary)', 3)} AS min_salary, {fx('MAX(salary)', 3)} AS max_salary,
    (SELECT job_title FROM jobs GROUP BY 1 ORDER BY COUNT(*) DESC, job_title LIMIT 1) AS most_common_title,
    (SELECT job_category FROM jobs GROUP BY 1 ORDER BY COUNT(*) DESC, job_category LIMIT 1) AS most_common_category,
    {fx("AVG(CASE WHEN work_setting = 'Remote' THEN 1.0 ELSE 0 END) * 100", 4)} AS pct_remote,
    {fx("AVG(CASE WHEN experience_level = 'Senior' THEN 1.0 ELSE 0 END) * 100", 4)} AS pct_senior,
    CAST(MIN(work_year) AS VARCHAR) || '-' || CAST(MAX(work_year) AS VARCHAR) AS year_range FROM jobs""",
)
def _(t):
    rows = salary.summary(
        jobs(t), "job_title", "job_category", "company_location", "salary", "work_year",
        F.col("work_setting") == "Remote", F.col("experience_level") == "Senior",
    )
    numbers = {"avg_salary": 3, "median_salary": 3, "min_salary": 3, "max_salary": 3, "pct_remote": 4, "pct_senior": 4}
    return rows.withColumns({c: fixed(F.col(c), d) for c, d in numbers.items()})


@query("l03_statistics_by_setting", f"WITH {JOBS} SELECT work_setting, {STATS} FROM jobs GROUP BY 1")
def _(t):
    return stats(salary.group_statistics(jobs(t), ["work_setting"], "salary"), "work_setting")


def _titles(way: str, descending: bool):
    @query(
        f"l04_{way}_titles",
        f"WITH {JOBS} SELECT job_title, {STATS} FROM jobs GROUP BY 1 HAVING COUNT(*) >= 5 ORDER BY MEDIAN(salary) {'DESC' if descending else 'ASC'}, job_title LIMIT 10",
    )
    def _(t):
        return stats(salary.top_groups(jobs(t), "job_title", "salary", 10, "median", descending), "job_title")


_titles("top", True)
_titles("bottom", False)


@query(
    "l05_yearly_trends",
    f"WITH {JOBS} SELECT work_year, COUNT(salary) AS job_count, {fx('AVG(salary)', 3)} AS avg_salary, {fx('MEDIAN(salary)', 3)} AS median_salary FROM jobs GROUP BY 1",
)
def _(t):
    rows = salary.yearly(jobs(t), "work_year", "salary")
    return rows.select("work_year", "job_count", *[fixed(F.col(c), 3).alias(c) for c in ("avg_salary", "median_salary")])


@query(
    "l06_experience_ladder",
    f"""WITH {JOBS} SELECT experience_level, CAST(CASE experience_level WHEN 'Entry-level' THEN 1 WHEN 'Mid-level' THEN 2 WHEN 'Senior' THEN 3 ELSE 4 END AS BIGINT) AS place,
    {STATS} FROM jobs GROUP BY 1""",
)
def _(t):
    return stats(salary.ladder(jobs(t), "experience_level", "salary"), "experience_level", "place")


@query(
    "l07_category_level_matrix",
    f"WITH {JOBS} SELECT job_category, " + ", ".join(f"""{fx(f"MEDIAN(salary) FILTER (WHERE experience_level = '{lv}')", 3)} AS "{lv}" """ for lv in LEVELS) + " FROM jobs GROUP BY 1",
)
def _(t):
    rows = salary.level_matrix(jobs(t), "job_category", "experience_level", "salary", LEVELS)
    return rows.select("job_category", *[fixed(F.col(f"`{lv}`"), 3).alias(lv) for lv in LEVELS])


@query("l07_progression", f"WITH {JOBS} SELECT job_category, experience_level AS level, {fx('MEDIAN(salary)', 3)} AS median FROM jobs GROUP BY 1, 2")
def _(t):
    matrix = salary.level_matrix(jobs(t), "job_category", "experience_level", "salary", LEVELS)
    rows = salary.progression(matrix, "job_category", LEVELS)
    return rows.select("job_category", "level", fixed(F.col("median"), 3).alias("median"))


@query(
    "a14_pivot_median",
    f"WITH {JOBS} SELECT work_setting, " + ", ".join(f"""{fx(f"MEDIAN(salary) FILTER (WHERE work_year = {y})", 3)} AS "{y}" """ for y in (2020, 2021, 2022, 2023)) + " FROM jobs GROUP BY 1",
)
def _(t):
    years = [2020, 2021, 2022, 2023]
    rows = salary.level_matrix(jobs(t), "work_setting", "work_year", "salary", years)
    return rows.select("work_setting", *[fixed(F.col(f"`{y}`"), 3).alias(str(y)) for y in years])


@query(
    "l08_top_countries",
    f"""WITH {JOBS} SELECT company_location, {STATS} FROM jobs WHERE company_location IN
    (SELECT company_location FROM jobs GROUP BY 1 ORDER BY COUNT(*) DESC, company_location LIMIT 6) GROUP BY 1""",
)
def _(t):
    kept = salary.restrict_to_top(jobs(t), "company_location", 6)
    return stats(salary.group_statistics(kept, ["company_location"], "salary"), "company_location")


@query(
    "l09_entry_to_senior_growth",
    f"""WITH {JOBS}, m AS (SELECT job_category, MEDIAN(salary) FILTER (WHERE experience_level = 'Entry-level') AS a,
    MEDIAN(salary) FILTER (WHERE experience_level = 'Senior') AS b FROM jobs GROUP BY 1)
    SELECT job_category, {fx('a', 3)} AS low_median, {fx('b', 3)} AS high_median, {fx('(b / a - 1) * 100', 5)} AS growth_pct FROM m""",
)
def _(t):
    rows = salary.level_growth(jobs(t), "job_category", "experience_level", "salary", "Entry-level", "Senior")
    digits = {"low_median": 3, "high_median": 3, "growth_pct": 5}
    return rows.select("job_category", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "l10_home_premium",
    f"""WITH {JOBS}, m AS (SELECT COUNT(*) FILTER (WHERE company_location = 'C1') AS h, COUNT(*) FILTER (WHERE company_location <> 'C1') AS w,
    MEDIAN(salary) FILTER (WHERE company_location = 'C1') AS a, MEDIAN(salary) FILTER (WHERE company_location <> 'C1') AS b FROM jobs)
    SELECT h AS home_jobs, w AS away_jobs, {fx('a', 3)} AS home_median, {fx('b', 3)} AS away_median, {fx('(a / b - 1) * 100', 5)} AS premium_pct FROM m""",
)
def _(t):
    rows = salary.home_premium(jobs(t), F.col("company_location") == "C1", "salary")
    digits = {"home_median": 3, "away_median": 3, "premium_pct": 5}
    return rows.select("home_jobs", "away_jobs", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "l11_comparable_range",
    f"""WITH {JOBS} SELECT job_category, experience_level, COUNT(salary) AS n, {fx('QUANTILE_CONT(salary, 0.25)', 3)} AS q25,
    {fx('MEDIAN(salary)', 3)} AS median, {fx('QUANTILE_CONT(salary, 0.75)', 3)} AS q75 FROM jobs GROUP BY 1, 2 HAVING COUNT(salary) >= 5""",
)
def _(t):
    rows = salary.comparable_range(jobs(t), ["job_category", "experience_level"], "salary")
    return rows.select("job_category", "experience_level", "n", *[fixed(F.col(c), 3).alias(c) for c in ("q25", "median", "q75")])


@query(
    "l12_welch_test",
    f"""WITH {JOBS}, s AS (SELECT COUNT(*) FILTER (WHERE work_setting = 'Remote') AS na, COUNT(*) FILTER (WHERE work_setting = 'In-person') AS nb,
    AVG(salary) FILTER (WHERE work_setting = 'Remote') AS ma, AVG(salary) FILTER (WHERE work_setting = 'In-person') AS mb,
    VAR_SAMP(salary) FILTER (WHERE work_setting = 'Remote') AS va, VAR_SAMP(salary) FILTER (WHERE work_setting = 'In-person') AS vb FROM jobs),
    x AS (SELECT *, va / na AS sa, vb / nb AS sb FROM s)
    SELECT {fx('ma', 3)} AS mean_a, {fx('mb', 3)} AS mean_b, {fx('ma - mb', 3)} AS difference, {fx('(ma - mb) / SQRT(sa + sb)', 6)} AS t_statistic,
    {fx('(sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1))', 3)} AS df FROM x""",
)
def _(t):
    rows = salary.welch_test(jobs(t), "work_setting", "Remote", "In-person", "salary")
    digits = {"mean_a": 3, "mean_b": 3, "difference": 3, "t_statistic": 6, "df": 3}
    return rows.select(*[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


@query("u02_welch_p_value")
def _(t):
    return salary.with_t_p_value(salary.welch_test(jobs(t), "work_setting", "Remote", "In-person", "salary"))


@query(
    "l13_anova",
    f"""WITH {JOBS}, g AS (SELECT experience_level, COUNT(salary) AS n, AVG(salary) AS m, VAR_POP(salary) * COUNT(salary) AS ss FROM jobs GROUP BY 1),
    t AS (SELECT SUM(n * m) / SUM(n) AS grand FROM g),
    a AS (SELECT SUM(n * (m - grand) * (m - grand)) AS b, SUM(ss) AS w, COUNT(*) - 1 AS db, SUM(n) - COUNT(*) AS dw FROM g, t)
    SELECT {fx('(b / db) / (w / dw)', 6)} AS f_statistic, CAST(db AS DOUBLE) AS df_between, CAST(dw AS DOUBLE) AS df_within FROM a""",
)
def _(t):
    rows = salary.anova(jobs(t), "experience_level", "salary")
    return rows.select(fixed(F.col("f_statistic"), 6).alias("f_statistic"), "df_between", "df_within")


@query("u02_anova_p_value")
def _(t):
    return salary.with_f_p_value(salary.anova(jobs(t), "experience_level", "salary"))


# ---------------------------------------------------------------- models

FEATURES = ["job_category", "experience_level", "employment_type", "work_setting", "company_size", "country_group"]


def with_groups(rows):
    """The two features that the pay statistics do not use."""
    kind = F.when(F.col("id") % 7 < 5, "FT").when(F.col("id") % 7 < 6, "CT").otherwise("PT")
    group = F.when(F.col("id") % 13 < 10, F.col("company_location")).otherwise("Other")
    return rows.withColumns({"employment_type": kind, "country_group": group})


def encoded(t: Tables):
    rows = ml.model_rows(with_groups(jobs(t)), FEATURES, "salary", "id")
    encoder = ml.Encoder(rows, FEATURES)
    return encoder, encoder.transform(rows)


@query(
    "l14_label_codes",
    f"""WITH {JOBS}, m AS (SELECT *, CASE WHEN id % 7 < 5 THEN 'FT' WHEN id % 7 < 6 THEN 'CT' ELSE 'PT' END AS employment_type,
    CASE WHEN id % 13 < 10 THEN company_location ELSE 'Other' END AS country_group FROM jobs WHERE company_size IS NOT NULL)
    SELECT id, CAST(DENSE_RANK() OVER (ORDER BY job_category) - 1 AS DOUBLE) AS job_category_enc,
    CAST(DENSE_RANK() OVER (ORDER BY experience_level) - 1 AS DOUBLE) AS experience_level_enc,
    CAST(DENSE_RANK() OVER (ORDER BY employment_type) - 1 AS DOUBLE) AS employment_type_enc,
    CAST(DENSE_RANK() OVER (ORDER BY work_setting) - 1 AS DOUBLE) AS work_setting_enc,
    CAST(DENSE_RANK() OVER (ORDER BY company_size) - 1 AS DOUBLE) AS company_size_enc,
    CAST(DENSE_RANK() OVER (ORDER BY country_group) - 1 AS DOUBLE) AS country_group_enc FROM m""",
)
def _(t):
    return encoded(t)[1].select("id", *[f"{f}_enc" for f in FEATURES])


def evaluated(t: Tables, names, k: int):
    """Metrics of the named regressors, side by side, on one split and its folds; the encoded rows are cached meanwhile."""
    kept = encoded(t)[1].repartition("id").persist()  # a small file is read by one task
    try:
        with ThreadPoolExecutor(len(names)) as pool:
            rows = list(pool.map(lambda name: ml.evaluate(name, ml.regressors()[name], kept, "id", k)[1], names))
    finally:
        kept.unpersist()
    return reduce(lambda a, b: a.unionByName(b), rows)


def _linear_sql(select: str) -> str:
    """Least squares in SQL: sums of products per training set, solved by elimination, for the query `select`.

    x holds y, the features xs with a leading 1, train and fold; w the weights b per training set s ('train', 0 to 4).
    """
    kinds = f"""CASE WHEN id % 7 < 5 THEN 'FT' WHEN id % 7 < 6 THEN 'CT' ELSE 'PT' END AS employment_type,
        CASE WHEN id % 13 < 10 THEN company_location ELSE 'Other' END AS country_group"""
    codes = ", ".join(
        f"code_{f} AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT {f} AS v FROM m))" for f in FEATURES
    )
    joins = " ".join(f"LEFT JOIN code_{f} ON code_{f}.v = COALESCE(j.{f}, 'Unknown')" for f in FEATURES)
    coded = ", ".join(f"COALESCE(code_{f}.code, 0)" for f in FEATURES)
    size = len(FEATURES) + 1
    hashed = lambda salt: f"CAST('0x' || SUBSTR(MD5('{salt}:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT)"
    rows = ", ".join("[" + ", ".join([f"SUM(xs[{i}] * xs[{j}])" for j in range(1, size + 1)] + [f"SUM(xs[{i}] * y)"]) + "]" for i in range(1, size + 1))
    return f"""WITH RECURSIVE {JOBS}, j AS (SELECT *, {kinds} FROM jobs), m AS (SELECT * FROM j WHERE company_size IS NOT NULL), {codes},
    p AS (SELECT j.id, j.salary AS y, CAST([1, {coded}] AS DOUBLE[]) AS xs FROM j {joins}),
    x AS (SELECT *, {hashed(42)} % 1000000 < 800000 AS train, {hashed(43)} % 5 AS fold FROM p WHERE id IN (SELECT id FROM m)),
    s AS (SELECT UNNEST(['train', '0', '1', '2', '3', '4']) AS s),
    e AS (SELECT s, 0 AS k, [{rows}] AS a FROM s JOIN x ON CASE WHEN s = 'train' THEN train ELSE CAST(fold AS VARCHAR) <> s END GROUP BY s
        UNION ALL SELECT s, k + 1, [CASE WHEN i = k + 1 THEN [v / r[k + 1] FOR v IN r] ELSE [v - r[k + 1] * a[k + 1][l] / a[k + 1][k + 1] FOR v, l IN r] END FOR r, i IN a]
        FROM e WHERE k < {size}),
    w AS (SELECT s, [r[{size + 1}] FOR r IN a] AS b FROM e WHERE k = {size}) {select}"""


LINEAR_METRICS = f"""SELECT 'Linear Regression' AS model,
    {fx("(SELECT 1 - AVG((y - LIST_DOT_PRODUCT(xs, b)) ** 2) / VAR_POP(y) FROM x, w WHERE s = 'train' AND train)", 6)} AS train_r2,
    {fx("(SELECT 1 - AVG((y - LIST_DOT_PRODUCT(xs, b)) ** 2) / VAR_POP(y) FROM x, w WHERE s = 'train' AND NOT train)", 6)} AS test_r2,
    {fx("AVG(r)", 6)} AS cv_r2_mean, {fx("STDDEV_POP(r)", 6)} AS cv_r2_std,
    {fx("(SELECT AVG(ABS(y - LIST_DOT_PRODUCT(xs, b))) FROM x, w WHERE s = 'train' AND NOT train)", 3)} AS mae,
    {fx("(SELECT SQRT(AVG((y - LIST_DOT_PRODUCT(xs, b)) ** 2)) FROM x, w WHERE s = 'train' AND NOT train)", 3)} AS rmse
    FROM (SELECT 1 - AVG((y - LIST_DOT_PRODUCT(xs, b)) ** 2) / VAR_POP(y) AS r FROM x JOIN w ON CAST(fold AS VARCHAR) = s GROUP BY fold)"""


@query("l15_l16_linear_model", _linear_sql(LINEAR_METRICS))
def _(t):
    digits = {"train_r2": 6, "test_r2": 6, "cv_r2_mean": 6, "cv_r2_std": 6, "mae": 3, "rmse": 3}
    rows = evaluated(t, ["Linear Regression"], 5)
    return rows.select("model", *[fixed(F.col(c), d).alias(c) for c, d in digits.items()])


@query("l15_l16_random_forest")
def _(t):
    return evaluated(t, ["Random Forest"], 5)


@query("l15_l16_gradient_boosting")
def _(t):
    return evaluated(t, ["Gradient Boosting"], 5)


@query("l15_l18_forest_importances")
def _(t):
    _, rows = encoded(t)
    model = ml.fit(ml.regressors()["Random Forest"], ml.split(rows, "id")[0], "id")
    return ml.importances(model, FEATURES, t.spark)


@query("l17_best_model")
def _(t):
    return ml.best_model(evaluated(t, ml.regressors(), 0))


@query(
    "l19_predictions",
    _linear_sql(f"SELECT id, {fx('GREATEST(LIST_DOT_PRODUCT(xs, b), 0)', 2)} AS predicted FROM p, w WHERE s = 'train'"),
)
def _(t):
    encoder, rows = encoded(t)
    model = ml.regressors()["Linear Regression"].fit(ml.split(rows, "id")[0])
    return ml.predict(model, encoder, with_groups(jobs(t))).select("id", fixed(F.col("predicted"), 2).alias("predicted"))
