"""Return, risk and portfolio measures for many series at once.

Inputs are series frames (one row per key and date, see `series.daily`) with columns key, date, value, ret.
Every measure is a grouped aggregate; nothing loops over keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.functions.dates import years_before
from grainmill.functions.numbers import ratio
from grainmill.functions.stats import regression
from grainmill.operators.quantiles import aggregate_with_quantiles, quantiles
from grainmill.operators.ranking import add_average_rank, percent_ranks
from grainmill.operators.series import period_return, rebase, rolling, running_max
from grainmill.operators.values import mode_by
from grainmill.session import cut_lineage

# Yearly risk-free rate and trading days.
RISK_FREE = 0.065
TRADING_DAYS = 252

# Weights of the scorecard, by measure.
SCORE_WEIGHTS = {"cagr": 0.30, "sharpe": 0.25, "alpha": 0.20, "expense": 0.15, "drawdown": 0.10}

# Risk categories in rising order and the categories open to each appetite.
RISK_ORDER = ("Low", "Low to Moderate", "Moderate", "Moderately High", "High", "Very High")
RISK_BY_APPETITE = {
    "low": ("Low", "Low to Moderate"),
    "moderate": ("Moderate", "Moderately High"),
    "high": ("High", "Very High"),
}


def with_returns(series: DataFrame, key: str) -> DataFrame:
    """Daily returns, the first date of each key dropped."""
    return period_return(series, [key], "value").where(F.col("ret").isNotNull())


def return_statistics(returns: DataFrame, key: str) -> DataFrame:
    return aggregate_with_quantiles(
        returns,
        [key],
        [
            F.avg("ret").alias("mean"),
            F.stddev_samp("ret").alias("std"),
            F.min("ret").alias("min"),
            F.max("ret").alias("max"),
            F.count("ret").alias("count"),
        ],
        {"median": ("ret", 0.5)},
    )


def cagr(returns: DataFrame, key: str, years: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Compound yearly growth from the last value on or before the same day `n` years earlier; null without one."""
    end = F.max("date").over(Window.partitionBy(key))
    dated = returns.withColumn("_end", end)
    starts = [
        F.max_by("value", F.when(F.col("date") <= years_before(F.col("_end"), n), F.col("date"))).alias(f"_s{n}")
        for n in years
    ]
    ends = dated.groupBy(key).agg(F.max_by("value", "date").alias("_e"), *starts)
    growth = [
        F.when(F.col(f"_s{n}") > 0, F.pow(F.col("_e") / F.col(f"_s{n}"), 1.0 / n) - 1).alias(f"cagr_{n}y")
        for n in years
    ]
    return ends.select(key, *growth)


def yearly_return() -> Column:
    return F.avg("ret") * TRADING_DAYS


def sharpe(returns: DataFrame, key: str, minimum: int = TRADING_DAYS) -> DataFrame:
    stats = returns.groupBy(key).agg(
        F.count("ret").alias("_n"),
        yearly_return().alias("ann_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("ann_vol"),
    )
    value = F.when(F.col("ann_vol") > 0, (F.col("ann_return") - RISK_FREE) / F.col("ann_vol"))
    return stats.where(F.col("_n") >= minimum).select(key, "ann_return", "ann_vol", value.alias("sharpe"))


def sortino(returns: DataFrame, key: str, minimum: int = TRADING_DAYS) -> DataFrame:
    down = F.when(F.col("ret") < 0, F.col("ret") * F.col("ret"))
    stats = returns.groupBy(key).agg(
        F.count("ret").alias("_n"),
        yearly_return().alias("ann_return"),
        (F.sqrt(F.avg(down)) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("downside"),
    )
    value = F.when(F.col("downside") > 0, (F.col("ann_return") - RISK_FREE) / F.col("downside"))
    return stats.where(F.col("_n") >= minimum).select(key, "ann_return", "downside", value.alias("sortino"))


def alpha_beta(returns: DataFrame, index_returns: DataFrame, key: str, minimum: int = 30) -> DataFrame:
    """Regression of each key's returns on an index (date, index_ret) over their common dates."""
    joined = returns.join(index_returns.where(F.col("index_ret").isNotNull()), "date")
    fit = regression(F.col("ret"), F.col("index_ret"))
    rows = joined.groupBy(key).agg(*[c.alias(name) for name, c in fit.items()])
    return rows.where(F.col("n") >= minimum).select(
        key,
        (F.col("intercept") * TRADING_DAYS).alias("alpha"),
        F.col("slope").alias("beta"),
        "r_squared",
        "std_error",
        "t_value",
        "n",
    )


def drawdown(series: DataFrame, key: str) -> DataFrame:
    """Deepest fall from a running maximum: first trough, last peak before it, first recovery after it."""
    marked = running_max(series, [key], "value").withColumn("dd", F.col("value") / F.col("peak") - 1)
    trough = F.min(F.struct("dd", "date", "peak")).over(Window.partitionBy(key))
    marked = marked.withColumn("t", trough)
    before = (F.col("date") <= F.col("t.date")) & (F.col("value") == F.col("t.peak"))
    after = (F.col("date") > F.col("t.date")) & (F.col("value") >= F.col("t.peak"))
    rows = marked.groupBy(key).agg(
        F.min("dd").alias("max_drawdown"),
        F.max(F.when(before, F.col("date"))).alias("peak_date"),
        F.min("t.date").alias("trough_date"),
        F.min(F.when(after, F.col("date"))).alias("recovery_date"),
    )
    return rows.withColumn("period_days", F.datediff("trough_date", "peak_date"))


def measures(returns: DataFrame, index_returns: DataFrame, key: str, years: int = 3) -> DataFrame:
    """cagr, sharpe, alpha and drawdown of every key together.

    The index is joined to the dates once, the windows share one partitioning by key, and the closing aggregate reuses
    it, so the series is shuffled a single time.
    """
    rows = returns.join(index_returns, "date", "left")
    rows = running_max(rows, [key], "value")
    start = years_before(F.max("date").over(Window.partitionBy(key)), years)
    rows = rows.withColumn("_start", F.when(F.col("date") <= start, F.col("date")))
    fit = regression(F.col("ret"), F.col("index_ret"))
    deviation = F.stddev_samp("ret") * F.sqrt(F.lit(float(TRADING_DAYS)))
    first = F.max_by("value", "_start")
    return rows.groupBy(key).agg(
        F.when(first > 0, F.pow(F.max_by("value", "date") / first, 1.0 / years) - 1).alias("cagr"),
        F.when((F.count("ret") >= TRADING_DAYS) & (deviation > 0), (yearly_return() - RISK_FREE) / deviation).alias(
            "sharpe"
        ),
        F.when(fit["n"] >= 30, fit["intercept"] * TRADING_DAYS).alias("alpha"),
        F.min(F.col("value") / F.col("peak") - 1).alias("drawdown"),
    )


def scorecard(measures: DataFrame, key: str) -> DataFrame:
    """Percent ranks of five measures (cagr, sharpe, alpha, expense, drawdown), weighted score and rank.

    Lower expense is better; drawdown is negative, so higher is better. Rows missing a measure are left out.
    """
    rows = measures.dropna(subset=list(SCORE_WEIGHTS))
    rows = percent_ranks(rows, key, {name: name == "expense" for name in SCORE_WEIGHTS})
    score = sum((F.lit(weight) * F.col(f"{name}_pct") for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0)) * 100
    # A fixed number of digits makes equal scores tie, whatever the order of the additions.
    rows = rows.withColumn("final_score", F.round(score, 9))
    rows = add_average_rank(rows, "final_score", "_place", descending=True)
    return rows.select(
        key,
        *[(F.col(f"{name}_pct") * 100).alias(f"{name}_score") for name in SCORE_WEIGHTS],
        "final_score",
        F.col("_place").cast("int").alias("overall_rank"),
    )


def base_hundred(series: DataFrame, key: str, years: int = 3) -> DataFrame:
    """Last `years` years of every series, each starting at 100."""
    start = series.agg(years_before(F.max("date"), years)).scalar()
    return rebase(series.where(F.col("date") >= start), [key], "value")


def tracking_error(returns: DataFrame, index_series: DataFrame, key: str, years: int = 3) -> DataFrame:
    """Yearly population deviation of the return difference to each index (columns index, date, value).

    Index returns start inside the window; a date counts only when every index has a return on it.
    """
    start = returns.agg(years_before(F.max("date"), years)).scalar()
    recent = returns.where(F.col("date") >= start)
    indices = period_return(index_series.where(F.col("date") >= start), ["index"], "value", "index_ret")
    wanted = index_series.agg(F.count_distinct("index")).scalar()
    complete = (
        indices.where(F.col("index_ret").isNotNull())
        .groupBy("date")
        .agg(F.collect_list(F.struct("index", "index_ret")).alias("all"))  # one entry per index
        .where(F.size("all") == wanted)
        .select("date", F.explode("all").alias("i"))
        .select("date", "i.index", "i.index_ret")
    )
    return (
        recent.join(complete, "date")
        .groupBy(key, "index")
        .agg(
            (F.stddev_pop(F.col("ret") - F.col("index_ret")) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias(
                "tracking_error"
            )
        )
    )


def value_at_risk(returns: DataFrame, key: str, level: float = 0.05, minimum: int = 90) -> DataFrame:
    """Return at the lower quantile, mean of the returns at or under it, mean and deviation."""
    returns = cut_lineage(returns)  # the quantile is compared with the returns it was read from, to the last bit
    cut = quantiles(returns, [key], "ret", [level], ["var"])
    joined = returns.join(cut, key)
    rows = joined.groupBy(key).agg(
        F.first("var").alias("var"),
        F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"),
        F.avg("ret").alias("mean_return"),
        F.stddev_samp("ret").alias("volatility"),
        F.count("ret").alias("_n"),
    )
    return rows.where(F.col("_n") >= minimum).drop("_n")


def rolling_sharpe(series_with_returns: DataFrame, key: str, length: int = 90) -> DataFrame:
    rows = rolling(series_with_returns, [key], "ret", length)
    value = F.col("rolling_mean") / F.col("rolling_std") * F.sqrt(F.lit(float(TRADING_DAYS)))
    return rows.withColumn("rolling_sharpe", value)


def representatives(rolled: DataFrame, performance: DataFrame, key: str) -> DataFrame:
    """Keys with the best and worst mean rolling ratio, the largest size, the lowest and the highest risk.

    `performance` has key, size and risk (text in RISK_ORDER). Ties go to the smaller key.
    """
    means = rolled.groupBy(key).agg(F.avg("rolling_sharpe").alias("m")).where(F.col("m").isNotNull())
    risk = F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), F.col("risk"))
    graded = performance.withColumn("r", F.when(risk > 0, risk))

    def best(rows: DataFrame, column: str, role: str, descending: bool) -> DataFrame:
        c = -F.col(column) if descending else F.col(column)
        pick = F.min_by(key, F.when(F.col(column).isNotNull(), F.struct(c, F.col(key))))
        return rows.agg(pick.alias(key)).select(F.lit(role).alias("role"), key)

    return (
        best(means, "m", "highest_ratio", True)
        .unionByName(best(means, "m", "lowest_ratio", False))
        .unionByName(best(graded, "size", "largest", True))
        .unionByName(best(graded, "r", "lowest_risk", False))
        .unionByName(best(graded, "r", "highest_risk", True))
    )


def cohorts(
    transactions: DataFrame, investor: str, moment: str, kind: str, plan_kind: str, amount: str, product: str
) -> DataFrame:
    """Investors grouped by the year of their first transaction.

    The first year is an aggregate joined back on the investor (a window would sort a hot investor's rows in one
    task). The preferred product is the most frequent one, the smallest among ties.
    """
    first = transactions.groupBy(investor).agg(F.min(F.year(moment)).alias("cohort"))
    rows = transactions.join(first, investor)
    planned = F.col(kind) == plan_kind
    summary = rows.groupBy("cohort").agg(
        F.coalesce(F.avg(F.when(planned, F.col(amount))), F.lit(0.0)).alias("avg_plan_amount"),
        F.sum(amount).alias("total_invested"),
        F.count(F.when(planned, 1)).alias("plan_transactions"),
    )
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("investors"))
    preferred = mode_by(rows, ["cohort"], product, "preferred_product")
    return summary.join(sizes, "cohort").join(preferred, "cohort", "left")


def plan_continuity(
    transactions: DataFrame, investor: str, moment: str, minimum: int = 6, healthy_days: float = 35.0
) -> DataFrame:
    """Mean gap in days between an investor's consecutive plan payments, and its class.

    Consecutive gaps add up to last minus first, so no ordering is needed: one aggregate per investor.
    """
    rows = transactions.groupBy(investor).agg(
        F.count(F.lit(1)).alias("payments"),
        ratio(F.datediff(F.max(F.to_date(moment)), F.min(F.to_date(moment))), F.count(F.lit(1)) - 1).alias("mean_gap"),
    )
    status = F.when(F.col("mean_gap") <= healthy_days, "Healthy").otherwise("At-Risk")
    return rows.where(F.col("payments") >= minimum).withColumn("status", status)


def continuity_rate(investors: DataFrame) -> DataFrame:
    healthy = F.count(F.when(F.col("status") == "Healthy", 1))
    return investors.agg(
        healthy.alias("healthy"),
        (F.count(F.lit(1)) - healthy).alias("at_risk"),
        F.coalesce(ratio(healthy, F.count(F.lit(1))), F.lit(0.0)).alias("continuity_rate"),
    )


def concentration(holdings: DataFrame, key: str, weight: str) -> DataFrame:
    """Herfindahl index of percent weights with its class, number of holdings and largest weight."""
    w = F.col(weight) / 100
    rows = holdings.groupBy(key).agg(
        F.sum(w * w).alias("hhi"), F.count(F.lit(1)).alias("holdings"), F.max(weight).alias("top_weight")
    )
    grade = (
        F.when(F.col("hhi") < 0.10, "Diversified").when(F.col("hhi") <= 0.18, "Moderate").otherwise("Concentrated")
    )
    return rows.withColumn("category", grade)


def recommend(performance: DataFrame, master: DataFrame, key: str, appetite: str, n: int = 3) -> DataFrame:
    """Top `n` for a risk appetite by sharpe, then return, then expense; score is sharpe over the best, times ten.

    `performance` has key, name, sharpe, return_1y, expense; `master` has key, risk.
    """
    allowed = RISK_BY_APPETITE[appetite.lower()]
    rows = performance.join(master.where(F.col("risk").isin(*allowed)).select(key, "risk"), key)
    best = rows.agg(F.max("sharpe")).scalar()
    return (
        rows.withColumn("score", F.col("sharpe") / best * 10)
        .orderBy(
            F.col("sharpe").desc_nulls_last(),
            F.col("return_1y").desc_nulls_last(),
            F.col("expense").asc_nulls_last(),
            F.col(key).asc(),
        )
        .limit(n)
        .select("name", "risk", "sharpe", "return_1y", "expense", "score")
    )
