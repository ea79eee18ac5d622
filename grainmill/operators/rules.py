"""Domain rule sets on transactions, stock and campaigns. Each rule returns rows, none when it finds nothing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.dates import iso_year_week
from grainmill.functions.stats import count_if
from grainmill.operators.integrity import find_column
from grainmill.operators.quantiles import quantiles

# Reporting limits and how close under one counts; night hours; shares and factors.
LIMITS = (50_000, 10_000, 20_000, 100_000, 1_000, 5_000)
CLOSE = 0.05
NIGHT_FROM, NIGHT_TO = 23, 4
NIGHT_SHARE, SPIKE, ROUND_SHARE = 0.30, 3.0, 0.15

# Words that find the columns of each rule set, by role.
ROLE_WORDS = {
    "fraud": {
        "amount": ("amount", "value", "price", "revenue", "cost", "transaction"),
        "account": ("account", "user", "customer", "id", "entity"),
        "moment": ("timestamp", "date", "time", "created_at", "datetime"),
    },
    "inventory": {
        "quantity": ("quantity", "qty", "stock", "units", "inventory"),
        "sku": ("sku", "product", "item", "name", "code"),
        "moment": ("date", "week", "month", "created_at", "order_date"),
        "demand": ("demand", "orders", "sold", "sales"),
    },
    "marketing": {
        "channel": ("channel", "source", "medium", "campaign"),
        "cost": ("cost", "spend", "budget", "cpc"),
        "revenue": ("revenue", "sales", "value", "amount"),
        "customer": ("customer", "user", "id", "buyer"),
        "moment": ("date", "month", "week", "created_at"),
    },
}

# Roles every rule needs.
RULE_ROLES = {
    "fraud": {
        "threshold_structuring": ("amount",),
        "time_of_day_clustering": ("moment", "account"),
        "frequency_spike": ("moment", "account"),
        "round_number_clustering": ("amount",),
    },
    "inventory": {
        "stockout_patterns": ("quantity",),
        "slow_fast_mover": ("quantity", "sku"),
        "reorder_suggestion": ("quantity", "sku", "moment"),
    },
    "marketing": {
        "channel_acquisition_cost": ("channel", "cost", "customer"),
        "repeat_purchase_by_channel": ("channel", "customer"),
        "campaign_seasonality": ("channel", "moment", "revenue"),
        "high_engagement_low_conversion": ("channel", "revenue"),
    },
}


def find_roles(df: DataFrame, domain: str, given: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """Column of every role: the given one, else the first whose name contains a role word."""
    given = dict(given or {})
    return {role: given.get(role) or find_column(df, words) for role, words in ROLE_WORDS[domain].items()}


def applicable(df: DataFrame, domain: str, given: Mapping[str, str] | None = None) -> DataFrame:
    """Rules of a domain with the roles they miss, from the schema alone."""
    roles = find_roles(df, domain, given)
    rows = []
    for rule, needed in RULE_ROLES[domain].items():
        missing = [r for r in needed if roles[r] is None]
        rows.append((rule, not missing, ", ".join(missing)))
    return df.sparkSession.createDataFrame(rows, "rule string, applicable boolean, missing string")


def _under_limit(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [(c >= limit * (1 - CLOSE)) & (c < limit) for limit in LIMITS])


def just_under_limits(df: DataFrame, amount: str) -> DataFrame:
    """Rows within 5% under a reporting limit: count, share of all rows, smallest and largest such amount."""
    v = F.col(amount)
    close = F.coalesce(_under_limit(v), F.lit(False))
    rows = df.agg(
        count_if(close).alias("affected_rows"),
        (count_if(close) * 100.0 / F.count(F.lit(1))).alias("pct"),
        F.min(F.when(close, v)).alias("smallest"),
        F.max(F.when(close, v)).alias("largest"),
    )
    return rows.where(F.col("affected_rows") > 0)


def night_accounts(df: DataFrame, moment: str, account: str, minimum: int = 5) -> DataFrame:
    """Accounts with over 30% of their rows between 23:00 and 04:00."""
    night = (F.hour(moment) >= NIGHT_FROM) | (F.hour(moment) < NIGHT_TO)
    rows = df.where(F.col(account).isNotNull()).groupBy(account).agg(
        count_if(night).alias("night_rows"), F.count(F.lit(1)).alias("rows")
    )
    return rows.where((F.col("rows") >= minimum) & (F.col("night_rows") / F.col("rows") > NIGHT_SHARE))


def busy_weeks(df: DataFrame, moment: str, account: str, by_year: bool = True) -> DataFrame:
    """Accounts whose busiest week is over three times their weekly mean.

    Weeks are counted per year and week; `by_year=False` joins the same week of all years.
    """
    week = iso_year_week(F.col(moment)) if by_year else F.weekofyear(moment)
    weekly = (
        df.where(F.col(moment).isNotNull() & F.col(account).isNotNull())
        .groupBy(account, week.alias("week"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = weekly.groupBy(account).agg(F.max("n").alias("peak"), F.avg("n").alias("mean"))
    return rows.where(F.col("peak") > F.col("mean") * SPIKE)


def round_amounts(df: DataFrame, amount: str, minimum: int = 20) -> DataFrame:
    """Share of amounts divisible by 100 when it reaches 15%, with the most frequent such amount."""
    v = F.col(amount)
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    is_round = F.col("v") % 100 == 0
    rows = counts.agg(
        F.coalesce(F.sum(F.when(is_round, F.col("n"))), F.lit(0)).alias("affected_rows"),
        F.sum("n").alias("rows"),
        F.min_by("v", F.when(is_round, F.struct(-F.col("n"), F.col("v")))).alias("most_frequent"),
    )
    rows = rows.withColumn("share", F.try_divide(F.col("affected_rows"), F.col("rows")))
    return rows.where((F.col("rows") >= minimum) & (F.col("share") >= ROUND_SHARE))


def stockouts(df: DataFrame, quantity: str, sku: str, demand: str | None = None) -> DataFrame:
    """Rows without stock when at least 2% of all, high over 10%, with the most affected item and open demand."""
    zero = F.col(quantity) == 0
    wanted = F.coalesce(F.sum(F.when(zero, F.col(demand))), F.lit(0.0)) if demand else F.lit(0.0)
    per_item = df.groupBy(sku).agg(count_if(zero).alias("z"), F.count(F.lit(1)).alias("n"), wanted.alias("d"))
    rows = per_item.agg(
        F.sum("z").alias("affected_rows"),
        (F.sum("z") * 100.0 / F.sum("n")).alias("pct"),
        F.min_by(sku, F.when(F.col("z") > 0, F.struct(-F.col("z"), F.col(sku)))).alias("top_sku"),
        F.sum("d").alias("open_demand"),
    )
    severity = F.when(F.col("pct") > 10, "high").otherwise("medium")
    return rows.where((F.col("affected_rows") > 0) & (F.col("pct") >= 2)).withColumn("severity", severity)


def movers(df: DataFrame, quantity: str, sku: str, minimum: int = 4) -> DataFrame:
    """Items with totals in the lowest and in the highest quarter."""
    totals = df.where(F.col(sku).isNotNull()).groupBy(sku).agg(F.coalesce(F.sum(quantity), F.lit(0.0)).alias("total"))
    q = quantiles(totals, [], "total", [0.25, 0.75], ["q25", "q75"])
    size = totals.agg(F.count(F.lit(1))).scalar()
    cut = q.select(F.struct("q25", "q75").alias("q")).scalar()
    speed = F.when(F.col("total") <= cut.getField("q25"), "slow").when(F.col("total") >= cut.getField("q75"), "fast")
    return totals.where(size >= minimum).withColumn("speed", speed).where(F.col("speed").isNotNull())


def reorder_points(df: DataFrame, quantity: str, sku: str, moment: str, lead_days: int = 7, n: int = 3) -> DataFrame:
    """Fastest items with the stock that lasts the lead time at their daily rate over the whole span."""
    rows = df.where(F.col(quantity).isNotNull() & F.col(moment).isNotNull())
    micros = F.unix_micros(F.col(moment).cast("timestamp"))
    span = rows.agg(F.floor((F.max(micros) - F.min(micros)) / 86_400_000_000)).scalar()
    totals = rows.groupBy(sku).agg(F.sum(quantity).alias("total"))
    rated = totals.where(span >= 7).select(sku, (F.col("total") / span).alias("daily_rate"))
    return (
        rated.withColumn("reorder_at", F.col("daily_rate") * lead_days)
        .orderBy(F.col("daily_rate").desc(), sku)
        .limit(n)
    )


def acquisition_cost(df: DataFrame, channel: str, cost: str, customer: str) -> DataFrame:
    """Cost per customer per channel, when the worst is at least twice the best."""
    rows = df.where(F.col(channel).isNotNull()).groupBy(channel).agg(
        F.sum(cost).alias("total_cost"), F.count_distinct(customer).alias("customers")
    )
    rows = rows.withColumn("cpa", F.try_divide(F.col("total_cost"), F.col("customers"))).where(F.col("cpa").isNotNull())
    ends = rows.agg(
        F.struct(F.min("cpa").alias("best"), F.max("cpa").alias("worst"), F.count(F.lit(1)).alias("k")).alias("e")
    ).scalar()
    factor = F.when(ends.getField("best") > 0, ends.getField("worst") / ends.getField("best")).otherwise(0.0)
    return rows.where((ends.getField("k") >= 2) & (factor >= 2)).withColumn("ratio", factor)


def repeat_rates(df: DataFrame, channel: str, customer: str) -> DataFrame:
    """Percent of customers with several rows per channel, when channels differ by 10 points or more.

    Channels without any repeat are left out, as no rate is formed for them.
    """
    orders = df.where(F.col(customer).isNotNull() & F.col(channel).isNotNull()).groupBy(channel, customer).agg(
        F.count(F.lit(1)).alias("n")
    )
    rates = orders.groupBy(channel).agg(
        count_if(F.col("n") > 1).alias("repeaters"), F.count(F.lit(1)).alias("customers")
    ).where(F.col("repeaters") > 0)
    rates = rates.withColumn("repeat_pct", F.col("repeaters") * 100.0 / F.col("customers"))
    ends = rates.agg(
        F.struct(F.min("repeat_pct").alias("low"), F.max("repeat_pct").alias("high"), F.count(F.lit(1)).alias("k")).alias("e")
    ).scalar()
    wide = (ends.getField("k") >= 2) & (ends.getField("high") - ends.getField("low") >= 10)
    return rates.where(wide)


def seasonal_swing(df: DataFrame, moment: str, revenue: str) -> DataFrame:
    """Best and worst calendar month by value, when at least 1.5 times apart; needs three months."""
    months = df.where(F.col(moment).isNotNull()).groupBy(F.month(moment).alias("m")).agg(
        F.coalesce(F.sum(revenue), F.lit(0.0)).alias("v")
    )
    rows = months.agg(
        F.max_by("m", F.struct(F.col("v"), -F.col("m"))).alias("peak_month"),
        F.min_by("m", F.struct(F.col("v"), F.col("m"))).alias("low_month"),
        F.max("v").alias("peak_value"),
        F.min("v").alias("low_value"),
        F.count(F.lit(1)).alias("months"),
    )
    rows = rows.withColumn("ratio", F.when(F.col("low_value") > 0, F.col("peak_value") / F.col("low_value")).otherwise(0.0))
    return rows.where((F.col("months") >= 3) & (F.col("ratio") >= 1.5)).drop("months")


def busy_but_poor(df: DataFrame, channel: str, revenue: str) -> DataFrame:
    """Channels over the 60% quantile of volume and, among those, under the 40% quantile of mean value."""
    stats = df.where(F.col(channel).isNotNull()).groupBy(channel).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(revenue).alias("mean_value")
    )
    volume = quantiles(stats, [], "rows", [0.6], ["q"]).scalar()
    busy = stats.where(F.col("rows") > volume)
    worth = quantiles(busy, [], "mean_value", [0.4], ["q"]).scalar()
    return busy.where(F.col("mean_value") < worth)


def all_fraud_findings(df: DataFrame, roles: Mapping[str, str | None]) -> DataFrame:
    """One row (rule, severity, affected_rows) per fraud rule that finds something."""
    parts: list[DataFrame] = []

    def add(rule: str, severity: Column, affected: Column, rows: DataFrame) -> None:
        found = rows.agg(severity.alias("severity"), affected.cast("long").alias("affected_rows"))
        parts.append(found.where(F.col("affected_rows") > 0).select(F.lit(rule).alias("rule"), "severity", "affected_rows"))

    amount, account, moment = roles["amount"], roles["account"], roles["moment"]
    if amount:
        add("threshold_structuring", F.lit("high"), F.sum("affected_rows"), just_under_limits(df, amount))
    if moment and account:
        many = F.when(F.count(F.lit(1)) > 3, "high").otherwise("medium")
        add("time_of_day_clustering", many, F.sum("rows"), night_accounts(df, moment, account))
        add("frequency_spike", F.lit("high"), F.count(F.lit(1)), busy_weeks(df, moment, account))
    if amount:
        add("round_number_clustering", F.lit("medium"), F.sum("affected_rows"), round_amounts(df, amount))
    return reduce(DataFrame.unionByName, parts)


