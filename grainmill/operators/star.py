"""Star schema: table definitions, dimensions, facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from grainmill.functions.dates import date_parts
from grainmill.operators.positions import running_total, sorted_ranges

# The star schema, one entry per table; the keys are checked by `integrity.key_match`.
STAR_SCHEMA = {
    "dim_fund": "amfi_code bigint, scheme_name string, fund_house string, category string, sub_category string, "
    "plan string, launch_date date, benchmark string, expense_ratio_pct double, exit_load_pct double, "
    "min_sip_amount bigint, min_lumpsum_amount bigint, fund_manager string, risk_category string, "
    "sebi_category_code string",
    "dim_date": "date_id date, year int, quarter int, month int, day int, is_weekday boolean",
    "dim_fund_house": "fund_house_id int, fund_house_name string",
    "fact_nav": "amfi_code bigint, date_id date, nav double",
    "fact_transactions": "transaction_id bigint, investor_id string, transaction_date date, amfi_code bigint, "
    "transaction_type string, amount_inr double, state string, city string, city_tier string, age_group string, "
    "gender string, annual_income_lakh double, payment_mode string, kyc_status string",
    "fact_performance": "amfi_code bigint, return_1yr_pct double, return_3yr_pct double, return_5yr_pct double, "
    "benchmark_3yr_pct double, alpha double, beta double, sharpe_ratio double, sortino_ratio double, "
    "std_dev_ann_pct double, max_drawdown_pct double, aum_crore bigint, expense_ratio_pct double, "
    "morningstar_rating bigint, risk_grade string, expense_ratio_anomaly_flag boolean",
    "fact_aum": "date_id date, fund_house_id int, aum_lakh_crore double, aum_crore bigint, num_schemes bigint",
}


def star_type(name: str) -> T.StructType:
    return T._parse_datatype_string(STAR_SCHEMA[name])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast to a table's definition; columns the source lacks become null."""
    fields = star_type(table).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def distinct_dates(sources: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """All days named in any of the sources. Each source is reduced to its days before the union."""
    days = [df.select(F.to_date(c).alias("date")).where(F.col("date").isNotNull()).distinct() for df, c in sources]
    return reduce(DataFrame.union, days).distinct()


def date_dimension(sources: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    parts = date_parts(F.col("date"))
    return distinct_dates(sources).select(
        F.col("date").alias("date_id"),
        *[parts[p].alias(p) for p in ("year", "quarter", "month", "day")],
        (~parts["is_weekend"]).alias("is_weekday"),
    )


def entity_dimension(sources: Sequence[DataFrame], name: str, key: str) -> DataFrame:
    """Distinct names from one-column frames, numbered from 1 in name order.

    The numbering sorts in ranges across all tasks and runs a job (`number_in_order`).
    """
    names = reduce(DataFrame.union, sources).toDF(name).where(F.col(name).isNotNull()).distinct()
    return number_in_order(names, [name], key).select(F.col(key).cast("int").alias(key), name)


def number_in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 along a total order, sorted in ranges across all tasks. Runs a job."""
    numbered = running_total(sorted_ranges(df, order), F.lit(1).cast("long"), "_position")
    return numbered.select(F.col("_position").alias(name), *df.columns)


def fact_aum(df: DataFrame, houses: DataFrame) -> DataFrame:
    """Map house names to their keys. The dimension joins by size: Spark broadcasts it while it is small."""
    return df.join(houses, F.col("fund_house") == F.col("fund_house_name"), "left").select(
        F.col("date").alias("date_id"), "fund_house_id", "aum_lakh_crore", "aum_crore", "num_schemes"
    )


def yearly_growth(df: DataFrame, moment: str, amount: str) -> DataFrame:
    """Total and count per year with the year before and the growth in percent; gaps in years give null."""
    yearly = df.groupBy(F.year(moment).alias("year")).agg(
        F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n")
    )
    before = yearly.select((F.col("year") + 1).alias("year"), F.col("total").alias("previous_total"))
    growth = F.try_divide(F.col("total") - F.col("previous_total"), F.col("previous_total")) * 100
    return yearly.join(before, "year", "left").withColumn("growth_pct", growth)
