"""Aggregate expressions whose definition differs from Spark's own function of that name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def skew(c: Column) -> Column:
    """Adjusted Fisher-Pearson skew (G1); null for fewer than three values or no spread."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when((n > 2) & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1)) / (n - 2))


def skew_label(value: Column) -> Column:
    """Five labels with limits at 0.5 and 1 either side of zero."""
    return (
        F.when(value > 1.0, "highly right-skewed")
        .when(value >= 0.5, "moderately right-skewed")
        .when(value >= -0.5, "normal")
        .when(value >= -1.0, "moderately left-skewed")
        .when(value.isNotNull(), "highly left-skewed")
        .otherwise("N/A")
    )


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds (null counts as no)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def avg_if(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null when either side is constant."""
    r = F.corr(a, b)
    # A constant side has a second moment of exactly 0, which makes the quotient no number.
    return F.when(~F.isnan(r), r)


def regression(y: Column, x: Column) -> dict[str, Column]:
    """Least squares of y on x: slope, intercept, r squared, standard error of the slope, t and n."""
    n = F.regr_count(y, x).cast("double")
    slope = F.regr_slope(y, x)
    r2 = F.regr_r2(y, x)
    error = F.sqrt((1 - r2) * F.regr_syy(y, x) / F.regr_sxx(y, x) / (n - 2))
    return {
        "slope": slope,
        "intercept": F.regr_intercept(y, x),
        "r_squared": r2,
        "std_error": error,
        "t_value": F.try_divide(slope, error),
        "n": F.regr_count(y, x),
    }
