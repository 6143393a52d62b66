"""Estimators as Columns over counts. Undefined ratios are NaN unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054
Z_ROUNDED = 1.96
NAN = float("nan")


def ratio(count: Column, n: Column) -> Column:
    """count / n, NaN for n = 0."""
    return F.when(n == 0, F.lit(NAN)).otherwise(count / F.when(n != 0, n))


def proportion(count: Column, n: Column) -> Column:
    """count / n; raises where 0 <= count <= n or n > 0 does not hold."""
    return F.when((n > 0) & (count >= 0) & (count <= n), count / n).otherwise(F.raise_error(F.lit("count outside 0..denominator")).cast("double"))


def wilson(count: Column, n: Column, clamp: bool = False, z: float = Z) -> tuple[Column, Column]:
    """Wilson's interval; NaN for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p = count / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low, high = centre - half, centre + half
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return F.coalesce(low, F.lit(NAN)), F.coalesce(high, F.lit(NAN))


def paired(first_only: Column, second_only: Column, both: Column, neither: Column) -> dict[str, Column]:
    """Of the four cells of a paired binary: marginals, difference, standard error and normal interval."""
    n = first_only + second_only + both + neither
    diff = ratio(first_only - second_only, n)
    # the differences are 1, -1 and 0: their sum of squares is the number of discordant pairs
    variance = F.when(n > 1, (first_only + second_only - n * diff * diff) / (n - 1)).otherwise(0.0)
    se = F.sqrt(F.greatest(variance, F.lit(0.0)) / F.when(n > 0, n))
    return {
        "eligible_n": n, "first_n": first_only + both, "second_n": second_only + both, "difference": diff, "se": F.coalesce(se, F.lit(0.0)),
        "low": F.greatest(F.lit(-1.0), diff - Z * F.coalesce(se, F.lit(0.0))), "high": F.least(F.lit(1.0), diff + Z * F.coalesce(se, F.lit(0.0))),
    }


def cells(first: Column, second: Column) -> list[Column]:
    """Counts first_only, second_only, both_n, neither as aggregates of two booleans (null counts as false)."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return [F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(a & b).alias("both_n"), F.count_if(~a & ~b).alias("neither")]


def odds_ratio(a: Column, n1: Column, b: Column, n2: Column) -> Column:
    """Infinite for an empty denominator with a filled numerator, NaN if both are empty."""
    top, bottom = (a * (n2 - b)).cast("double"), ((n1 - a) * b).cast("double")
    return F.when(bottom != 0, top / F.when(bottom != 0, bottom)).when(top > 0, F.lit(float("inf"))).otherwise(F.lit(NAN))


def bh_adjusted(df: DataFrame, p: str, family: str, order: str) -> DataFrame:
    """q by Benjamini and Hochberg in each family: ties in input order, p that is not finite stays out and gets NaN."""
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(family, fine)
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy(p, order))).withColumn("_m", F.count(F.lit(1)).over(w))
    step = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(w.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.when(fine, F.least(F.lit(1.0), step)).otherwise(F.lit(NAN))).drop("_rank", "_m")


def kappa(observed: Column, expected: Column, undefined: str = "value") -> Column:
    """Cohen's kappa. Without variation of marginals: 1 or 0 by agreement ('value'), or null ('null')."""
    flat = F.abs(expected - 1) <= 1e-15
    other = F.when(observed == 1, F.lit(1.0)).otherwise(0.0) if undefined == "value" else F.lit(None).cast("double")
    return F.when(flat, other).otherwise((observed - expected) / F.when(~flat, 1 - expected))


def kish(w: str) -> Column:
    """Effective sample size of weights, as an aggregate."""
    return F.sum(w) * F.sum(w) / F.sum(F.col(w) * F.col(w))


def worst_margin(full_n: Column, known_n: Column, remaining_n: Column, effective_n: Column, z: float = Z_ROUNDED) -> Column:
    """Half width at a proportion of one half, with a finite population correction, for the part that is not known."""
    fpc = F.sqrt(F.greatest(F.lit(0.0), 1 - effective_n / F.when(remaining_n > 0, remaining_n)))
    return F.when(remaining_n > 0, remaining_n / full_n * z * 0.5 / F.sqrt(effective_n) * fpc).otherwise(0.0)


def zero_upper(n: Column, confidence: float = 0.95) -> Column:
    """One-sided upper bound after no event in n."""
    return 1 - F.pow(F.lit(1 - confidence), 1 / n)


def cmh(df: DataFrame, stratum: str) -> DataFrame:
    """(odds_ratio, chi2) of Cochran, Mantel and Haenszel from a, n1, b, n2 by stratum; strata need both groups."""
    n, a, b, n1, n2 = F.col("n1") + F.col("n2"), F.col("a"), F.col("b"), F.col("n1"), F.col("n2")
    k = a + b
    use = df.where((n1 > 0) & (n2 > 0) & (n > 1))
    sums = use.agg(
        F.sum(a * (n2 - b) / n).alias("top"), F.sum(b * (n1 - a) / n).alias("bottom"), F.sum(a - n1 * k / n).alias("excess"),
        F.sum(n1.cast("double") * n2 * k * (n - k) / (n * n * (n - 1))).alias("variance"),
    )
    return sums.select(F.when(F.col("bottom") > 0, F.col("top") / F.col("bottom")).otherwise(F.lit(NAN)).alias("odds_ratio"), F.when(F.col("variance") > 0, F.pow("excess", F.lit(2)) / F.col("variance")).otherwise(F.lit(NAN)).alias("chi2"))
