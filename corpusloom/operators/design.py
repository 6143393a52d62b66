"""Estimates under a stratified design: ratios by linearised residuals, weighted ratios, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import Z, Z_ROUNDED, kish


def stratified_ratio(sample: DataFrame, strata: DataFrame, domain: Column, outcome: Column, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """estimate, se, low, high of sum(w y) / sum(w) over a domain. sample holds stratum; strata holds stratum, population, n.
    The variance is that of residuals within strata, with the finite population correction."""
    d = F.coalesce(domain.cast("double"), F.lit(0.0))
    y = F.coalesce(outcome.cast("double"), F.lit(0.0)) * d
    rows = sample.select("stratum", d.alias("d"), y.alias("y")).join(F.broadcast(strata), "stratum").withColumn("w", F.col("population") / F.col("n"))
    totals = rows.agg(F.sum(F.col("w") * F.col("d")).alias("td"), F.sum(F.col("w") * F.col("y")).alias("ty")).withColumn("estimate", F.col("ty") / F.col("td"))
    residuals = rows.crossJoin(F.broadcast(totals)).withColumn("e", F.col("y") - F.col("estimate") * F.col("d"))
    by = residuals.groupBy("stratum", "population", "n", "estimate", "td").agg(F.coalesce(F.var_samp("e"), F.lit(0.0)).alias("s2"))
    v = by.groupBy("estimate", "td").agg(F.sum(F.pow("population", F.lit(2)) * (1 - F.col("n") / F.col("population")) * F.col("s2") / F.col("n")).alias("v"))
    se = F.sqrt("v") / F.col("td")
    return v.select("estimate", se.alias("se"), F.greatest(F.lit(bounds[0]), F.col("estimate") - Z * se).alias("low"), F.least(F.lit(bounds[1]), F.col("estimate") + Z * se).alias("high"))


def weighted_ratio(df: DataFrame, predicate: Column, weight: str, keys: list[str] | None = None) -> DataFrame:
    """estimate, effective_n (Kish), low, high."""
    y = F.coalesce(predicate, F.lit(False)).cast("double")
    out = df.groupBy(*(keys or [])).agg((F.sum(F.col(weight) * y) / F.sum(weight)).alias("estimate"), kish(weight).alias("effective_n"))
    half = Z_ROUNDED * F.sqrt(F.col("estimate") * (1 - F.col("estimate")) / F.col("effective_n"))
    return out.withColumn("low", F.col("estimate") - half).withColumn("high", F.col("estimate") + half)


def unresolved_bounds(df: DataFrame, predicate: Column, resolved: Column, weight: str) -> DataFrame:
    """The weighted share if all unresolved rows are not selected, and if all are."""
    yes = F.coalesce(predicate & resolved, F.lit(False)).cast("double")
    open_ = (~F.coalesce(resolved, F.lit(False))).cast("double")
    w = F.col(weight)
    return df.agg((F.sum(w * yes) / F.sum(w)).alias("low"), (F.sum(w * (yes + open_)) / F.sum(w)).alias("high"))
