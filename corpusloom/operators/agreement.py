"""Agreement of coders over items: dense confusion tables, kappa, weighted agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import kappa


def unmatched(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """Items that one coder lacks or holds twice: agreement needs this to be empty."""
    both = left.select(item, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(item, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(item).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l != 1 or r != 1")


def confusion(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Counts over the product of all labels of either coder, zeros included. Labels are a small domain."""
    labels = pairs.select(F.col(first).alias("label")).union(pairs.select(second)).distinct()
    grid = labels.select(F.col("label").alias("first_value")).crossJoin(F.broadcast(labels.select(F.col("label").alias("second_value"))))
    cells = pairs.groupBy(F.col(first).alias("first_value"), F.col(second).alias("second_value")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cells, ["first_value", "second_value"], "left").na.fill(0, ["n"])


def summary(pairs: DataFrame, first: str, second: str, keys: list[str] | None = None, undefined: str = "value") -> DataFrame:
    """records, exact_agreement_n, rate, kappa by keys: chance agreement comes from the marginals of the same aggregation."""
    keys = keys or []
    cells = pairs.groupBy(*keys, F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("records"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("exact_agreement_n"))
    left = cells.groupBy(*keys, F.col("a").alias("label")).agg(F.sum("n").alias("l"))
    right = cells.groupBy(*keys, F.col("b").alias("label")).agg(F.sum("n").alias("r"))
    chance = left.join(right, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("l") * F.col("r")).alias("chance"))
    out = total.join(chance, keys, "left") if keys else total.crossJoin(F.broadcast(chance))
    observed = F.col("exact_agreement_n") / F.col("records")
    expected = F.coalesce("chance", F.lit(0)) / (F.col("records").cast("double") * F.col("records"))
    return out.select(*keys, "records", "exact_agreement_n", observed.alias("exact_agreement_rate"), kappa(observed, expected, undefined).alias("kappa"), F.when(F.abs(expected - 1) <= 1e-15, "undefined_no_marginal_variation").otherwise("defined").alias("kappa_status"))
