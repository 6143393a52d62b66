"""The metric compiler: many metrics, scopes and leave-one-out variants in one pass.

A metric is a set of boolean Columns (opportunity, selected, perhaps a comparison). All of them become conditional sums of a
single aggregation, so the corpus is scanned once. Overlapping scopes are labels exploded before the shuffle. Leaving out one
group is the total less the group's own sums, not a new scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import paired, ratio, wilson


@dataclass(frozen=True)
class Metric:
    name: str
    opportunity: Column
    selected: Column
    comparison: Column | None = None


COUNTS = ("n", "first_only", "second_only", "both_n", "neither")


def _sums(metrics: Sequence[Metric]) -> list[Column]:
    out = []
    for m in metrics:
        o, a = F.coalesce(m.opportunity, F.lit(False)), F.coalesce(m.selected, F.lit(False))
        b = F.lit(False) if m.comparison is None else F.coalesce(m.comparison, F.lit(False))
        for name, c in zip(COUNTS, (o, o & a & ~b, o & ~a & b, o & a & b, o & ~a & ~b), strict=True):
            out.append(F.count_if(c).alias(f"{m.name}__{name}"))
    return out


def _long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.lit(m.comparison is not None).alias("is_paired"), *[F.col(f"{m.name}__{c}").alias(c) for c in COUNTS]) for m in metrics])
    return wide.select(*keys, F.inline(rows))


def counted(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str] = ()) -> DataFrame:
    """metric, is_paired and cell counts, by keys."""
    return _long(df.groupBy(*keys).agg(*_sums(metrics)), keys, metrics)


def estimated(counts: DataFrame) -> DataFrame:
    """Adds estimate, low, high: a proportion with a clamped Wilson interval, or a paired difference with a normal one."""
    p = paired(F.col("first_only"), F.col("second_only"), F.col("both_n"), F.col("neither"))
    selected = F.col("first_only") + F.col("both_n")
    low, high = wilson(selected, F.col("n"), clamp=True)
    two = F.col("is_paired")
    return counts.withColumns({"selected_n": selected, "estimate": F.when(two, p["difference"]).otherwise(ratio(selected, F.col("n"))), "low": F.when(two, p["low"]).otherwise(low), "high": F.when(two, p["high"]).otherwise(high)})


def scoped(df: DataFrame, scopes: Mapping[str, Column]) -> DataFrame:
    """One row per scope that holds for a row; scopes may overlap."""
    labels = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in scopes.items()]))
    return df.withColumn("scope", F.explode(labels))


def leave_one_out(df: DataFrame, metrics: Sequence[Metric], group: str) -> DataFrame:
    """Cell counts of all rows but those of each group, as total less group."""
    parts = counted(df, metrics, [group])
    total = parts.groupBy("metric").agg(*[F.sum(c).alias(f"t_{c}") for c in COUNTS])
    return parts.join(F.broadcast(total), "metric").select(F.lit(group).alias("dimension"), F.col(group).cast("string").alias("left_out"), "metric", "is_paired", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in COUNTS])


def ranges(variants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least and greatest estimate and denominator, and how often the direction does not hold, by keys."""
    holds = F.when(F.col("is_paired"), F.col("estimate") > 0).otherwise(F.col("estimate") > 0.5)
    return variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("variants"), F.min("n").alias("least_n"), F.max("n").alias("greatest_n"), F.min("estimate").alias("least"), F.max("estimate").alias("greatest"), F.count_if(~holds).alias("failures"))
