"""Keyed state from event rows: upserts, revisions, corrections. The state is an aggregate of events, so it can be rebuilt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_key(site: Column, url: Column, title: Column) -> Column:
    return F.sha2(F.concat(site, F.lit("\n"), F.coalesce(F.when(url != "", url), title)), 256)


def titles(events: DataFrame, key: str, seq: str, attributes: Sequence[str], at: str) -> DataFrame:
    """One row per key: attributes of the latest event, first and last time, times seen."""
    latest = F.max_by(F.struct(*attributes), F.col(seq)).alias("row")
    return events.groupBy(key).agg(latest, F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("seen_count")).select(key, "row.*", "first_seen", "last_seen", "seen_count")


def queue(events: DataFrame, keys: Sequence[str], seq: str, firsts: Sequence[str]) -> DataFrame:
    """One row per key with the first non-null value of each attribute, in order of seq."""
    return events.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in firsts], F.count(F.lit(1)).alias("attempts"))


def annotations(events: DataFrame, key: str, revision: str, payload: str, at: str, duration: str) -> DataFrame:
    """Latest payload by revision, first time, summed duration, number of revisions."""
    return events.groupBy(key).agg(F.max_by(payload, revision).alias(payload), F.max(revision).alias("revision"), F.min(at).alias("started_at"), F.sum(duration).alias("duration"), F.count(F.lit(1)).alias("events"))


def corrections(baseline: DataFrame, events: DataFrame, key: str, value: str) -> DataFrame:
    """Baseline with the current correction laid over it. Events hold key, revision, action (save or reset), the value and a
    reason; a save needs a reason that is not blank and a value that differs from the baseline, else it is marked invalid."""
    latest = events.groupBy(key).agg(F.max_by(F.struct("action", F.col(value).alias("corrected"), "reason", "revision"), "revision").alias("e")).select(key, "e.*")
    out = baseline.join(latest, key, "left")
    active = F.coalesce(F.col("action") == "save", F.lit(False))
    valid = ~active | ((F.trim(F.coalesce("reason", F.lit(""))) != "") & ~F.col("corrected").eqNullSafe(F.col(value)))
    return out.select(key, F.col(value).alias("baseline"), F.when(active, F.col("corrected")).alias("correction"), F.coalesce(F.when(active, F.col("corrected")), F.col(value)).alias("current"), active.alias("active"), valid.alias("valid"), F.coalesce("revision", F.lit(0)).alias("revision"))
