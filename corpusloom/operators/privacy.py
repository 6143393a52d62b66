"""Direct locators: findings as spans, gates, merged candidates and remediation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.udfs import apply_exact_spans, pattern_spans
from corpusloom.operators.dedup import deduplicated

#: Patterns of the release gate.
GATE = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "web_url": r"(?i)\b(?:https?://|www\.)\S+",
    "domain": r"(?i)\b(?:[A-Z0-9-]+\.)+(?:com|net|org|cn|tv|cc)\b",
    "mainland_phone": r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)",
    "mainland_id": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "social_handle": r"(?<!\w)@[A-Za-z0-9_]{4,32}\b",
    "labelled_contact": r"(?i)(?:contact|email|phone|wechat|telegram|qq)\s*[:：]\s*\S+",
}
#: Patterns of the residual scan, with their priority.
RESIDUAL = {
    "email_address": r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?!\w)",
    "url_or_domain": r"(?i)(?:https?://|www\.)\S+|(?<![\w@])(?:[a-z0-9-]+\.)+(?:com|cn|net|org|tv|me|cc|xyz)(?:/\S*)?",
    "cn_mobile_number": r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)",
    "explicit_at_handle": r"(?<![\w@])@[A-Za-z0-9_][A-Za-z0-9_.-]{2,31}",
    "long_digit_sequence": r"(?<!\d)\d{7,19}(?!\d)",
}
PRIORITY = {"long_digit_sequence": "medium"}
#: What the structured audit adds to the residual patterns.
STRUCTURED = RESIDUAL | {
    "cn_national_id_number": r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)",
    "labelled_contact_identifier": r"(?i)(?:微信(?:号)?|wechat|vx|qq(?:号)?|telegram|tg(?:号)?|电报|微博(?:号)?|抖音(?:号)?|推特(?:号)?|账号|(?:user)?id)\s*[:：@]\s*(?:[A-Za-z][A-Za-z0-9_.-]{2,31}|\d{5,12})",
    "address_like_phrase": r"[一-鿿]{2,12}(?:路|街|巷|道|镇|乡|村|小区|公寓)\s*\d{1,5}(?:号|栋|室|楼)",
}
REVIEW_ONLY = ("long_digit_sequence", "address_like_phrase")
#: Secrets that must not be published.
SECRETS = {"private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "aws_key": r"\bAKIA[0-9A-Z]{16}\b", "bearer_token": r"(?i)\bbearer\s+[a-z0-9._-]{20,}", "assigned_secret": r"(?i)\b(?:api[_-]?key|secret|token|password)\s*[=:]\s*['\"]?[A-Za-z0-9/+_.-]{12,}"}


def findings(df: DataFrame, text: str, patterns: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """One row per finding: keys, category, start, end (half-open code points), matched."""
    return df.select(*keys, F.explode(pattern_spans(patterns)(F.col(text))).alias("f")).select(*keys, "f.*")


def gate(df: DataFrame, text: str, patterns: dict[str, str] = GATE) -> DataFrame:
    """(category, findings, texts) with a row for all: the gate passes when that row counts none."""
    found = df.select(F.monotonically_increasing_id().alias("row"), text)
    spans = findings(found, text, patterns, ["row"])
    by = spans.groupBy("category").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("row").alias("texts"))
    every = spans.agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("row").alias("texts")).select(F.lit("all").alias("category"), "findings", "texts")
    return by.unionByName(every)


def merged(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates of equal keys as one: signals sorted and joined by a bar, the strongest confidence."""
    return candidates.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("signal")), "|").alias("signals"), F.when(F.bool_or(F.col("confidence") == "strong"), "strong").otherwise("review").alias("confidence"))


def authorized(candidates: DataFrame, decisions: DataFrame, keys: Sequence[str], accepted: Column) -> DataFrame:
    """Candidates accepted themselves, or through an accepted decision on their keys."""
    yes = decisions.where(accepted).select(*keys).distinct().withColumn("_yes", F.lit(True))
    return candidates.join(yes, list(keys), "left").withColumn("authorized", F.coalesce(accepted, F.lit(False)) | F.coalesce("_yes", F.lit(False))).drop("_yes")


def is_accepted(c: Column) -> Column:
    """Truthy answers of reviewers, in several languages."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "accept", "accepted", "ok", "是", "接受", "通过"), F.lit(False))


def remediated(df: DataFrame, decisions: DataFrame, record_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows after exact-span decisions and renewed deduplication, counts). decisions: id, start, end, expected, replacement."""
    spans = decisions.groupBy(record_id).agg(F.collect_list(F.struct("start", "end", "expected", "replacement")).alias("spans"))
    out = df.join(spans, record_id, "left").withColumn(text, apply_exact_spans(F.col(text), F.col("spans"))).withColumn("remediated", F.col("spans").isNotNull()).drop("spans")
    return deduplicated(out.withColumn("final_text_sha256", F.sha2(F.col(text), 256)), "final_text_sha256", record_id)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether a half-open span overlaps any of an array of spans."""
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def span_is_valid(text: Column, start: Column, end: Column, matched: Column) -> Column:
    """Offsets are numbers inside the text, and the text there is what was matched."""
    a, b = start.try_cast("int"), end.try_cast("int")
    return F.coalesce((a >= 0) & (a < b) & (b <= F.char_length(text)) & (F.substring(text, a + 1, b - a) == matched), F.lit(False))
