"""Exact duplicates: flags, canonical rows, groups and contiguous numbers.

Grouping is by the hash of the text, so long texts are shuffled as 64 characters. No group gathers its rows in one task: sizes
and first rows come from partial aggregations, and ranks from windows over parts of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

#: Parts that the rows of a group are dealt to.
PARTS = 64


def _in_groups(df: DataFrame, key: str, order: Sequence[str], size: str, first: str) -> DataFrame:
    """Adds the size of a row's group and whether the row is the group's first. Rows that tie in `order` share a part, where one
    of them is first; the parts' counts and firsts make up those of the group."""
    part = [key, "_part"]
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS))).withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    whole = Window.partitionBy("_key")
    parts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_least"))
    parts = parts.select("_key", "_of", F.sum("_n").over(whole).alias(size), (F.col("_least") == F.min("_least").over(whole)).alias("_holds"))
    out = dealt.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return out.withColumn(first, F.col("_holds") & (F.col("_rank") == 1)).drop("_part", "_rank", "_key", "_of", "_holds")


def flag_exact(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """duplicate_group_id (12 hex), duplicate_group_size and is_canonical (first by `order`) beside every row."""
    out = _in_groups(df.withColumn("_h", F.sha2(F.col(text), 256)), "_h", order, "duplicate_group_size", "is_canonical")
    return out.select(*df.columns, F.substring("_h", 1, 12).alias("duplicate_group_id"), "duplicate_group_size", "is_canonical")


def canonical_by_aggregate(df: DataFrame, key: Column, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The first row of each key by a partial aggregation: no key gathers its rows in one task."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(key.alias("key")).agg(first.alias("row"), F.count(F.lit(1)).alias("group_size")).select("key", "row.*", "group_size")


def deduplicated(df: DataFrame, key: str, record_id: str, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counts): rows that are not valid go before duplicates are counted; ids compare as text."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    marked = df.withColumn("_ok", ok)
    kept = marked.where("_ok").groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(F.col(record_id).cast("string"))).alias("_row")).select("_row.*")
    sizes = marked.groupBy("_ok", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))

    def total(n: Column) -> Column:
        return F.coalesce(F.sum(n), F.lit(0))

    counts = sizes.agg(total(F.col("n")).alias("input_n"), total(F.when(~F.col("_ok"), F.col("n"))).alias("excluded_n"), total(F.when(F.col("_ok"), F.col("n") - 1)).alias("duplicate_n"), F.count_if("_ok").alias("kept_n"))
    return kept, counts


def numbered(df: DataFrame, order: Sequence[str], name: str = "corpus_index") -> DataFrame:
    """Contiguous numbers from 1 in global order, without a single-partition window: rows are range-partitioned and stored, so
    that both readings see the same partitions, and each partition's first number is the sum of the counts before it (a table
    of one row per partition)."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    starts = sizes.select("_part", "_first", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_start")


def collisions(df: DataFrame, key: str, record_id: str) -> DataFrame:
    """Groups of more than one row: the winner, and the ids of the others as JSON."""
    ids = F.array_sort(F.collect_list(F.col(record_id).cast("string")))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).where("n > 1").select(key, "n", F.col("ids")[0].alias("kept_id"), F.to_json(F.slice("ids", F.lit(2), F.size("ids") - 1)).alias("dropped_ids"))


def memberships(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """is_representative and group_size for each row of a key."""
    return _in_groups(df, key, order, "group_size", "is_representative")
