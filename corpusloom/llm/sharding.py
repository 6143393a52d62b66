"""Sharding by fixed virtual slots.

A record hashes into one of `slots` virtual slots. Bytes are summed per slot, and a versioned table maps slots to shards:
version 1 deals slots out in turn; version 2 is the same map after rebalancing, which moves single slots from loaded to
light shards. Only the map, whose size is the number of slots, is ever gathered in one row; records move once, in aggregate form.

Nulls: a null text has the size of its overhead and checksum 0; a null doc_id hashes like any value. Repeated rows are
counted, numbered as a run and expanded again, so that no key is a hot one. An empty table gives an empty result.
Columns other than doc_id and text are neither read nor returned. Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

SLOTS = 4096
OVERHEAD = 8


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per different record: doc_id, size, text_crc32, copies, virtual_slot."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return (
        docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))
    )


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes and rows of every slot, empty ones included; partial sums go before the shuffle."""
    spark = records.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def first_map(sums: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: slots dealt out in turn."""
    return sums.select(F.lit(1).alias("version"), "virtual_slot", (F.col("virtual_slot") % shards).cast("int").alias("shard"), "bytes", "rows")


def rebalanced(slot_map: DataFrame, shards: int, passes: int = 2) -> DataFrame:
    """The next version of the map. Slots are looked at from the largest down; one moves to the lightest shard when its own
    shard stays the heavier of both without it. The fold runs over the map alone, in one row of fixed size."""
    slot_map.createOrReplaceTempView("corpusloom_slot_map")
    step = """
      aggregate({items},
        named_struct('load', {load}, 'moved', cast(array() as array<struct<slot:int,shard:int,bytes:bigint,rows:bigint>>)),
        (a, s) -> transform(
          transform(array(cast(array_position(a.load, array_min(a.load)) - 1 as int)),
                    light -> if(s.bytes > 0 and a.load[s.shard] - a.load[light] > s.bytes, light, s.shard)),
          target -> named_struct(
            'load', if(target = s.shard, a.load, transform(a.load, (x, i) -> case i when target then x + s.bytes when s.shard then x - s.bytes else x end)),
            'moved', array_append(a.moved, named_struct('slot', s.slot, 'shard', target, 'bytes', s.bytes, 'rows', s.rows))))[0])
    """
    spark = slot_map.sparkSession
    state = spark.sql(
        f"""
        select max(version) + 1 as version,
               sort_array(collect_list(named_struct('bytes', -bytes, 'slot', virtual_slot, 'shard', shard, 'rows', rows))) as items,
               {", ".join(f"sum(if(shard = {i}, bytes, 0)) as load_{i}" for i in range(shards))}
        from corpusloom_slot_map
        """
    ).select(
        "version",
        F.expr("transform(items, s -> named_struct('slot', s.slot, 'shard', s.shard, 'bytes', -s.bytes, 'rows', s.rows))").alias("items"),
        F.array(*[F.coalesce(f"load_{i}", F.lit(0)).cast("long") for i in range(shards)]).alias("load"),
    )
    for _ in range(passes):
        state = state.select("version", F.expr(step.format(items="items", load="load")).alias("s")).select("version", F.col("s.moved").alias("items"), F.col("s.load").alias("load"))
    return state.select("version", F.inline("items")).select("version", F.col("slot").alias("virtual_slot"), "shard", "bytes", "rows")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed records, map of all versions). Placed: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot,
    map_version; slot numbers a shard's records from 0 without gaps. Sizes of shards come out near equal (law `bytes`)."""
    records = stored(sized(docs, slots), "sized")
    one = stored(first_map(slot_bytes(records, slots), shards), "slot-map-1")
    two = stored(rebalanced(one, shards), "slot-map-2")
    # first number of each slot inside its shard: a running sum over the map, which has as many rows as there are slots
    starts = two.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("rows")).select("virtual_slot", "shard", "start", "version")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    first = F.col("start") + F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    placed = (
        records.join(F.broadcast(starts), "virtual_slot")  # bounded: one row per slot
        .withColumn("first", first)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
        )
    )
    return placed, one.unionByName(two)
