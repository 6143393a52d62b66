"""Queries of samples and allocations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import sampling as SP
from corpusloom.plans.base import query, r9, records, table, units

SEP = "chr(31)"
CELL = "'(''' || source || ''', ''' || band || ''')'"
RANK = f"sha256('7' || {SEP} || {CELL} || {SEP} || doc_id)"
QUOTA = "cells as (select source, band, count(*) as cell_n from records group by all), x as (select *, {t}::double * cell_n / sum(cell_n) over () as exact from cells), f as (select *, floor(exact) as fl from x), quotas as (select source, band, cell_n, (fl + (row_number() over (order by exact - fl desc, source, band) <= {t} - sum(fl) over ())::int)::bigint as quota from f)"


@query("smp_1", f"select doc_id, sha256('7' || {SEP} || doc_id || {SEP} || lang) as rank from documents")
def smp_1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", SP.stable_rank(7, F.col("doc_id"), F.col("lang")).alias("rank"))


def _quota(key, total):
    @query(key, "with {records}, " + QUOTA.replace("{t}", str(total)) + " select source, band, cell_n, quota from quotas")
    def run(spark, sf):
        cells = records(spark, sf).groupBy("source", "band").agg(F.count(F.lit(1)).alias("cell_n"))
        return SP.hamilton(cells, "cell_n", total, ["source", "band"])


_quota("smp_2", 97)
_quota("smp_14", 50)


@query("smp_3", "with {records}, " + QUOTA.replace("{t}", "97") + f", r as (select doc_id, source, band, quota, row_number() over (partition by source, band order by {RANK}, cast(doc_id as varchar)) as rank from records join quotas using (source, band)) select doc_id, rank, sha256('7' || {SEP} || 'output' || {SEP} || doc_id) as output_rank from r where rank <= quota")
def smp_3(spark, sf):
    df = records(spark, sf).select("doc_id", "source", "band")
    return SP.stratified(df, 97, ["source", "band"], 7, "doc_id").select("doc_id", "rank", "output_rank")


@query("smp_4", f"with {{records}} select doc_id from (select doc_id, lang, row_number() over (partition by lang order by sha256('7' || {SEP} || lang || {SEP} || doc_id)) as r from records where doc_id % 10 <> 0) where (lang = 'en' and r <= 20) or (lang = 'de' and r <= 5)")
def smp_4(spark, sf):
    df = records(spark, sf).select("doc_id", "lang")
    return SP.enriched(df, "lang", {"en": 20, "de": 5}, 7, "doc_id", df.where("doc_id % 10 = 0")).select("doc_id")


def _cells(spark, sf):
    return {tuple(r[:-1]): r["n"] for r in records(spark, sf).groupBy("source", "band").agg(F.count(F.lit(1)).alias("n")).collect()}


def _bounded(key, total, minimum):
    @query(key)
    def run(spark, sf):
        cells = _cells(spark, sf)
        out = SP.bounded_hamilton(cells, min(total, sum(cells.values())), {c: minimum for c in cells})
        return spark.createDataFrame([(*c, n, out[c]) for c, n in sorted(cells.items())], "source string, band string, n long, quota long")


_bounded("smp_5", 120, 1)
_bounded("smp_10", 80, 1)


@query("smp_6")
def smp_6(spark, sf):
    """Sources first, then bands within a source; with inclusion probabilities and weights."""
    cells = _cells(spark, sf)
    sources: dict = {}
    for (s, _), n in cells.items():
        sources[s] = sources.get(s, 0) + n
    first = SP.bounded_hamilton(sources, min(100, sum(sources.values())))
    rows = []
    for s, quota in sorted(first.items()):
        own = {c: n for c, n in cells.items() if c[0] == s}
        for c, q in sorted(SP.bounded_hamilton(own, quota).items()):
            rows.append((*c, cells[c], q, q / cells[c], cells[c] / q if q else None))
    return spark.createDataFrame(rows, "source string, band string, n long, quota long, pi double, weight double")


@query("smp_7")
def smp_7(spark, sf):
    df = records(spark, sf).where("lang = 'en'")
    cells = {(r["source"],): r["n"] for r in df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = SP.bounded_hamilton(cells, min(30, sum(cells.values())))
    return SP.enriched(df.select("doc_id", "source"), "source", {c[0]: q for c, q in quotas.items() if q}, 7, "doc_id").select("doc_id", "source", "rank")


def _waves(key, sizes):
    @query(key)
    def run(spark, sf):
        df = records(spark, sf).select("doc_id", "source", "band")
        n = df.count()
        own = [s for s in sizes if s < n // 2]
        return SP.waves(df, ["source", "band"], [*own, n - sum(own)], 7, "doc_id").select("doc_id", "wave", "cell_rank", r9(F.col("pi")).alias("pi"), r9(F.col("weight")).alias("weight"))


for _key, _sizes in (("smp_8", (60, 90)), ("smp_21", (70,))):
    _waves(_key, _sizes)


def _drawn(spark, sf, sizes, seed, exhaust):
    """Waves of the given shares of the frame, in percent."""
    df = records(spark, sf).select("doc_id", "source", "band")
    n = df.count()
    counts = [n * s // 100 for s in sizes]
    return df, SP.waves(df, ["source", "band"], [*counts, n - sum(counts)] if exhaust else counts, seed, "doc_id", exhaust)


@query("smp_11")
def smp_11(spark, sf):
    """Margins of two cumulative waves of 20 % and 50 %; the weights of each row are held by their sums."""
    df, drawn = _drawn(spark, sf, (20, 30), 7, False)
    sums = SP.wave_weights(drawn, df, ["source", "band"], 2).agg(F.sum("weight_1").alias("w1"), F.sum("weight_2").alias("w2"))
    margins = SP.wave_margins(drawn, df, ["source", "band"], 2)
    return margins.join(F.broadcast(sums)).select("wave", "drawn", "empty_cells", r9(F.col("effective")).alias("effective"), r9(F.col("margin")).alias("margin"), F.round(F.when(F.col("wave") == 1, F.col("w1")).otherwise(F.col("w2")), 6).alias("weights"))


@query("smp_22", f"select count(*) as n, count(distinct i) as indexes, max(i) as last, count(distinct batch) as batches, true as in_order from (select doc_id, row_number() over (order by doc_id) as i, (row_number() over (order by doc_id) - 1) // 20 as batch from documents)")
def smp_22(spark, sf):
    """Three waves that use up the frame, dispatched in batches of 20: numbers without a gap, waves one after the other."""
    out = SP.dispatched(_drawn(spark, sf, (10, 30), 7, True)[1], 7, "doc_id")
    by = out.groupBy("wave").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dispatch_index").alias("k"), F.min("dispatch_index").alias("a"), F.max("dispatch_index").alias("b"), F.collect_set("batch_id").alias("batches"))
    follows = F.bool_and(F.col("b") - F.col("a") + 1 == F.col("n"))
    return by.agg(F.sum("n").alias("n"), F.sum("k").alias("indexes"), F.max("b").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("batches")))).cast("long").alias("batches"), follows.alias("in_order"))


@query("smp_9", f"with {{records}}, e as (select distinct source from records where doc_id < 3), f as (select doc_id, source, band, count(*) over (partition by source, band) as cell_n from records where source not in (select source from e)) select doc_id, cell_n, round(1.0 / cell_n, 9) as pi from f".replace("1.0 /", "1::double /"))
def smp_9(spark, sf):
    df = records(spark, sf).select("doc_id", "source", "band")
    exposed = df.where("doc_id < 3").select("source").distinct()
    return df.join(exposed, "source", "left_anti").withColumn("cell_n", F.count(F.lit(1)).over(Window.partitionBy("source", "band"))).select("doc_id", "cell_n", r9(1 / F.col("cell_n")).alias("pi"))


@query("smp_12", f"select distinct source, lang, substr(sha256(source || {SEP} || lang), 1, 16) as stratum_id from documents")
def smp_12(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct().withColumn("stratum_id", F.substring(F.sha2(F.concat_ws("\x1f", "source", "lang"), 256), 1, 16))


@query("smp_13", "with {records}, t as (select floor(count(*) * 0.05::double + 0.5)::bigint as t from records), cells as (select source, count(*) as cell_n from records group by all), x as (select *, t::double * cell_n / sum(cell_n) over () as exact, t from cells, t), f as (select *, floor(exact) as fl from x), q as (select source, (fl + (row_number() over (order by exact - fl desc, source) <= t - sum(fl) over ())::int)::bigint as quota from f), r as (select doc_id, row_number() over (partition by source order by sha256('pilot' || '|' || doc_id)) as rank, quota from records join q using (source)) select doc_id, rank from r where rank <= quota")
def smp_13(spark, sf):
    df = records(spark, sf).select("doc_id", "source")
    total = int(df.count() * 0.05 + 0.5)
    quotas = SP.hamilton(df.groupBy("source").agg(F.count(F.lit(1)).alias("cell_n")), "cell_n", total, ["source"])
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(F.concat_ws("|", F.lit("pilot"), F.col("doc_id").cast("string")), 256)))
    return df.join(F.broadcast(quotas), "source").withColumn("rank", rank).where("rank <= quota").select("doc_id", "rank")


query("smp_15", "with {records} select source, floor(count(*) * 0.05::double + 0.5)::bigint as size from records group by source")(lambda spark, sf: records(spark, sf).groupBy("source").agg(SP.pilot_size(F.count(F.lit(1)), 0.05).alias("size")))
query("smp_16")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit("pilot"), F.char(F.lit(0)), F.col("doc_id").cast("string")), 256).alias("rank")))
query("smp_17", f"select doc_id from documents order by sha256('9' || {SEP} || doc_id) limit 50")(lambda spark, sf: table(spark, sf, "documents").select("doc_id").orderBy(SP.stable_rank(9, F.col("doc_id"))).limit(50))


def _per_group(key, group, k, seed):
    @query(key, f"with {{records}} select doc_id, {group} as g from records qualify row_number() over (partition by {group} order by sha256('{seed}' || {SEP} || doc_id)) <= {k}")
    def run(spark, sf):
        """A seeded draw within groups by hash rank."""
        w = Window.partitionBy(group).orderBy(SP.stable_rank(seed, F.col("doc_id")))
        return records(spark, sf).select("doc_id", F.col(group).alias("g"), F.row_number().over(w).alias("r")).where(F.col("r") <= k).select("doc_id", "g")


_per_group("smp_18", "source", 10, 5)
_per_group("smp_19", "band", 20, 11)


@query("smp_20", f"with {{records}}, a as (select doc_id from records where band = 'long' order by sha256('3' || {SEP} || doc_id) limit 5), b as (select doc_id from records where lang = 'en' and doc_id not in (select doc_id from a) order by sha256('3' || {SEP} || doc_id) limit 10) select 'long' as stratum, doc_id from a union all select 'english', doc_id from b")
def smp_20(spark, sf):
    df = records(spark, sf)
    order = SP.stable_rank(3, F.col("doc_id"))
    a = df.where("band = 'long'").select("doc_id").orderBy(order).limit(5)
    b = df.where("lang = 'en'").select("doc_id").join(F.broadcast(a), "doc_id", "left_anti").orderBy(order).limit(10)
    return a.select(F.lit("long").alias("stratum"), "doc_id").unionByName(b.select(F.lit("english").alias("stratum"), "doc_id"))


query("smp_23", "with {units} select doc_id, case when toxic = 1 and quality = 1 then 'both' when toxic = 1 then 'toxic' when quality = 1 then 'quality' else 'none' end as stratum from units")(lambda spark, sf: units(spark, sf).select("doc_id", F.expr("case when toxic = 1 and quality = 1 then 'both' when toxic = 1 then 'toxic' when quality = 1 then 'quality' else 'none' end").alias("stratum")))
query("smp_24", "select doc_id, case when doc_id < 100 then 'wave_1' when doc_id < 500 then 'wave_2' else 'wave_3' end as wave from documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") < 100, "wave_1").when(F.col("doc_id") < 500, "wave_2").otherwise("wave_3").alias("wave")))
