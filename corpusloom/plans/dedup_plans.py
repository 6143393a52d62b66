"""Queries of upserts, deduplication, joins, windows, sorts, sets and scalar semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import udfs as U
from corpusloom.functions.text import sha256
from corpusloom.operators import dedup as D
from corpusloom.operators import upsert as UP
from corpusloom.plans.base import events, query, records, table, units
from corpusloom.plans.base import r9 as _r9

# upserts


@query("ups_1", "with {events} select cast(user_id as varchar) as key, max_by(event_type, event_id) as event_type, max_by(k, event_id) as k, min(event_id) as first_seen, max(event_id) as last_seen, count(*) as seen_count from log group by user_id")
def ups_1(spark, sf):
    e = events(spark, sf).withColumn("key", F.col("user_id").cast("string")).withColumn("at", F.col("event_id"))
    return UP.titles(e, "key", "event_id", ["event_type", "k"], "at")


@query("ups_2", "with {events} select user_id, event_type, min_by(nullif(k, 0), event_id) filter (where k <> 0) as k, count(*) as attempts from log group by all")
def ups_2(spark, sf):
    return UP.queue(events(spark, sf).withColumn("k", F.nullif("k", F.lit(0))), ["user_id", "event_type"], "event_id", ["k"])


#: Logs of decisions over whole tables: key, revision, decision and duration of each event.
LOGS = {
    "ups_3": ("events", "user_id", "event_id", "event_type", "cast(get_json_object(props, '$.k') as bigint)", "cast(json_extract(props, '$.k') as bigint)"),
    "ups_4": ("conversations", "conv_id", "turn", "role", "cast(char_length(text) as bigint)", "length(text)"),
    "ups_5": ("documents", "source", "doc_id", "lang", "cast(n_chars as bigint)", "n_chars"),
}


def _log(name, key, revision, decision, duration):
    def run(spark, sf):
        e = table(spark, sf, name).select(F.col(key).alias("key"), F.col(revision).alias("revision"), F.col(decision).alias("decision"), F.expr(duration).alias("duration"), F.col(revision).alias("at"))
        return UP.annotations(e, "key", "revision", "decision", "at", "duration")

    return run


for _key, (_t, _k, _rev, _dec, _dur, _sql) in LOGS.items():
    query(_key, f"select {_k} as key, max_by({_dec}, {_rev}) as decision, max({_rev}) as revision, min({_rev}) as started_at, cast(sum({_sql}) as bigint) as duration, count(*) as events from {_t} group by {_k}")(_log(_t, _k, _rev, _dec, _dur))

CORR = """with {units}, e as (select doc_id, turn, case when turn % 3 = 2 then 'reset' else 'save' end as action, cast(length(text) % 2 as bigint) as v from conversations join units on doc_id = conv_id),
 last as (select doc_id, max_by(action, turn) as action, max_by(v, turn) as v, max(turn) as revision from e group by doc_id)
 select doc_id, toxic as baseline, case when action = 'save' then v end as correction, coalesce(case when action = 'save' then v end, toxic) as current, coalesce(action = 'save', false) as active, coalesce(revision, 0) as revision from units left join last using (doc_id)"""


def _corrections(spark, sf):
    u = units(spark, sf)
    e = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("revision"), F.when(F.col("turn") % 3 == 2, "reset").otherwise("save").alias("action"), (F.char_length("text") % 2).cast(u.schema["toxic"].dataType).alias("toxic"), F.lit("why").alias("reason"))
    return UP.corrections(u.select("doc_id", "toxic"), e.join(u.select("doc_id"), "doc_id", "left_semi"), "doc_id", "toxic").drop("valid")


query("ups_6", CORR)(_corrections)
query("ups_7", "select doc_id, correction from (" + CORR + ") where not active")(lambda spark, sf: _corrections(spark, sf).where("not active").select("doc_id", "correction"))
query("ups_8", "select doc_id, current from (" + CORR + ")")(lambda spark, sf: _corrections(spark, sf).select("doc_id", "current"))

# deduplication

FLAGGED = "flagged as (select doc_id, round, substr(sha256(text), 1, 12) as duplicate_group_id, count(*) over (partition by text) as duplicate_group_size, row_number() over (partition by text order by doc_id) = 1 as is_canonical from records)"


def _flagged(spark, sf):
    return D.flag_exact(records(spark, sf), "text", ["doc_id"]).select("doc_id", "round", "duplicate_group_id", "duplicate_group_size", "is_canonical")


query("ded_1", "with {records}, " + FLAGGED + " select * from flagged")(_flagged)


@query("ded_2", "with {records}, v as (select *, row_number() over (partition by text order by cast(doc_id as varchar)) as r from records where n_chars >= 300) select (select count(*) from records) as input_n, (select count(*) from records where n_chars < 300) as excluded_n, (select count(*) from v where r > 1) as duplicate_n, (select count(*) from v where r = 1) as kept_n")
def ded_2(spark, sf):
    df = records(spark, sf).select("doc_id", "n_chars", sha256(F.col("text")).alias("h"))
    return D.deduplicated(df, "h", "doc_id", F.col("n_chars") >= 300)[1]


@query("ded_3", "with {records}, " + FLAGGED + " select f.*, f.round = 2 and f.duplicate_group_id in (select duplicate_group_id from flagged where round = 1) as seen_before from flagged f")
def ded_3(spark, sf):
    f = _flagged(spark, sf)
    first = f.where("round = 1").select("duplicate_group_id").distinct().withColumn("hit", F.lit(True))
    return f.join(first, "duplicate_group_id", "left").select("doc_id", "round", "duplicate_group_id", "duplicate_group_size", "is_canonical", ((F.col("round") == 2) & F.coalesce("hit", F.lit(False))).alias("seen_before"))


@query("ded_4", "with {records}, " + FLAGGED.replace("from records", "from records where round = 1") + " select * from flagged")
def ded_4(spark, sf):
    return D.flag_exact(records(spark, sf).where("round = 1"), "text", ["doc_id"]).select("doc_id", "round", "duplicate_group_id", "duplicate_group_size", "is_canonical")


@query("ded_5", "select distinct substr(sha256(text), 1, 12) as group_id from documents")
def ded_5(spark, sf):
    return table(spark, sf, "documents").select(F.substring(sha256(F.col("text")), 1, 12).alias("group_id")).distinct()


@query("ded_6", "with m as (select doc_id, sha256(text) as h from documents), g as (select h, min(doc_id) as representative, count(*) as group_size from m group by h) select h, representative, group_size, row_number() over (order by h) as corpus_index from g")
def ded_6(spark, sf):
    g = table(spark, sf, "documents").groupBy(sha256(F.col("text")).alias("h")).agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("group_size"))
    return D.numbered(g, ["h"]).select("h", "representative", "group_size", F.col("corpus_index").cast("long").alias("corpus_index"))


@query("ded_7", "with {records}, m as (select doc_id, round, sha256(text) as h from records) select h, min((h, round, doc_id)).doc_id as doc_id, count(*) as n from (select h, round, doc_id, {'h': h, 'round': round, 'doc_id': doc_id} as s from m) group by h".replace("min((h, round, doc_id)).doc_id", "min(s).doc_id"))
def ded_7(spark, sf):
    m = records(spark, sf).select(sha256(F.col("text")).alias("h"), "round", "doc_id")
    return m.groupBy("h").agg(F.min(F.struct("round", "doc_id"))["doc_id"].alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("ded_8", "with g as (select count(*) as n from documents group by text) select count(*) as groups, count(*) filter (where n > 1) as repeated_groups, coalesce(sum(n - 1), 0)::bigint as extra_rows from g")
def ded_8(spark, sf):
    g = table(spark, sf, "documents").groupBy(sha256(F.col("text")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("repeated_groups"), F.sum(F.col("n") - 1).alias("extra_rows"))


@query("ded_9", "with t as (select doc_id, case when doc_id % 5 = 0 and length(text) >= 40 then 'X' || substr(text, 41) else text end as t from documents), k as (select t, min_by(doc_id, cast(doc_id as varchar)) as doc_id from t group by t) select doc_id, sha256(t) as final_text_sha256 from k")
def ded_9(spark, sf):
    from corpusloom.operators.privacy import remediated

    docs = table(spark, sf, "documents").select("doc_id", "text")
    decisions = docs.where((F.col("doc_id") % 5 == 0) & (F.char_length("text") >= 40)).select("doc_id", F.lit(0).alias("start"), F.lit(40).alias("end"), F.substring("text", 1, 40).alias("expected"), F.lit("X").alias("replacement"))
    return remediated(docs, decisions, "doc_id", "text")[0].select("doc_id", "final_text_sha256")


@query("ded_10", "with m as (select sha256(text) as h, cast(doc_id as varchar) as id from documents), g as (select h, count(*) as n, list(id order by id) as ids from m group by h having count(*) > 1) select h, n, ids[1] as kept_id, '[' || array_to_string(list_transform(ids[2:], lambda x: '\"' || x || '\"'), ',') || ']' as dropped_ids from g")
def ded_10(spark, sf):
    return D.collisions(table(spark, sf, "documents").select(sha256(F.col("text")).alias("h"), "doc_id"), "h", "doc_id")


@query("ded_11", "with {units0} select policy, count(*) as n, sum(toxic)::bigint as toxic from (select 'min' as policy, toxic from u qualify row_number() over (partition by source, band order by doc_id) = 1 union all select 'max', toxic from u qualify row_number() over (partition by source, band order by doc_id desc) = 1 union all select 'hash', toxic from u qualify row_number() over (partition by source, band order by sha256(cast(doc_id as varchar))) = 1) group by policy".replace("with {units0}", "with {units}").replace(" from u ", " from units "))
def ded_11(spark, sf):
    """Three choices of representative in one aggregation of the groups."""
    u = units(spark, sf)
    g = u.groupBy("source", "band").agg(F.min_by("toxic", "doc_id").alias("a"), F.max_by("toxic", "doc_id").alias("b"), F.min_by("toxic", sha256(F.col("doc_id").cast("string"))).alias("c"))
    rows = g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(c).alias("toxic")) for n, c in (("min", "a"), ("max", "b"), ("hash", "c"))])))
    return rows.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("toxic"))


@query("ded_12", "with {records} select source, min_by(doc_id, sha256('seed' || chr(31) || doc_id)) as doc_id, count(*) as eligible from records where n_chars > 100 group by source")
def ded_12(spark, sf):
    from corpusloom.operators.sampling import stable_rank

    return records(spark, sf).where("n_chars > 100").groupBy("source").agg(F.min_by("doc_id", stable_rank("seed", F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("eligible"))


# joins


@query("join_1", "select l.l_orderkey, l.l_linenumber, o.o_custkey from lineitem l join orders o on l_orderkey = o_orderkey")
def join_1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("join_2", "select d.doc_id, coalesce(l.toxic, -1) as toxic from documents d left join labels l using (doc_id)")
def join_2(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("join_3", "with t as (select conv_id, count(*) as turns, array_to_string(list(role order by turn), '|') as roles from conversations group by conv_id) select d.doc_id, coalesce(turns, 0) as turns, roles from documents d left join t on conv_id = doc_id")
def join_3(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "|").alias("roles"))
    return table(spark, sf, "documents").select("doc_id").join(t, F.col("conv_id") == F.col("doc_id"), "left").select("doc_id", F.coalesce("turns", F.lit(0)).alias("turns"), "roles")


@query("join_4", "select d.doc_id from documents d where exists (select 1 from labels l join documents x using (doc_id) where l.toxic = 1 and x.source = d.source and x.lang = d.lang)")
def join_4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    bad = d.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("source", "lang").distinct()
    return d.join(bad, ["source", "lang"], "left_semi").select("doc_id")


@query("join_5", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def join_5(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("join_6", "select (select count(*) from (select doc_id from documents where doc_id % 2 = 0 intersect select doc_id from documents where doc_id % 2 = 1)) as shared, (select count(*) from (select doc_id from documents except (select doc_id from documents where doc_id % 2 = 0 union select doc_id from documents where doc_id % 2 = 1))) as missing")
def join_6(spark, sf):
    """One aggregation of marks instead of set operations."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("a"), (F.col("doc_id") % 2 == 1).alias("b"))
    g = d.groupBy("doc_id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(~F.col("a") & ~F.col("b")).alias("missing"))


@query("join_7", "select d.doc_id, coalesce(a.toxic, b.quality, -1) as label, case when a.doc_id is not null then 'new' when b.doc_id is not null then 'legacy' else 'none' end as layer from documents d left join (select * from labels where toxic = 1) a using (doc_id) left join labels b using (doc_id)")
def join_7(spark, sf):
    labels = table(spark, sf, "labels")
    a = labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("a"))
    b = labels.select("doc_id", F.col("quality").alias("b"))
    return table(spark, sf, "documents").select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("a", "b", F.lit(-1)).alias("label"), F.when(F.col("a").isNotNull(), "new").when(F.col("b").isNotNull(), "legacy").otherwise("none").alias("layer"))


@query("join_8", "select d.doc_id, l.quality, t.turns, e.n from documents d join labels l using (doc_id) left join (select conv_id, count(*) as turns from conversations group by 1) t on conv_id = d.doc_id left join (select user_id, count(*) as n from events group by 1) e on user_id = d.doc_id")
def join_8(spark, sf):
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").join(t, "doc_id", "left").join(e, "doc_id", "left")


@query("join_9", "select coalesce(a.doc_id, b.doc_id) as doc_id, a.quality as a, b.toxic as b from labels a full outer join (select * from labels where doc_id % 3 <> 0) b on a.doc_id = b.doc_id")
def join_9(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select("doc_id", F.col("quality").alias("a")).join(labels.where("doc_id % 3 <> 0").select("doc_id", F.col("toxic").alias("b")), "doc_id", "full")


@query("join_10", "select c.conv_id, c.turn, d.source from conversations c join documents d on d.doc_id = c.conv_id")
def join_10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return table(spark, sf, "conversations").select("conv_id", "turn").join(d, F.col("conv_id") == F.col("doc_id")).select("conv_id", "turn", "source")


@query("join_11", "select status, count(*) as n from (select coalesce(case when l.toxic = 1 then 'flagged' when l.doc_id is not null then 'done' end, 'pending') as status from documents d left join labels l using (doc_id)) group by status")
def join_11(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").otherwise("done").alias("s"))
    return table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").groupBy(F.coalesce("s", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("join_12", "with {records} select source from records group by source having count(distinct round) = 2")
def join_12(spark, sf):
    return records(spark, sf).groupBy("source").agg(F.min("round").alias("a"), F.max("round").alias("b")).where("a <> b").select("source")


@query("join_13", "with {units}, s as (select * from (values ('all'), ('en'), ('short')) t(scope)) select scope, source, count(*) as n from units, s where scope = 'all' or scope = lang or scope = band group by scope, source")
def join_13(spark, sf):
    from corpusloom.operators.metrics import scoped

    return scoped(units(spark, sf), {"all": F.lit(True), "en": F.col("lang") == "en", "short": F.col("band") == "short"}).groupBy("scope", "source").agg(F.count(F.lit(1)).alias("n"))


@query("join_14", "select doc_id, instr(text, 'the') - 1 < 12 and instr(text, 'the') + 2 > 4 as hit from documents where contains(text, 'the')")
def join_14(spark, sf):
    from corpusloom.operators.privacy import overlaps

    at = F.instr("text", "the") - 1
    return table(spark, sf, "documents").where("contains(text, 'the')").select("doc_id", overlaps(at, at + 3, F.array(F.struct(F.lit(4).alias("start"), F.lit(12).alias("end")))).alias("hit"))


# windows



def w_src():
    return Window.partitionBy("source")

_simple = {
    "win_1": ("with {records} select source, doc_id from records qualify row_number() over (partition by source order by n_chars desc, doc_id) = 1", lambda d: d.groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("doc_id"))),
    "win_2": ("with {records} select doc_id, count(*) over (partition by source) as n from records", lambda d: d.select("doc_id", F.count(F.lit(1)).over(w_src()).alias("n"))),
    "win_3": ("with {records} select doc_id from records qualify row_number() over (partition by source order by sha256(cast(doc_id as varchar))) <= 3", lambda d: d.withColumn("r", F.row_number().over(w_src().orderBy(sha256(F.col("doc_id").cast("string"))))).where("r <= 3").select("doc_id")),
    "win_4": ("with {records} select doc_id, row_number() over (partition by source, band order by doc_id) as candidate_order from records", lambda d: d.select("doc_id", F.row_number().over(Window.partitionBy("source", "band").orderBy("doc_id")).alias("candidate_order"))),
    "win_5": ("with {records} select doc_id, row_number() over (order by doc_id) as i from records", lambda d: D.numbered(d.select("doc_id"), ["doc_id"], "i").select("doc_id", F.col("i").cast("long").alias("i"))),
    "win_6": ("with {records} select doc_id, (row_number() over (order by doc_id) - 1) // 20 + 1 as batch from records", lambda d: D.numbered(d.select("doc_id"), ["doc_id"], "i").select("doc_id", F.expr("cast(i - 1 as bigint) div 20 + 1").alias("batch"))),
    "win_7": ("with {records} select doc_id, min(n_chars) over (partition by source order by doc_id rows between current row and unbounded following) as m from records", lambda d: d.select("doc_id", F.min("n_chars").over(w_src().orderBy("doc_id").rowsBetween(0, Window.unboundedFollowing)).alias("m"))),
    "win_8": ("with {records}, w as (select band, count(*) as n from records group by band) select band, sum(n) over (order by band rows unbounded preceding)::bigint as running from w", lambda d: d.groupBy("band").agg(F.count(F.lit(1)).alias("n")).select("band", F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))),
    "win_9": ("with {records} select doc_id, coalesce(n_chars > lag(n_chars) over (partition by source order by doc_id), false) as grows from records", lambda d: d.select("doc_id", F.coalesce(F.col("n_chars") > F.lag("n_chars").over(w_src().orderBy("doc_id")), F.lit(False)).alias("grows"))),
    "win_10": ("with {records} select source, lang, round(count(*) / sum(count(*)) over (partition by source), 9) as share from records group by source, lang", lambda d: d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).select("source", "lang", _r9(F.col("n") / F.sum("n").over(w_src())).alias("share"))),
}
for _key, (_sql, _f) in _simple.items():
    query(_key, _sql)(lambda spark, sf, f=_f: f(records(spark, sf)))


@query("win_11", "select conv_id, max_by(role, turn) as role from conversations group by conv_id")
def win_11(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))


# sorts, limits, sets, dates, numbers, arrays, maps, JSON, locale

_more = {
    "ord_1": ("with {records} select source, count(*) as n from records group by source order by n desc, source", lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")),
    "ord_2": ("with {records} select doc_id from records order by lang <> 'en', n_chars desc, doc_id limit 25", lambda d: d.orderBy(F.col("lang") != "en", F.desc("n_chars"), "doc_id").limit(25).select("doc_id")),
    "ord_3": ("with {records} select doc_id, n_chars from records order by n_chars desc, doc_id limit 10", lambda d: d.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")),
    "ord_4": ("with {records} select doc_id from records order by case band when 'medium' then 0 when 'short' then 1 else 2 end, doc_id limit 1", lambda d: d.orderBy(F.when(F.col("band") == "medium", 0).when(F.col("band") == "short", 1).otherwise(2), "doc_id").limit(1).select("doc_id")),
    "ord_5": ("with {records} select doc_id from records order by doc_id limit 100", lambda d: d.orderBy("doc_id").limit(100).select("doc_id")),
    "ord_6": ("with {records} select source, list(doc_id order by doc_id)[:5] as first_ids from records group by source", lambda d: d.withColumn("r", F.row_number().over(w_src().orderBy("doc_id"))).where("r <= 5").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("first_ids"))),
    "set_1": ("with {records} select 'a' as track, doc_id from records where lang = 'en' union all select 'b', doc_id from records where n_chars < 500", lambda d: d.where("lang = 'en'").select(F.lit("a").alias("track"), "doc_id").unionByName(d.where("n_chars < 500").select(F.lit("b").alias("track"), "doc_id"))),
    "set_2": ("with {records} select source from records where lang = 'en' intersect select source from records where lang = 'de'", lambda d: d.where("lang = 'en'").select("source").intersect(d.where("lang = 'de'").select("source"))),
    "set_3": ("with {records} select doc_id from records except select doc_id from records where lang = 'en'", lambda d: d.select("doc_id").exceptAll(d.where("lang = 'en'").select("doc_id"))),
    "set_4": ("with {records} select count(*) as missing from records where lang = 'en' and doc_id not in (select doc_id from records where n_chars >= 0)", lambda d: d.where("lang = 'en'").select("doc_id").join(d.where("n_chars >= 0").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))),
    "set_5": ("with {records} select lang as label from records union select band from records", lambda d: d.select(F.col("lang").alias("label")).union(d.select("band")).distinct()),
    "mth_2": ("with {records} select doc_id, cast(round_even(n_chars / 8.0, 0) as bigint) as half_even, cast(floor(n_chars / 8.0 + 0.5) as bigint) as half_up from records", lambda d: d.select("doc_id", F.bround(F.col("n_chars") / 8.0, 0).cast("long").alias("half_even"), F.floor(F.col("n_chars") / 8.0 + 0.5).cast("long").alias("half_up"))),
    "mth_3": ("with {records} select doc_id, abs(n_chars / 3.0 - n_chars * 0.333333) <= 0.001 as close from records", lambda d: d.select("doc_id", (F.abs(F.col("n_chars") / 3.0 - F.col("n_chars") * 0.333333) <= 0.001).alias("close"))),
    "arr_1": ("with {records} select doc_id, len(list_filter(string_split(title, ' '), lambda x: length(x) > 4)) as long_words, len(list_distinct(string_split(title, ' '))) as words from records", lambda d: d.select("doc_id", F.size(F.filter(F.split("title", " "), lambda x: F.char_length(x) > 4)).cast("long").alias("long_words"), F.size(F.array_distinct(F.split("title", " "))).cast("long").alias("words"))),
    "arr_2": ("with {records} select doc_id, title from records", lambda d: d.select("doc_id", "title")),
    "arr_3": ("with {records} select word, count(*) as n from (select unnest(string_split(title, ' ')) as word from records) group by word", lambda d: d.select(F.explode(F.split("title", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))),
    "map_1": ("with {records} select doc_id, coalesce(map {'en': 1, 'de': 2}[lang], 0) as code from records", lambda d: d.select("doc_id", F.coalesce(F.element_at(F.create_map(F.lit("en"), F.lit(1), F.lit("de"), F.lit(2)), F.col("lang")), F.lit(0)).alias("code"))),
    "map_2": ("with {records} select doc_id, '{\"001\":\"1\",\"lang\":\"' || lang || '\"}' as versions from records", lambda d: d.select("doc_id", F.to_json(F.map_concat(F.create_map(F.lit("001"), F.lit("1")), F.create_map(F.lit("lang"), F.col("lang")))).alias("versions"))),
}
for _key, (_sql, _f) in _more.items():
    query(_key, _sql)(lambda spark, sf, f=_f: f(records(spark, sf)))


@query("arr_2", "with {records}, w as (select doc_id, generate_subscripts(string_split(title, ' '), 1) as i, unnest(string_split(title, ' ')) as x from records), f as (select doc_id, x, min(i) as i from w group by all) select doc_id, array_to_string(list(x order by i), ' ') as title from f group by doc_id")
def arr_2(spark, sf):
    return records(spark, sf).select("doc_id", F.array_join(F.array_distinct(F.split("title", " ")), " ").alias("title"))


@query("dat_1", "select count(*) as n, min(ts)::varchar[:10] as first_day, max(ts)::varchar[:10] as last_day, 0 as failures from events".replace("::varchar[:10]", "::date::varchar"))
def dat_1(spark, sf):
    t = F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min(t), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(t), "yyyy-MM-dd").alias("last_day"), F.count_if(t.isNull() & F.col("ts").isNotNull()).cast("int").alias("failures"))


@query("dat_2", "select event_id, strftime(ts - interval 2 hour, '%Y-%m-%d %H:%M:%S') as utc from events")
def dat_2(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return table(spark, sf, "events").select("event_id", F.date_format(F.to_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("dat_3", "select count(*) as n from events where ts < (select max(ts) from events) - interval 90 minute")
def dat_3(spark, sf):
    e = table(spark, sf, "events").select("ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("latest")))).where("ts < latest - interval 90 minutes").agg(F.count(F.lit(1)).alias("n"))


@query("dat_4", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def dat_4(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("mth_1", "with {events} select event_id, round(sqrt(k), 9) as root, floor(k / 3.0)::bigint as down, ceil(k / 3.0)::bigint as up, round(ln(k + 1), 9) as log, round(lgamma(k + 1), 6) as log_factorial from log")
def mth_1(spark, sf):
    return events(spark, sf).select("event_id", _r9(F.sqrt("k")).alias("root"), F.floor(F.col("k") / 3.0).alias("down"), F.ceil(F.col("k") / 3.0).alias("up"), _r9(F.ln(F.col("k") + 1)).alias("log"), F.round(U.lgamma((F.col("k") + 1).cast("double")), 6).alias("log_factorial"))


@query("jsn_1", "with {events} select event_id, '{\"k\":' || k || ',\"type\":\"' || event_type || '\"}' as j from log")
def jsn_1(spark, sf):
    return events(spark, sf).select("event_id", F.to_json(F.struct("k", F.col("event_type").alias("type"))).alias("j"))


@query("loc_1", "with {records} select doc_id, contains(lower(title), 'straße') as hit from records")
def loc_1(spark, sf):
    return records(spark, sf).select("doc_id", F.contains(U.casefold(F.col("title")), F.lit("strasse")).alias("hit"))
