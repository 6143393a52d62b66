"""Queries of aggregate tables. Predicates are SQL text, so the compiler and the oracle read the same definitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import udfs as U
from corpusloom.functions.text import sha256
from corpusloom.operators import metrics as M
from corpusloom.plans.base import events, query, r9, records, table, units

SOURCES = [f"source = 'src{i}'" for i in range(4)]
TRACKS = {"track_1": "round = 1", "track_2": "round = 2"}
LENGTHS = {b: f"band = '{b}'" for b in ("short", "medium", "long")}
ALL = {"all": "true"}

METRICS = {
    "quality": ("true", "quality = 1", None),
    "toxic_en": ("lang = 'en'", "toxic = 1", None),
    "clean_long": ("n_chars >= 3000", "quality = 1 and toxic = 0", None),
    "paired": ("true", "quality = 1", "toxic = 1"),
    "paired_en": ("lang = 'en'", "quality = 1", "toxic = 1"),
}


def metric_specs():
    return [M.Metric(n, F.expr(o), F.expr(a), None if b is None else F.expr(b)) for n, (o, a, b) in METRICS.items()]


def _metric_sql(scopes: dict[str, str], keys: str = "") -> str:
    """Long table of scope, metric, n, selected_n, estimate."""
    parts = []
    for scope, where in scopes.items():
        for name, (o, a, b) in METRICS.items():
            estimate = f"avg(({a})::int)" if b is None else f"avg((({a})::int - ({b})::int)::double)"
            parts.append(f"select '{scope}' as scope, '{name}' as metric, count(*) as n, count(*) filter (where {a}) as selected_n, round({estimate}, 9) as estimate from units where ({where}) and ({o})")
    return "with {units} select * from (" + " union all ".join(parts) + ") where n > 0"


def _metric_table(scopes: dict[str, str]):
    def run(spark, sf):
        df = M.scoped(units(spark, sf), {k: F.expr(v) for k, v in scopes.items()})
        return M.estimated(M.counted(df, metric_specs(), ["scope"])).where("n > 0").select("scope", "metric", "n", "selected_n", r9(F.col("estimate")).alias("estimate"))

    return run




@query("agg_1", "with {units}, c as (select count(*)::double as n, count(*) filter (where quality = 1) as k, 1.959963984540054 as z from units), p as (select *, k / n as p from c) select 'quality' as metric, n::bigint as n, k as selected_n, round(p, 9) as estimate, round(greatest(0, ((p + z*z/(2*n)) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) as low, round(least(1, ((p + z*z/(2*n)) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) as high from p")
def agg_1(spark, sf):
    out = M.estimated(M.counted(units(spark, sf), [M.Metric("quality", F.lit(True), F.expr("quality = 1"))]))
    return out.select("metric", "n", "selected_n", *[r9(F.col(c)).alias(c) for c in ("estimate", "low", "high")])


query("agg_2", _metric_sql(ALL))(_metric_table(ALL))


@query("agg_3", "with {units}, v as (select 'lang' as field, lang as value from units union all select 'band', band from units union all select 'source', source from units) select field, value, count(*) as n, round(count(*) / sum(count(*)) over (partition by field), 9) as share from v group by field, value")
def agg_3(spark, sf):
    v = units(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("lang", "band", "source")])))
    return v.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("share", r9(F.col("n") / F.sum("n").over(Window.partitionBy("field"))))


SENSITIVITY = {"main": "true", "english": "lang = 'en'", "first_round": "round = 1", "no_src0": "source <> 'src0'", "long": "band = 'long'"}
QUALITY = {"all": "true", "clean": "toxic = 0", "flagged": "toxic = 1", "not_short": "band <> 'short'"}
query("agg_4", _metric_sql(SENSITIVITY))(_metric_table(SENSITIVITY))


def _loo(group: str) -> str:
    return f"select '{group}' as dimension, g.{group} as left_out, count(*) as n, count(*) filter (where u.quality = 1) as selected_n from (select distinct {group} from units) g join units u on u.{group} <> g.{group} group by all"


@query("agg_5", "with {units} " + _loo("source") + " union all " + _loo("band"))
def agg_5(spark, sf):
    u = units(spark, sf)
    specs = [M.Metric("quality", F.lit(True), F.expr("quality = 1"))]
    out = M.leave_one_out(u, specs, "source").unionByName(M.leave_one_out(u, specs, "band"))
    return out.select("dimension", "left_out", "n", (F.col("first_only") + F.col("both_n")).alias("selected_n"))


@query("agg_6", "with {units}, v as (" + _loo("source") + "), e as (select dimension, n, selected_n / n as e from v) select dimension, count(*) as variants, min(n) as least_n, max(n) as greatest_n, round(min(e), 9) as least, round(max(e), 9) as greatest, count(*) filter (where e <= 0.5) as failures from e group by dimension")
def agg_6(spark, sf):
    specs = [M.Metric("quality", F.lit(True), F.expr("quality = 1"))]
    out = M.ranges(M.estimated(M.leave_one_out(units(spark, sf), specs, "source")), ["dimension"])
    return out.select("dimension", "variants", "least_n", "greatest_n", r9(F.col("least")).alias("least"), r9(F.col("greatest")).alias("greatest"), "failures")


def _scope_sizes(key, scopes):
    sql = "with {units} select * from (" + " union all ".join(f"select '{s}' as scope, count(*) as n from units where {w}" for s, w in scopes.items()) + ") where n > 0"
    query(key, sql)(lambda spark, sf: M.scoped(units(spark, sf), {k: F.expr(v) for k, v in scopes.items()}).groupBy("scope").agg(F.count(F.lit(1)).alias("n")))


_scope_sizes("agg_7", SENSITIVITY)
_scope_sizes("agg_8", QUALITY)

BOUNDARIES = {"narrow": "^The ", "wide": "^(The|It|Is|En) "}


@query("agg_9", "with {records} select * from (" + " union all ".join(f"select '{b}' as boundary, regexp_matches(title, '{p}') as inside, count(*) as n from records group by all" for b, p in BOUNDARIES.items()) + ")")
def agg_9(spark, sf):
    t = F.col("title")
    marks = F.array(*[F.struct(F.lit(b).alias("boundary"), t.rlike(p).alias("inside")) for b, p in BOUNDARIES.items()])
    return records(spark, sf).select(F.inline(marks)).groupBy("boundary", "inside").agg(F.count(F.lit(1)).alias("n"))


@query("agg_10", "with {events}, t as (select event_type as origin, lead(event_type) over (partition by user_id order by event_id) as destination from log) select origin, destination, count(*) as n, round(count(*) / sum(count(*)) over (partition by origin), 9) as share from t where destination is not null group by origin, destination")
def agg_10(spark, sf):
    t = events(spark, sf).select(F.col("event_type").alias("origin"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("destination")).where("destination is not null")
    return t.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n")).withColumn("share", r9(F.col("n") / F.sum("n").over(Window.partitionBy("origin"))))


@query("agg_11", "with {records} select coalesce(source, 'all') as source, count(*) as n, count(distinct text) as texts, min(n_chars) as least, max(n_chars) as greatest, quantile_disc(n_chars, 0.5) as median, quantile_disc(n_chars, 0.9) as p90 from records group by grouping sets ((), (source))")
def agg_11(spark, sf):
    records(spark, sf).select("source", "n_chars", sha256(F.col("text")).alias("h")).createOrReplaceTempView("corpusloom_profile")
    return spark.sql("select coalesce(source, 'all') as source, count(*) as n, count(distinct h) as texts, min(n_chars) as least, max(n_chars) as greatest, percentile_disc(0.5) within group (order by n_chars) as median, percentile_disc(0.9) within group (order by n_chars) as p90 from corpusloom_profile group by grouping sets ((), (source))")


@query("agg_12", r"select content, count(*) as n, min(doc_id) as example from (select doc_id, unnest(regexp_extract_all(text, '\(([^()]*)\)', 1)) as content from documents) where trim(content) <> '' group by content")
def agg_12(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(U.bracket_spans(("()",))(F.col("text"))).alias("s"))
    return s.groupBy(F.col("s.content").alias("content")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example"))


def _sets(key, dims):
    cols = ", ".join(dims)
    sets = ", ".join(["()", *[f"({d})" for d in dims]])
    names = " || ".join(f"coalesce('{d}=' || {d}, '')" for d in dims)
    body = f"select {names} as scope, count(*) as n, sum(quality) as quality, sum(toxic) as toxic, round(avg(quality), 9) as rate from {{0}} group by grouping sets ({sets})"

    def run(spark, sf):
        units(spark, sf).createOrReplaceTempView("corpusloom_units")
        return spark.sql(body.format("corpusloom_units").replace("sum(quality)", "cast(sum(quality) as bigint)").replace("sum(toxic)", "cast(sum(toxic) as bigint)"))

    query(key, "with {units} " + body.format("units").replace("sum(quality)", "sum(quality)::bigint").replace("sum(toxic)", "sum(toxic)::bigint"))(run)


_sets("agg_13", ["lang", "source", "band", "round"])
_sets("agg_37", ["round", "band"])


@query("agg_14", "with {units}, v as (select round, 'quality' as field, quality = 0 as sentinel from units union all select round, 'toxic', toxic = 0 from units) select round, field, count(*) as n, count(*) filter (where sentinel) as sentinel_n from v group by round, field")
def agg_14(spark, sf):
    v = units(spark, sf).select("round", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) == 0).alias("sentinel")) for f in ("quality", "toxic")])))
    return v.groupBy("round", "field").agg(F.count(F.lit(1)).alias("n"), F.count_if("sentinel").alias("sentinel_n"))


@query("agg_15", "select split_part(a, ':', 1) as action, count(*) as n, count(distinct event_id) as records from (select event_id, unnest([event_type || ':a', 'seen:' || user_id]) as a from events) group by 1")
def agg_15(spark, sf):
    a = table(spark, sf, "events").select("event_id", F.explode(F.array(F.concat("event_type", F.lit(":a")), F.concat(F.lit("seen:"), F.col("user_id").cast("string")))).alias("a"))
    return a.groupBy(F.split("a", ":")[0].alias("action")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("records"))


def _paired(key, scopes, comparisons):
    """Cells of paired booleans for each scope and comparison."""
    cell = "count(*) filter (where ({a}) and not ({b})) as first_only, count(*) filter (where not ({a}) and ({b})) as second_only, count(*) filter (where ({a}) and ({b})) as both_n, count(*) filter (where not ({a}) and not ({b})) as neither, round(avg((({a})::int - ({b})::int)::double), 9) as difference"
    sql = "with {units} select * from (" + " union all ".join(f"select '{s}' as scope, '{c}' as comparison, {cell.format(a=a, b=b)} from units where {w}" for s, w in scopes.items() for c, (a, b) in comparisons.items()) + ") where difference is not null"

    def run(spark, sf):
        specs = [M.Metric(c, F.lit(True), F.expr(a), F.expr(b)) for c, (a, b) in comparisons.items()]
        out = M.estimated(M.counted(M.scoped(units(spark, sf), {k: F.expr(v) for k, v in scopes.items()}), specs, ["scope"]))
        return out.select("scope", F.col("metric").alias("comparison"), "first_only", "second_only", "both_n", "neither", r9(F.col("estimate")).alias("difference"))

    query(key, sql)(run)


def _contrast(key, scopes, groups, outcomes, tested=False):
    """Two groups in each scope: counts, risk difference; tested adds the odds ratio and Fisher's p (no oracle)."""
    parts = [f"select '{s}' as scope, '{g}' as contrast, '{o}' as outcome, count(*) filter (where ({a}) and ({y})) as a, count(*) filter (where ({a})) as n1, count(*) filter (where ({b}) and ({y})) as b, count(*) filter (where ({b})) as n2 from units where {w}" for s, w in scopes.items() for g, (a, b) in groups.items() for o, y in outcomes.items()]
    sql = "with {units} select *, case when n1 > 0 and n2 > 0 then round(a / n1 - b / n2, 9) end as difference from (" + " union all ".join(parts) + ") where n1 + n2 > 0"

    def run(spark, sf):
        df = M.scoped(units(spark, sf), {k: F.expr(v) for k, v in scopes.items()})
        sums, rows = [], []
        for i, (g, (a, b)) in enumerate(groups.items()):
            for j, (o, y) in enumerate(outcomes.items()):
                names = [f"c{i}_{j}_{x}" for x in ("a", "n1", "b", "n2")]
                conditions = [f"({a}) and ({y})", f"({a})", f"({b}) and ({y})", f"({b})"]
                sums += [F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in zip(names, conditions, strict=True)]
                rows.append(F.struct(F.lit(g).alias("contrast"), F.lit(o).alias("outcome"), *[F.col(n).alias(x) for n, x in zip(names, ("a", "n1", "b", "n2"), strict=True)]))
        out = df.groupBy("scope").agg(*sums).select("scope", F.inline(F.array(*rows))).where("n1 + n2 > 0")
        out = out.withColumn("difference", F.when((F.col("n1") > 0) & (F.col("n2") > 0), r9(F.col("a") / F.when(F.col("n1") > 0, F.col("n1")) - F.col("b") / F.when(F.col("n2") > 0, F.col("n2")))))
        if tested:
            out = S.bh_adjusted(out.withColumn("odds_ratio", S.odds_ratio(*[F.col(c) for c in ("a", "n1", "b", "n2")])).withColumn("p", U.fisher("a", "n1", "b", "n2")).withColumn("order", F.concat_ws("|", "scope", "contrast", "outcome")), "p", "outcome", "order").drop("order")
        return out

    query(key, None if tested else sql)(run)


CUES = {"english": ("lang = 'en'", "lang <> 'en'"), "src0": ("source = 'src0'", "source <> 'src0'")}
LANGS = {f"{l}_vs_en": (f"lang = '{l}'", "lang = 'en'") for l in ("de", "fr", "es")}
TOXIC, BOTH = {"toxic": "toxic = 1"}, {"toxic": "toxic = 1", "quality": "quality = 1"}
WITHOUT = {"main": "true"} | {f"no_src{i}": f"source <> 'src{i}'" for i in range(4)} | {f"no_{b}": f"band <> '{b}'" for b in LENGTHS}
PAIR = {"quality_toxic": ("quality = 1", "toxic = 1"), "quality_long": ("quality = 1", "band = 'long'")}
STAGES = {"one_two": ("quality = 1", "toxic = 0"), "two_three": ("toxic = 0", "n_chars > 500"), "one_three": ("quality = 1", "n_chars > 500")}
BY_LENGTH = ALL | LENGTHS
BY_TRACK_LENGTH = {f"{t}_{b}": f"{w} and band = '{b}'" for t, w in TRACKS.items() for b in LENGTHS} | TRACKS

_contrast("agg_16", TRACKS, LANGS, TOXIC)
_paired("agg_17", TRACKS, STAGES)
_contrast("agg_18", {f"{t}_{n}": f"{w} and {v}" for t, w in TRACKS.items() for n, v in WITHOUT.items()}, {"english": CUES["english"]}, TOXIC)
_paired("agg_19", {f"{t}_{n}": f"{w} and {v}" for t, w in TRACKS.items() for n, v in WITHOUT.items()}, {"one_two": STAGES["one_two"]})
_contrast("agg_20", BY_LENGTH | {"english": "lang = 'en'"}, {"quality": ("quality = 1", "quality = 0")}, {"toxic": "toxic = 1", "long": "n_chars > 3000", "src0": "source = 'src0'"})
_contrast("agg_21", TRACKS, LANGS, BOTH)
_contrast("agg_22", TRACKS, CUES, BOTH, tested=True)
_contrast("agg_23", WITHOUT | {"clean": "quality = 1"}, {"english": CUES["english"]}, TOXIC)
_contrast("agg_24", {f"s_{b}": f"band = '{b}'" for b in LENGTHS}, {"english": CUES["english"]}, BOTH, tested=True)
_paired("agg_25", {f"s_{b}": f"band = '{b}'" for b in LENGTHS}, PAIR)
_paired("agg_26", {f"{t}_{q}": f"{w} and {v}" for t, w in TRACKS.items() for q, v in QUALITY.items()}, PAIR)
_contrast("agg_27", ALL, {"version": ("round = 1", "round = 2")}, BOTH | {"long": "n_chars > 3000"})
query("agg_28", _metric_sql(TRACKS | BY_LENGTH))(_metric_table(TRACKS | BY_LENGTH))
_paired("agg_29", TRACKS | ALL, STAGES)
_contrast("agg_30", BY_TRACK_LENGTH, {"quality": ("quality = 1", "quality = 0")}, TOXIC)
_contrast("agg_31", TRACKS, {"toxic": ("toxic = 1", "toxic = 0")}, {"quality": "quality = 1", "long": "n_chars > 3000", "english": "lang = 'en'", "src0": "source = 'src0'"})
_contrast("agg_32", SENSITIVITY, {"toxic": ("toxic = 1", "toxic = 0")}, {"composite": "quality = 1 and n_chars > 500"})
_contrast("agg_33", TRACKS, {"toxic": ("toxic = 1", "toxic = 0")}, {f"p{i}": p for i, p in enumerate(("quality = 1", "lang = 'en'", "lang = 'de'", "band = 'short'", "band = 'medium'", "band = 'long'", "source = 'src0'"))})
_contrast("agg_34", TRACKS, {"quality": ("quality = 1", "quality = 0")}, TOXIC)
_contrast("agg_35", BY_LENGTH, {"english": CUES["english"]}, TOXIC, tested=True)
_contrast("agg_36", WITHOUT | SENSITIVITY, CUES, BOTH)
_contrast("agg_38", TRACKS | ALL, {"toxic": ("toxic = 1", "toxic = 0")}, {"quality": "quality = 1", "long": "n_chars > 3000"}, tested=True)
_paired("agg_39", TRACKS | ALL, PAIR)


@query("agg_40", "with {units}, g as (select round, band as value, count(*) as n from units where toxic = 1 group by all) select r.round, coalesce(value, 'none') as value, coalesce(n, 0) as n from (select distinct round from units) r left join g on g.round = r.round")
def agg_40(spark, sf):
    u = units(spark, sf)
    g = u.where("toxic = 1").groupBy("round", F.col("band").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return u.select("round").distinct().join(g, "round", "left").select("round", F.coalesce("value", F.lit("none")).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_41", "with {units}, w as (select *, 1.0 + doc_id % 3 as w from units) select round(sum(w * toxic) / sum(w), 9) as estimate, round(sum(w) * sum(w) / sum(w * w), 6) as effective_n, round(sum(w * (toxic = 1 and quality = 1)::int) / sum(w), 9) as low, round(sum(w * ((toxic = 1 and quality = 1)::int + (quality = 0)::int)) / sum(w), 9) as high from w".replace("1.0 + doc_id % 3", "(1 + doc_id % 3)::double"))
def agg_41(spark, sf):
    from corpusloom.operators.design import unresolved_bounds, weighted_ratio

    u = units(spark, sf).withColumn("w", (1 + F.col("doc_id") % 3).cast("double"))
    e = weighted_ratio(u, F.expr("toxic = 1"), "w").select(r9(F.col("estimate")).alias("estimate"), F.round("effective_n", 6).alias("effective_n"))
    b = unresolved_bounds(u, F.expr("toxic = 1"), F.expr("quality = 1"), "w").select(r9(F.col("low")).alias("low"), r9(F.col("high")).alias("high"))
    return e.crossJoin(F.broadcast(b))


_contrast("agg_42", {f"{t}_{n}": f"{w} and {v}" for t, w in (TRACKS | ALL).items() for n, v in WITHOUT.items()}, {"toxic": ("toxic = 1", "toxic = 0")}, {"quality": "quality = 1"})


@query("agg_45", "with {records} select lang, source, count(*) as n from records group by grouping sets ((lang), (lang, source))")
def agg_45(spark, sf):
    records(spark, sf).select("lang", "source").createOrReplaceTempView("corpusloom_design")
    return spark.sql("select lang, source, count(*) as n from corpusloom_design group by grouping sets ((lang), (lang, source))")


@query("agg_46", "with {units} select round, count(*) as n, count(*) filter (where quality = 1) as valid, count(*) >= 10 as enough, avg(quality) >= 0.5 as gate from units group by round")
def agg_46(spark, sf):
    return units(spark, sf).groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("valid"), (F.count(F.lit(1)) >= 10).alias("enough"), (F.avg("quality") >= 0.5).alias("gate"))


STATUS = ("click", "view", "purchase", "error")


def _pivot(spark, sf, keys):
    return table(spark, sf, "events").groupBy(*keys).agg(*[F.count_if(F.col("event_type") == s).alias(s) for s in STATUS])


_status = ", ".join(f"count(*) filter (where event_type = '{s}') as \"{s}\"" for s in STATUS)
query("agg_47", f"select {_status} from events")(lambda spark, sf: _pivot(spark, sf, []))
query("agg_48", f"select user_id, {_status} from events group by user_id")(lambda spark, sf: _pivot(spark, sf, ["user_id"]))

_plain = {
    "agg_49": ("with {records} select count(*) as n, count(distinct source) as sources from records", lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))),
    "agg_50": ("with {records} select source, count(*) as n from records where source in ('src0', 'src1') group by source", lambda d: d.where("source in ('src0', 'src1')").groupBy("source").agg(F.count(F.lit(1)).alias("n"))),
    "agg_51": ("with {records} select round, band, count(*) as n from records group by round, band", lambda d: d.groupBy("round", "band").agg(F.count(F.lit(1)).alias("n"))),
    "agg_54": (r"with {records}, t as (select doc_id, unnest(list_filter(string_split(title, ' '), lambda x: x <> '')) as w from records) select count(*) as tokens, count(distinct w) as types, round(avg(length(w)), 9) as mean_length, round(avg((length(w) = 1)::int), 9) as single from t", lambda d: d.select(F.explode(F.filter(F.split("title", " "), lambda x: x != "")).alias("w")).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("w").alias("types"), r9(F.avg(F.char_length("w"))).alias("mean_length"), r9(F.avg((F.char_length("w") == 1).cast("int"))).alias("single"))),
    "agg_55": ("select source, count(*) as docs, sum(len(string_split(text, ' ')))::bigint as tokens from documents group by source", lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(F.split("text", " "))).alias("tokens"))),
    "agg_56": (r"select lang, sum(len(string_split(regexp_replace(text, '[0-9]+', '#', 'g'), ' ')))::bigint as tokens from documents group by lang", lambda d: d.groupBy("lang").agg(F.sum(F.size(F.split(F.regexp_replace("text", "[0-9]+", "#"), " "))).alias("tokens"))),
}
for _key, (_sql, _f) in _plain.items():
    query(_key, _sql)(lambda spark, sf, f=_f: f(records(spark, sf)))


def _review(spark, sf, keys):
    l = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").otherwise("done").alias("s"))
    return records(spark, sf).select("doc_id", *keys).join(l, "doc_id", "left").groupBy(*keys, F.coalesce("s", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_rev = "with {records} select {k} coalesce(case when toxic = 1 then 'flagged' when toxic is not null then 'done' end, 'pending') as status, count(*) as n from records left join labels using (doc_id) group by all"
query("agg_52", _rev.replace("{k}", ""))(lambda spark, sf: _review(spark, sf, []))
query("agg_53", _rev.replace("{k}", "round,"))(lambda spark, sf: _review(spark, sf, ["round"]))


@query("agg_57", "with {records} select count(*) as n, count(*) filter (where contains(text, '@')) as changed, count(*) filter (where contains(text, '@') and toxic = 1) as depends from records left join labels using (doc_id)")
def agg_57(spark, sf):
    at = F.contains("text", F.lit("@"))
    return records(spark, sf).select("doc_id", at.alias("at")).join(table(spark, sf, "labels"), "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if("at").alias("changed"), F.count_if(F.col("at") & F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("depends"))


@query("agg_58", "with {units} select lang as row_label, printf('%d', count(*)) as n, printf('%.2f', round(avg(quality), 6) * 100) as pct from units group by lang")
def agg_58(spark, sf):
    from corpusloom.functions.text import fixed

    return units(spark, sf).groupBy(F.col("lang").alias("row_label")).agg(F.count(F.lit(1)).cast("string").alias("n"), fixed(F.round(F.avg("quality"), 6) * 100, 2).alias("pct"))


@query("agg_59", "with {records}, g as (select count(*) as n, count(distinct text) as texts from records), p as (select sum(n)::bigint as n from (select count(*) as n from records group by source)) select g.n = p.n as sources_add_up, g.n - g.texts as removed, g.texts as kept from g, p")
def agg_59(spark, sf):
    d = records(spark, sf).select("source", sha256(F.col("text")).alias("h"))
    by = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    parts = d.groupBy("source").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("m"))
    return total.crossJoin(F.broadcast(parts)).select((F.col("n") == F.col("m")).alias("sources_add_up"), (F.col("n") - F.col("texts")).alias("removed"), F.col("texts").alias("kept"))
