"""Queries of estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import udfs as U
from corpusloom.operators import agreement as A
from corpusloom.operators import design as DS
from corpusloom.operators import models as FM
from corpusloom.plans.base import events, query, r9, units

BY_SOURCE = "with {units}, c as (select source, count(*)::double as n, count(*) filter (where toxic = 1)::double as k, 1.959963984540054 as z from units group by source), p as (select *, k / n as p from c) "


def _by_source(spark, sf):
    return units(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))


@query("sta_1", BY_SOURCE + "select source, round(p, 9) as p from p")
def sta_1(spark, sf):
    return _by_source(spark, sf).select("source", r9(S.proportion(F.col("k"), F.col("n"))).alias("p"))


def _wilson(key, clamp):
    low = "((p + z*z/(2*n)) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)"
    high = low.replace(") - z*", ") + z*")
    sql = f"select source, round(greatest(0, {low}), 9) as low, round(least(1, {high}), 9) as high from p" if clamp else f"select source, round({low}, 9) as low, round({high}, 9) as high from p"

    def run(spark, sf):
        low, high = S.wilson(F.col("k"), F.col("n"), clamp)
        # values at 0 come out as -0.0 or 1e-17 by the order of operations
        return _by_source(spark, sf).select("source", (r9(low) + 0.0).alias("low"), r9(high).alias("high"))

    query(key, BY_SOURCE + sql.replace("round(greatest", "0.0 + round(greatest").replace("source, round((", "source, 0.0 + round(("))(run)


_wilson("sta_2", False)
_wilson("sta_3", True)
_wilson("sta_4", False)
query("sta_40", BY_SOURCE + "select source, k::bigint as k, n::bigint as n, round(p, 9) as p from p")(lambda spark, sf: _by_source(spark, sf).select("source", "k", "n", r9(S.ratio(F.col("k"), F.col("n"))).alias("p")))

CELLS = "with {units}, c as (select lang, count(*) filter (where quality = 1 and toxic = 0) as first_only, count(*) filter (where quality = 0 and toxic = 1) as second_only, count(*) filter (where quality = 1 and toxic = 1) as both_n, count(*) filter (where quality = 0 and toxic = 0) as neither from units group by lang), d as (select *, first_only + second_only + both_n + neither as n, (first_only - second_only)::double / (first_only + second_only + both_n + neither) as diff from c) "


def _cells(spark, sf):
    return units(spark, sf).groupBy("lang").agg(*S.cells(F.col("quality") == 1, F.col("toxic") == 1))


def _named():
    return S.paired(*[F.col(c) for c in ("first_only", "second_only", "both_n", "neither")])


@query("sta_5", CELLS + "select lang, n as eligible_n, first_only + both_n as first_n, second_only + both_n as second_n, round(diff, 9) as difference from d")
def sta_5(spark, sf):
    p = _named()
    return _cells(spark, sf).select("lang", p["eligible_n"].alias("eligible_n"), p["first_n"].alias("first_n"), p["second_n"].alias("second_n"), r9(p["difference"]).alias("difference"))


MCNEMAR = "round(least(1, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) from (select unnest(generate_series(0::bigint, least(b, c))) as i))), 6)"


@query("sta_6", CELLS + ", t as (select lang, n, diff, sqrt((first_only + second_only - n * diff * diff) / (n - 1) / n) as se, first_only as b, second_only as c from d) select lang, round(diff, 9) as difference, round(se, 9) as se, round(greatest(-1, diff - 1.959963984540054 * se), 9) as low, round(least(1, diff + 1.959963984540054 * se), 9) as high from t")
def sta_6(spark, sf):
    p = _named()
    return _cells(spark, sf).select("lang", *[r9(p[c]).alias(c) for c in ("difference", "se", "low", "high")])


@query("sta_7")
def sta_7(spark, sf):
    return _cells(spark, sf).withColumn("t", U.mcnemar("first_only", "second_only")).select("lang", "first_only", "second_only", F.round("t.p", 6).alias("p"), F.round("t.log10_p", 6).alias("log10_p"))


@query("sta_8", CELLS + "select lang, first_only, second_only, both_n, neither from d")
def sta_8(spark, sf):
    return _cells(spark, sf)


GROUPS = "with {units}, g as (select source, count(*) filter (where toxic = 1 and lang = 'en') as a, count(*) filter (where lang = 'en') as n1, count(*) filter (where toxic = 1 and lang <> 'en') as b, count(*) filter (where lang <> 'en') as n2 from units group by source) "


def _groups(spark, sf):
    en, t = F.col("lang") == "en", F.col("toxic") == 1
    return units(spark, sf).groupBy("source").agg(F.count_if(t & en).alias("a"), F.count_if(en).alias("n1"), F.count_if(t & ~en).alias("b"), F.count_if(~en).alias("n2"))


@query("sta_9", GROUPS + "select source, round(a / nullif(n1, 0) - b / nullif(n2, 0), 9) as difference, case when (n1 - a) * b <> 0 then round((a * (n2 - b))::double / ((n1 - a) * b), 9) end as odds_ratio from g where n1 > 0 and n2 > 0")
def sta_9(spark, sf):
    odds = S.odds_ratio(*[F.col(c) for c in ("a", "n1", "b", "n2")])
    return _groups(spark, sf).where("n1 > 0 and n2 > 0").select("source", r9(F.col("a") / F.col("n1") - F.col("b") / F.col("n2")).alias("difference"), F.when((F.col("n1") - F.col("a")) * F.col("b") != 0, r9(odds)).alias("odds_ratio"))


FISHER = "h as (select source, a, n1, b, n2, unnest(generate_series(greatest(0, a + b - n2), least(a + b, n1))) as x from g where n1 > 0 and n2 > 0), l as (select *, lgamma(n1 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) + lgamma(n2 + 1) - lgamma(a + b - x + 1) - lgamma(n2 - a - b + x + 1) - lgamma(n1 + n2 + 1) + lgamma(a + b + 1) + lgamma(n1 + n2 - a - b + 1) as lp from h), o as (select source, max(lp) filter (where x = a) as own from l group by source) "


def _fisher(key, columns):
    query(key, GROUPS + ", " + FISHER + f"select l.source, {columns}round(least(1, sum(exp(lp)) filter (where lp <= own + 1e-7)), 6) as p from l join o using (source) group by all")(lambda spark, sf: _groups(spark, sf).where("n1 > 0 and n2 > 0").select("source", *[c for c in ("a", "n1") if c in columns], F.round(U.fisher("a", "n1", "b", "n2"), 6).alias("p")))


_fisher("sta_10", "a, n1, ")
_fisher("sta_11", "")


@query("sta_12", "with {events}, p as (select event_type as family, k, min(event_id) as id, (k + 1) / 1000.0 as p from log group by all), r as (select *, row_number() over (partition by family order by p, id) as i, count(*) over (partition by family) as m from p) select family, k, round(least(1, min(p * m / i) over (partition by family order by i desc rows unbounded preceding)), 9) as q from r".replace("(k + 1) / 1000.0", "(k + 1)::double / 1000"))
def sta_12(spark, sf):
    p = events(spark, sf).groupBy(F.col("event_type").alias("family"), "k").agg(F.min("event_id").alias("id")).withColumn("p", (F.col("k") + 1) / 1000.0)
    return S.bh_adjusted(p, "p", "family", "id").select("family", "k", r9(F.col("q")).alias("q"))


KAPPA = "with {units}, c as (select {k}quality as a, toxic as b, count(*) as n from units group by all), t as (select {k}sum(n) as n, sum(n) filter (where a = b) as agree from c group by all), l as (select {k}a as label, sum(n) as l from c group by all), r as (select {k}b as label, sum(n) as r from c group by all), e as (select {k}sum(l * r) as chance from l join r using ({k}label) group by all) select {k}t.n::bigint as records, coalesce(agree, 0)::bigint as exact_agreement_n, round((coalesce(agree, 0) / t.n - chance / (t.n * t.n)) / nullif(1 - chance / (t.n * t.n), 0), 9) as kappa from t {join}"


@query("sta_13", KAPPA.replace("{k}", "").replace("{join}", ", e").replace("t.n * t.n", "t.n::double * t.n::double"))
def sta_13(spark, sf):
    return A.summary(units(spark, sf), "quality", "toxic").select("records", "exact_agreement_n", r9(F.col("kappa")).alias("kappa"))


@query("sta_14", KAPPA.replace("using ({k}label)", "using (lang, label)").replace("{k}", "lang, ").replace("{join}", "left join e using (lang)").replace("chance /", "coalesce(chance, 0) /").replace("t.n * t.n", "t.n::double * t.n::double"))
def sta_14(spark, sf):
    return A.summary(units(spark, sf), "quality", "toxic", ["lang"], "null").select("lang", "records", "exact_agreement_n", r9(F.col("kappa")).alias("kappa"))


@query("sta_15", "with {units}, l as (select quality as v from units union select toxic from units) select x.v as first_value, y.v as second_value, count(u.doc_id) as n from l x cross join l y left join units u on u.quality = x.v and u.toxic = y.v group by all")
def sta_15(spark, sf):
    return A.confusion(units(spark, sf), "quality", "toxic")


@query("sta_16", "with {units} select count(*) as records, count(*) filter (where quality = toxic) as exact_agreement_n, round(avg((quality = toxic)::int), 9) as rate from units")
def sta_16(spark, sf):
    return A.summary(units(spark, sf), "quality", "toxic").select("records", "exact_agreement_n", r9(F.col("exact_agreement_rate")).alias("rate"))


@query("sta_17", "with {units}, v as (select 'a_b' as pair, lang as field, (quality = toxic)::int as same, (1 + doc_id % 3)::double as w from units union all select 'a_c', lang, (quality = doc_id % 2)::int, (1 + doc_id % 3)::double from units) select pair, field, count(*) as records, round(avg(same), 9) as rate, round(sum(w * same) / sum(w), 9) as weighted from v group by all")
def sta_17(spark, sf):
    u = units(spark, sf)
    w = (1 + F.col("doc_id") % 3).cast("double").alias("w")
    v = u.select("lang", w, F.inline(F.array(F.struct(F.lit("a_b").alias("pair"), (F.col("quality") == F.col("toxic")).cast("int").alias("same")), F.struct(F.lit("a_c").alias("pair"), (F.col("quality") == F.col("doc_id") % 2).cast("int").alias("same")))))
    return v.groupBy("pair", F.col("lang").alias("field")).agg(F.count(F.lit(1)).alias("records"), r9(F.avg("same")).alias("rate"), r9(F.sum(F.col("w") * F.col("same")) / F.sum("w")).alias("weighted"))


STRATA = "with {units}, s as (select band as stratum, count(*) as n, 2 * count(*) as population from units group by band), u as (select band as stratum, ({d})::int::double as d, ({y})::int::double * ({d})::int as y from units), w as (select u.*, population / n as w, population, n from u join s using (stratum)), t as (select sum(w * d) as td, sum(w * y) / sum(w * d) as e from w), v as (select stratum, population, n, var_samp(y - e * d) as s2 from w, t group by all) select round(any_value(e), 9) as estimate, round(sqrt(sum(population * population * (1 - n / population) * coalesce(s2, 0) / n)) / any_value(td), 9) as se from v, t"


def _strata(spark, sf, d, y):
    u = units(spark, sf).withColumn("stratum", F.col("band"))
    s = u.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), (2 * F.count(F.lit(1))).alias("population"))
    return DS.stratified_ratio(u, s, F.expr(d), F.expr(y))


def _ratio_query(key, d, y):
    query(key, STRATA.replace("{d}", d).replace("{y}", y))(lambda spark, sf: _strata(spark, sf, d, y).select(r9(F.col("estimate")).alias("estimate"), r9(F.col("se")).alias("se")))


_ratio_query("sta_18", "lang = 'en'", "quality = 1")


def _many(key, cases):
    sql = " union all ".join("select '" + n + "' as measure, * from (" + STRATA.replace("with {units}, ", "with ").replace("{d}", d).replace("{y}", y) + ")" for n, (d, y) in cases.items())

    def run(spark, sf):
        out = None
        for n, (d, y) in cases.items():
            one = _strata(spark, sf, d, y).select(F.lit(n).alias("measure"), r9(F.col("estimate")).alias("estimate"), r9(F.col("se")).alias("se"))
            out = one if out is None else out.unionByName(one)
        return out

    query(key, "with {units} " + sql)(run)


_many("sta_19", {"target": ("lang = 'en'", "quality = 1"), "actor": ("lang = 'en'", "toxic = 1"), "both": ("lang = 'en'", "quality = 1 and toxic = 1")})
_many("sta_20", {"agree_all": ("true", "quality = toxic"), "agree_en": ("lang = 'en'", "quality = toxic")})
query("sta_21", "with {units} select doc_id, lang = 'en' as fixed, lang = 'en' and quality = 1 as common from units")(lambda spark, sf: units(spark, sf).select("doc_id", F.expr("lang = 'en'").alias("fixed"), F.expr("lang = 'en' and quality = 1").alias("common")))
query("sta_22", "with {units}, s as (select band, count(*) as n, 2 * count(*) as population from units group by band) select band as stratum, n, population, population / n as weight, sum(population) over ()::bigint as frame from s")(lambda spark, sf: units(spark, sf).groupBy(F.col("band").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), (2 * F.count(F.lit(1))).alias("population")).withColumn("weight", F.col("population") / F.col("n")).withColumn("frame", F.sum("population").over(Window.partitionBy())))

WEIGHTED = "with {units}, w as (select *, (1 + doc_id % 3)::double as w, round::double as factor from units) "


def _w(spark, sf):
    return units(spark, sf).withColumn("w", (1 + F.col("doc_id") % 3).cast("double"))


@query("sta_23", WEIGHTED + "select lang, round(sum(w * toxic) / sum(w), 9) as estimate, round(sum(w) * sum(w) / sum(w * w), 6) as effective_n from w group by lang")
def sta_23(spark, sf):
    return DS.weighted_ratio(_w(spark, sf), F.expr("toxic = 1"), "w", ["lang"]).select("lang", r9(F.col("estimate")).alias("estimate"), F.round("effective_n", 6).alias("effective_n"))


@query("sta_24", WEIGHTED.replace("with {units}", "with {units}") + "select lang, round(sum(w * factor * toxic) / sum(w * factor), 9) as estimate from w group by lang")
def sta_24(spark, sf):
    u = _w(spark, sf)
    factors = u.select("round").distinct().withColumn("factor", F.col("round").cast("double"))
    return DS.weighted_ratio(u.join(F.broadcast(factors), "round").withColumn("wf", F.col("w") * F.col("factor")), F.expr("toxic = 1"), "wf", ["lang"]).select("lang", r9(F.col("estimate")).alias("estimate"))


@query("sta_25", "with {units} select lang, band, round(count(*) / nullif(count(*) filter (where round = 1), 0), 9) as factor, count(*) filter (where round = 1) = 0 as empty_cell from units group by lang, band")
def sta_25(spark, sf):
    first = F.count_if(F.col("round") == 1)
    return units(spark, sf).groupBy("lang", "band").agg(r9(F.count(F.lit(1)) / F.nullif(first, F.lit(0))).alias("factor"), (first == 0).alias("empty_cell"))


@query("sta_26", WEIGHTED + "select 'record' as weight, round(sum(w * toxic) / sum(w), 9) as estimate from w union all select 'cluster', round(sum(factor * toxic) / sum(factor), 9) from w")
def sta_26(spark, sf):
    u = _w(spark, sf).withColumn("c", F.col("round").cast("double"))
    one = u.agg(r9(F.sum(F.col("w") * F.col("toxic")) / F.sum("w")).alias("a"), r9(F.sum(F.col("c") * F.col("toxic")) / F.sum("c")).alias("b"))
    return one.select(F.inline(F.array(F.struct(F.lit("record").alias("weight"), F.col("a").alias("estimate")), F.struct(F.lit("cluster").alias("weight"), F.col("b").alias("estimate")))))


@query("sta_27", WEIGHTED + "select round(sum(w * (toxic = 1 and quality = 1)::int) / sum(w), 9) as low, round(sum(w * ((toxic = 1 and quality = 1)::int + (quality = 0)::int)) / sum(w), 9) as high from w")
def sta_27(spark, sf):
    return DS.unresolved_bounds(_w(spark, sf), F.expr("toxic = 1"), F.expr("quality = 1"), "w").select(r9(F.col("low")).alias("low"), r9(F.col("high")).alias("high"))


@query("sta_28", WEIGHTED + "select source, round(sum(w) * sum(w) / sum(w * w), 6) as effective_n from w group by source")
def sta_28(spark, sf):
    return _w(spark, sf).groupBy("source").agg(F.round(S.kish("w"), 6).alias("effective_n"))


@query("sta_29", "with {units}, c as (select source, count(*) as n, count(*) filter (where toxic = 0) as m from units group by source) select source, case when m > 0 then round(m / n * 1.96 * 0.5 / sqrt(10.0) * sqrt(greatest(0, 1 - 10.0 / m)), 9) else 0.0 end as margin from c".replace("10.0", "10::double"))
def sta_29(spark, sf):
    c = units(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 0).alias("m"))
    return c.select("source", r9(S.worst_margin(F.col("n"), F.col("n") - F.col("m"), F.col("m"), F.lit(10.0))).alias("margin"))


query("sta_30", "with {units} select source, round(1 - pow(0.05, 1.0 / count(*)), 9) as upper from units group by source".replace("0.05", "(1 - 0.95::double)").replace("1.0 /", "1::double /"))(lambda spark, sf: units(spark, sf).groupBy("source").agg(r9(S.zero_upper(F.count(F.lit(1)))).alias("upper")))


@query("sta_31", "with {events} select event_type, quantile_disc(k, 0.95) as p95, quantile_disc(k, 0.5) as p50 from log group by event_type")
def sta_31(spark, sf):
    events(spark, sf).createOrReplaceTempView("corpusloom_events")
    return spark.sql("select event_type, percentile_disc(0.95) within group (order by k) as p95, percentile_disc(0.5) within group (order by k) as p50 from corpusloom_events group by event_type")


def _grouped_design(spark, sf, covariates=("lang", "band")):
    """Covariate patterns with counts: at most one row for each combination of the covariates and quality."""
    rows = units(spark, sf).groupBy(*covariates, "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y")).orderBy(*covariates, "quality").collect()
    levels = {c: sorted({r[c] for r in rows}) for c in covariates}
    x = np.column_stack([np.ones(len(rows)), [r["quality"] for r in rows], *(FM.dummies([r[c] for r in rows], levels[c]) for c in covariates)])
    return x, np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float), ["intercept", "quality", *(v for c in covariates for v in levels[c][1:])]


def _fit_rows(spark, names, fit, more=None):
    return spark.createDataFrame([(n, round(float(b), 6), fit.method, *(more or ())) for n, b in zip(names, fit.beta, strict=True)], "term string, coefficient double, method string" + (", low double, high double, p double" if more else ""))


@query("sta_32")
def sta_32(spark, sf):
    x, y, n, _ = _grouped_design(spark, sf)
    return spark.createDataFrame([(round(FM.Grouped(x, y, n).at(np.zeros(x.shape[1]))[0], 6),)], "value double")


@query("sta_33")
def sta_33(spark, sf):
    x, y, n, names = _grouped_design(spark, sf)
    return _fit_rows(spark, names, FM.newton(FM.Grouped(x, y, n)))


@query("sta_34")
def sta_34(spark, sf):
    """The quasi-Newton steps that take over where Newton's fail."""
    x, y, n, names = _grouped_design(spark, sf)
    return _fit_rows(spark, names, FM.lbfgs(FM.Grouped(x, y, n)))


@query("sta_35")
def sta_35(spark, sf):
    x, y, n, names = _grouped_design(spark, sf)
    fit = FM.firth(x, y, n)
    return _fit_rows(spark, names, fit, [round(v, 6) for v in FM.profile_interval(x, y, fit, 1, n)])


@query("sta_38")
def sta_38(spark, sf):
    """Controlled probabilities for several sets of covariates."""
    out = []
    for covariates in ((), ("lang",), ("band",), ("lang", "band"), ("source", "band")):
        x, y, n, _ = _grouped_design(spark, sf, covariates)
        found = FM.controlled(x, y, n)
        out.append(("+".join(covariates) or "none", int(n.sum()), x.shape[1], *(round(v, 6) for v in found.values())))
    return spark.createDataFrame(out, "covariates string, analysis_n long, parameters_n long, untreated double, treated double, difference double, log_odds double")


@query("sta_36", "with {units} select doc_id, (lang = 'en')::int::double as lang_en, (lang = 'fr')::int::double as lang_fr, (band = 'medium')::int::double as medium from units")
def sta_36(spark, sf):
    return units(spark, sf).select("doc_id", *[F.expr(f"cast({c} as double)").alias(n) for c, n in (("lang = 'en'", "lang_en"), ("lang = 'fr'", "lang_fr"), ("band = 'medium'", "medium"))])


def _cmh(key):
    sql = "with {units}, g as (select source, count(*) filter (where toxic = 1 and quality = 1)::double as a, count(*) filter (where quality = 1)::double as n1, count(*) filter (where toxic = 1 and quality = 0)::double as b, count(*) filter (where quality = 0)::double as n2 from units group by source) select round(sum(a * (n2 - b) / (n1 + n2)) / nullif(sum(b * (n1 - a) / (n1 + n2)), 0), 9) as odds_ratio, round(pow(sum(a - n1 * (a + b) / (n1 + n2)), 2) / sum(n1 * n2 * (a + b) * (n1 + n2 - a - b) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))), 9) as chi2 from g where n1 > 0 and n2 > 0"

    @query(key, sql)
    def run(spark, sf):
        t, q = F.col("toxic") == 1, F.col("quality") == 1
        g = units(spark, sf).groupBy("source").agg(F.count_if(t & q).alias("a"), F.count_if(q).alias("n1"), F.count_if(t & ~q).alias("b"), F.count_if(~q).alias("n2"))
        return S.cmh(g, "source").select(r9(F.col("odds_ratio")).alias("odds_ratio"), r9(F.col("chi2")).alias("chi2"))


_cmh("sta_37")


#: Bootstrap replicates, as many as the reference draws.
REPLICATES = 999


def _bootstrapped(spark, x, y, n):
    """Risk difference by g-computation, with bootstrap replicates as tasks over the grouped design. Rows are drawn within
    each treatment; replicates by the fallback and failures are counted."""

    def replicate(frames):
        import pandas as pd

        for frame in frames:
            values, fallbacks = [], []
            for i in frame["id"]:
                design, draw, drawn = FM.resampled(x, y, n, np.random.default_rng(20260815 + int(i)))
                try:
                    fit = FM.firth(design, draw, drawn)
                except FM.FitError:
                    fit = None
                values.append(FM.risk_difference(design, drawn, fit.beta) if fit else None)
                fallbacks.append(bool(fit and fit.method != "newton"))
            yield pd.DataFrame({"value": pd.array(values, "Float64"), "fallback": fallbacks})

    boots = spark.range(0, REPLICATES, 1, 4).mapInPandas(replicate, "value double, fallback boolean")
    ends = [F.round(F.percentile("value", F.lit(q)), 6).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))]
    estimate = FM.risk_difference(x, n, FM.firth(x, y, n).beta)
    return boots.agg(*ends, F.count("value").alias("successful"), F.count_if(F.col("value").isNull()).alias("failures"), F.count_if("fallback").alias("fallbacks")).withColumn("estimate", F.lit(round(estimate, 6)))


@query("sta_37_model")
def sta_37_model(spark, sf):
    """Beside the common odds ratio of sta_37: the controlled risk difference by source and length, with its bootstrap."""
    x, y, n, _ = _grouped_design(spark, sf, ("source", "band"))
    fit = FM.firth(x, y, n)
    low, high, p = (round(v, 6) for v in FM.profile_interval(x, y, fit, 1, n))
    return _bootstrapped(spark, x, y, n).select("*", F.lit(round(float(fit.beta[1]), 6)).alias("log_odds"), F.lit(low).alias("profile_low"), F.lit(high).alias("profile_high"), F.lit(p).alias("profile_p"))


@query("sta_39")
def sta_39(spark, sf):
    x, y, n, _ = _grouped_design(spark, sf)
    return _bootstrapped(spark, x, y, n)
