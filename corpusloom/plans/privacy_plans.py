"""Queries of privacy detection and remediation, and of annotation contracts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusloom.functions import udfs as U
from corpusloom.functions.text import context, sha256
from corpusloom.operators import contracts as C
from corpusloom.operators import privacy as P
from corpusloom.plans.base import query, records, table, units

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query("prv_1")
def prv_1(spark, sf):
    return P.findings(records(spark, sf), "text", P.GATE, ["doc_id"]).select("doc_id", "category", "start", "end", sha256(F.col("matched")).alias("matched_sha256"))


@query("prv_2")
def prv_2(spark, sf):
    f = P.findings(records(spark, sf), "text", P.RESIDUAL, ["doc_id", "source", "text"])
    return f.select("doc_id", "source", F.col("category").alias("scan_type"), F.when(F.col("category") == "long_digit_sequence", "medium").otherwise("high").alias("priority"), "start", "end", sha256(context(F.col("text"), F.col("start"), F.col("end"))).alias("context_sha256"))


@query("prv_3")
def prv_3(spark, sf):
    f = P.findings(records(spark, sf), "text", P.STRUCTURED, ["doc_id"])
    return f.select("doc_id", "category", "start", "end", F.when(F.col("category").isin(*P.REVIEW_ONLY), "review_required").otherwise("direct_locator").alias("risk"))


HANDLES = {"explicit_at_handle": P.RESIDUAL["explicit_at_handle"]}


@query("prv_4")
def prv_4(spark, sf):
    return P.findings(records(spark, sf), "text", HANDLES, ["doc_id"]).select("doc_id", "start", "end", F.lit("strong").alias("confidence"))


def names_in(text: str) -> list[tuple[int, int, str]]:
    """A stand-in for a name model: two capitalised words in a row inside a sentence."""
    import re

    return [(m.start(1), m.end(1), m[1]) for m in re.finditer(r"[a-z,] ([A-Z][a-z]+ [A-Z][a-z]+)", text)]


@query("prv_5")
def prv_5(spark, sf):
    @F.pandas_udf("array<struct<start:int,end:int,matched:string>>")
    def run(s):
        return s.map(lambda t: [dict(zip(("start", "end", "matched"), x, strict=True)) for x in names_in(t or "")])

    return records(spark, sf).select("doc_id", F.explode(run("text")).alias("f")).select("doc_id", "f.start", "f.end", sha256(F.col("f.matched")).alias("matched_sha256"))


def _candidates(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("signal"), F.when(F.col("event_id") % 7 == 0, "strong").otherwise("weak").alias("confidence"))


@query("prv_6", "select user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') as signals, case when bool_or(event_id % 7 = 0) then 'strong' else 'review' end as confidence from events group by user_id")
def prv_6(spark, sf):
    return P.merged(_candidates(spark, sf), ["user_id"])


@query("prv_7")
def prv_7(spark, sf):
    layers = records(spark, sf).select("doc_id", F.inline(F.array(F.struct(F.lit("title").alias("layer"), F.col("title").alias("t")), F.struct(F.lit("text").alias("layer"), F.col("text").alias("t")))))
    return P.findings(layers, "t", P.RESIDUAL, ["doc_id", "layer"]).select("doc_id", "layer", "category", "start", "end")


def _masked(spark, sf):
    """Spans of one word in each text, and one that does not fit."""
    at = (F.instr("text", "the") - 1).cast("int")
    good = F.struct(at.alias("start"), (at + 3).alias("end"), F.lit("the").alias("expected"), F.lit("[T]").alias("replacement"))
    bad = F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("\u0000\u0000\u0000").alias("expected"), F.lit("x").alias("replacement"))
    return records(spark, sf).where("contains(text, 'the')").withColumn("good", F.array(good)).withColumn("mixed", F.array(good, bad))


MASKED = "select doc_id, sha256(substr(text, 1, instr(text, 'the') - 1) || '[T]' || substr(text, instr(text, 'the') + 3)) as h from documents where contains(text, 'the')"


@query("prv_8", MASKED)
def prv_8(spark, sf):
    return _masked(spark, sf).select("doc_id", sha256(U.apply_lenient_spans("text", "mixed")["text"]).alias("h"))


@query("prv_9", "select user_id, event_type, case when event_id % 7 = 0 then 'yes' else 'no' end as decision, event_id % 7 = 0 or event_type in (select event_type from events where event_id % 11 = 0 and user_id % 5 = 0) as authorized from events")
def prv_9(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    c = e.select("user_id", "event_type", F.when(F.col("event_id") % 7 == 0, "yes").otherwise("no").alias("decision"))
    d = e.where("event_id % 11 = 0 and user_id % 5 = 0").select("event_type", F.lit("yes").alias("decision"))
    return P.authorized(c, d, ["event_type"], P.is_accepted(F.col("decision"))).select("user_id", "event_type", "decision", "authorized")


@query("prv_10", MASKED)
def prv_10(spark, sf):
    return _masked(spark, sf).select("doc_id", sha256(U.apply_exact_spans("text", "good")).alias("h"))


@query("prv_11", "select doc_id, instr(text, 'the') - 1 as start, instr(text, 'the') + 2 as end from documents where contains(text, 'the')")
def prv_11(spark, sf):
    """Placeholders in masked texts: here one each."""
    at = F.instr("masked", "[T]") - 1
    return _masked(spark, sf).withColumn("masked", U.apply_exact_spans("text", "good")).select("doc_id", at.cast("long").alias("start"), (at + 3).cast("long").alias("end"))


@query("prv_12", "select event_id, sha256(user_id || '|' || event_type || '|' || event_id) as candidate_id from events")
def prv_12(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")), 256).alias("candidate_id"))


@query("prv_13", "select count(*) as n, count(distinct doc_id) as ids, count(distinct text) as texts from documents")
def prv_13(spark, sf):
    by = table(spark, sf, "documents").select("doc_id", sha256(F.col("text")).alias("h"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.countDistinct("h").alias("texts"))


@query("prv_14", "select (select count(*) from labels where doc_id not in (select doc_id from documents)) as unknown, (select count(*) from labels where quality not in (0, 1)) as invalid")
def prv_14(spark, sf):
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", F.lit(True).alias("known"))
    return l.join(d, "doc_id", "left").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(~F.col("quality").isin(0, 1)).alias("invalid"))


@query("prv_15", "select doc_id, instr(text, 'the') > 0 and length(text) >= 3 and not (instr(text, 'the') - 1 < 2) as ok from documents")
def prv_15(spark, sf):
    """Two submitted spans, [0, 2) and the first `the`: inside the text and not overlapping."""
    at = F.instr("text", "the") - 1
    spans = F.array_sort(F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(at.alias("start"), (at + 3).alias("end"))))
    inside = F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.char_length("text")))
    apart = spans[0]["end"] <= spans[1]["start"]
    return table(spark, sf, "documents").select("doc_id", (inside & apart & (F.char_length("text") >= 3)).alias("ok"))


@query("prv_16", "select count(*) as n, count(*) filter (where contains(text, 'the')) as edited, 0::bigint as labels_changed from documents join labels using (doc_id)")
def prv_16(spark, sf):
    before = units(spark, sf).select("doc_id", F.struct("quality", "toxic").alias("o"))
    after = units(spark, sf).select("doc_id", F.struct("quality", "toxic").alias("p"))
    edited = table(spark, sf, "documents").select("doc_id", F.contains("text", F.lit("the")).alias("e"))
    return before.join(after, "doc_id").join(edited, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("e").alias("edited"), F.count_if(~F.col("o").eqNullSafe(F.col("p"))).alias("labels_changed"))


@query("prv_17", "select source, bool_or(n_chars > 20000) as too_large from documents group by source")
def prv_17(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.bool_or(F.col("n_chars") > 20000).alias("too_large"))


@query("prv_18", "select * from (values ('text'), ('record_id')) t(forbidden)")
def prv_18(spark, sf):
    from corpusloom.sources.records import FORBIDDEN

    columns = [*table(spark, sf, "documents").columns, "record_id"]
    return spark.createDataFrame([(c,) for c in sorted(FORBIDDEN & set(columns))], "forbidden string")


@query("prv_19")
def prv_19(spark, sf):
    return P.findings(records(spark, sf), "text", P.SECRETS, ["doc_id"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("prv_20")
def prv_20(spark, sf):
    from corpusloom.sources.records import manifest

    return manifest(spark, f"{sf}/region.parquet").select("bytes", "sha256")


@query("agg_43")
def agg_43(spark, sf):
    return P.gate(records(spark, sf), "text")


@query("agg_44")
def agg_44(spark, sf):
    f = P.findings(records(spark, sf), "text", P.STRUCTURED, ["doc_id"])
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("texts"), F.min("doc_id").alias("example")).orderBy(F.col("category").isin(*P.REVIEW_ONLY), F.desc("n"), "category")


# contracts: a neutral codebook over records built from the labels

CODEBOOK = C.Contract(
    enums={"record_validity": ("valid", "not_applicable_record"), "role": ("actor", "target", "not_applicable", "unclear"), "stage_one": ("visible", "absent", "not_applicable"), "one_actor": ("named", "implied", "not_applicable"), "one_target": ("named", "implied", "not_applicable")},
    arrays={"positions": ("front", "back", "none")},
    exclusive={"positions": ("none",)},
    validity=("record_validity", "valid"),
    stages={"one": ("stage_one", "one_actor", "one_target")},
)
ALIASES = {"acting": "actor", "targeted": "target", "fwd": "front"}


def annotations(spark, sf):
    """A JSON record for each labelled document: valid ones, and one kind of fault for each remainder of the id."""
    u = units(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("title")), "doc_id")
    i = F.col("doc_id") % 8
    visible = F.col("quality") == 1
    own = lambda field, code: F.struct(F.lit(field).alias("field"), code.alias("code"))
    role = F.when(i == 1, "boss").when(i == 2, "unclear").otherwise("actor")
    one = F.when(visible, "visible").otherwise("absent")
    who = F.when(visible, "named").otherwise("not_applicable")
    positions = F.when(i == 3, F.array(F.lit("none"), F.lit("front"))).when(i == 4, F.array(F.lit("front"), F.lit("front"))).otherwise(F.array(F.lit("front")))
    supports = F.array_compact(F.array(own("role", role), own("stage_one", one), own("one_actor", who), own("one_target", who), own("positions", F.lit("front"))))
    supports = F.filter(supports, lambda s: ~s["code"].isin("absent", "not_applicable", "unclear") & ~((i == 5) & (s["field"] == "role")))
    record = F.struct(
        F.when(i == 6, "not_applicable_record").otherwise("valid").alias("record_validity"), role.alias("role"), one.alias("stage_one"), who.alias("one_actor"), who.alias("one_target"), positions.alias("positions"),
        F.lit(False).alias("needs_adjudication"), F.array().cast("array<string>").alias("reasons"),
        F.array(F.struct(F.when(i == 7, "not in the title").otherwise(F.substring("title", 1, 10)).alias("span"), supports.alias("supports"))).alias("evidence"),
    )
    return u.select("doc_id", "title", "quality", "toxic", F.to_json(record).alias("raw"))


EXPECTED = "select doc_id, {c} from (select doc_id, doc_id % 8 as i, quality from labels join documents using (doc_id))"
_rules = {
    "con_2": ("enum:role", "i = 1"),
    "con_3": ("array:positions", "i = 4"),
    "con_4": ("exclusive:positions", "i = 3"),
    "con_5": ("nonvalid_block", "i = 6"),
}


def _validated(spark, sf, **kw):
    return C.validated(annotations(spark, sf), CODEBOOK, "raw", "title", **kw)


query("con_1", EXPECTED.replace("{c}", "i = 0 as valid"))(lambda spark, sf: _validated(spark, sf).select("doc_id", "valid"))
for _key, (_rule, _sql) in _rules.items():
    query(_key, EXPECTED.replace("{c}", f"{_sql} as violated"))(lambda spark, sf, r=_rule: _validated(spark, sf).select("doc_id", F.array_contains("violations", r).alias("violated")))


@query("con_10", EXPECTED.replace("{c}", "(2 * quality + (case when i = 2 then 0 else 1 end) + (case when i = 3 or i = 4 then 2 else 1 end) + quality)::int as needed"))
def con_10(spark, sf):
    v = annotations(spark, sf).withColumn("r", F.from_json("raw", CODEBOOK.schema()))
    return v.select("doc_id", F.size(C._selected(CODEBOOK, F.col("r"))).alias("needed"))


@query("con_11", EXPECTED.replace("{c}", "i = 7 as bad_span, i = 5 or i = 3 as missing"))
def con_11(spark, sf):
    return _validated(spark, sf).select("doc_id", F.array_contains("violations", "evidence_span").alias("bad_span"), F.array_contains("violations", "evidence_missing").alias("missing"))


@query("con_12", EXPECTED.replace("{c}", "i in (0, 5) as valid"))
def con_12(spark, sf):
    return _validated(spark, sf, require_evidence=False).select("doc_id", "valid")


@query("con_13", EXPECTED.replace("{c}", "quality = 1 as visible, true as consistent"))
def con_13(spark, sf):
    v = annotations(spark, sf).withColumn("r", F.from_json("raw", CODEBOOK.schema()))
    shown = F.col("r.stage_one") == "visible"
    return v.select("doc_id", shown.alias("visible"), (shown == (F.col("r.one_actor") != "not_applicable")).alias("consistent"))


@query("con_14", "select 9::bigint as properties, true as keys_match")
def con_14(spark, sf):
    return spark.createDataFrame([(len(CODEBOOK.keys()), sorted(CODEBOOK.keys()) == CODEBOOK.keys())], "properties long, keys_match boolean")


@query("con_15", "select 1::bigint as placeholders")
def con_15(spark, sf):
    template = "Use this codebook: {{CODEBOOK}}."
    rendered = template.replace("{{CODEBOOK}}", json.dumps({k: list(v) for k, v in CODEBOOK.enums.items()}, sort_keys=True, separators=(",", ":")))
    assert "{{" not in rendered
    return spark.createDataFrame([(template.count("{{CODEBOOK}}"),)], "placeholders long")


@query("con_16", "select * from (values ('role', 4::bigint), ('record_validity', 2), ('stage_one', 3), ('one_actor', 3), ('one_target', 3), ('positions', 3)) t(field, options)")
def con_16(spark, sf):
    return spark.createDataFrame([(k, len(v)) for k, v in {**CODEBOOK.enums, **CODEBOOK.arrays}.items()], "field string, options long")


def _raw(spark, sf):
    """Records as they come from a model: scalars for arrays, aliases, missing arrays."""
    i = F.col("doc_id") % 3
    raw = F.when(i == 0, F.to_json(F.struct(F.lit("acting").alias("role"), F.lit("fwd").alias("positions")))).when(i == 1, F.to_json(F.struct(F.lit("target").alias("role")))).otherwise(F.to_json(F.struct(F.lit("actor").alias("role"), F.array(F.lit("back")).alias("positions"))))
    return table(spark, sf, "labels").select("doc_id", raw.alias("raw"))


def _normal(key, aliases, expected):
    query(key, f"select doc_id, {expected} as actions from (select doc_id, doc_id % 3 as i from labels)")(lambda spark, sf: C.normalized(_raw(spark, sf), CODEBOOK, "raw", aliases).select("doc_id", F.array_join("actions", "|").alias("actions")))


_normal("con_17", ALIASES, "case i when 0 then 'alias:role|scalar_to_array:positions|alias:positions' when 1 then 'missing_array:positions' else '' end")
_normal("con_18", {"acting": "actor"}, "case i when 0 then 'alias:role|scalar_to_array:positions' when 1 then 'missing_array:positions' else '' end")
_normal("con_19", {"fwd": "front"}, "case i when 0 then 'scalar_to_array:positions|alias:positions' when 1 then 'missing_array:positions' else '' end")


@query("con_20", "select conv_id, conv_id % 3 <> 0 as transport_ok from conversations group by conv_id")
def con_20(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("expected"))
    extra = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    items = F.transform(F.reverse(F.concat("expected", extra)), lambda t: F.struct(t.alias("item_index"), F.lit("x").alias("code")))
    return C.transport(g.withColumn("items", items), "conv_id", "items", "expected").select("conv_id", "transport_ok")


LONG = {"r": "role", "v": "validity"}
CODES = {"a": "actor", "t": "target"}


def _map(a, b):
    return F.create_map(F.lit(a), F.when(F.col("doc_id") % 2 == 0, b[0]).otherwise(b[1]))


query("con_21", "select doc_id, case when doc_id % 2 = 0 then 'actor' else 'target' end as role from labels")(lambda spark, sf: table(spark, sf, "labels").select("doc_id", C.recoded(_map("r", ("a", "t")), LONG, CODES)["role"].alias("role")))
query("con_22", "select doc_id, case when doc_id % 2 = 0 then 'a' else 't' end as r from labels")(lambda spark, sf: table(spark, sf, "labels").select("doc_id", C.recoded(_map("role", ("actor", "target")), {v: k for k, v in LONG.items()}, {v: k for k, v in CODES.items()})["r"].alias("r")))
query("con_25", "select doc_id, case when doc_id % 2 = 0 then 'actor' else 'target' end as validity from labels")(lambda spark, sf: table(spark, sf, "labels").select("doc_id", C.recoded(_map("v", ("a", "t")), LONG, CODES)["validity"].alias("validity")))
query("con_23", EXPECTED.replace("{c}", "case when i = 0 then 0 else 1 end as faulty"))(lambda spark, sf: _validated(spark, sf).select("doc_id", (~F.col("valid")).cast("int").alias("faulty")))
query("con_26")(lambda spark, sf: _validated(spark, sf, require_evidence=False).select("doc_id", "valid", F.round("evidence_recall", 9).alias("recall")))


@query("con_27")
def con_27(spark, sf):
    v = annotations(spark, sf).withColumn("r", F.from_json("raw", CODEBOOK.schema()))
    return v.select("doc_id", F.explode(C._selected(CODEBOOK, F.col("r"))).alias("p")).select("doc_id", "p.field", "p.code")

#: The name model is a plug-in: any function from text to spans can take the place of `names_in`.
query("udx_3")(prv_5)
