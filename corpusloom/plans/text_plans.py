"""Queries of text rules, filters and flags."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import udfs as U
from corpusloom.plans.base import events, query, records, table, units

RULES = {
    "version": "1",
    "minimum_semantic_cjk_length": 0,
    "rules": [
        {"id": "r1", "kind": "literal_replace", "old": " the ", "new": " THE "},
        {"id": "r2", "kind": "regex_replace", "pattern": "[aeiou]{3,}", "replacement": "*"},
        {"id": "r3", "kind": "character_map", "mapping": {"é": "e", "è": "e", "ß": "s"}},
        {"id": "r4", "kind": "collapse_whitespace"},
    ],
}
LEXICON = ("worthless", "idiot", "clown", "pathetic")
COLLAPSED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def transform(df, text: str, config: dict):
    """final_text, its hash, semantic length, validity, and the audit of the rules that changed something."""
    current, audit = F.col(text), []
    out = df
    for i, rule in enumerate(config["rules"]):
        new, count = T.rule_step(current, rule)
        out = out.withColumn(f"_t{i}", new).withColumn(f"_n{i}", count)
        audit.append((rule["id"], current, F.col(f"_t{i}"), F.col(f"_n{i}")))
        current = F.col(f"_t{i}")
    entries = F.array_compact(F.array(*[F.when(n > 0, F.struct(F.lit(k).alias("rule_id"), n.alias("replacement_count"), T.sha256(a).alias("before_sha256"), T.sha256(b).alias("after_sha256"))) for k, a, b, n in audit]))
    length = T.semantic_cjk_length(current)
    return out.select(*df.columns, current.alias("final_text"), T.sha256(current).alias("final_text_sha256"), length.alias("semantic_cjk_length"), F.when(length >= config["minimum_semantic_cjk_length"], "valid").otherwise("excluded_short").alias("record_validity"), entries.alias("transform_audit"))


STEPS = r"""
with {records}, a as (select doc_id, text, replace(text, ' the ', ' THE ') as t1 from records),
b as (select *, regexp_replace(t1, '[aeiou]{3,}', '*', 'g') as t2 from a),
c as (select *, translate(t2, 'éèß', 'ees') as t3 from b),
d as (select *, trim(regexp_replace(t3, '\s+', ' ', 'g')) as t4 from c)
"""


@query("str_1", STEPS + r"""select doc_id, cast((length(text) - length(replace(text, ' the ', ''))) / 5 as int) as literal_n, cast(len(regexp_extract_all(t1, '[aeiou]{3,}')) as int) as regex_n,
 cast(length(t2) - length(replace(replace(replace(t2, 'é', ''), 'è', ''), 'ß', '')) as int) as map_n, sha256(t3) as mapped from d""")
def str_1(spark, sf):
    df = records(spark, sf)
    t1, n1 = T.rule_step(F.col("text"), RULES["rules"][0])
    t2, n2 = T.rule_step(F.col("t1"), RULES["rules"][1])
    t3, n3 = T.rule_step(F.col("t2"), RULES["rules"][2])
    return df.select("doc_id", t1.alias("t1"), n1.alias("literal_n")).withColumn("t2", t2).withColumn("regex_n", n2).select("doc_id", "literal_n", "regex_n", n3.cast("int").alias("map_n"), T.sha256(t3).alias("mapped"))


@query("str_2", "with {records} select doc_id, sha256(" + COLLAPSED.format("text") + ") as h from records")
def str_2(spark, sf):
    return records(spark, sf).select("doc_id", T.sha256(T.collapse_whitespace(F.col("text"))).alias("h"))


@query("str_3", "select doc_id, sha256(text) as h from documents")
def str_3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sha256(F.col("text")).alias("h"))


@query("str_4", "select doc_id, cast(len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) as int) as n from documents")
def str_4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.semantic_cjk_length(F.col("text")).alias("n"))


@query("str_5", STEPS + "select doc_id, sha256(t4) as final_text_sha256, cast((t1 <> text)::int + (t2 <> t1)::int + (t3 <> t2)::int + (t4 <> t3)::int as int) as steps, 'valid' as record_validity from d")
def str_5(spark, sf):
    return transform(records(spark, sf), "text", RULES).select("doc_id", "final_text_sha256", F.size("transform_audit").alias("steps"), "record_validity")


@query("str_6", STEPS + "select sha256(string_agg(sha256(t4), '' order by doc_id)) as h, count(*) as n from d")
def str_6(spark, sf):
    rows = transform(records(spark, sf), "text", RULES).select("doc_id", "final_text_sha256")
    return rows.agg(T.sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "final_text_sha256"))), lambda x: x["final_text_sha256"]), "")).alias("h"), F.count(F.lit(1)).alias("n"))


@query("str_7", "select * from (values ('r1', 'literal_replace'), ('r2', 'regex_replace'), ('r3', 'character_map'), ('r4', 'collapse_whitespace')) t(id, kind)")
def str_7(spark, sf):
    return spark.range(1).select(F.inline(F.from_json(F.get_json_object(F.lit(json.dumps(RULES)), "$.rules"), "array<struct<id:string,kind:string>>")))


@query("str_8", "with {records} select doc_id, " + COLLAPSED.format("title") + " as title from records")
def str_8(spark, sf):
    return records(spark, sf).select("doc_id", T.collapse_whitespace(F.col("title")).alias("title"))


SPANS = r"""len(list_filter(regexp_extract_all(text, '\(([^()]*)\)', 1), lambda x: trim(x) <> '')) + len(list_filter(regexp_extract_all(text, '\[([^\[\]]*)\]', 1), lambda x: trim(x) <> '')) + len(list_filter(regexp_extract_all(text, '\{([^{}]*)\}', 1), lambda x: trim(x) <> ''))"""


@query("str_9", f"select doc_id, cast({SPANS} as int) as spans from documents")
def str_9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(U.bracket_spans()(F.col("text"))).alias("spans"))


@query("str_10")
def str_10(spark, sf):
    df = records(spark, sf)
    both = F.when(F.col("round") == 1, U.bracket_spans()(F.col("text"))).otherwise(U.bracket_spans((*U.BRACKETS, *U.SECOND_ROUND_BRACKETS))(F.col("text")))
    return df.select("doc_id", "round", both.alias("spans"))


def bracket_category(content: str) -> str:
    """A neutral stand-in for lexicons that are given by configuration."""
    return "handle" if content.startswith("@") else "number" if content.isdigit() else "content_descriptor" if len(content) > 12 else "marketing"


def _bracket_query(styles):
    def run(spark, sf):
        return records(spark, sf).select("doc_id", U.bracket_cleaning(bracket_category, styles=styles)(F.col("text")).alias("r")).select("doc_id", T.sha256(F.col("r.cleaned")).alias("h"), "r.kept", "r.removed", "r.skipped")

    return run


query("str_12")(_bracket_query(tuple(U.BRACKETS)))


@query("str_11", "select doc_id, 2 as outer_spans, false as crossing, '[ab(c)]' as first from documents where doc_id % 3 = 0 union all select doc_id, 0, true, null from documents where doc_id % 3 = 1 union all select doc_id, 1, false, '(d)' from documents where doc_id % 3 = 2")
def str_11(spark, sf):
    """Spans inside another one go, and spans that cross leave none: on three planted texts, one by the id's remainder."""
    i = F.col("doc_id") % 3
    text = F.when(i == 0, "x [ab(c)] (d)").when(i == 1, "x [a(b]c) d").otherwise("x (d) y")
    r = table(spark, sf, "documents").select("doc_id", text.alias("t")).select("doc_id", "t", U.nested_spans()(F.col("t")).alias("r"))
    first = F.get("r.spans", F.lit(0))
    return r.select("doc_id", F.size("r.spans").alias("outer_spans"), "r.crossing", F.when(first.isNotNull(), F.expr("substring(t, r.spans[0].start + 1, r.spans[0].end - r.spans[0].start)")).alias("first"))


query("str_13")(_bracket_query((*U.BRACKETS, *U.SECOND_ROUND_BRACKETS)))

CATEGORY = """case when regexp_matches(title, '^[0-9]+$') then 'number' when regexp_matches(title, '^@') then 'handle' when contains(title, 'idiot') or contains(title, 'clown') then 'flagged' when length(title) = 4 then 'tag' when length(title) < 30 then 'short' else 'text' end"""


@query("str_14", f"with {{records}} select doc_id, {CATEGORY} as category from records")
def str_14(spark, sf):
    t = F.col("title")
    hit = F.size(T.lexicon_hits(t, ("idiot", "clown"))) > 0
    return records(spark, sf).select("doc_id", F.when(t.rlike("^[0-9]+$"), "number").when(t.rlike("^@"), "handle").when(hit, "flagged").when(F.char_length(t) == 4, "tag").when(F.char_length(t) < 30, "short").otherwise("text").alias("category"))


@query("str_15", "with {records} select doc_id, case when length(title) = 4 and not contains(title, 'the') then 'tag' else 'other' end as kind from records")
def str_15(spark, sf):
    t = F.col("title")
    return records(spark, sf).select("doc_id", F.when((F.char_length(t) == 4) & ~F.contains(t, F.lit("the")), "tag").otherwise("other").alias("kind"))


@query("str_16", "select doc_id, (contains(text, 'idiot') or contains(text, 'clown')) and (contains(text, 'trash') or contains(text, 'scum')) as both_lexicons from documents")
def str_16(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", ((F.size(T.lexicon_hits(t, ("idiot", "clown"))) > 0) & (F.size(T.lexicon_hits(t, ("trash", "scum"))) > 0)).alias("both_lexicons"))


@query("str_17")
def str_17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.code_stripping(("acme",), ("abc",))(F.col("text")).alias("r")).select("doc_id", "r.removed")


@query("str_18")
def str_18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.code_stripping(("acme",), ("abc",))(F.col("text")).alias("r")).select("doc_id", T.sha256(F.col("r.text")).alias("h"), F.size("r.removed").alias("removed"))


@query("str_19", "with {records} select doc_id, case when starts_with(title, 'The ') then substr(title, 5) else title end as title, starts_with(title, 'The ') as hit from records")
def str_19(spark, sf):
    out, hit = T.strip_prefix(F.col("title"), "The ")
    return records(spark, sf).select("doc_id", out.alias("title"), hit.alias("hit"))


@query("str_20")
def str_20(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title")).select("page_id", U.html_unescape(F.col("title")).alias("title"), (U.html_unescape(F.col("title")) != F.col("title")).alias("hit"))


@query("str_21", "select doc_id, sha256(translate(text, '⼀⼆éè', '一二ee')) as h from documents")
def str_21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sha256(F.translate("text", "⼀⼆éè", "一二ee")).alias("h"))


TRIMMED = r"trim(regexp_replace(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '^[\-_·丨|>：:.。!！?？,，\s]+', ''), '[\-_·丨|>：:\s]+$', ''))"


@query("str_22", "with {records} select doc_id, " + TRIMMED.format("replace(replace(title, 'worthless', ''), 'clown', '')") + " as title from records")
def str_22(spark, sf):
    return records(spark, sf).select("doc_id", T.clean_freetext(F.col("title"), ("worthless", "clown")).alias("title"))


@query("str_23", "with {records} select doc_id, case when round = 2 then " + TRIMMED.format("replace(replace(title, 'idiot', ''), 'worthless', '')") + " else " + TRIMMED.format("replace(title, 'worthless', '')") + " end as title from records")
def str_23(spark, sf):
    t = F.col("title")
    return records(spark, sf).select("doc_id", F.when(F.col("round") == 2, T.clean_freetext(t, ("idiot", "worthless"))).otherwise(T.clean_freetext(t, ("worthless",))).alias("title"))


@query("str_24", "with {records} select doc_id, " + TRIMMED.format(r"regexp_replace(title, '\d{4}年\d{1,2}月(?:\d{1,2}日)?', '', 'g')") + " as title from records")
def str_24(spark, sf):
    return records(spark, sf).select("doc_id", T.clean_date_stamps(F.col("title"), ("新作", "作品")).alias("title"))


@query("str_25", "with {records} select doc_id, " + TRIMMED.format(r"regexp_replace(title, '\.{2,}\s*$', '')") + " as title from records")
def str_25(spark, sf):
    return records(spark, sf).select("doc_id", T.clean_truncation(F.col("title")).alias("title"))


def residue(c, source, gate: str, least: int = 6):
    """Rewrite residue of one source: closed annotation blocks off, then the last part after a marker that has enough letters."""
    plain = F.regexp_replace(c, r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]", "")
    parts = F.transform(F.split(plain, r"\s*(?:->|=>|：|\|)\s*"), lambda x: F.regexp_replace(T.strip(x), r"^[\-*#>\s\d.]+|[\-*#>(\[（\s]+$", ""))
    usable = F.filter(parts, lambda x: F.char_length(x) >= least)
    return F.when(gate_on(c, source, gate) & (F.size(usable) > 0), F.element_at(usable, -1)).otherwise(c)


def gate_on(c, source, gate: str):
    return (F.col(source) == gate) & c.rlike(r"->|=>|：|\|")


@query("str_26")
def str_26(spark, sf):
    return records(spark, sf).select("doc_id", residue(F.col("title"), "source", "src8").alias("title"))


@query("str_27", r"with {records} select doc_id, regexp_replace(title, '\([^()]*\)|\[[^\[\]]*\]', '', 'g') as title from records")
def str_27(spark, sf):
    return records(spark, sf).select("doc_id", F.regexp_replace("title", r"\([^()]*\)|\[[^\[\]]*\]", "").alias("title"))


@query("str_28", r"with {records} select doc_id, regexp_replace(regexp_replace(title, '^[\-*#> 0-9.]+', ''), '[\-*#>(\[ ]+$', '') as title from records")
def str_28(spark, sf):
    return records(spark, sf).select("doc_id", F.regexp_replace(F.regexp_replace("title", r"^[\-*#> 0-9.]+", ""), r"[\-*#>(\[ ]+$", "").alias("title"))


def fallback(original, cleaned, least: int = 2):
    """(title, applied, source): bracket contents, else the whole original, where cleaning has left less than two characters."""
    inside = T.collapse_whitespace(F.array_join(F.transform(U.bracket_spans()(original), lambda s: T.strip(s["content"])), " "))
    applied = (F.char_length(T.strip(original)) > 0) & (F.char_length(T.strip(cleaned)) < least)
    by_bracket = F.char_length(inside) >= least
    return F.when(~applied, cleaned).when(by_bracket, inside).otherwise(T.strip(original)), applied, F.when(~applied, "").when(by_bracket, "bracket_content").otherwise("full_original_title")


@query("str_29")
def str_29(spark, sf):
    cleaned = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("title"))
    out, applied, source = fallback(F.col("title"), cleaned)
    return records(spark, sf).select("doc_id", out.alias("title"), applied.alias("applied"), source.alias("origin"))


@query("str_30")
def str_30(spark, sf):
    return records(spark, sf).select("doc_id", T.collapse_whitespace(F.array_join(F.transform(U.bracket_spans()(F.col("text")), lambda s: T.strip(s["content"])), " ")).alias("inside"))


PREFIX = r"regexp_replace(title, '^[A-Z][a-z]+ [0-9]*[ :\-]*', '')"


@query("str_31", f"with {{records}} select doc_id, trim(regexp_extract(title, '^[A-Z][a-z]+')) as prefix from records")
def str_31(spark, sf):
    return records(spark, sf).select("doc_id", T.strip(F.regexp_extract("title", "^[A-Z][a-z]+", 0)).alias("prefix"))


@query("str_32", f"with {{records}} select doc_id, {PREFIX} as title, regexp_matches(title, '^[A-Z][a-z]+ ') as removed from records")
def str_32(spark, sf):
    return records(spark, sf).select("doc_id", F.regexp_replace("title", r"^[A-Z][a-z]+ [0-9]*[ :\-]*", "").alias("title"), F.col("title").rlike("^[A-Z][a-z]+ ").alias("removed"))


@query("str_33")
def str_33(spark, sf):
    """All title rules in order, with the versions of the rules that ran."""
    df = records(spark, sf).withColumn("b", U.bracket_cleaning(bracket_category)(F.col("title"))).withColumn("c", U.code_stripping(("acme",))(F.col("b.cleaned")))
    t, hit = T.strip_prefix(F.col("c.text"), "The ")
    df = df.withColumn("t", U.html_unescape(t)).withColumn("prefix_hit", hit).withColumn("t2", T.clean_truncation(T.clean_date_stamps(T.clean_freetext(F.col("t"), ("worthless",)), ())))
    out, applied, source = fallback(F.col("title"), F.col("t2"))
    versions = F.create_map(*[F.lit(x) for kv in {"001": "1", "002": "1", "004": "1", "005": "1", "012": "2", "013": "1", "014": "1"}.items() for x in kv])
    return df.select("doc_id", out.alias("cleaned_title"), "b.kept", "b.removed", F.col("c.removed").alias("codes"), "prefix_hit", applied.alias("fallback"), source.alias("fallback_source"), T.contains_cjk(F.col("title")).alias("contains_cjk"), F.to_json(versions).alias("rule_versions"))


@query("str_34", r"with {records} select doc_id, regexp_matches(text, '[\x00-\x1f\x7f-\x9f]') as control from records")
def str_34(spark, sf):
    return records(spark, sf).select("doc_id", T.has_control_char(F.col("text")).alias("control"))


def _context(width):
    def run(spark, sf):
        at = F.instr("text", "th") - 1
        return records(spark, sf).where("instr(text, 'th') > 0").select("doc_id", T.context(F.col("text"), at, at + 2, width).alias("context"))

    return run


for _key, _w in (("str_35", 48), ("str_36", 36)):
    query(_key, f"with {{records}} select doc_id, substr(text, greatest(instr(text, 'th') - 1 - {_w}, 0) + 1, instr(text, 'th') + 1 + {_w} - greatest(instr(text, 'th') - 1 - {_w}, 0)) as context from records where instr(text, 'th') > 0")(_context(_w))


@query("str_37", "select doc_id, array_to_string(list_filter(['worthless', 'idiot', 'clown', 'pathetic'], lambda x: contains(text, x)), '|') as terms from documents")
def str_37(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.lexicon_hits(F.col("text"), LEXICON), "|").alias("terms"))


@query("str_38", "select doc_id, 'R-' || upper(substr(sha256('seed|' || doc_id), 1, 12)) as blind_id from documents")
def str_38(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.opaque_id("R", F.lit("seed"), F.col("doc_id").cast("string")).alias("blind_id"))


@query("str_39", "select doc_id, substr(sha256(source), 1, 16) as g from documents")
def str_39(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.group_hash(F.col("source")).alias("g"))


@query("str_40", "select event_id, k from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)")
def str_40(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(T.unfenced(fenced), "$.k").cast("long").alias("k"))


@query("str_41", "select event_id, event_type as field, cast(json_extract(props, '$.k') as varchar) as code from events")
def str_41(spark, sf):
    """Support as "field:code" text or as an object, both as a pair."""
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat_ws(":", "event_type", k)).otherwise(F.to_json(F.struct(F.col("event_type").alias("field"), k.alias("code"))))
    parts = F.split(raw, ":", 2)
    return table(spark, sf, "events").select("event_id", F.when(raw.startswith("{"), F.get_json_object(raw, "$.field")).otherwise(parts[0]).alias("field"), F.when(raw.startswith("{"), F.get_json_object(raw, "$.code")).otherwise(parts[1]).alias("code"))


@query("str_42", """select event_id, sha256('{"id":' || event_id || ',"type":"' || event_type || '"}') as h from events""")
def str_42(spark, sf):
    return table(spark, sf, "events").select("event_id", U.canonical_sha256(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")))).alias("h"))


@query("str_43", "select event_id, printf('%.3f', round(value, 2)) as v from events")
def str_43(spark, sf):
    return table(spark, sf, "events").select("event_id", T.fixed(F.round("value", 2), 3).alias("v"))


@query("str_44", "with {units} select lang, printf('%.3f', round(avg(toxic), 4) * 100) as pct from units group by lang")
def str_44(spark, sf):
    return units(spark, sf).groupBy("lang").agg(T.percent(F.round(F.avg("toxic"), 4), 3).alias("pct"))


@query("str_45", "select distinct source, printf('source_%02d', dense_rank() over (order by source)) as alias from documents")
def str_45(spark, sf):
    sources = table(spark, sf, "documents").select("source").distinct()
    return sources.select("source", F.format_string("source_%02d", F.dense_rank().over(Window.orderBy("source"))).alias("alias"))


@query("str_46", "select doc_id, case lang when 'en' then 'English' when 'de' then 'German' else lang end as lang from documents")
def str_46(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.recode(F.col("lang"), {"en": "English", "de": "German"}).alias("lang"))


@query("str_47", "with {events} select event_id, case when k >= 0 then least(k, 10) end as hit, case when k >= 0 then k - least(k, 10) end as miss from log")
def str_47(spark, sf):
    u = T.usage(F.col("k"), F.least("k", F.lit(10)), F.lit(None).cast("long"), F.lit(1))
    return events(spark, sf).select("event_id", u["hit"].alias("hit"), u["miss"].alias("miss"))


# filters and flags: rows are marked, never dropped

@query("flt_1", "with {records} select doc_id, nullif(concat_ws('+', case when length(title) > 200 then 'long' end, case when regexp_matches(title, '\\[thread\\]|\\| ') then 'forum' end), '') as reason from records")
def flt_1(spark, sf):
    t = F.col("title")
    return records(spark, sf).select("doc_id", F.nullif(F.concat_ws("+", F.when(F.char_length(t) > 200, "long"), F.when(t.rlike(r"\[thread\]|\| "), "forum")), F.lit("")).alias("reason"))


@query("flt_2", "with {records}, frozen as (select doc_id, length(text) > 2000 as f from records where round = 1) select doc_id, case when round = 1 then frozen.f else length(title) > 200 end as excluded from records left join frozen using (doc_id)")
def flt_2(spark, sf):
    df = records(spark, sf)
    frozen = df.where("round = 1").select("doc_id", (F.char_length("text") > 2000).alias("f"))
    return df.join(frozen, "doc_id", "left").select("doc_id", F.when(F.col("round") == 1, F.col("f")).otherwise(F.char_length("title") > 200).alias("excluded"))


def _no_cjk(spark, sf, rounds):
    return records(spark, sf).where(F.col("round").isin(rounds)).select("doc_id", (~T.contains_cjk(F.col("title"))).alias("excluded"))


query("flt_3", "with {records} select doc_id, not regexp_matches(title, '[一-鿿]') as excluded from records")(lambda spark, sf: _no_cjk(spark, sf, [1, 2]))
query("flt_4", "with {records} select doc_id, not regexp_matches(title, '[一-鿿]') as excluded from records where round = 1")(lambda spark, sf: _no_cjk(spark, sf, [1]))

SERIES = "series as (select regexp_extract(title, '^([A-Z][a-z]+) ', 1) as name from records where regexp_matches(title, '^[A-Z][a-z]+ ') group by 1 having count(distinct title) >= 3)"


@query("flt_5", "with {records}, " + SERIES + " select name from series")
def flt_5(spark, sf):
    name = F.regexp_extract("title", "^([A-Z][a-z]+) ", 1)
    return records(spark, sf).where(name != "").groupBy(name.alias("name")).agg(F.countDistinct("title").alias("n")).where("n >= 3").select("name")


@query("flt_6", "with {records}, " + SERIES + " select doc_id, max_by(name, length(name)) as series from records join series on starts_with(title, name || ' ') group by doc_id")
def flt_6(spark, sf):
    """The longest series name that begins a title: an equi-join on the first word instead of a prefix product."""
    names = flt_5(spark, sf)
    df = records(spark, sf).select("doc_id", F.regexp_extract("title", "^([A-Z][a-z]+) ", 1).alias("name"))
    return df.join(names, "name").select("doc_id", F.col("name").alias("series"))


@query("flt_7", "with {records}, c as (select *, row_number() over (partition by text order by doc_id) = 1 as canonical from records) select doc_id from c where canonical and length(title) <= 200 and n_chars >= 100")
def flt_7(spark, sf):
    first = records(spark, sf).groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by(F.struct("doc_id", "title", "n_chars"), "doc_id").alias("r")).select("r.*")
    return first.where((F.char_length("title") <= 200) & (F.col("n_chars") >= 100)).select("doc_id")


@query("flt_8", "with {records} select 'long' as view, doc_id from records where round = 1 and length(title) > 200 union all select 'short', doc_id from records where round = 1 and n_chars < 100")
def flt_8(spark, sf):
    df = records(spark, sf).where("round = 1")
    return df.where(F.char_length("title") > 200).select(F.lit("long").alias("view"), "doc_id").unionByName(df.where("n_chars < 100").select(F.lit("short").alias("view"), "doc_id"))


@query("flt_9", "select doc_id from documents where not list_contains(string_split(lang || '|' || source, '|'), 'src0')")
def flt_9(spark, sf):
    docs = table(spark, sf, "documents")
    bad = docs.where(F.array_contains(F.split(F.concat_ws("|", "lang", "source"), "\\|"), "src0")).select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select("doc_id")


@query("flt_10", "select event_id, lower(trim(event_type)) in ('click', 'yes') as accepted from events")
def flt_10(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lower(F.trim("event_type")).isin("click", "yes").alias("accepted"))


@query("flt_11", "with {records} select doc_id, instr(text, 'the') > 0 as valid from records")
def flt_11(spark, sf):
    from corpusloom.operators.privacy import span_is_valid

    at = F.instr("text", "the") - 1
    return records(spark, sf).select("doc_id", span_is_valid(F.col("text"), at.cast("string"), (at + 3).cast("string"), F.lit("the")).alias("valid"))


def _flag(key, sql, column):
    query(key, "with {units} select doc_id, " + sql + " as flag from units")(lambda spark, sf: units(spark, sf).select("doc_id", column().alias("flag")))


_flag("flt_12", "coalesce(quality = 1 and toxic = 0, false)", lambda: F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)))
_flag("flt_13", "coalesce(quality = 1, false)", lambda: F.coalesce(F.col("quality") == 1, F.lit(False)))
_flag("flt_14", "coalesce(source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5'), false)", lambda: F.coalesce(F.col("source").isin(*[f"src{i}" for i in range(6)]), F.lit(False)))
_flag("flt_15", "not coalesce(nullif(source, 'src0') in ('src1', 'src2', 'src3'), false)", lambda: ~F.coalesce(F.nullif("source", F.lit("src0")).isin("src1", "src2", "src3"), F.lit(False)))
_flag("flt_16", "lang = 'en'", lambda: F.col("lang") == "en")
_flag("flt_17", "lang = 'en' and quality = 1", lambda: (F.col("lang") == "en") & (F.col("quality") == 1))
_flag("flt_18", "quality = 1 or toxic = 1", lambda: F.exists(F.array("quality", "toxic"), lambda x: x == 1))
_flag("flt_19", "lang = 'en' and quality = 1 and n_chars > 500", lambda: (F.col("lang") == "en") & (F.col("quality") == 1) & (F.col("n_chars") > 500))
_flag("flt_20", "quality = 1 and list_contains(['short', 'medium'], band) and toxic = 0", lambda: (F.col("quality") == 1) & F.array_contains(F.array(F.lit("short"), F.lit("medium")), F.col("band")) & (F.col("toxic") == 0))
_flag("flt_21", "case when toxic = 1 then 'forced' when quality = 1 then 'direct' end", lambda: F.when(F.col("toxic") == 1, "forced").when(F.col("quality") == 1, "direct"))
_flag("flt_22", "case when toxic = 1 and lang in ('en', 'de') then 'a' when lang in ('fr', 'es') then 'b' end", lambda: F.when((F.col("toxic") == 1) & F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("de"))), "a").when(F.arrays_overlap(F.array("lang"), F.array(F.lit("fr"), F.lit("es"))), "b"))
_flag("flt_23", "(toxic = 1)::int + (quality = 0)::int + (n_chars > 3000)::int >= 2", lambda: ((F.col("toxic") == 1).cast("int") + (F.col("quality") == 0).cast("int") + (F.col("n_chars") > 3000).cast("int")) >= 2)


@query("flt_24", "select doc_id, instr(text, 'the') between 8 and 20 as hit from documents")
def flt_24(spark, sf):
    """Whether the span of the first `the` overlaps one that ends at 10 or one that begins there and ends at 20."""
    from corpusloom.operators.privacy import overlaps

    at = F.instr("text", "the") - 1
    spans = F.array(F.struct(F.lit(9).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(10).alias("start"), F.lit(20).alias("end")))
    return table(spark, sf, "documents").select("doc_id", overlaps(at, at + 3, spans).alias("hit"))


@query("flt_25", "with {records} select doc_id from records where contains(lower(title), 'the') and lang = 'en'")
def flt_25(spark, sf):
    return records(spark, sf).where(F.contains(F.lower("title"), F.lit("the")) & (F.col("lang") == "en")).select("doc_id")


@query("flt_26", "with {records} select r.doc_id from records r join labels l using (doc_id) where l.toxic = 1 and contains(lower(r.text), 'idiot')")
def flt_26(spark, sf):
    return records(spark, sf).join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").where(F.contains(F.lower("text"), F.lit("idiot"))).select("doc_id")


@query("flt_27", "select event_id, contains(props, '7') or contains(event_type, 'cl') as hit from events")
def flt_27(spark, sf):
    needles = F.array(F.lit("7"), F.lit("cl"))
    own = F.concat_ws(" ", "props", "event_type")
    return table(spark, sf, "events").select("event_id", F.exists(needles, lambda x: F.contains(own, x)).alias("hit"))


@query("flt_28", "with {units} select source, case when count(*) < 5 then 'not_applicable' when avg(quality) > 0.5 then 'true' else 'false' end as retained from units group by source")
def flt_28(spark, sf):
    return units(spark, sf).groupBy("source").agg(F.when(F.count(F.lit(1)) < 5, "not_applicable").when(F.avg("quality") > 0.5, "true").otherwise("false").alias("retained"))
