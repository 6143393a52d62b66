"""Queries of sources, sinks, streaming state and extension points."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans.base import events, query, r9, records, table
from corpusloom.session import shared_dir
from corpusloom.sources import pages as PG
from corpusloom.sources import records as RC
from corpusloom.streaming import incremental as ST

DOMAINS = ("ththre.example.com", "m.ththth.example.net")
HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
PAGE = r"coalesce(nullif(regexp_extract(url, '/page/(\d+)', 1), ''), nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''))::int"


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"


def _pages(spark, sf):
    return table(spark, sf, "pages")


@query("src_1", "select page_id, length(html) as n from pages")
def src_1(spark, sf):
    """Pages come from a table; the engine itself does not fetch."""
    return _pages(spark, sf).select("page_id", F.char_length("html").cast("long").alias("n"))


@query("src_5", "select 'demo' as name, 'requests' as fetch_mode, 0::bigint as patterns")
def src_5(spark, sf):
    site = RC.site_configs(json.dumps({"sites": [{"name": "demo"}]}))[0]
    return spark.createDataFrame([(site["name"], site["fetch_mode"], len(site["detail_patterns"]))], "name string, fetch_mode string, patterns long")


@query("src_6")
def src_6(spark, sf):
    return PG.items(_pages(spark, sf))


@query("src_7")
def src_7(spark, sf):
    return PG.items(_pages(spark, sf)).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("src_8")
def src_8(spark, sf):
    return PG.next_pages(_pages(spark, sf))


query("src_9", f"select page_id, {PAGE} as page_no from pages")(lambda spark, sf: _pages(spark, sf).select("page_id", PG.page_number(F.col("url")).alias("page_no")))
query("src_10", f"select page_id, {HOST} in {DOMAINS} as allowed from pages")(lambda spark, sf: _pages(spark, sf).select("page_id", PG.allowed_domain(F.col("url"), DOMAINS).alias("allowed")))
query("src_11", "select page_id, regexp_matches(url, '(?i)/EN/|/de/') as hit from pages")(lambda spark, sf: _pages(spark, sf).select("page_id", PG.matches_any(F.col("url"), ["/EN/", "/de/"]).alias("hit")))
query("src_12", f"select page_id, {HOST} in {DOMAINS} and not regexp_matches(url, '(?i)utm_') and not regexp_matches(url, '(?i)page=') and regexp_matches(url, '(?i)/[a-z]{{2}}/[0-9]+') as detail from pages")(
    lambda spark, sf: _pages(spark, sf).select("page_id", PG.detail_url(F.col("url"), DOMAINS, ["/[a-z]{2}/[0-9]+"], ["utm_"], ["page="]).alias("detail"))
)


@query("src_13", "select min(page_id) as page_id from pages group by url, html")
def src_13(spark, sf):
    return PG.first_seen(_pages(spark, sf).select("page_id", "url", F.sha2("html", 256).alias("h")), ["url", "h"], ["page_id"]).select("page_id")


def _sample(spark, sf):
    return records(spark, sf).select("doc_id", "lang", "source", "n_chars")


@query("src_16", "select doc_id, lang, source, n_chars from documents")
def src_16(spark, sf):
    RC.write_jsonl(_sample(spark, sf), path := scratch(spark))
    return spark.read.schema("doc_id long, lang string, source string, n_chars long").json(path)


@query("src_17", "select cast(doc_id as varchar) as doc_id, lang from documents")
def src_17(spark, sf):
    RC.write_csv(_sample(spark, sf), path := scratch(spark), ["doc_id", "lang"])
    return RC.read_csv(spark, path)


def _jsonl(key):
    @query(key, "select doc_id, source from documents")
    def run(spark, sf):
        RC.write_jsonl(_sample(spark, sf), path := scratch(spark))
        return RC.read_jsonl(spark, path, "doc_id long, source string")


for _key in ("src_18", "src_19", "src_26"):
    _jsonl(_key)


@query("src_20", "select cast(doc_id as varchar) as doc_id, lang, source, cast(n_chars as varchar) as n_chars from documents")
def src_20(spark, sf):
    RC.write_csv(_sample(spark, sf), path := scratch(spark), ["doc_id", "lang", "source", "n_chars"])
    return RC.read_csv(spark, path)


def _commented(key):
    @query(key, "select * from (values ('1', 'a'), ('#2', 'b'), ('3', 'c')) t(id, name)")
    def run(spark, sf):
        lines = ["# a comment", "", "id,name", "1,a", "", "#2,b", "3,c"]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path := scratch(spark))
        return RC.read_commented_csv(spark, path)


for _key in ("src_21", "src_22"):
    _commented(_key)

query("src_23", "select doc_id, lang from documents where source in ('src0', 'src1') order by doc_id limit 200")(lambda spark, sf: records(spark, sf).where("source in ('src0', 'src1')").select("doc_id", "lang").orderBy("doc_id").limit(200))
query("src_24", "select * from (values ('titles'), ('queue'), ('runs')) t(name)")(lambda spark, sf: spark.createDataFrame([(n,) for n in ("titles", "queue", "runs")], "name string"))


@query("src_25", "select count(*) as rows_written, sum(n_chars)::bigint as n_chars from documents")
def src_25(spark, sf):
    """Written under another name, then moved: a reader finds the whole table or none."""
    RC.write_atomically(_sample(spark, sf), path := scratch(spark))
    return spark.read.schema("n_chars long").json(path).agg(F.count(F.lit(1)).alias("rows_written"), F.sum("n_chars").alias("n_chars"))


@query("src_27", "select cast(doc_id as varchar) as doc_id, source from documents")
def src_27(spark, sf):
    RC.write_csv(_sample(spark, sf), path := scratch(spark), ["doc_id", "source"])
    return RC.read_csv(spark, path)


query("src_28", "select lang, count(*) as n from documents group by lang")(lambda spark, sf: RC.guarded(records(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))))


@query("src_29", "with {events} select user_id, max_by(event_type, event_id) as event_type, count(*) as n from log group by user_id")
def src_29(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("src_30", "select count(*) as rows, count(distinct lang) as sources, count(distinct url) as unique_urls, min(page_id) as first_time, max(page_id) as last_time, count(*) filter (where coalesce(url, '') = '') as missing_url from (select *, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) as lang from pages)")
def src_30(spark, sf):
    return RC.export_report(_pages(spark, sf).withColumn("lang", F.regexp_extract("html", 'lang="([a-z]+)"', 1)), ["url"], "lang", "url", "page_id")


@query("src_31", "select doc_id, lang from documents")
def src_31(spark, sf):
    RC.write_jsonl(records(spark, sf).select("doc_id", "lang"), path := scratch(spark))
    return spark.read.schema("doc_id long, lang string").json(path)


# keyed state over time

STATUS = "with {events}, q as (select user_id, max_by(event_type, event_id) as status, max(ts) as updated, count(*) as attempts from log group by user_id) "


def _queue(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("ts").alias("updated"), F.count(F.lit(1)).alias("attempts"))


query("stm_1", STATUS + "select user_id, status, attempts + 1 as attempts from q order by status, attempts, user_id limit 1")(lambda spark, sf: _queue(spark, sf).orderBy("status", "attempts", "user_id").limit(1).select("user_id", "status", (F.col("attempts") + 1).alias("attempts")))
query("stm_2", STATUS + "select user_id, case when status = 'error' then substr(repeat('e', 5000), 1, 4000) else status end as state from q")(lambda spark, sf: _queue(spark, sf).select("user_id", F.when(F.col("status") == "error", F.substring(F.repeat(F.lit("e"), 5000), 1, 4000)).otherwise(F.col("status")).alias("state")))


@query("stm_3", STATUS + "select user_id, case when (status = 'view' and updated < (select max(ts) from log) - interval 60 minute) or (status in ('click', 'error') and attempts < 50) then 'pending' else status end as status from q")
def stm_3(spark, sf):
    q = _queue(spark, sf)
    now = events(spark, sf).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    renamed = q.select("user_id", "updated", "attempts", F.when(F.col("status") == "view", "processing").when(F.col("status") == "click", "error").otherwise(F.col("status")).alias("state"), "status")
    out = ST.requeued(renamed, "state", "updated", now, 60, "attempts", 50)
    return out.select("user_id", F.when(F.col("state") == "pending", "pending").otherwise(F.col("status")).alias("status"))


@query("stm_4", "with {events}, w as (select event_id // 1000 as wave, count(*) as n, count(*) filter (where event_type = 'click') as done from log group by 1) select wave, n, done, coalesce(bool_and(done > 0) over (order by wave rows between unbounded preceding and 1 preceding), true) as prior_complete from w")
def stm_4(spark, sf):
    w = events(spark, sf).groupBy(F.expr("event_id div 1000").alias("wave")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("done"))
    before = Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)
    return w.withColumn("prior_complete", F.coalesce(F.bool_and(F.col("done") > 0).over(before), F.lit(True)))


@query("stm_5", "select user_id, max_by(event_type, event_id) as event_type, count(*) as seen_count from events group by user_id")
def stm_5(spark, sf):
    """The events as a stream of files, upserted by micro-batch."""
    base = scratch(spark)
    source = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    source.repartition(4).write.parquet(f"{base}/in")
    stream = ST.file_stream(spark, f"{base}/in", source.schema, 2)
    ST.upsert_stream(stream, f"{base}/out", f"{base}/checkpoint", "user_id", "event_id", ["event_type"], "ts").awaitTermination()
    return ST.upserted(spark, f"{base}/out", "user_id", "event_id", ["event_type"]).select("user_id", "event_type", "seen_count")


# extension points


@query("udx_1")
def udx_1(spark, sf):
    from corpusloom.plans.text_plans import RULES, transform

    return transform(records(spark, sf), "text", RULES).select("doc_id", F.explode("transform_audit").alias("a")).groupBy(F.col("a.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("docs"), F.sum("a.replacement_count").alias("replacements"))


@query("udx_2", "select doc_id, contains(lower(text), 'idiot') as hit from documents")
def udx_2(spark, sf):
    """A restricted literal given by the caller, not by the library."""
    given = ("idiot",)
    return records(spark, sf).select("doc_id", F.exists(F.array(*[F.lit(g) for g in given]), lambda g: F.contains(F.lower("text"), g)).alias("hit"))


@query("udx_4", "with {units} select count(*) filter (where quality = 1) as selected_n, count(*) as n from units")
def udx_4(spark, sf):
    from corpusloom.operators.metrics import Metric, counted, estimated
    from corpusloom.plans.base import units

    return estimated(counted(units(spark, sf), [Metric("own", F.lit(True), F.expr("quality = 1"))])).select("selected_n", "n")


def max_match(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Dictionary tokenizer: the longest known word from the left, else one character."""
    out, i = [], 0
    while i < len(text):
        n = next((k for k in range(min(longest, len(text) - i), 1, -1) if text[i : i + k] in words), 1)
        if not text[i].isspace():
            out.append(text[i : i + n])
        i += n
    return out


@query("udx_5")
def udx_5(spark, sf):
    words = frozenset(("the", "thth", "tion", "ing", "and"))

    @F.pandas_udf("array<string>")
    def run(s):
        return s.map(lambda t: max_match(t or "", words, 4))

    return records(spark, sf).select("doc_id", F.size(run("title")).alias("tokens"))


@query("udx_6", "with {records} select doc_id, length(replace(title, ' ', '')) as tokens from records")
def udx_6(spark, sf):
    return records(spark, sf).select("doc_id", F.size(F.filter(F.split(F.replace("title", F.lit(" "), F.lit("")), ""), lambda x: x != "")).cast("long").alias("tokens"))


@query("udx_9", "with {events} select event_type, round(sum(k) * 0.25::double / 1000000, 9) as cost from log group by event_type")
def udx_9(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(r9(F.sum("k") * 0.25 / 1000000).alias("cost"))


@query("udx_11")
def udx_11(spark, sf):
    """Bars of an aggregate as one SVG text."""
    rows = records(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    top = max(r["n"] for r in rows)
    bars = "".join(f'<rect x="0" y="{20 * i}" width="{200 * r["n"] // top}" height="16"><title>{r["lang"]}: {r["n"]}</title></rect>' for i, r in enumerate(rows))
    return spark.createDataFrame([(f'<svg xmlns="http://www.w3.org/2000/svg" height="{20 * len(rows)}">{bars}</svg>',)], "svg string")


@query("udx_12")
def udx_12(spark, sf):
    return RC.manifest(spark, f"{sf}/nation.parquet").select("bytes", "sha256", "line_count")


@query("udx_13", "select 2 as version, count(*) as n from documents")
def udx_13(spark, sf):
    """The active version is the greatest one: activation writes a new folder and moves nothing."""
    base = scratch(spark)
    for v in (1, 2):
        records(spark, sf).select("doc_id").where(f"{v} = 2 or doc_id < 10").write.parquet(f"{base}/version={v}")
    every = spark.read.parquet(base)
    return every.groupBy("version").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("version")).limit(1)
