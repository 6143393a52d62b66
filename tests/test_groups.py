"""Ranks, sizes and first rows of groups against plain Python, with a group that holds most rows, ties, nulls and no rows; the
rule blocks on values that the queries do not hold."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, rule_blocks, sampling
from corpusloom.plans import contract_plans as CP


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(3000)]


def test_groups_match_plain_python(spark, rows):
    df = spark.createDataFrame([*rows, *rows[:50]], "id long, k string, at int")  # repeated rows tie in the order
    out = dedup.memberships(df, "k", ["at", "id"]).collect()
    assert len(out) == 3050
    for key in {r[1] for r in rows}:
        own = [r for r in out if r.k == key]
        assert {r.group_size for r in own} == {len(own)}
        first = [(r["at"], r.id) for r in own if r.is_representative]
        assert first == [min((r["at"], r.id) for r in own)]


def test_deduplicated_matches_plain_python(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, at int")
    kept, counts = dedup.deduplicated(df, "k", "id", F.col("at") > 0)
    valid = [r for r in rows if r[2] > 0]
    best = {k: min(str(r[0]) for r in valid if r[1] == k) for k in {r[1] for r in valid}}
    assert {r.k: str(r.id) for r in kept.collect()} == best
    assert tuple(counts.first()) == (3000, 3000 - len(valid), len(valid) - len(best), len(best))
    none, counts = dedup.deduplicated(df.limit(0), "k", "id")
    assert none.count() == 0 and tuple(counts.first()) == (0, 0, 0, 0)


def test_numbers_of_stored_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, at int")
    assert [r.id for r in dedup.numbered(df, ["at", "id"], "n").orderBy("n").collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def test_cell_ranks_match_plain_python(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, at int")
    order = F.sha2(F.col("id").cast("string"), 256)
    own = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    out = sampling.cell_ranked(df, ["k"], order, F.col("id"), "rank").collect()
    assert len(out) == 3000
    for key in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == key), key=own)
        assert [r.id for r in sorted((r for r in out if r.k == key), key=lambda r: r["rank"])] == ids
        assert sorted(r["rank"] for r in out if r.k == key) == list(range(1, len(ids) + 1))
    cut = sampling.cell_ranked(df.withColumn("q", F.lit(7)), ["k"], order, F.col("id"), "rank", "q").where("rank <= q")
    assert {(r.id, r["rank"]) for r in cut.collect()} == {(r.id, r["rank"]) for r in out if r["rank"] <= 7}


def test_waves_and_margins(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[1]], "id long, k string, at int")
    n = df.count()
    waved = sampling.waves(df, ["k"], [300, n - 300], 1, "id", exhaust=True)
    weights = sampling.wave_weights(waved, df, ["k"], 2).collect()
    assert len(weights) == n and sum(r.weight_1 or 0 for r in weights) == pytest.approx(n) and {r.pi_2 for r in weights} == {1.0}
    own = [r.weight_1 for r in weights if r.weight_1]
    margins = {r.wave: r for r in sampling.wave_margins(waved, df, ["k"], 2).collect()}
    assert margins[1].drawn == 300 and margins[1].effective == pytest.approx(sum(own) ** 2 / sum(w * w for w in own))
    assert margins[2].margin == pytest.approx(0, abs=1e-9) and margins[1].margin > 0
    sent = sampling.dispatched(waved, 1, "id").orderBy("dispatch_index").collect()
    assert [r.dispatch_index for r in sent] == list(range(1, n + 1)) and [r.wave for r in sent] == sorted(r.wave for r in sent)
    assert sent[20].batch_id == "batch_000002" and sent[19].batch_id == "batch_000001"
    for sizes in ([10, 0], [10, 20]):
        with pytest.raises(ValueError):
            sampling.waves(df, ["k"], sizes, 1, "id", exhaust=True)


def test_form_record_is_cleaned(spark):
    raws = ['{"validity": "valid", "cues": ["back", "front", "back"], "evidence_notes": "more than twelve"}', "{}", None, "[1]"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").select(rule_blocks.form_record(F.col("raw"), CP.FORM).alias("r"))
    first, empty, *_ = (r.r for r in df.collect())
    assert (first.cues, first.evidence_notes, first.role) == (["back", "front"], "more than tw", "")
    assert (empty.validity, empty.cues, empty.evidence_notes) == ("", [], "")


def test_router_items_match_plain_python(spark):
    rng = random.Random(11)
    options = {f: [*o, "?", None, 3] for f, o in CP.ROUTER.enums.items()}
    items = [{"i": rng.choice([1, 2, 0, -1, True, "1", 1.5])} | {f: rng.choice(o if rng.random() < 0.2 else o[:-3]) for f, o in options.items()} for _ in range(2000)]

    def sound(x):
        stages = [x[s] for s in CP.ROUTER.stages]
        known = all(x[f] in o for f, o in CP.ROUTER.enums.items())
        wanted = {"not_relevant": lambda s: s == "not_applicable", "relevant": lambda s: s != "not_applicable", "unclear": lambda s: s == "unclear"}
        if x["validity"] == "valid":
            fits = x["relevance"] in wanted and all(map(wanted[x["relevance"]], stages))
        else:
            fits = {x["relevance"], *stages} == {"not_applicable"}
        return known and fits and type(x["i"]) is int and x["i"] > 0

    df = spark.createDataFrame([(n, json.dumps(x)) for n, x in enumerate(items)], "n long, raw string")
    found = {r.n: r.v for r in df.select("n", rule_blocks.router_item(F.col("raw"), CP.ROUTER).alias("v")).collect()}
    assert {n for n, v in found.items() if not v} == {n for n, x in enumerate(items) if sound(x)}
    assert any(not v for v in found.values())
