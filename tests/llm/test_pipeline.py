"""The pipeline on planted cases: what each stage must catch and must leave alone."""

import random

import pytest

import corpus_pipeline
from corpusloom.llm.common import stored


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [(i, text(120)) for i in range(150)]
    toxic = [(i, text(40) + " villain " + text(40)) for i in range(200, 240)]
    passage = text(90)
    sharing = [(300, text(50) + " " + passage + " " + text(50)), (301, text(60) + " " + passage)]
    near = clean[5][1].split(" ")
    near[60] = "other"
    copies = [(400, clean[3][1]), (401, " ".join(near)), (3, clean[3][1])]
    rows = [(i, t, "en", "src0", len(t)) for i, t in [*clean, *toxic, *sharing, *copies]] + [(500, None, None, None, None), (501, "", "en", "src1", 0)]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, _ in clean[:100]] + [(i, 1) for i, _ in toxic[:25]], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {"clean": clean, "toxic": toxic, "passage": passage}


def test_stages(spark, planted):
    path, p = planted
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "sentencepiece"]
    docs = first = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), "test")
        if name != "sentencepiece":
            assert docs.columns == first.columns
        out[name] = docs.collect()
    ids = {n: [r.doc_id for r in rows] for n, rows in out.items()}
    assert not set(ids["toxicity"]) & {i for i, _ in p["toxic"]}
    assert {i for i, _ in p["clean"]} | {300, 301, 400, 401, 500, 501} <= set(ids["toxicity"])
    assert sorted(ids["ngram_join"]) == sorted({i for i, _ in p["clean"]} | {300, 301, 500, 501})
    kept = {r.doc_id: r.text for r in out["suffix_dedup"]}
    assert sorted(kept) == sorted(ids["ngram_join"])
    assert all(p["passage"] not in t for t in kept.values()) and kept[300] and kept[301]
    assert all(kept[i] == t for i, t in p["clean"])
    assert set(ids["mixing"]) <= set(ids["suffix_dedup"]) and len(ids["mixing"]) > 50
    assert sorted(ids["sentencepiece"]) == sorted(ids["mixing"])
