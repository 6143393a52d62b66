"""A training-data pipeline: each stage calls one operator, and works on all that the stage before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Null and empty texts are clean, link with nothing, have no passages and no tokens but the end id: they pass every stage. Very
long texts are read whole by each. Rows repeated with id and text are one group to the join, of which one row stays; rows of
one id and different texts are judged each by its own text, and ties between linked rows go to the least id and, of equal
ids, to the least hash of the text. A null id is an id like others. Columns beside those of documents are carried along
through all stages but the last, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, ngram_join, sentencepiece_codec, suffix_dedup, toxicity
from corpusloom.llm.common import stored, table


def keep_mild(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted severity does not reject them. The model learns from the labelled among docs."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    # the whole row stands for the id, so rows of equal ids are judged each by its own text
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    return toxicity.severity(rows, model).where(~F.col("rejected")).select("doc_id.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one of the least doc_id; documents without links stay."""
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("doc_id", text_key.alias("key")).alias("doc_id"), "text")
    found = stored(ngram_join.join(rows)[0], "pipeline-groups")
    kept = found.where(F.col("node").isNull() | (F.col("doc_id") == F.col("component_id")))
    counted = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("node").isNull()).alias("alone"))
    counted = stored(counted.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.key").alias("key"), "n", "alone"), "pipeline-kept")
    same = docs["doc_id"].eqNullSafe(F.col("id")) & (text_key == F.col("key"))
    as_is = docs.join(counted.where("alone or n = 1").select("id", "key"), same, "left_semi")
    # rows repeated with id and text are a group as well
    repeated = docs.join(counted.where("not alone and n > 1").select("id", "key"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return as_is.unionByName(repeated)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start elsewhere: strings of 400 bytes, and runs of 50 words."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*others).alias("doc_id"), "text")
    kept = suffix_dedup.spans(rows, texts=True).select("doc_id.*", F.col("kept_text").alias("text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities of their cells."""
    return mixing.mix(docs, carry=F.struct(*docs.columns)).where("sampled").select("doc_id.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids of each text."""
    import public_tokenizers

    rows = docs.select(F.struct("doc_id", "source", "lang").alias("doc_id"), "text")
    out = sentencepiece_codec.encode(rows, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", keep_mild),
    ("ngram_join", keep_one_of_each_group),
    ("suffix_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: No stage is expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
