"""Queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusloom.llm.common import table
from corpusloom.llm import ann, html_extraction, lm_scoring, mixing, ngram_join, ogg, sentencepiece_codec, sharding, suffix_dedup, toxicity


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, the least doc_id it is linked with, and its number of links."""
    return ngram_join.join(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id", "n_links")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)[0]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages that also start elsewhere."""
    return suffix_dedup.spans(table(spark, sf_dir, "documents")).drop("starts", "ends", "kept_text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with an end id, and decoded again."""
    import public_tokenizers

    return sentencepiece_codec.digest(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file and read back."""
    return ogg.digest(ogg.documents_as_media(table(spark, sf_dir, "documents")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by n-grams of the training documents."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked probability, and whether it is drawn."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_ogg": op6_ogg,
    "op7_html": op7_html,
    "op8_ann": op8_ann,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_mixing": op10_mixing,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
