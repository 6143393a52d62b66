"""Registration of queries with their oracle SQL, and the tables that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BAND = "case when n_chars < 500 then 'short' when n_chars < 3000 then 'medium' else 'long' end"
#: The same relations for DuckDB. The rules for titles run over the whole text of a document.
RECORDS = f"records as (select doc_id, text, text as title, lang, source, n_chars, {BAND} as band, doc_id % 2 + 1 as round from documents)"
UNITS = f"units as (select doc_id, lang, source, n_chars, {BAND} as band, doc_id % 2 + 1 as round, quality, toxic from documents join labels using (doc_id))"
EVENTS = "log as (select user_id, event_id, event_type, ts, value, cast(json_extract(props, '$.k') as bigint) as k from events)"


def query(key: str, oracle: str | None = None):
    """Registers a query; `{records}`, `{units}` and `{events}` in the oracle stand for the shared relations."""

    def put(f):
        QUERIES[key] = f
        if oracle:
            ORACLE_SQL[key] = oracle.replace("{records}", RECORDS).replace("{units}", UNITS).replace("{events}", EVENTS)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def band() -> Column:
    return F.expr(BAND).alias("band")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("title"), "lang", "source", "n_chars", band(), (F.col("doc_id") % 2 + 1).alias("round"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality and toxic stand for a paired binary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", band(), (F.col("doc_id") % 2 + 1).alias("round"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars", "band", "round", "quality", "toxic")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def r9(c: Column) -> Column:
    return F.round(c, 9)
