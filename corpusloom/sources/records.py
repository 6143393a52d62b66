"""Reading and writing records: JSON lines, CSV with comments, guarded sinks, file manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a public file must not hold.
FORBIDDEN = frozenset({"title", "text", "title_text", "source_text", "final_text", "source_url", "listing_url", "record_id", "matched_text", "context", "prompt", "response"})


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines pass, a faulty one stops the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        return spark.read.option("mode", "FAILFAST").json(path)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose lines that start with # count as comments only above the header; later ones are rows. Blank lines pass."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = lines.where(~F.col("value").startswith("#")).first()
    if header is None:
        return spark.createDataFrame([], "value string")
    names = [c.strip().strip('"') for c in header[0].split(",")]
    schema = ", ".join(f"`{c}` string" for c in names)
    body = lines.withColumn("_at", F.monotonically_increasing_id())
    start = body.where(F.col("value") == header[0]).agg(F.min("_at")).first()[0]
    return body.where(F.col("_at") > start).select(F.from_csv("value", F.lit(schema)).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_atomically(df: DataFrame, path: str, mode: str = "700") -> None:
    """JSON lines below path, which appears by one rename when all is written, readable by its owner only."""
    spark = df.sparkSession
    jvm = spark._jvm
    draft, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.draft", path))
    df.write.json(f"{path}.draft")
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.setPermission(draft, jvm.org.apache.hadoop.fs.permission.FsPermission(mode))
    if not files.rename(draft, target):
        raise OSError(f"{path} could not be put in place")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed order of columns. The committer makes the folder appear whole or not at all."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def guarded(df: DataFrame, forbidden: frozenset[str] = FORBIDDEN) -> DataFrame:
    """The same rows, or an error where a column must not be published."""
    if bad := sorted(forbidden & set(df.columns)):
        raise ValueError(f"columns not to be published: {bad}")
    return df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256, line_count of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "ISO-8859-1")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.regexp_count(text, F.lit("\n")).alias("line_count"))


def export_report(df: DataFrame, columns: Sequence[str], source: str, url: str, at: str) -> DataFrame:
    """Missing values of each column, sources, different urls, first and last time, in one aggregation."""
    missing = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}") for c in columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(source).alias("sources"), F.countDistinct(url).alias("unique_urls"), F.min(at).alias("first_time"), F.max(at).alias("last_time"), *missing)


def site_configs(payload: str) -> list[dict]:
    """Site configurations with defaults."""
    base = {"allowed_domains": [], "item_selectors": [], "next_selectors": [], "detail_patterns": [], "exclude_patterns": [], "list_patterns": [], "fetch_mode": "requests"}
    return [base | s for s in json.loads(payload).get("sites", [])]
