"""Gates for incoming files and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 60 << 20


def slug(name: Column) -> Column:
    """A document id of a file name: runs of other characters become a dash, at most 120 characters."""
    return F.substring(F.regexp_replace(name, r"[^\w.-]+", "-"), 1, 120)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, length, content) of binary files that may enter: at most MOST_BYTES and with the %PDF mark."""
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES)
    return raw.where(F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF")).select("path", slug(F.element_at(F.split("path", "/"), -1)).alias("doc_id"), "length", "content")


def to_skip(documents: DataFrame, completed: DataFrame) -> DataFrame:
    """(doc_id, content_hash, status): `done` where the same id and text has a completed run, `renamed` where only the
    text has, else `new`. documents: doc_id, text; completed: doc_id, content_hash."""
    rows = documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash")).distinct()
    known = completed.select("doc_id", "content_hash").distinct()
    by_hash = known.select("content_hash").distinct().withColumn("seen", F.lit(True))
    out = rows.join(known.withColumn("same", F.lit(True)), ["doc_id", "content_hash"], "left").join(by_hash, "content_hash", "left")
    return out.select("doc_id", "content_hash", F.when(F.col("same"), "done").when(F.col("seen"), "renamed").otherwise("new").alias("status"))


def without_document(rules: DataFrame, doc_id: str) -> DataFrame:
    """Rules of which no source span lies in the document."""
    return rules.where(~F.coalesce(F.exists("source_spans", lambda s: s["doc_id"] == doc_id), F.lit(False)))


def export_reader(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON export (one array or one object a line) with a given schema; malformed rows are null, not errors."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
