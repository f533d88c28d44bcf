"""Incremental replay of the assertion log with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rulegrid.operators.changes import in_force
from rulegrid.operators.links import swept


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of Parquet files; its schema is that of the folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Parts that the log is cut into by identity and by seq, so that a batch reads only those that it touches.
BUCKETS = 256


def _bucket(column: str):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(BUCKETS)).cast("int")


def _hit(path: str, like: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The part of a bucketed table, of the schema of `like`, that can hold these values: at most BUCKETS numbers go
    through the driver, and the folders of the others are not read."""
    wanted = [r.b for r in rows.select(_bucket(column).alias("b")).distinct().collect()]
    return rows.sparkSession.read.schema(like.schema).parquet(path).where(F.col("bucket").isin(wanted))


def keep_current(stream: DataFrame, log_path: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Appends each batch to the log at `log_path` and gives `write` the current state of the identities it touches.

    Retroactive rows of any age are legal, so there is no watermark: a batch is appended, and only the identities it
    names, or whose rows it corrects, are replayed. The log lies there three times, each bucketed by what it is asked
    for: rows by identity, identities by seq, corrections by the seq they void. `write` gets (identity_hash, full_hash,
    in_force). A batch that is run again overwrites its own part, so replaying after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("identity_hash", F.lower("identity_hash"))
        parts = {
            "rows": rows.withColumn("bucket", _bucket("identity_hash")),
            "seqs": rows.select("seq", "identity_hash").where("identity_hash IS NOT NULL").distinct().withColumn("bucket", _bucket("seq")),
            "voids": rows.where("corrects_seq IS NOT NULL").select(F.col("corrects_seq").alias("seq")).distinct().withColumn("bucket", _bucket("seq")),
        }
        for name, part in parts.items():
            part.write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/{name}/batch={number}")
        fixes = rows.where("corrects_seq IS NOT NULL").select(F.col("corrects_seq").alias("seq")).distinct()
        corrected = _hit(f"{log_path}/seqs", parts["seqs"], fixes, "seq").join(fixes, "seq", "left_semi").select("identity_hash")
        touched = rows.where("identity_hash IS NOT NULL").select("identity_hash").unionByName(corrected).distinct()
        mine = _hit(f"{log_path}/rows", parts["rows"], touched, "identity_hash").join(touched, "identity_hash", "left_semi").drop("bucket")
        # A correction may stand under another identity: what voids these rows is found by their seq.
        kept = mine.join(_hit(f"{log_path}/voids", parts["voids"], mine, "seq").select("seq").distinct(), "seq", "left_anti").withColumn("corrects_seq", F.lit(None).cast("long"))
        state = in_force(kept)
        write(touched.join(state, "identity_hash", "left").withColumn("in_force", F.col("full_hash").isNotNull()), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry(clauses: DataFrame, queue_path: str, checkpoint: str) -> StreamingQuery:
    """Tries the queue of citations anew with each batch of clauses that arrives.

    The queue lies at `queue_path`/version=n, version 0 being the first; batch n reads version n and writes n + 1 with one
    attempt more: resolved and abandoned citations keep their state, as in rulegrid.operators.links.swept. A batch that is
    run again writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        queue = batch.sparkSession.read.parquet(f"{queue_path}/version={number}")
        tried = swept(queue, batch).select(F.col("citation_id").alias("id"), F.col("state").alias("now"), F.col("attempts").alias("tries"), F.col("clause_id").alias("found"))
        done = queue.join(tried, "id", "left").withColumns({"state": F.coalesce("now", "state"), "attempts": F.coalesce("tries", "attempts"), "resolved_clause_id": F.coalesce("found", "resolved_clause_id")})
        done.select(queue.columns).write.mode("overwrite").parquet(f"{queue_path}/version={number + 1}")

    return clauses.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, end, event_type, events, total) by event-time window, for events at most `late` behind. An addition; the
    replay above is what the log needs."""
    spans = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(spans.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counted.select("w.start", "w.end", "event_type", "events", "total")
