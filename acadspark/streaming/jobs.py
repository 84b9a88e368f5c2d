"""Incremental jobs with Structured Streaming.

Sources are directories of Parquet files. Sinks are idempotent: a repeated micro-batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from acadspark.operators import links as L


def read_dir(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _append(df: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out_path)


def _timed(log: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as a zoned time stamp (tables store it without zone, in UTC) with its watermark."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_upsert(stream: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch as one delta partition; ``current_table`` resolves the deltas on read.

    A batch costs its own size, whatever the size of the table, and a replayed batch replaces its own partition.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_table(deltas: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ts: str) -> DataFrame:
    """State of an upserted table: the last row per key, when it was first and last seen. Rows of a compacted table among
    the deltas keep their created_at and updated_at."""
    known = [c for c in ("created_at", "updated_at") if c in deltas.columns]
    rest = [c for c in deltas.columns if c not in (*keys, "batch_id", *known)]
    first, last = (F.coalesce(c, ts) if c in known else F.col(ts) for c in ("created_at", "updated_at"))
    number = F.coalesce("batch_id", F.lit(-1)) if "batch_id" in deltas.columns else F.lit(-1)
    got = deltas.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(number.alias("batch_id"), *order)).alias("b"), F.min(first).alias("created_at"), F.max(last).alias("updated_at"))
    return got.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest], "created_at", "updated_at")


def compact_table(spark: SparkSession, path: str, compacted: str, keys: tuple[str, ...], order: tuple[str, ...], ts: str, upto: int | None = None) -> DataFrame:
    """Folds the deltas of an upserted table (up to batch ``upto``) into one row per key in a new folder. Later deltas go
    beside it: ``with_deltas`` reads both."""
    deltas = spark.read.parquet(path)
    current_table(deltas if upto is None else deltas.filter(F.col("batch_id") <= upto), keys, order, ts).write.mode("overwrite").parquet(compacted)
    return spark.read.parquet(compacted)


def with_deltas(compacted: DataFrame, deltas: DataFrame, after: int, keys: tuple[str, ...], order: tuple[str, ...], ts: str) -> DataFrame:
    """State of a compacted table and the deltas after batch ``after``."""
    return current_table(compacted.unionByName(deltas.filter(F.col("batch_id") > after), allowMissingColumns=True), keys, order, ts)


def stream_categorize(links: DataFrame, out_path: str, checkpoint: str, col: str = "url") -> StreamingQuery:
    """Class links as they arrive."""
    return _append(L.categorize_url(links, col), out_path, checkpoint)


def stream_first_seen(log: DataFrame, out_path: str, checkpoint: str, key: str = "url", ts: str = "ts", watermark: str = "10 minutes") -> StreamingQuery:
    """First row per key within the watermark delay."""
    return _append(_timed(log, ts, watermark).dropDuplicatesWithinWatermark([key]), out_path, checkpoint)


def stream_progress(log: DataFrame, out_path: str, checkpoint: str, ts: str = "ts", window: str = "1 minute", slide: str | None = None,
                    watermark: str = "10 minutes") -> StreamingQuery:
    """Requests, errors and load time per host and window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = _timed(log, ts, watermark).groupBy(w, "host").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.round(F.sum("load_ms"), 3).alias("load_ms"))
    return _append(counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "host", "requests", "errors", "load_ms"), out_path, checkpoint)


def stream_sessions(log: DataFrame, out_path: str, checkpoint: str, ts: str = "ts", gap: str = "30 minutes", watermark: str = "10 minutes") -> StreamingQuery:
    """Crawl sessions per host: pages until a gap. Sessions are merged within each task before the shuffle, so a busy host
    sends one row per task and session."""
    log.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    s = _timed(log, ts, watermark).groupBy(F.session_window(ts, gap).alias("s"), "host").agg(F.count("*").alias("pages"))
    return _append(s.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "host", "pages"), out_path, checkpoint)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
