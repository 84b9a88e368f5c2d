"""Keyed state in streams: an upserted table with expiry, and first rows per key where one key may be very common."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acadspark.streaming.jobs import _append, _timed

BUCKETS = 64


def stream_latest(stream: DataFrame, out_path: str, checkpoint: str, key: str, ts: str, order: str, ttl: int, watermark: str = "0 seconds") -> StreamingQuery:
    """Upserted table with one row per key: the last row by (ts, order), created_at and updated_at; a key without rows for
    ``ttl`` seconds of event time leaves it. Rows that are not newer than the watermark are late and change nothing, nor do
    rows without a time.

    The table is the state. A batch is reduced to a row per key and folded with the buckets of its keys, by one aggregate;
    these are written anew, in a version of the batch's number, which a repeated batch overwrites. The watermark of a version
    (the latest time so far less the delay) is part of its folder's name, so keys of buckets that no batch touches end on read.
    """
    columns = [c for c in stream.columns if c != key]

    def folded(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*columns), F.struct(ts, order, "held")).alias("r")
        return rows.groupBy("bucket", key).agg(best, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")).select("bucket", key, "r.*", "created_at", "updated_at")

    def merge(batch: DataFrame, number: int) -> None:
        held, mark = _newest(batch.sparkSession, out_path, number)
        timed = batch.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull() if mark is None else F.col(ts) > F.timestamp_micros(F.lit(mark)))
        timed = timed.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), "created_at": F.col(ts), "updated_at": F.col(ts), "held": F.lit(False)})
        rows = folded(timed).persist()
        try:
            seen = rows.groupBy("bucket").agg(F.unix_micros(F.max("updated_at") - F.expr(f"INTERVAL {watermark}")).alias("mark")).collect()  # BUCKETS at most
            if not seen:
                return
            now = max([r["mark"] for r in seen] + ([] if mark is None else [mark]))
            whole = rows
            if held is not None:
                old = held.filter(F.col("bucket").isin([r["bucket"] for r in seen])).select(*rows.columns, F.lit(True).alias("held"))
                whole = folded(old.unionByName(rows.withColumn("held", F.lit(False))))
            ends = F.col("updated_at") + F.make_interval(secs=F.lit(ttl))
            whole = whole.withColumn("ends_at", ends).filter(F.col("ends_at") >= F.timestamp_micros(F.lit(now))).withColumn("gone", F.lit(False))
            empty = batch.sparkSession.createDataFrame([(r["bucket"], True) for r in seen], "bucket int, gone boolean")  # an emptied bucket has a version as well
            whole = whole.unionByName(empty, allowMissingColumns=True).withColumns({"version": F.lit(number), "mark": F.lit(now)})
            whole.repartition("bucket").write.mode("overwrite").partitionBy("version", "mark", "bucket").option("partitionOverwriteMode", "dynamic").parquet(out_path)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame | None, int | None]:
    """Live rows of the newest version of every bucket and the watermark in microseconds, or (None, None) without any version.
    Versions and watermarks are partition folders: which to read is known without their rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None, None
    table = spark.read.parquet(path)
    versions = table.select("version", "mark", "bucket").distinct()
    if before is not None:
        versions = versions.filter(F.col("version") < before)
    newest = versions.groupBy("bucket").agg(F.max("version").alias("v"), F.max("mark").alias("mark")).collect()  # BUCKETS at most
    if not newest:
        return None, None
    keep = F.lit(False)
    for r in newest:
        keep = keep | ((F.col("bucket") == r["bucket"]) & (F.col("version") == r["v"]))
    mark = max(r["mark"] for r in newest)
    return table.filter(keep & ~F.col("gone") & (F.col("ends_at") >= F.timestamp_micros(F.lit(mark)))).drop("version", "mark", "gone", "ends_at"), mark


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows of an upserted table with state, as of its last batch or of that before ``before``."""
    table, _ = _newest(spark, path, before)
    if table is None:
        raise FileNotFoundError(path)
    return table


def first_of_parts(log: DataFrame, key: str, ts: str) -> DataFrame:
    """The first row of every key in each Arrow batch of each task: a key of a third of all rows shrinks to a row per some
    thousands before anything is shuffled."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield part.sort_values(ts, kind="stable").drop_duplicates(key)

    return log.mapInPandas(run, log.schema)


def stream_first_rows(log: DataFrame, out_path: str, checkpoint: str, key: str = "url", ts: str = "ts", watermark: str = "10 minutes") -> StreamingQuery:
    """First rows per key within the watermark delay in two levels: within the parts of a micro-batch, then by key in state."""
    return _append(_timed(first_of_parts(log, key, ts), ts, watermark).dropDuplicatesWithinWatermark([key]), out_path, checkpoint)
