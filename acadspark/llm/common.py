"""Helpers shared by the operators of this subpackage: staging, text keys, salted ranks and byte-level hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.session import stage_dir

WORD = r"[^\x20\x09-\x0D]+"
#: While a table is written: shuffle files go once it is there, and Arrow batches hold few rows, as texts can be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def writing(spark: SparkSession):
    """The settings of WRITING, for the time of one write."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = stage_dir(spark, name)
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_keys(text: Column) -> tuple[Column, Column]:
    """96-bit identity of a text: xxHash and Murmur3."""
    return F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")


def distinct_texts(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Table of distinct texts, and its name for ``drop``.

    Distinct texts with their number of rows: (k1, k2, copies, text), null counted as empty.

    Copies are combined before the shuffle, so a text that a third of all rows share costs one row per task. The result
    is bucketed by its key in the shared folder: later joins on (k1, k2) move only the other side, never the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = text_keys(F.col("text"))
    keyed = docs.select(text.alias("text")).select("text", k1, k2)
    unique = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
    return _bucketed(unique, name)


def first_texts(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``distinct_texts``, with the smallest doc_id of each text instead of its number of rows: (k1, k2, doc, some, text).
    A null doc_id is smaller than any other; ``some`` is false for it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = text_keys(F.col("text"))
    keyed = docs.select(text.alias("text"), F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("doc")).alias("first")).select("text", k1, k2, "first")
    unique = keyed.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.any_value("text").alias("text"))
    return _bucketed(unique.select("k1", "k2", "first.doc", "first.some", "text"), name)


def _bucketed(unique: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = unique.sparkSession
    label, path = f"{name}_{uuid.uuid4().hex[:12]}", stage_dir(spark, name)
    with writing(spark):
        unique.write.bucketBy(partitions(spark), "k1", "k2").option("path", path).saveAsTable(label)
    return spark.table(label), label


def drop(texts: DataFrame, label: str) -> None:
    """Removes a table of ``distinct_texts`` once nothing reads it."""
    discard(texts)
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {label}")


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, slices: int = 1024) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within ``keys`` (any type, null is a key), ordered by a hash of ``order`` and then by it.

    A key with a third of all rows is spread: rows are numbered within (keys, slice of the hash range), and the counts of
    the slices below are added. Only those counts, at most ``slices`` per key, meet in one task.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(11), *[F.col(c) for c in order])).withColumn(
        "_slice", F.shiftright(F.col("_hash"), 65 - slices.bit_length()))
    marked = [f"_key{i}" for i in range(len(keys))]
    for mark, key in zip(marked, keys, strict=True):  # null-safe keys: a key and whether it is there
        hashed = hashed.withColumn(mark, F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn(f"{mark}_null", F.col(key).isNull())
    full = [c for m in marked for c in (m, f"{m}_null")]
    counts = hashed.groupBy(*full, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*full).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*full, "_slice", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*full, "_slice").orderBy("_hash", *order)
    numbered = hashed.withColumn("_row", F.row_number().over(inside))
    joined = numbered.join(bases, [*full, "_slice"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_row") - 1).alias(name))


# --- bytes as numpy arrays -------------------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        inverse = pow(int(BASE), -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
                      for b in (BASE, np.uint64(inverse))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` gives the hash of any stretch from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column, without copying; null is empty."""
    kind = np.int64 if "large" in str(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text stands alone. They bound the arrays of a task."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def batches(rows: dict, schema) -> Iterator:
    """One Arrow batch from numpy columns, if there are rows."""
    import pyarrow as pa

    if len(next(iter(rows.values()))):
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], names=list(rows)).cast(schema)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
