"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once(df: DataFrame, *cols: str) -> DataFrame:
    """Same rows, with the named columns computed exactly once per row.

    The optimiser pushes later filters below a projection and repeats the projected expressions in them. Costly
    columns are therefore put behind a one-element generator, which neither filters nor merged projections cross.
    All other columns pass by it, so unused ones are still pruned from the scan.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: fn(v)), 1)


def head(items: Column, n: int | None) -> Column:
    """The first ``n`` items of an array, or all of them without a number."""
    return F.slice(items, 1, n) if n else items


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row tables next to each other: stacked with nulls, then folded into one row by an aggregate."""
    out = one_row[0]
    for df in one_row[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


#: Tasks per core that an input is dealt over if it comes in few splits.
SPREAD = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over several tasks per core where it comes in fewer than that, by a hash of ``keys`` or, without any, in turn.

    No reader divides a row group, so a file of one is one task, and all that is computed from its rows runs there. An input of
    many splits stays as it is read. The setting ``spark.acadspark.scan.tasks`` names a number of tasks for local runs.
    """
    tasks = df.sparkSession.conf.get("spark.acadspark.scan.tasks", None)
    if tasks:
        return df.repartition(int(tasks))
    most = SPREAD * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most, *keys) if df.rdd.getNumPartitions() < most else df


def dealt_tasks(spark: SparkSession) -> int:
    """Tasks for rows whose work is large beside their bytes: a shuffle of few bytes would be merged into few tasks."""
    return max(SPREAD * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Words of 64 bits in a key filter: 1 MB at most, whatever the number of keys.
FILTER_WORDS = 1 << 16


def key_bits(*cols: str) -> tuple[Column, Column]:
    """Word and bits of a key in a key filter: three bits of one word."""
    h = F.xxhash64(F.lit(3), *cols)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(3)]
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_WORDS)).cast("int").alias("_word"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("_bits")


def key_filter(keys: DataFrame, *cols: str) -> DataFrame:
    """Bloom filter of the values of ``cols`` as a table (_word, _bits) of FILTER_WORDS rows at most."""
    return keys.select(*key_bits(*cols)).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def maybe_in(df: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """Rows of ``df`` whose values of ``cols`` may be among those of ``keys``: all that are, and few others. Only the filter is
    broadcast, whose size is bounded; no row of ``df`` is shuffled. Types of the columns must agree."""
    known = F.broadcast(key_filter(keys, *cols).withColumnRenamed("_bits", "_known"))
    word, bits = key_bits(*cols)
    hit = df.withColumns({"_word": word, "_bits": bits}).join(known, "_word").filter(F.col("_known").bitwiseAND(F.col("_bits")) == F.col("_bits"))
    return hit.select(*[f"`{c}`" for c in df.columns])
