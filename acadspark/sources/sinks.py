"""Writers: keyed upserts, exports, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acadspark.operators.ranking import top_per_key


def upsert_table(current: DataFrame, batch: DataFrame, keys: tuple[str, ...], now: Column) -> DataFrame:
    """New state of a keyed table: batch rows replace stored ones and keep their ``created_at``.

    The caller writes the result to a new version path; the path being read is never overwritten.
    """
    cols = [c for c in current.columns if c not in (*keys, "created_at", "updated_at")]
    b = batch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_new"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    j = current.withColumn("_old", F.lit(True)).join(b, on, "full_outer")
    fresh = F.coalesce("_new", F.lit(False))
    return j.select(
        *[F.when(F.coalesce("_old", F.lit(False)), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in keys],
        *[F.when(fresh, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(F.coalesce("_old", F.lit(False)), F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"))


def last_per_key(batch: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Last row per key of a batch, as an aggregate."""
    rest = [c for c in batch.columns if c not in keys]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def bulk_upsert(current: DataFrame, batch: DataFrame, program_id: str, now: Column, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Upsert many rows of one program; the last row of a key in the batch counts."""
    rows = last_per_key(batch.withColumn("program_id", F.lit(program_id)), keys, order)
    return upsert_table(current, rows, keys, now)


def list_results(people: DataFrame, n: int = 10, preview: int = 3) -> DataFrame:
    """Newest ``n`` result sets (university, department) with count, time and a preview of names.

    The newest sets are found first; only their rows take part in the preview.
    """
    sets = people.groupBy("university", "department").agg(F.count("*").alias("people"), F.max("scraped_at").alias("scraped_at"))
    newest = sets.orderBy(F.desc("scraped_at"), "university", "department").limit(n)
    rows = people.select("university", "department", "obs_id", "name").join(F.broadcast(newest.select("university", "department")), ["university", "department"], "left_semi")
    first = top_per_key(rows, ("university", "department"), [F.col("obs_id")], preview)
    names = first.groupBy("university", "department").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("preview"))
    return newest.join(names, ["university", "department"])


def write_targets(df: DataFrame, path: str) -> str:
    """Write candidate targets or a report as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def export_views(views: dict[str, DataFrame], path: str, partition: dict[str, str] | None = None) -> dict[str, str]:
    """Write every view as Parquet under ``path``, partitioned where a column is named. Returns the paths."""
    out = {}
    for name, df in views.items():
        writer = df.write.mode("overwrite")
        if partition and name in partition:
            writer = writer.partitionBy(partition[name])
        out[name] = f"{path}/{name}"
        writer.parquet(out[name])
    return out


def read_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per exported view."""
    out = None
    for name, p in sorted(paths.items()):
        part = spark.read.parquet(p).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("view"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
