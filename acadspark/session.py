"""Session and checkpoint helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "acadspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; the cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",  # a batch may hold whole pages
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Taken from ``spark.checkpoint.dir`` (or a checkpoint folder already set on the context). A cluster must name one; only
    a local session without it uses a folder in its warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage_dir(spark: SparkSession, name: str) -> str:
    """Fresh sub-folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor does not replay the whole history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    For tables that several plans read: computed once, survives lost executors, and every reader prunes its columns.
    """
    path = stage_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Largest side of a join to broadcast, by estimate and by measure.
BY_ESTIMATE, BY_MEASURE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within, joins are planned and run that broadcast only what has been measured, up to the session's own limit.

    A stored table is estimated by its bytes on disk. Repeated values take a small part there of what they take in the driver, and
    rows made from a table (a dozen forms of each name) are estimated by that table, so that far more than the limit is sent.
    """
    before = {k: spark.conf.get(k, None) for k in (BY_ESTIMATE, BY_MEASURE)}
    spark.conf.set(BY_MEASURE, before[BY_MEASURE] or spark.conf.get(BY_ESTIMATE))
    spark.conf.set(BY_ESTIMATE, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
