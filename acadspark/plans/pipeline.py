"""Jobs of several stages that go on after a failure: a stage is a written table with a mark of its completion."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from acadspark.plans import conversion, enrichment
from acadspark.plans import links as PL
from acadspark.session import measured_broadcasts

MARK = "stage string, run int, n_rows bigint, seconds double"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], path: str) -> dict[str, DataFrame]:
    """Tables of all stages. A stage takes the tables of the stages before it.

    A stage is complete once its mark is written, after its table. A call on the same path reads complete stages and goes on
    with the first other one, whose half-written table is overwritten. Rows are counted as they are written.
    """
    done: dict[str, DataFrame] = {}
    runs = 1
    if _exists(spark, f"{path}/_marks"):
        runs = 1 + max((r["run"] for r in spark.read.schema(MARK).json(f"{path}/_marks/*").select("run").collect()), default=0)  # one row per stage
    for name, stage in stages:
        table, mark = f"{path}/{name}", f"{path}/_marks/{name}"
        if not _exists(spark, f"{mark}/_SUCCESS"):
            began = time.time()
            seen = Observation()
            with measured_broadcasts(spark):  # stages join tables that are stored in few bytes
                stage(done).observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(table)
            spark.createDataFrame([(name, runs, seen.get["n_rows"], time.time() - began)], MARK).coalesce(1).write.mode("overwrite").json(mark)
        done[name] = spark.read.parquet(table)
    return done


def stage_marks(spark: SparkSession, path: str) -> DataFrame:
    """Report of a job: stage, run in which it was completed, rows and seconds."""
    return spark.read.schema(MARK).json(f"{path}/_marks/*")


def full_pipeline(spark: SparkSession, people: DataFrame, directories: DataFrame, profiles: DataFrame, form_pages: DataFrame, typed: DataFrame, enrichments: DataFrame, path: str) -> dict[str, DataFrame]:
    """The whole job: people of directories (university), sparse records filled from profile pages (sparse), missing links found
    and checked (links), pages of people's links enriched (pages), entities and views written (export, rows per view), and
    the people with what was found for them (people). Called again on the same path, it goes on where it stopped."""
    o = people.select(F.col("obs_id").alias("page_id"), "name", "university", "research_interests")
    stages = [
        ("university", lambda t: conversion.extract_university(directories)[0]),
        ("sparse", lambda t: enrichment.enhance_sparse(people, profiles)),
        ("links", lambda t: PL.find_missing_links(t["sparse"].drop("google_scholar"), form_pages)),
        ("pages", lambda t: enrichment.enrich_pages(typed, o)),
        ("export", lambda t: conversion.exported_counts(spark, t["links"].select(*people.columns), enrichments, f"{path}/views")),
        ("people", lambda t: t["links"].join(t["pages"].select(F.col("page_id").alias("obs_id"), "link_type", "content_quality", "confidence"), "obs_id", "left")),
    ]
    return run_stages(spark, stages, path)
