"""Jobs that turn scraped people into stored entities, views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from acadspark.functions import names as N
from acadspark.operators import dedup as D
from acadspark.operators import entities as E
from acadspark.operators import links as L
from acadspark.operators import listings as H
from acadspark.operators import ranking as R
from acadspark.operators import views as V
from acadspark.plans.links import better_links
from acadspark.session import stage_table
from acadspark.sources.sinks import export_views, read_counts


def extract_university(directories: DataFrame, max_people: int | None = None) -> tuple[DataFrame, DataFrame]:
    """People of directory pages, deduplicated over departments. Returns (people, people per department)."""
    found = H.directory_people(directories, ("page_id", "university", "department"))
    return university_people(found.orderBy("department", "profile_url").limit(max_people) if max_people else found)


def university_people(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``extract_university`` on listing entries that are read already."""
    keyed = found.withColumn("dedup_key", N.dedup_key(F.col("name"), F.col("university")))
    order = F.struct("department", "profile_url")
    people = keyed.groupBy("dedup_key").agg(
        F.count("*").alias("n_records"), F.min_by("name", order).alias("name"), F.count_distinct("department").alias("n_departments"),
        F.min_by("email", F.when(F.coalesce("email", F.lit("")) != "", order)).alias("email"))
    return people, found.groupBy("university", "department").agg(F.count("*").alias("people"))


OVERVIEW = ("people", "people_per_department", "departments", "labs")


def university_overview(directories: DataFrame, sources: list[DataFrame], records: DataFrame, target: str | None = None, parts: tuple[str, ...] = OVERVIEW) -> dict[str, DataFrame]:
    """People of a university's directories with their departments and labs: all tables, or those named in ``parts``. Pages are read
    once, and only for the tables that come from them.

    ``people`` and ``people_per_department`` are those of ``extract_university``; ``departments`` are the department pages of
    several ``sources`` (url, seq, university, department), first source first, ranked as directories within their university;
    ``labs`` rolls up the labs that the people's ``records`` name.
    """
    out = {}
    if not {"people", "people_per_department"}.isdisjoint(parts):
        listed = H.directory_people(directories, ("page_id", "university", "department")).select("university", "department", "name", "email", "profile_url")
        out["people"], out["people_per_department"] = university_people(stage_table(listed, "listed"))
    if "departments" in parts:
        ranked = R.rank_departments(D.combine_departments(*sources), "department", "url", target)
        out["departments"] = ranked.withColumn("rank", F.row_number().over(W.partitionBy("university").orderBy(F.desc("points"), "url")))
    if "labs" in parts:
        out["labs"] = D.lab_rollup(records)[0]
    return out


def convert_and_export(people: DataFrame, enrichments: DataFrame, path: str) -> dict[str, str]:
    """Build entity and edge tables, per-person and per-lab views and the relationship map, and write them.

    Entity tables are written first and the views read the written tables, so nothing is computed twice.
    """
    spark = people.sparkSession
    paths = export_views(E.build_entities(people, staged=True), path)
    e = {name: spark.read.parquet(p) for name, p in paths.items()}
    views = {
        "view_person_institution": V.person_institution(e["person"], e["university"], e["department"]),
        "view_person_department": V.person_departments(e["person"], e["person_department"], e["department"]),
        "view_relationship_map": V.relationship_map(e, enrichments),
    }
    return {**paths, **export_views(views, path)}


def exported_counts(spark: SparkSession, people: DataFrame, enrichments: DataFrame, path: str) -> DataFrame:
    """``convert_and_export``, and the rows of every written table: view, n_rows."""
    return read_counts(spark, convert_and_export(people, enrichments, path))


def full_refresh(spark: SparkSession, people: DataFrame, fetches: DataFrame, enrichments: DataFrame, fetch, path: str) -> DataFrame:
    """Validate, replace, resolve and convert, every stage written before the next one reads it. Returns rows per stage."""
    linked = stage_table(L.attach_links(people), "linked")  # people are read and their links classed once for all stages
    first = export_views({"checked_links": L.link_accessibility(L.link_table(linked), fetches)}, path)
    report = L.validated_report(spark.read.parquet(first["checked_links"]), linked.agg(F.count("*").alias("people")))
    first |= export_views({"link_report": report}, path)
    better = better_links(linked, stage_table(fetch, "candidate_pages"))
    second = export_views({"people": better.drop("replacement_reasons")}, path)
    stored = spark.read.parquet(second["people"])
    third = export_views({"merged_people": D.merge_people(D.resolve_person(stored.select(*people.columns)))}, path)
    fourth = convert_and_export(stored.select(*people.columns), enrichments, path)
    paths = {**first, **second, **third, **fourth}
    out = None
    for name, p in sorted(paths.items()):
        part = spark.read.parquet(p).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
