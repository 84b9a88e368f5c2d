"""Entity and association tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.functions import names as N
from acadspark.functions import urls as U
from acadspark.operators import registry as R
from acadspark.operators.dedup import ORDER, _filled, _first, fold_confidence
from acadspark.session import stage_table


def with_ids(obs: DataFrame) -> DataFrame:
    """Observations with deterministic person, university, department and lab ids."""
    c = F.col
    return obs.withColumns({
        "person_id": N.person_id(N.dedup_key(c("name"), c("university"))),
        "university_id": N.university_id(c("university")),
        "department_id": N.department_id(c("university"), c("department")),
        "lab_id": N.lab_id(c("university"), c("lab_name"), c("lab_website")),
    })


#: Kinds of enrichment facts that become edges of a person.
FACT_KINDS = ("google_scholar", "links", "profile")


def with_registry_ids(obs: DataFrame, people: DataFrame, labs: DataFrame) -> DataFrame:
    """As ``with_ids``, with the ids of resolved people and labs from their registries; rows without a name are left out."""
    out = R.with_entities(R.with_entities(obs, R.person_nodes, people, "_person"), R.lab_nodes, labs, "_lab").filter("_person IS NOT NULL")
    ids = {"person_id": F.col("_person").cast("string"), "lab_id": F.col("_lab").cast("string")}
    return with_ids(out).withColumns(ids).drop("_person", "_lab")


def enrichment_edges(obs_with_ids: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges of people to their scholar, link and profile facts: enrichment_id, person_id, enrichment_type, pct."""
    return facts.filter(F.col("enrichment_type").isin(*FACT_KINDS)).select("enrichment_id", "obs_id", "enrichment_type").join(
        obs_with_ids.select("obs_id", "person_id"), "obs_id").select("enrichment_id", "person_id", "enrichment_type", F.lit(80).alias("pct"))


def person_names(obs_with_ids: DataFrame) -> DataFrame:
    """Id and name of every person, as in the table of people, without its other columns and its fold of confidences."""
    return obs_with_ids.groupBy("person_id").agg(F.min_by("name", F.struct(*ORDER)).alias("name"))


def build_entities(obs: DataFrame, staged: bool = False, registries: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Entity tables (person, university, department, lab) and edge tables (person_department, person_lab,
    lab_department, person_enrichment). Edges keep one row per observation; confidences are hundredths.

    With ``registries`` (of people and of labs) ids are those of resolved entities, which last from batch to batch.

    All tables derive from the observations with ids. With ``staged`` these are written to the shared folder first, for
    jobs that use most of the tables; without it each table is one lazy plan over the observations.
    """
    o = with_registry_ids(obs, *registries) if registries else with_ids(obs)
    o = stage_table(o, "ids") if staged else o
    in_order = F.struct(*ORDER)
    host = F.nullif(U.authority(F.col("profile_url")), F.lit(""))
    person = o.groupBy("person_id").agg(
        F.min_by("name", in_order).alias("name"), F.min_by("university_id", in_order).alias("university_id"),
        F.min_by("department_id", in_order).alias("department_id"), _first("title"), _first("email"), _first("phone"),
        _first("office"), _first("profile_url"), _first("personal_website")).join(
        fold_confidence(o, "person_id"), "person_id")
    university = o.groupBy("university_id").agg(
        F.min_by("university", in_order).alias("name"), F.coalesce(F.min_by(host, in_order), F.lit("unknown.edu")).alias("domain"))
    department = o.groupBy("department_id").agg(F.min_by("department", in_order).alias("name"), F.min_by("university_id", in_order).alias("university_id"))
    labs = o.filter("lab_id IS NOT NULL")
    lab = labs.groupBy("lab_id").agg(
        F.min_by(F.coalesce(_filled("lab_name"), F.lit("Unknown Lab")), in_order).alias("name"), F.min_by("university_id", in_order).alias("university_id"),
        F.min_by("department_id", in_order).alias("department_id"), F.min_by("lab_website", in_order).alias("website"))
    role = N.lab_role(F.col("name"), F.col("lab_name"))
    return {
        "person": person, "university": university, "department": department, "lab": lab,
        "person_department": o.select("obs_id", "person_id", "department_id", "title", F.lit("primary").alias("appointment"), F.lit(90).alias("pct")),
        "person_lab": labs.select("obs_id", "person_id", "lab_id", role.alias("role"), F.lit(70).alias("pct"), F.lit("pending_verification").alias("status")),
        "lab_department": lab.select("lab_id", "department_id", F.lit(80).alias("pct")),
        "person_enrichment": o.filter(_filled("research_interests").isNotNull()).select(
            "obs_id", "person_id", F.lit("profile").alias("enrichment_type"), F.lit(80).alias("pct")),
    }
