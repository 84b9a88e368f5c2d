"""Per-person and per-lab views over entity, edge and enrichment tables.

Views are long: one row per edge, joined to the entity it points to. A person or lab with very many edges stays many
rows, which adaptive execution can split, instead of one list in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acadspark.functions.steps import side_by_side
from acadspark.operators.ranking import top_per_key

# fixed values: list caps per enrichment type
CAPS = (("publications", 10), ("co_authors", 15), ("members", 20), ("projects", 10), ("equipment", 15), ("funding", 10))


def person_institution(person: DataFrame, university: DataFrame, department: DataFrame) -> DataFrame:
    """Person with names of university and primary department."""
    u = university.select("university_id", F.col("name").alias("university_name"), "domain")
    d = department.select("department_id", F.col("name").alias("department_name"))
    return person.join(u, "university_id", "left").join(d, "department_id", "left")


def with_edges(entities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Every entity with its edges, one row each, entities without edges included.

    Same as a left join. The edge side of a left join cannot be split when one entity owns most edges, an inner join
    can; entities without edges are added by an anti join against the distinct keys.
    """
    alone = entities.join(edges.select(key).distinct(), key, "left_anti")
    return entities.join(edges, key).unionByName(alone, allowMissingColumns=True)


def person_departments(person: DataFrame, edges: DataFrame, department: DataFrame) -> DataFrame:
    """One row per person and department edge."""
    d = department.select("department_id", F.col("name").alias("department_name"))
    e = edges.select("person_id", "department_id", "obs_id", "appointment", "pct").join(d, "department_id", "left")
    return with_edges(person.select("person_id", "name"), e, "person_id")


def person_labs(person: DataFrame, edges: DataFrame, lab: DataFrame, key: str = "person_key") -> DataFrame:
    """One row per person and lab edge, people without one included."""
    return with_edges(person, edges.join(lab, "lab_key", "left"), key)


def person_enrichments(edges: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Edges joined to their enrichment by id and type."""
    return edges.join(enrichments, ["enrichment_id", "enrichment_type"])


def lab_people(lab: DataFrame, edges: DataFrame, person: DataFrame, types: DataFrame) -> DataFrame:
    """One row per lab and member with the member's number of enrichment types."""
    n = types.groupBy("person_key").agg(F.count_distinct("enrichment_type").alias("n_types"))
    return lab.join(edges, "lab_key").join(person, "person_key").join(n, "person_key", "left")


def orphans(entities: DataFrame, key: str, *edges: DataFrame) -> DataFrame:
    """Entities without any edge."""
    linked = edges[0].select(key).distinct()
    for e in edges[1:]:
        linked = linked.unionByName(e.select(key).distinct())
    return entities.join(linked, key, "left_anti")


def attach_lab_data(people: DataFrame, labs: DataFrame, on: str) -> DataFrame:
    """Attach the extracted lab record to people."""
    return people.join(labs, on, "left")


def primary_lab(edges: DataFrame) -> DataFrame:
    """Primary lab per person: the first edge as principal investigator, else the first current edge."""
    pi = F.col("role") == "Principal Investigator"
    usable = edges.filter(F.coalesce(pi, F.lit(False)) | F.col("is_current"))
    rank = F.when(pi, 0).otherwise(1)
    return usable.groupBy("person_key").agg(F.min_by(F.struct("lab_key", "role"), F.struct(rank, "created_at", "edge_id", "lab_key")).alias("b")).select(
        "person_key", "b.lab_key", "b.role")


def current_members(edges: DataFrame) -> DataFrame:
    """Current members per lab with their role, 'member' by default."""
    return edges.filter("is_current").select("lab_key", "person_key", F.coalesce("role", F.lit("member")).alias("role"))


def lab_metrics(edges: DataFrame, website: Column | None = None) -> DataFrame:
    """Members, principal investigators and completeness per lab."""
    site = F.max(website) if website is not None else F.lit(None)
    return edges.groupBy("lab_key").agg(
        F.count("*").alias("member_count"), F.count_if(F.col("role") == "Principal Investigator").alias("pi_count"), site.alias("site"),
    ).withColumns({"is_multi_pi": F.col("pi_count") > 1, "completeness": F.when(F.coalesce("site", F.lit("")) != "", 0.8).otherwise(0.3)}).drop("site")


def age_days(ts: Column, now: Column) -> Column:
    """Whole days between, by elapsed time."""
    return F.floor(F.timestamp_diff("MICROSECOND", ts, now) / F.lit(86_400_000_000))


def age_freshness(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """Age in days, linear decay over 30 days and the band of the age."""
    days = age_days(F.col(ts), now)
    return df.withColumn("age_days", days).withColumns({
        "freshness": F.greatest(F.lit(0.0), 1.0 - F.col("age_days") / 30.0),
        "band": F.when(F.col("age_days") < 1, "fresh").when(F.col("age_days") < 30, "aging").otherwise("stale")})


def person_metrics(enrichments: DataFrame, now: Column, sources: str) -> DataFrame:
    """Enrichments, completeness, mean freshness and distinct sources per person.

    Ages become integer day counts, so that the mean does not depend on the order of addition.
    """
    left = F.greatest(F.lit(0), 30 - age_days(F.col("extracted_at"), now))
    return enrichments.groupBy("person_key").agg(
        F.count("*").alias("total_enrichments"), F.round(F.least(F.lit(1.0), F.count("*") / 5.0), 6).alias("completeness"),
        F.round(F.sum(left) / (F.count("*") * 30.0), 6).alias("freshness"), F.count_distinct(sources).alias("n_sources"))


def citation_latest(enrichments: DataFrame) -> DataFrame:
    """Latest scholar metrics per person, nulls where none."""
    scholar = F.col("enrichment_type") == "google_scholar"
    order = F.when(scholar, F.struct("extracted_at", "enrichment_id", "lab_key"))
    return enrichments.groupBy("person_key").agg(F.max_by(F.struct("total_citations", "h_index"), order).alias("m")).select(
        "person_key", "m.total_citations", "m.h_index")


def top_cited(enrichments: DataFrame, n: int = 10) -> DataFrame:
    """Most cited rows per person."""
    return top_per_key(enrichments, ("person_key",), [F.desc("total_citations"), F.col("enrichment_id"), F.col("extracted_at"), F.col("lab_key")], n)


def cap_lists(rows: DataFrame, caps: dict[str, int], kind: str, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Keep the first rows per key and kind, as many as the cap of the kind."""
    cap = F.lit(max(caps.values()))
    for k, n in caps.items():
        cap = F.when(F.col(kind) == k, n).otherwise(cap)
    ranked = top_per_key(rows, (*key, kind), order, max(caps.values()))
    return ranked.filter(F.col("rank") <= cap)


def contact_summary(people: DataFrame, extra: DataFrame, on: str) -> DataFrame:
    """Contact fields as rows (on, field, value): the base overlaid by the enrichment, empty ones left out."""
    new = extra.select(on, *[F.col(c).alias(f"_{c}") for c in extra.columns if c != on])
    joined = people.join(new, on, "left")
    rows = []
    for f in ("email", "phone", "office", "profile_url", "personal_website"):
        value = F.coalesce(F.nullif(f"_{f}", F.lit("")), F.col(f)) if f in extra.columns else F.col(f)
        rows.append(F.struct(F.lit(f).alias("field"), value.alias("value")))
    return joined.select(on, F.inline(F.array(*rows))).filter(F.coalesce("value", F.lit("")) != "")


def relationship_map(e: dict[str, DataFrame], enrichments: DataFrame) -> DataFrame:
    """One row: entities, edges and enrichments, mean confidence, completeness and orphans.

    Every table is reduced to one row before the rows are put side by side.
    """
    def n(df, name):
        return df.agg(F.count("*").alias(name))

    types = enrichments.groupBy("enrichment_type").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_enrichments"), *[F.coalesce(F.sum(F.when(F.col("enrichment_type") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}")
                                             for t in ("google_scholar", "profile", "links", "research")])
    conf = e["person"].agg(F.count("*").alias("n_people"), F.sum(F.floor(F.col("confidence") * 1_000_000 + 0.001)).alias("_person_micro"))
    parts = [
        conf, n(e["lab"], "n_labs"), n(e["university"], "n_universities"), n(e["department"], "n_departments"),
        n(e["person_lab"], "n_person_lab"), n(e["person_department"], "n_person_department"), n(e["lab_department"], "n_lab_department"), types,
        n(orphans(e["person"], "person_id", e["person_department"], e["person_lab"]), "orphan_people"),
        n(orphans(e["lab"], "lab_id", e["person_lab"]), "orphan_labs"),
    ]
    out = side_by_side(*parts)
    mean = F.try_divide(F.col("_person_micro") + F.col("n_labs") * 700_000, (F.col("n_people") + F.col("n_labs")) * 1_000_000.0)
    full = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("n_enrichments"), F.col("n_people") * 3.0)), F.lit(0.0))
    return out.withColumns({"average_confidence": F.round(F.coalesce(mean, F.lit(0.0)), 6), "data_completeness": F.round(full, 6)}).drop("_person_micro")


def distinct_sources(*sources: DataFrame) -> DataFrame:
    """Distinct contributing URLs per person over several (person_key, url) tables."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.distinct()


CHUNK = 1000


def documents(entity: DataFrame, key: str, lists: dict[str, tuple[DataFrame, str, list[str]]], chunk: int = CHUNK) -> DataFrame:
    """(key, part, n, json): nested JSON documents of entities, in parts of bounded size.

    ``lists`` names each list with its edges, their id column (a unique integer) and the columns to keep. Every part holds the
    edges whose ids lie in one stretch of ``chunk`` ids, so a key with a third of all edges is many documents and no list grows;
    part -1 is the entity itself, with the number of entries per list. A document of a part has the key, the part and its lists.
    """
    head = entity
    parts = None
    for name, (edges, edge_id, cols) in lists.items():
        keyed = edges.select(key, F.floor(F.col(edge_id) / chunk).alias("part"), F.struct(F.col(edge_id).alias("id"), *cols).alias("item"))
        counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        head = head.join(counts, key, "left").fillna(0, [f"n_{name}"])
        grouped = keyed.groupBy(key, "part").agg(F.sort_array(F.collect_list("item")).alias(name))
        packed = grouped.select(key, "part", F.lit(name).alias("list"), F.size(name).cast("bigint").alias("n"), F.to_json(F.struct(key, F.lit(name).alias("list"), F.col(name).alias("items")), {"ignoreNullFields": "false"}).alias("json"))
        parts = packed if parts is None else parts.unionByName(packed)
    whole = head.select(key, F.lit(-1).cast("bigint").alias("part"), F.lit("entity").alias("list"), F.lit(1).cast("bigint").alias("n"), F.to_json(F.struct(*head.columns), {"ignoreNullFields": "false"}).alias("json"))
    return whole.unionByName(parts) if parts is not None else whole
