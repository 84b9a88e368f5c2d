"""Duplicate people and labs: keys, connected groups, merged records and set unions.

Multi-valued attributes stay in long form, one row per (key, kind, value). A key that holds a large share of all rows
is then reduced by the partial aggregation of every task, and no list of unbounded length is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from acadspark.functions import names as N
from acadspark.functions import text as X
from acadspark.session import cut_lineage

ORDER = ("scraped_at", "obs_id")


def _filled(name: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))


def _first(name: str) -> Column:
    """First filled value in scrape order."""
    return F.min_by(name, F.when(_filled(name).isNotNull(), F.struct(*ORDER))).alias(name)


def person_values(obs: DataFrame, key: str) -> DataFrame:
    """Distinct (key, kind, value) rows of departments, links, interests and labs."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (
            ("department", "department"), ("link", "profile_url"), ("link", "personal_website"), ("link", "lab_website"), ("lab", "lab_name"))]),
        F.transform(X.interests(F.col("research_interests")), lambda i: F.struct(F.lit("interest").alias("kind"), i.alias("value"))),
    )
    return obs.select(key, F.inline(pairs)).filter("value IS NOT NULL AND value <> ''").distinct()


def value_counts(values: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """Number of distinct values per key and kind."""
    return values.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in kinds])


def dedup_people(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group observations by university and first and last name. Returns (people, values)."""
    keyed = obs.withColumn("dedup_key", N.dedup_key(F.col("name"), F.col("university")))
    people = keyed.groupBy("dedup_key").agg(
        F.count("*").alias("n_obs"), F.min_by("name", F.struct(*ORDER)).alias("name"),
        F.min_by("department", F.struct(*ORDER)).alias("department"), _first("title"), _first("email"))
    values = person_values(keyed, "dedup_key")
    counts = value_counts(values, "dedup_key", ("department", "link", "interest", "lab"))
    return people.join(counts, "dedup_key", "left").fillna(0, [f"n_{k}s" for k in ("department", "link", "interest", "lab")]), values


def connected_groups(nodes: DataFrame, node: str, hubs: tuple[str, ...]) -> DataFrame:
    """Connected groups of nodes that share a hub value. Returns (node, root), root being the smallest node id.

    Every round takes the smallest label per hub value, then per node, and follows labels to their own labels, which
    halves long chains. The work per round is one aggregate and one join per hub; pairs of a busy hub are never
    formed. Rounds end when no label changes. Each round is checkpointed in the shared folder.
    """
    links = nodes.select(F.col(node).alias("id"), F.explode(F.array(*[
        F.when(F.col(h).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(h))) for i, h in enumerate(hubs)])).alias("hub")).filter("hub IS NOT NULL")
    links = cut_lineage(links)
    labels = nodes.select(F.col(node).alias("id"), F.col(node).alias("root"))
    while True:
        per_hub = links.join(labels, "id").groupBy("hub").agg(F.min("root").alias("hub_root"))
        offered = links.join(per_hub, "hub").groupBy("id").agg(F.min("hub_root").alias("offer"))
        step = labels.join(offered, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        up = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        moved = step.join(up, "root").select("id", "old", F.least("root", "up").alias("root"))
        moved = cut_lineage(moved)
        labels = moved.select("id", "root")
        if moved.filter("root <> old").isEmpty():
            return labels.select(F.col("id").alias(node), "root")


def resolve_person(obs: DataFrame) -> DataFrame:
    """Observations with ``entity``: same name key and same e-mail or same university, followed transitively.

    Observations are first reduced to distinct (name, e-mail, university) nodes. An unknown university matches nothing,
    and rows without a name are left out: ``nameless`` lists them as issues.
    """
    keyed = obs.withColumns({"name_key": N.person_key(F.col("name")), "uni_key": F.coalesce(N.institution_key(F.col("university")), F.lit("")), "mail": F.lower(_filled("email"))})
    keyed = keyed.filter(F.coalesce("name_key", F.lit("")) != "")
    nodes = cut_lineage(keyed.groupBy("name_key", "uni_key", "mail").agg(F.min("obs_id").alias("node")))
    hubs = nodes.withColumns({
        "by_mail": F.when(F.col("mail").isNotNull(), F.concat_ws("|", "name_key", "mail")), "by_uni": F.when(F.col("uni_key") != "", F.concat_ws("|", "name_key", "uni_key"))})
    roots = connected_groups(hubs, "node", ("by_mail", "by_uni"))
    entity = nodes.join(roots, "node").select(F.col("name_key").alias("_n"), F.col("uni_key").alias("_u"), F.col("mail").alias("_m"), F.col("root").alias("entity"))
    same = (F.col("name_key") == F.col("_n")) & (F.col("uni_key") == F.col("_u")) & F.col("mail").eqNullSafe(F.col("_m"))
    return keyed.join(entity, same).select(*obs.columns, "name_key", "entity")


def nameless(obs: DataFrame) -> DataFrame:
    """Issue rows of observations that cannot become a person: obs_id, issue."""
    key = F.coalesce(N.person_key(F.col("name")), F.lit(""))
    return obs.filter(key == "").select("obs_id", F.lit("missing name").alias("issue"))


def resolve_lab(obs: DataFrame) -> DataFrame:
    """Distinct (lab name key, web site) nodes with ``lab_entity``: same name key or same site, transitively."""
    labs = obs.select(F.when(_filled("lab_name").isNotNull(), N.institution_key(F.col("lab_name"))).alias("lab_key"), _filled("lab_website").alias("site"), "obs_id")
    nodes = cut_lineage(labs.filter("lab_key IS NOT NULL OR site IS NOT NULL").groupBy("lab_key", "site").agg(F.min("obs_id").alias("node")))
    roots = connected_groups(nodes, "node", ("lab_key", "site"))
    return nodes.join(roots, "node").select("lab_key", "site", F.col("root").alias("lab_entity"))


def six_places(col: Column) -> Column:
    """Value cut to six places. Folded hundredths end in exact halves, which two engines may round differently."""
    return F.floor(col * 1_000_000 + 0.001) / F.lit(1_000_000.0)


def fold_confidence(rows: DataFrame, key: str, first: float = 0.8, later: float = 0.5) -> DataFrame:
    """Ordered fold c = (c + new) / 2 per key, starting from the first value. Returns (key, n_merged, confidence).

    Unrolled, the last value weighs 1/2, the one before 1/4 and so on, the first one twice its share. The fold of a day is
    the map c -> c / 2^m + offset; the maps of a key's days are joined in order, the later days shifting the earlier. No
    row is left out, and a key with a large share of all rows is split by day.
    """
    ordered = rows.select(key, *ORDER, "confidence_score", F.to_date("scraped_at").alias("day"))
    place = F.row_number().over(W.partitionBy(key, "day").orderBy(*[F.desc(c) for c in ORDER]))
    half = lambda n: F.pow(F.lit(0.5), n)
    days = ordered.withColumn("place", place).groupBy(key, "day").agg(
        F.count("*").alias("m"), F.sum(F.coalesce("confidence_score", F.lit(later)) * half(F.col("place"))).alias("offset"), F.min_by(F.struct("confidence_score"), F.struct(*ORDER)).alias("s"))
    after = F.coalesce(F.sum("m").over(W.partitionBy(key).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = days.withColumn("after", after).groupBy(key).agg(
        F.sum("m").alias("n_merged"), F.sum(F.col("offset") * half(F.col("after"))).alias("c"), F.min_by("s", F.struct("day")).alias("s"))
    extra = 2 * F.coalesce("s.confidence_score", F.lit(first)) - F.coalesce("s.confidence_score", F.lit(later))
    return joined.select(key, "n_merged", (F.col("c") + extra * half(F.col("n_merged"))).alias("confidence"))


def merge_people(resolved: DataFrame, key: str = "entity") -> DataFrame:
    """One record per resolved person: first e-mail and phone, longest title (earliest on ties), folded confidence."""
    longest = F.max_by("title", F.when(_filled("title").isNotNull(), F.struct(F.length("title"), -F.unix_micros(F.col("scraped_at").cast("timestamp")), -F.col("obs_id"))))
    merged = resolved.groupBy(key).agg(F.min_by("name", F.struct(*ORDER)).alias("name"), _first("email"), _first("phone"), longest.alias("title"))
    return merged.join(fold_confidence(resolved, key), key)


def lab_rollup(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labs by lower-case name. Returns (labs with counts, distinct (lab_key, kind, value) rows)."""
    keyed = people.filter(_filled("lab_name").isNotNull()).withColumn("lab_key", F.lower(F.trim("lab_name")))
    pairs = F.concat(
        F.array(F.struct(F.lit("department").alias("kind"), F.col("department").alias("value")), F.struct(F.lit("website").alias("kind"), F.col("lab_website").alias("value")),
                F.struct(F.lit("member").alias("kind"), N.display_name(F.col("name")).alias("value"))),
        F.transform(X.interests(F.col("research_interests")), lambda i: F.struct(F.lit("area").alias("kind"), i.alias("value"))))
    values = keyed.select("lab_key", F.inline(pairs)).filter("value IS NOT NULL AND value <> ''").distinct()
    labs = keyed.groupBy("lab_key").agg(F.count("*").alias("n_records"), F.min_by("lab_name", F.struct(*ORDER)).alias("lab_name"))
    counts = value_counts(values, "lab_key", ("member", "department", "website", "area"))
    return labs.join(counts, "lab_key").withColumn("interdisciplinary", F.col("n_departments") > 1), values


def interest_union(people: DataFrame, key: str) -> DataFrame:
    """Distinct interests per key."""
    return people.select(key, F.explode(X.interests(F.col("research_interests"))).alias("interest")).distinct()


def lab_unions(labs: DataFrame, key: str) -> DataFrame:
    """Distinct (key, kind, value): research areas of a lab's members and equipment that its texts (``text``) name."""
    rows = labs.select(key, F.inline(F.concat(
        F.transform(X.interests(F.col("research_interests")), lambda v: F.struct(F.lit("area").alias("kind"), v.alias("value"))),
        F.transform(X.lab_fields(F.col("text"))["equipment"], lambda v: F.struct(F.lit("equipment").alias("kind"), v.alias("value"))))))
    return rows.distinct()


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Set union of (key, category, url) rows of several profile maps."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.distinct()


def merge_structures(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure store: (one row per slug, distinct (slug, kind, path) rows).

    ``found`` has slug, university, department, path, method, pct and seen_at; the latest method wins, the best
    confidence stays.
    """
    paths = found.select("slug", F.inline(F.array(
        F.struct(F.lit("general").alias("kind"), F.col("path").alias("path")),
        F.struct(F.concat(F.lit("department:"), F.lower("department")).alias("kind"), F.col("path").alias("path"))))).filter("path IS NOT NULL").distinct()
    head = found.groupBy("slug").agg(
        F.count("*").alias("discovery_count"), F.max("pct").alias("pct"), F.max_by("method", F.struct("seen_at", "seq")).alias("method"), F.max("seen_at").alias("last_updated"))
    n = paths.groupBy("slug").agg(F.count_if(F.col("kind") == "general").alias("n_paths"), F.count_if(F.col("kind") != "general").alias("n_department_paths"))
    return head.join(n, "slug", "left"), paths


def combine_departments(*sources: DataFrame) -> DataFrame:
    """Concatenate department sources, first one per URL in source order."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("_src", F.lit(i))
        out = part if out is None else out.unionByName(part)
    cols = [c for c in out.columns if c not in ("url", "_src")]
    return out.groupBy("url").agg(F.min_by(F.struct("_src", *cols), F.struct("_src", "seq")).alias("b")).select(
        "url", F.col("b._src").cast("bigint").alias("source"), *[F.col(f"b.{c}").alias(c) for c in cols])


def best_discovery(found: DataFrame) -> DataFrame:
    """Best strategy per slug; a stored structure above 80 wins outright, earlier strategies win ties."""
    stored = F.when((F.col("method") == "stored") & (F.col("pct") > 80), 1).otherwise(0)
    return found.groupBy("slug").agg(F.max_by(F.struct("method", "pct"), F.struct(stored, "pct", -F.col("ord"))).alias("b")).select("slug", "b.method", "b.pct")


def department_paths(structures: DataFrame, query: str) -> DataFrame:
    """General paths plus those of departments whose name contains the query or is contained in it."""
    needle = query.lower()
    dep = F.regexp_replace("kind", "^department:", "")
    match = (F.col("kind") == "general") | (F.col("kind").startswith("department:") & (dep.contains(needle) | F.lit(needle).contains(dep)))
    return structures.filter(match).select("slug", "path").distinct()
