"""Entity registry: groups of records that keep their ids from batch to batch.

A registry is a table of nodes (node, hubs, entity, since): distinct keyed records, the hub values by which they are linked
with others, their entity, and the batch in which that entity began. ``update`` takes the nodes of a batch: only they and
the entities that they touch take part in the rounds, old entities as hubs of their own, so the cost of a batch is its own
size and one pass over the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.functions import names as N
from acadspark.operators.dedup import _filled
from acadspark.session import cut_lineage

NODES = "node string, hubs array<string>, entity bigint, since int"
LOG = "batch int, kind string, entity bigint, other bigint"


def person_nodes(obs: DataFrame) -> DataFrame:
    """(node, hubs, low): distinct (name, university, e-mail) of observations with a name, and the smallest obs_id. Linked by
    name and e-mail or name and university; an unknown university links nothing."""
    name, uni, mail = N.person_key(F.col("name")), F.coalesce(N.institution_key(F.col("university")), F.lit("")), F.lower(_filled("email"))
    keyed = obs.select("obs_id", name.alias("n"), uni.alias("u"), mail.alias("m")).filter("n IS NOT NULL AND n <> ''")
    hubs = F.array_compact(F.array(F.when(F.col("m").isNotNull(), F.concat_ws("|", F.lit("m"), "n", "m")), F.when(F.col("u") != "", F.concat_ws("|", F.lit("u"), "n", "u"))))
    node = F.to_json(F.array("n", "u", F.coalesce("m", F.lit(""))))
    return keyed.select("obs_id", node.alias("node"), hubs.alias("hubs")).groupBy("node").agg(F.any_value("hubs").alias("hubs"), F.min("obs_id").alias("low"))


def lab_nodes(obs: DataFrame) -> DataFrame:
    """(node, hubs, low): distinct (lab name, web site), linked by either."""
    keyed = obs.select("obs_id", F.when(_filled("lab_name").isNotNull(), N.institution_key(F.col("lab_name"))).alias("n"), _filled("lab_website").alias("s")).filter("n IS NOT NULL OR s IS NOT NULL")
    hubs = F.array_compact(F.array(F.concat(F.lit("n|"), F.col("n")), F.concat(F.lit("s|"), F.col("s"))))
    node = F.to_json(F.array(F.coalesce("n", F.lit("")), F.coalesce("s", F.lit(""))))
    return keyed.select("obs_id", node.alias("node"), hubs.alias("hubs")).groupBy("node").agg(F.any_value("hubs").alias("hubs"), F.min("obs_id").alias("low"))


def empty_registry(spark) -> DataFrame:
    return spark.createDataFrame([], NODES)


def hub_groups(links: DataFrame) -> DataFrame:
    """(node, root): connected groups of ``links`` (node, hub), named by their smallest node. Labels pass to hubs and back by
    partial minima and are followed to their own labels; every round is a checkpoint, pairs of a busy hub are never formed."""
    links = cut_lineage(links.distinct())
    labels = cut_lineage(links.select("node").distinct().select("node", F.col("node").alias("root")))
    while True:
        per_hub = links.join(labels, "node").groupBy("hub").agg(F.min("root").alias("least"))
        offer = links.join(per_hub, "hub").groupBy("node").agg(F.min("least").alias("offer"))
        step = labels.join(offer, "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", "old", F.least("root", "up").alias("root"))
        moved = cut_lineage(jump)
        labels = moved.select("node", "root")
        if moved.filter("root <> old").isEmpty():
            return labels


def update(registry: DataFrame, batch: DataFrame, number: int, withdrawn: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Registry after ``batch`` (node, hubs, low) and the log rows (batch, kind, entity, other) of what changed.

    A node that links to known entities joins the oldest of them (the smaller id among equally old ones); the others are
    merged into it. Nodes that link to none begin an entity, whose id is the smallest ``low`` of its group. ``withdrawn``
    (node) holds nodes that no longer exist: the rest of their entities is grouped anew; the part with the oldest node (by
    its key among equal ones) keeps the id, the others are split off under new ids. ``low`` must be new in every batch, as
    record ids are. Kinds: new, merge (entity became part of other), split (other came from entity), gone. The batch's
    tables are checkpointed in the shared folder while the plan is built.
    """
    registry = registry.select("node", "hubs", "entity", "since")
    if withdrawn is None:
        kept, loose = registry, registry.limit(0)
    else:
        gone = withdrawn.select("node").distinct()
        hit = cut_lineage(registry.join(gone, "node", "left_semi").select("entity").distinct())
        kept = registry.join(gone, "node", "left_anti")
        loose = kept.join(hit, "entity", "left_semi").select("node", "hubs", "entity", "since")
        kept = kept.join(hit, "entity", "left_anti").select("node", "hubs", "entity", "since")
    fresh = batch.join(registry.select("node"), "node", "left_anti") if withdrawn is None else batch.join(kept.unionByName(loose).select("node"), "node", "left_anti")
    open_ = fresh.select("node", "hubs", "low", F.lit(None).cast("bigint").alias("entity"), F.lit(None).cast("int").alias("since")).unionByName(
        loose.select("node", "hubs", F.lit(None).cast("bigint").alias("low"), "entity", "since"))
    open_ = cut_lineage(open_)
    hubs = open_.select("node", F.explode("hubs").alias("hub"))
    known = kept.select(F.explode("hubs").alias("hub"), F.col("entity").alias("old"), F.col("since").alias("began"))
    touched = known.join(hubs.select("hub").distinct(), "hub", "left_semi").groupBy("hub").agg(F.min(F.struct("began", "old")).alias("at"))
    tied = cut_lineage(hubs.join(touched, "hub", "left").select("node", F.when(F.col("at").isNull(), F.concat(F.lit("h"), F.col("hub"))).otherwise(F.concat(F.lit("="), F.col("at.old").cast("string"))).alias("hub"), "at"))
    alone = open_.select("node", F.concat(F.lit("."), F.col("node")).alias("hub"))
    roots = hub_groups(tied.select("node", "hub").unionByName(alone))
    placed = cut_lineage(open_.join(roots, "node"))
    held = tied.filter("at IS NOT NULL").join(roots, "node").select("root", F.col("at.began").alias("since"), F.col("at.old").alias("entity")).distinct()
    owner = placed.filter("entity IS NOT NULL").groupBy("entity").agg(F.min(F.struct("since", "node", "root")).alias("o")).select("entity", "o.since", "o.root")
    claims = cut_lineage(held.unionByName(owner.select("root", "since", "entity")))
    won = claims.groupBy("root").agg(F.min(F.struct("since", "entity")).alias("w"))
    first = placed.groupBy("root").agg(F.min("low").alias("low"), F.min(F.struct("node")).alias("n"))
    named = first.join(won, "root", "left").select(
        "root", F.coalesce("w.entity", "low", -F.abs(F.xxhash64("n.node", F.lit(number)))).alias("now"), F.coalesce("w.since", F.lit(number)).alias("began"), F.col("w").isNull().alias("born"))
    named = cut_lineage(named)
    merged = cut_lineage(claims.join(named, "root").filter("entity <> now").select("entity", "now", "began"))
    moved = kept.join(merged, "entity", "left").select("node", "hubs", F.coalesce("now", "entity").alias("entity"), F.coalesce("began", "since").alias("since"))
    settled = placed.select("node", "hubs", "root", F.col("entity").alias("was")).join(named, "root")
    out = moved.unionByName(settled.select("node", "hubs", F.col("now").alias("entity"), F.col("began").alias("since")))
    split = settled.filter("born AND was IS NOT NULL").select("was", "now").distinct()
    entry = lambda df, kind, a, b: df.select(F.lit(number).alias("batch"), F.lit(kind).alias("kind"), F.col(a).alias("entity"), (F.col(b) if b else F.lit(None).cast("bigint")).alias("other"))
    log = entry(merged, "merge", "entity", "now").unionByName(entry(split, "split", "was", "now")).unionByName(entry(named.filter("born"), "new", "now", None))
    if withdrawn is not None:
        log = log.unionByName(entry(hit.join(loose.select("entity").distinct(), "entity", "left_anti"), "gone", "entity", None))
    return cut_lineage(out), cut_lineage(log)


def with_entities(obs: DataFrame, nodes, registry: DataFrame, name: str) -> DataFrame:
    """``obs`` with the entity id of each row as column ``name`` (null for rows that are no node); ``nodes`` is
    ``person_nodes`` or ``lab_nodes``."""
    per_row = obs.select("obs_id").join(_row_nodes(obs, nodes), "obs_id")
    found = per_row.join(registry.select("node", F.col("entity").alias(name)), "node").select("obs_id", name)
    return obs.join(found, "obs_id", "left")


def _row_nodes(obs: DataFrame, nodes) -> DataFrame:
    """(obs_id, node) of every row: the key of a node depends on its row alone."""
    if nodes is person_nodes:
        key = F.to_json(F.array(N.person_key(F.col("name")), F.coalesce(N.institution_key(F.col("university")), F.lit("")), F.coalesce(F.lower(_filled("email")), F.lit(""))))
    else:
        key = F.to_json(F.array(F.coalesce(F.when(_filled("lab_name").isNotNull(), N.institution_key(F.col("lab_name"))), F.lit("")), F.coalesce(_filled("lab_website"), F.lit(""))))
    return obs.select("obs_id", key.alias("node"))
