"""Shards of equal row counts by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from acadspark.llm.common import discard, gapless, staged, text_keys

SHARDS = 16


def quotas(total: int, shards: int) -> list[int]:
    """Rows of every shard, at most one apart."""
    return [(total - s + shards - 1) // shards for s in range(shards)]


def allowed(wanted: dict[tuple[int, int], int], held: list[int], quota: list[int]) -> dict[tuple[int, int], int]:
    """Moves (from, to) that keep every shard within its quota, as many of the wanted ones as the room admits.

    Room is what a shard has free plus what leaves it, so full shards exchange rows. All moves are made at first. A move
    given up takes a row from the shard it leads to and leaves one more where it comes from; rows above a quota are carried
    to room along the shortest chain of such steps, a move already given up may come back. The fewest are given up that way.
    """
    moves = dict(wanted)
    above = [h - q for h, q in zip(held, quota, strict=True)]
    for (a, b), n in moves.items():
        above[a] -= n
        above[b] += n
    while max(above) > 0:
        steps = [0 if n > 0 else None for n in above]  # moves given up on the way to a shard
        back: list = [None] * len(above)
        changed = True
        while changed:
            changed = False
            for (a, b), n in moves.items():
                if n and steps[b] is not None and (steps[a] is None or steps[b] + 1 < steps[a]):
                    steps[a], back[a], changed = steps[b] + 1, (b, (a, b), -1), True
                if n < wanted[a, b] and steps[a] is not None and (steps[b] is None or steps[a] - 1 < steps[b]):
                    steps[b], back[b], changed = steps[a] - 1, (a, (a, b), 1), True
        end = min((s for s, n in enumerate(above) if n < 0 and steps[s] is not None), key=lambda s: steps[s])
        chain, s = [], end
        while back[s] is not None:
            chain.append(back[s][1:])
            s = back[s][0]
        rows = min(above[s], -above[end], *(moves[k] if sign < 0 else wanted[k] - moves[k] for k, sign in chain))
        for k, sign in chain:
            moves[k] += sign * rows
        above[s] -= rows
        above[end] += rows
    return {k: n for k, n in moves.items() if n}


def started(linked: DataFrame, sizes: DataFrame, quota: list[int]) -> DataFrame:
    """``linked`` (uid, hub) with their first shard: hubs that fill shards by themselves, then the others dealt by number."""
    shards = len(quota)
    dealt = linked.select("uid", "hub", (F.col("uid") % shards).cast("int").alias("shard"))
    large = sizes.filter(F.col("n") >= F.lit(max(quota))).orderBy(F.xxhash64("hub"), "hub").collect() if max(quota) > 1 else []  # at most one a shard
    at, places = 0, []
    for i, r in enumerate(large):
        first, rows = at, 0
        while at < shards and rows + quota[at] <= r["n"]:
            rows += quota[at]
            at += 1
        low = sum(quota[:first])
        places += [(i, s, sum(quota[:s]) - low, sum(quota[:s + 1]) - low) for s in range(first, at)]
    if not places:
        return dealt
    names = StructType([linked.schema["hub"], StructField("_hub", IntegerType())])
    which = linked.sparkSession.createDataFrame([(r["hub"], i) for i, r in enumerate(large)], names)
    ranked = gapless(linked.join(which, "hub"), ["_hub"], ["uid"], "_rank")
    spot = F.coalesce(*[F.when((F.col("_hub") == i) & (F.col("_rank") >= lo) & (F.col("_rank") < hi), F.lit(s)) for i, s, lo, hi in places])
    whole = staged(ranked.select("uid", "hub", spot.cast("int").alias("shard")).filter("shard is not null"), "whole")
    others = linked.join(whole.select("uid"), "uid", "left_anti")
    others = gapless(others, [], ["uid"], "_rank").select("uid", "hub", (F.col("_rank") % max(1, shards - at) + at).cast("int").alias("shard"))
    return whole.unionByName(others)


def propagate(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``nodes`` (uid: 0, 1, 2, ..., hub: null or what links rows) with their shard.

    Rows of one hub are neighbours; a hub stands for its pairs, which are never formed. A hub with more rows than a shard
    takes fills whole shards one after the other. All other linked rows are dealt over the rest by number and move, round by round, to the shard that holds most of their neighbours, if it holds no fewer of them
    than their own; a full shard takes as many rows as leave it. Quotas bound the moves between two shards, and who moves is
    decided by hash. A shard that took nobody is passed over in the next round, and one that a hub fills by itself for good.
    Every move adds to the pairs of neighbours within a shard, so the rounds come to an end: when no shard admits a row that
    wants to move. Rows without links cost nothing to place and fill the shards up at the end. The driver sees one number
    per pair of shards.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    quota = quotas(total, shards)
    sizes = nodes.filter("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = staged(nodes.join(sizes.select("hub"), "hub", "left_semi"), "linked")
    state = staged(started(linked, sizes, quota), "labels")
    discard(linked)
    takes = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    counts, turn, closed, moved_since = None, 0, set(), False
    while True:
        turn += 1
        if counts is None:
            counts = staged(state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")
            held = [0] * shards
            for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row per shard
                held[r["shard"]] = r["n"]
        open_ = counts.filter((F.col("n") < takes) & ~F.col("shard").isin(*closed, -1))
        best = open_.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard", F.lit(turn)).alias("h"), "shard")).alias("best"))
        goals = counts.join(best.select("hub", F.col("best.shard").alias("goal"), F.col("best.n").alias("most")), "hub")
        goals = goals.filter((F.col("goal") != F.col("shard")) & (F.col("most") >= F.col("n"))).select("hub", "shard", "goal", "n")
        wanted = {(r["shard"], r["goal"]): r["n"] for r in goals.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}  # shards squared
        moves = allowed(wanted, held, quota)
        refused = {b for _, b in wanted} - {b for _, b in moves}
        if moves:
            movers = staged(state.join(goals.drop("n"), ["hub", "shard"]).select("uid", "shard", "goal"), "movers")
            limits = spark.createDataFrame([(a, b, n) for (a, b), n in moves.items()], "shard int, goal int, most long")
            moved = gapless(movers, ["shard", "goal"], ["uid"], "_rank").join(limits, ["shard", "goal"]).filter("_rank < most").select("uid", F.col("goal").alias("to"))
            after = staged(state.join(moved, "uid", "left").select("uid", "hub", F.coalesce("to", "shard").alias("shard")), "labels")
            discard(state, counts, movers)
            state, counts, closed, moved_since = after, None, refused, True
        elif refused:
            closed |= refused
        elif closed and moved_since:
            closed, moved_since = set(), False
        else:
            break
    ends, at = [], 0
    for s in range(shards):
        at += quota[s] - held[s]
        ends.append(at)
    rest = gapless(nodes.join(state, "uid", "left_anti").select("uid"), [], ["uid"], "_rank")
    filled = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        filled = F.when(F.col("_rank") < ends[s], F.lit(s)).otherwise(filled)
    return state.select("uid", "shard").unionByName(rest.select("uid", filled.cast("int").alias("shard")))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``, under the law ``rows``.

    Rows of one text are linked (null texts too, as empty ones). Repeated rows and null ids are rows of their own. A text
    with more rows than a shard takes fills whole shards one after the other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = text_keys(text)
    rows = staged(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), k1, k2), "rows")
    numbered = staged(gapless(rows, [], ["doc_id", "k1", "k2", "size"], "uid"), "rows")
    placed = propagate(numbered.select("uid", F.struct("k1", "k2").alias("hub")), shards)
    joined = staged(numbered.join(placed, "uid").select("doc_id", "size", "text_crc32", "shard", "uid"), "placed")
    return gapless(joined, ["shard"], ["uid"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
