"""Mixing of sources to target weights by subset-sum budget fitting over document lengths."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.llm.common import WORD, gapless, staged, text_keys

WEIGHTS = (5, 2, 1)
MOST = 3
EXACT = 1 << 15  # words that are left to dynamic programming at most, beside two longest documents


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with weight and target.

    Sources in code-point order, null last, take the weights in turn and share the words of all; no target exceeds ``most``
    times its source's size, the excess going to the others by weight. That fixes one level, words per weight: sources
    whose limit lies below it are at the limit. The level follows from running sums in order of limit per weight.
    """
    spot = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (spot % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    levels = ranked.select("*", ((total - capped) / rest).alias("level"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(Window.partitionBy())  # the first that holds is the highest
    found = levels.withColumn("level", level)
    return found.select("source", "source_size", "weight", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT) -> list[int]:
    """How many documents of each length to take so that their words come to ``budget``, or next to it.

    At every size of a source, each length first gives its share of the budget but for two longest documents: shares are
    rounded as running sums over rising lengths, so any stretch of lengths gives its part and the words stay within a longest
    document of the share. Bounded-knapsack dynamic programming then fills what is left. Where it can't meet the budget to
    the word, twice as much is left to it, and so on, up to ``exact`` words; the nearest sum found counts.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not whole:
        return [0] * len(lengths)
    if budget >= whole:
        return list(counts)
    rising = sorted(range(len(lengths)), key=lambda i: lengths[i])
    room, best = 2 * lengths[rising[-1]], None
    while True:
        share, take, seen, given = max(0, budget - room), [0] * len(lengths), 0, 0
        for i in rising:
            seen += counts[i]
            take[i] = seen * share // whole - given
            given += take[i]
        miss = fill_rest(lengths, counts, take, rising, budget - sum(n * t for n, t in zip(lengths, take, strict=True)))
        if best is None or miss < best[0]:
            best = miss, take
        if not miss or room >= min(budget, exact):
            return best[1]
        room *= 2


def fill_rest(lengths: list[int], counts: list[int], take: list[int], rising: list[int], left: int) -> int:
    """Adds documents to ``take`` whose words come nearest to ``left``, and returns by how many words they miss it.

    Dynamic programming over reachable sums, one bit per sum; lengths are tried in a seeded order, so that it prefers none.
    """
    top = left + lengths[rising[-1]]
    reach, steps, mask = 1, [], (1 << (top + 1)) - 1
    order = rising[:]
    random.Random(len(order)).shuffle(order)
    for i in order:
        free, lot = min(counts[i] - take[i], top // lengths[i]), 1
        while free > 0 and not reach >> left & 1:
            lot = min(lot, free)
            steps.append((i, lot, reach))
            reach |= reach << (lot * lengths[i]) & mask
            free -= lot
            lot *= 2
    below = (reach & (1 << (left + 1)) - 1).bit_length() - 1
    above = reach >> left
    over = (above & -above).bit_length() - 1 if above else top
    total = below if left - below <= over else left + over
    miss = abs(left - total)
    for i, lot, before in reversed(steps):
        if not before >> total & 1:
            take[i] += lot
            total -= lot * lengths[i]
    return miss


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source: a row per length. The number of lengths is bounded by the longest text, not by the corpus."""
    size = int(pdf["source_size"].iloc[0])
    budget = round(float(pdf["target"].iloc[0]))
    full = budget // size if size else 0
    extra = fit_lengths([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], budget - full * size)
    return pdf[["source", "size"]].assign(full=full, extra=extra)


def mix(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``rows`` (source, size, id: a struct that orders rows) with source_size, target and copies.

    Whole copies of a source come first; the rest of its budget is fitted by length counts, and within a source and length
    the documents of the smallest seeded hash of ``id`` are taken, whatever the order of the input. Rows are numbered in
    slices of the hash, so no source or length has to fit one task. Documents without words take nothing.
    """
    by_length = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares = staged(targets(sizes, weights, most), "targets")
    same = by_length["source"].eqNullSafe(shares["source"])
    joined = by_length.join(shares, same).select(by_length["source"], "size", "n", "source_size", "target")
    kind = rows.schema["source"].dataType.simpleString()
    fitted = joined.filter("size > 0").groupBy("source").applyInPandas(_fit, f"source {kind}, size long, full long, extra long")
    plan = joined.join(fitted.withColumnsRenamed({"source": "s2", "size": "n2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("n2")), "left").select(
        F.col("source").alias("s2"), F.col("size").alias("n2"), "source_size", "target", F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("extra", F.lit(0)).alias("extra"))
    ranked = gapless(rows, ["source", "size"], ["id"], "_rank")
    out = ranked.join(staged(plan, "plan"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("n2")))
    copies = F.col("full") + F.when(F.col("_rank") < F.col("extra"), 1).otherwise(0)
    return out.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row of ``docs``.

    A null text has no words and takes nothing; a null source is the last one; null and repeated ids stay rows, equal rows
    are told apart by their place only. An empty table gives no rows; other columns are not read.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("k"))
    rows = staged(docs.select("source", word_count(F.col("text")).alias("size"), key.alias("id")), "sizes")
    return mix(rows).select("id.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every column of ``docs``, each row as often as the mix takes it (0 to MOST times)."""
    k1, k2 = text_keys(F.col("text"))
    rows = docs.select("source", word_count(F.col("text")).alias("size"), F.struct("doc_id", k1, k2).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = mix(rows).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select("row.*")
