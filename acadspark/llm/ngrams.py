"""N-gram Jaccard join by vertical partitioning, and the groups that its links form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.llm.common import chunks, discard, distinct_texts, drop, lowered, mix, prefix_hash, span_hash, staged, text_keys, utf8, word_bounds

GRAM = 5
PER_CENT = 80
FRAGMENTS = 16
LEADER_ROUNDS = 1
PARITY = ((800, 1024), (None, 8192))  # bits for texts of up to so many n-grams
COMMON = 16  # n-grams of more texts come last in the global order, by class
ZONE = 3  # eighths of the hash range that are counted over all texts

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """Distinct n-gram hashes of each text; a text with fewer words has its whole sequence, one without words none."""
    start, end = word_bounds(data)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    at = np.searchsorted(end, inner, "right")
    cut = inner[(at < len(start)) & (start[np.minimum(at, max(0, len(start) - 1))] < inner)] if len(start) else inner[:0]
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))  # a word never crosses texts
    low = lowered(data)
    word = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(start, offsets[:-1])
    last = np.searchsorted(start, offsets[1:])
    grams = np.zeros(max(0, len(word) - gram + 1), np.uint64)
    for k in range(gram):
        grams = mix(grams * _STEP + word[k: k + len(grams)])
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= gram:
            out.append(np.unique(grams[a: b - gram + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = mix(h * _STEP + w)
            out.append(h)
        else:
            out.append(grams[:0])
    return out


def zone_sets(texts: DataFrame, low: int, high: int) -> DataFrame:
    """(k1, k2, n, grams): the n-grams of every text whose hash lies from low / 8 to high / 8 of the hash range, ascending;
    ``n`` counts all its n-grams."""

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            size, parts = [], []
            for i, j in chunks(offsets):
                for s in shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]):
                    size.append(len(s))
                    a, b = np.searchsorted(s >> np.uint64(61), [low, high])
                    parts.append(s[a:b].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(size, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["k1", "k2", "n", "grams"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 int, n int, grams array<long>")


def _shared(zone: DataFrame) -> DataFrame:
    """(g, rank, k1, k2, cls): the n-grams of ``zone`` that several of its texts have, with their rank in the text and class:
    0 up to COMMON texts, else the binary logarithm of their number."""
    rows = zone.select("k1", "k2", F.posexplode("grams").alias("rank", "g"))
    held = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "held")
    cls = F.when(F.col("held") > COMMON, F.floor(F.log2("held"))).otherwise(0).cast("int").alias("cls")
    out = staged(rows.join(held, "g").select("g", "rank", "k1", "k2", cls), "shared")
    discard(held)
    return out


def prefix_lists(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, pos, n, k1, k2): the n-grams in the prefixes of texts that others have as well, and (k1, k2, n) of all texts.

    Any two linked texts have a common n-gram in their prefixes, the first n-grams of each in one global order. Frequent
    n-grams come last in it, by class, at every size of the table: all n-grams of the first zone (hashes below ZONE / 8) are
    counted over all texts. A text with enough n-grams there that are in no class needs no others. The n-grams of the second
    zone are counted over the texts that have not; they alone reach it. The order is: first zone without a class, second zone
    without a class, then by class; within, by hash.
    """
    first = staged(zone_sets(texts, 0, ZONE), "zone")
    one = _shared(first)
    most = F.when(F.col("n") > 0, F.floor(F.col("n") * (100 - PER_CENT) / 100) + 1).otherwise(0).cast("int")  # n - ceil(0.8 n) + 1
    tally = lambda df, name: df.filter("cls > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias(name))
    state = first.select("k1", "k2", "n", most.alias("keep"), F.size("grams").alias("m")).join(tally(one, "f"), ["k1", "k2"], "left")
    state = staged(state.select("k1", "k2", "n", "keep", (F.col("m") - F.coalesce("f", F.lit(0))).alias("free")), "state")
    discard(first)
    wide = staged(zone_sets(texts.join(state.filter("free < keep").select("k1", "k2"), ["k1", "k2"], "left_semi"), ZONE, 8), "zone")
    two = _shared(wide)
    more = staged(wide.select("k1", "k2", F.size("grams").alias("m")).join(tally(two, "f"), ["k1", "k2"], "left").select(
        "k1", "k2", (F.col("m") - F.coalesce("f", F.lit(0))).alias("free2")), "more")
    both = one.withColumn("zone", F.lit(1)).unionByName(two.withColumn("zone", F.lit(2)))
    known = both.join(state.join(more, ["k1", "k2"], "left"), ["k1", "k2"])
    upto = Window.partitionBy("k1", "k2", "zone").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("k1", "k2", F.col("cls") > 0).orderBy("cls", "zone", "rank")
    plain = F.when(F.col("zone") == 2, F.col("free")).otherwise(0) + F.col("rank") - F.sum(F.signum("cls").cast("int")).over(upto)
    pos = F.when(F.col("cls") == 0, plain).otherwise(F.col("free") + F.col("free2") + F.row_number().over(later) - 1)  # null: out of reach
    lists = known.select("g", pos.cast("int").alias("pos"), "keep", "n", "k1", "k2").filter("pos < keep")
    lists = staged(lists.select("g", "pos", "n", "k1", "k2"), "lists")
    discard(one, wide, two, more)
    return lists, state


def segments(texts: DataFrame) -> DataFrame:
    """Vertical partitions: (k1, k2, fragment, grams), the n-grams of a text in each range of the order by hash."""

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for i, j in chunks(offsets):
                rows, fragment, parts = [], [], []
                for d, s in enumerate(shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])):
                    own = (s >> np.uint64(64 - FRAGMENTS.bit_length() + 1)).astype(np.int32)
                    edges = np.flatnonzero(np.diff(own)) + 1
                    for part in np.split(s, edges) if len(s) else ():
                        rows.append(i + d)
                        fragment.append(int(part[0] >> np.uint64(64 - FRAGMENTS.bit_length() + 1)))
                        parts.append(part.view(np.int64))
                rows = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[rows]), pa.array(k2[rows]), pa.array(fragment, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["k1", "k2", "fragment", "grams"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 int, fragment int, grams array<long>")


def parities(texts: DataFrame) -> DataFrame:
    """(k1, k2, bits): whether the n-grams of a text that fall on each of some bits are odd in number. Two texts differ in
    at least as many n-grams as in bits, which rules out most pairs without their n-grams; long texts have more bits."""

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            rows = []
            for i, j in chunks(offsets):
                for s in shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]):
                    size = next(bits for most, bits in PARITY if most is None or len(s) <= most)
                    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                    rows.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(rows, pa.list_(pa.int64()))], names=["k1", "k2", "bits"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 int, bits array<long>")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate ``pairs`` (x, y: id and size) that reach the threshold: common n-grams are counted in each fragment
    on its own and summed per pair. Pairs that differ in too many parity bits fall first."""
    pairs = staged(pairs, "pairs")
    both_ids = lambda df: df.select(F.col("x.k1"), F.col("x.k2")).union(df.select(F.col("y.k1"), F.col("y.k2"))).distinct()
    marks = staged(parities(texts.join(both_ids(pairs), ["k1", "k2"])), "parities")
    mark = lambda side: marks.select(F.struct("k1", "k2").alias(side), F.col("bits").alias(f"bits_{side}"))
    keyed = pairs.select("x", "y", *[F.struct(F.col(f"{s}.k1").alias("k1"), F.col(f"{s}.k2").alias("k2")).alias(f"id_{s}") for s in "xy"])
    unlike = F.aggregate(F.zip_with("bits_id_x", "bits_id_y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    near = unlike * (100 + PER_CENT) <= (F.col("x.n") + F.col("y.n")) * (100 - PER_CENT)
    close = F.when(F.size("bits_id_x") == F.size("bits_id_y"), near).otherwise(True)
    kept = staged(keyed.join(mark("id_x"), "id_x").join(mark("id_y"), "id_y").filter(close).select("x", "y"), "pairs")
    discard(pairs, marks)
    pairs = kept
    parts = staged(segments(texts.join(both_ids(pairs), ["k1", "k2"])), "segments")
    xs = parts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "fragment", F.col("grams").alias("gx"))
    ys = parts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "fragment", F.col("grams").alias("gy"))
    flat = pairs.select(F.col("x.k1").alias("a1"), F.col("x.k2").alias("a2"), F.col("y.k1").alias("b1"), F.col("y.k2").alias("b2"), (F.col("x.n") + F.col("y.n")).alias("both"))
    common = F.size(F.array_intersect("gx", "gy")).cast("long").alias("common")
    counted = flat.join(xs, ["a1", "a2"]).join(ys, ["b1", "b2", "fragment"]).select("a1", "a2", "b1", "b2", "both", common)
    summed = counted.groupBy("a1", "a2", "b1", "b2", "both").agg(F.sum("common").alias("common"))
    good = summed.filter(F.col("common") * 100 >= (F.col("both") - F.col("common")) * PER_CENT)
    found = staged(good.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("b")), "links")
    discard(parts, pairs)
    return found


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that links (a, b) reach. Labels pass along links, then along labels, until none changes.

    Partial minima keep a text with very many links from gathering them in one task; every round is a written table.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).toDF("id", "other").distinct(), "links")
    labels = staged(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root")), "labels")
    while True:
        offers = both.join(labels.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("offer"))
        step = labels.join(offers, "id").select("id", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        jump = step.join(labels.select(F.col("id").alias("root"), F.col("root").alias("up")), "root").select("id", "old", F.least("root", "up").alias("root"))
        moved = staged(jump, "labels")
        if moved.filter("root <> old").isEmpty():
            return moved.select("id", "root")
        labels = moved.select("id", "root")


def _side(name: str, prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("n", "k1", "k2")]).alias(name)


def _feasible(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """Sizes within the threshold, and enough n-grams left from the first common one on."""
    sizes = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * PER_CENT
    return sizes & (F.least(nx - px, ny - py) * (100 + PER_CENT) >= (nx + ny) * PER_CENT)


def similar_groups(docs: DataFrame) -> DataFrame:
    """Per distinct text of ``docs``: (k1, k2, n, root), its n-gram count and the id of its group (null if linked to none).

    Candidates share an n-gram of their prefixes; a link is any pair of reached threshold. Pairs within a group of copies
    are not needed to know the group, so links are found in rounds. First the texts of a list are compared with the
    one of their size whose prefix has the fewest n-grams of its own, in an eighth of the lists. In LEADER_ROUNDS more, the
    texts outside the largest group of a list are compared with one text of that group. Then every list that still holds
    more than one group is gone through in full, but only pairs of different groups are candidates. No link between groups
    is missed, and no list, however long, is paired within a group.
    """
    texts, label = distinct_texts(docs, "texts")
    lists, state = prefix_lists(texts)
    rows = lists.withColumn("cls", F.floor(F.log(100 / PER_CENT, F.col("n"))).cast("int"))
    some = rows.filter("g % 8 = 0 or n < 64")
    lead = some.groupBy("g", "cls").agg(F.min(F.struct("pos", "n", "k1", "k2")).alias("lead"))
    lead = lead.select("g", F.explode(F.array(F.col("cls"), F.col("cls") + 1)).alias("cls"), "lead")
    near = some.join(lead, ["g", "cls"]).filter(
        ((F.col("lead.k1") != F.col("k1")) | (F.col("lead.k2") != F.col("k2"))) & _feasible(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    me, it = _side("me"), _side("it", "lead.")
    pair = lambda df: df.select(F.least("me", "it").alias("x"), F.greatest("me", "it").alias("y")).distinct()
    first = linked(pair(near.select(me, it)), texts)
    groups = components(first)

    rows = rows.select("g", "pos", "n", "k1", "k2", F.struct("k1", "k2").alias("id"))
    found = first
    for turn in range(LEADER_ROUNDS + 1):
        held = staged(rows.join(groups, "id", "left").select("g", "pos", "n", "k1", "k2", F.coalesce("root", "id").alias("root")), "held")
        weight = held.groupBy("g", "root").agg(F.count(F.lit(1)).alias("m"))
        mixed = weight.groupBy("g").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("m", "root")).alias("most")).filter("groups > 1")
        open_ = staged(held.join(mixed.select("g", F.col("most.root").alias("most")), "g"), "open")
        discard(held)
        if turn == LEADER_ROUNDS:
            break
        lead = open_.filter("root = most").groupBy("g").agg(F.min(F.struct("pos", "n", "k1", "k2")).alias("lead"))
        more = open_.filter("root <> most").join(lead, "g").filter(_feasible(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        more = linked(pair(more.select(me, it)), texts)
        discard(open_)
        found = found.union(more)
        groups = components(found)
    left = open_.filter("root <> most").select("g", F.col("pos").alias("p"), F.col("root").alias("r"), _side("me"))
    right = open_.select("g", "pos", "root", _side("it"))
    cross = (F.col("root") != F.col("r")) & _feasible(F.col("me.n"), F.col("p"), F.col("it.n"), F.col("pos"))
    later = linked(pair(left.join(right, "g").filter(cross).select("me", "it")), texts)
    discard(open_)
    roots = components(found.union(later))
    own = state.select("k1", "k2", "n", F.struct("k1", "k2").alias("id"))
    groups = staged(own.join(roots, "id", "left").select("k1", "k2", "n", "root"), "groups")
    discard(lists, state, found, later)
    drop(texts, label)
    return groups


def jaccard_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are runs other than ASCII white space, A to Z in lower case; a null text has none. Equal texts are linked as any
    others; texts without words are linked with nothing and stand for themselves. The component is the smallest doc_id of
    the group (null ids do not count; a group without ids has null).
    """
    groups = similar_groups(docs)
    k1, k2 = text_keys(F.coalesce(F.col("text"), F.lit("")))
    rows = staged(docs.select("doc_id", k1, k2), "ids")
    least = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    each = groups.join(least, ["k1", "k2"]).withColumn("root", F.coalesce("root", F.struct("k1", "k2")))
    each = staged(each, "least")
    whole = each.groupBy("root").agg(F.min("least").alias("component_id"))
    named = each.join(whole, "root").select("k1", "k2", F.col("n").cast("long").alias("n_shingles"), "component_id")
    out = rows.join(named, ["k1", "k2"])
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def unique_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with every column: the smallest doc_id, then the smallest text key, then any of equal
    rows. Documents without words stay."""
    groups = similar_groups(docs)
    k1, k2 = text_keys(F.coalesce(F.col("text"), F.lit("")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), "k1", "k2").alias("first")
    rows = docs.select("doc_id", k1, k2)
    least = rows.select("k1", "k2", first).groupBy("k1", "k2").agg(F.min("first").alias("first"))
    each = staged(groups.join(least, ["k1", "k2"]).withColumn("root", F.coalesce("root", F.struct("k1", "k2"))), "least")
    kept = each.filter("n > 0").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("d"), F.col("first.k1").alias("a"), F.col("first.k2").alias("b"))
    empty = each.filter("n = 0").select(F.col("k1").alias("a"), F.col("k2").alias("b"))
    full = docs.select(whole, "doc_id", k1, k2)
    same = (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))
    chosen = full.join(staged(kept, "kept"), same & F.col("doc_id").eqNullSafe(F.col("d")))
    one = chosen.groupBy("k1", "k2").agg(F.any_value("row").alias("row")).select("row.*")
    wordless = full.join(staged(empty, "empty"), same, "left_semi").select("row.*")
    return one.unionByName(wordless)
