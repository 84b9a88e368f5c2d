"""Prefix trie of conversations, with subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.llm.common import discard, partitions, staged

GROUP = 100
HEADS = 6  # a conversation takes fewer turns than this from the first one of its group
CHUNK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- tree contraction ------------------------------------------------------------------------------------------------


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): the sums of the long columns ``values`` over the subtree of every node of ``nodes`` (id, parent, *values;
    the parent of a root is null, ids are structs or plain, several roots are allowed).

    Every round rakes all leaves into their parents, which ends their totals, and then compresses unary chains: of the
    nodes with one child, those that a coin of the round picks and whose parent it does not pick are cut out, and their
    values lie on the link from their child upwards from then on. The number of rounds grows with the logarithm of the tree,
    however deep it is. Then the rounds are undone in reverse: a node that was cut out gets the total of its child, with what
    lay between. Values of children are summed before the shuffle, so a node with very many children is no hot key; all
    joins are between unique ids. Every round is a written table.
    """
    many = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    v, w = [f"v_{c}" for c in values], [f"w_{c}" for c in values]
    alive = nodes.join(many, "id", "left").select(
        "id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(c).cast("long").alias(a) for c, a in zip(values, v, strict=True)], *[F.lit(0).cast("long").alias(b) for b in w])
    alive = staged(alive, "alive")
    raked, cut, used, turn = [], [], [alive], 0
    while True:
        leaves = alive.filter("kids = 0")
        raked.append(leaves.select("id", *v))
        gifts = leaves.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.lit(1)).alias("raked"), *[F.sum(F.col(a) + F.col(b)).alias(f"g{a}") for a, b in zip(v, w, strict=True)])
        rest = alive.filter("kids > 0").join(gifts, "id", "left").select(
            "id", "parent", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"), *[(F.col(a) + F.coalesce(f"g{a}", F.lit(0))).alias(a) for a in v], *w)
        rest = staged(rest, "rest")
        used.append(rest)
        if rest.isEmpty():
            break
        sole = rest.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("child")).filter("n = 1").select("id", "child")
        picked = rest.filter(F.col("parent").isNotNull() & (F.col("kids") == 1) & (F.pmod(F.xxhash64(F.lit(turn), F.col("id")), F.lit(2)) == 1)).join(sole, "id")
        out = staged(picked.join(picked.select(F.col("id").alias("parent")), "parent", "left_anti"), "cut")
        above = out.select(F.col("child").alias("id"), F.col("id").alias("gone"), F.col("parent").alias("up"), *[F.col(a).alias(f"c{a}") for a in v], *[F.col(b).alias(f"c{b}") for b in w])
        kept = rest.join(above, "id", "left").join(out.select("id"), "id", "left_anti")
        alive = staged(kept.select(
            "id", F.coalesce("up", "parent").alias("parent"), "kids", *v, *[(F.col(b) + F.coalesce(F.col(f"c{a}") + F.col(f"c{b}"), F.lit(0))).alias(b) for a, b in zip(v, w, strict=True)],
            "gone", *[(F.col(f"c{a}") + F.col(b)).alias(f"add_{a}") for a, b in zip(v, w, strict=True)]), "alive")
        cut.append(alive.filter("gone IS NOT NULL").select(F.col("gone"), "id", *[f"add_{a}" for a in v]))
        used += [out, alive]
        turn += 1
    total = raked.pop()
    while raked:
        again = cut.pop().join(total, "id").select(F.col("gone").alias("id"), *[(F.col(f"add_{a}") + F.col(a)).alias(a) for a in v])
        total = staged(total.unionByName(again).unionByName(raked.pop()), "totals")
        used.append(total)
    total = staged(total.select("id", *[F.col(a).alias(c) for c, a in zip(values, v, strict=True)]), "subtrees")
    discard(*used)
    return total


# --- conversations ---------------------------------------------------------------------------------------------------


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, slice, place, h1, h2, chars, head, taken, size): the turns of every conversation with their place, and how
    the conversation is rebuilt: it starts with ``taken`` turns of another one instead of its own first ``head``, and has
    ``size`` turns then.

    Turns are ordered by turn (null first), then role, then a hash of role and text. A conversation of any length is spread
    over slices of its order, of which only the counts meet.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(13), text, role).alias("h2"), F.char_length(text).alias("chars"))
    order = ["turn", "role", "h1", "h2"]  # nulls come first
    spread = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", *order).withColumn("slice", F.spark_partition_id())
    spread = staged(spread, "turns")
    counts = spread.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    below = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.select("conv_id", "slice", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("own")), "counts")
    own = counts.filter("base = 0").select("conv_id", "own")
    first = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("top"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("head"))
    given = first.join(own.select(F.col("conv_id").alias("top"), F.col("own").alias("there")), "top", "left")
    given = given.withColumn("taken", F.least("head", F.coalesce("there", F.lit(0)))).select(
        "conv_id", "top", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size"))
    inside = Window.partitionBy("conv_id", "slice").orderBy(*order)
    placed = spread.withColumn("row", F.row_number().over(inside)).join(counts.join(given, "conv_id"), ["conv_id", "slice"])
    out = staged(placed.select("conv_id", "slice", (F.col("base") + F.col("row")).alias("place"), "h1", "h2", "chars", "top", "head", "taken", "size"), "placed")
    discard(spread, counts)
    return out


def rebuilt_prefixes(placed: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, y1, y2, chars, size): every prefix of every rebuilt conversation, with its 128-bit identity
    (x1, x2), that of the prefix without its last turn (y1, y2), and the characters of the last turn. The empty prefix is
    (0, 0).

    An identity is the exclusive or of one hash per turn and depth, so it can be summed over slices of a conversation.
    """
    convs = placed.filter("place = 1").select("conv_id", "top", "head", "size")
    heads = placed.filter(F.col("place") < HEADS).select(F.col("conv_id").alias("top"), "place", "h1", "h2", "chars")
    taken = convs.join(heads, "top").filter("place <= head").select("conv_id", F.lit(-1).alias("slice"), F.col("place").alias("depth"), "h1", "h2", "chars", "size")
    own = placed.filter("place > head").select("conv_id", "slice", (F.col("taken") + F.col("place") - F.col("head")).alias("depth"), "h1", "h2", "chars", "size")
    rows = taken.unionByName(own).select(
        "conv_id", "slice", "depth", F.xxhash64("depth", "h1", "h2").alias("r1"), F.xxhash64(F.lit(17), F.col("depth"), F.col("h2"), F.col("h1")).alias("r2"), "chars", "size")
    rows = staged(rows, "rebuilt")
    slices = rows.groupBy("conv_id", "slice").agg(F.bit_xor("r1").alias("b1"), F.bit_xor("r2").alias("b2"))
    below = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.select("conv_id", "slice", *[F.coalesce(F.bit_xor(c).over(below), F.lit(0)).alias(c) for c in ("b1", "b2")])
    upto = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", F.bit_xor("r1").over(upto).alias("s1"), F.bit_xor("r2").over(upto).alias("s2")).join(bases, ["conv_id", "slice"])
    x1, x2 = F.col("s1").bitwiseXOR(F.col("b1")), F.col("s2").bitwiseXOR(F.col("b2"))
    out = run.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("r1")).alias("y1"), x2.bitwiseXOR(F.col("r2")).alias("y2"), "chars", "size")
    out = out.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "y1", "y2")], F.lit(0).alias("chars"), "size"))
    out = staged(out, "prefixes")
    discard(rows)
    return out


def _texts(it):
    """Rows come sorted by (x1, x2, conv_id): ids joined by commas, CHUNK at most in one row."""
    node, ids = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["x1", "x2", "first", "part"])

    for batch in it:
        for x1, x2, conv in zip(*[batch.column(c).to_pylist() for c in ("x1", "x2", "conv_id")], strict=True):
            if node and ((x1, x2) != node or len(ids) == CHUNK):
                yield row()
                ids = []
            node = x1, x2
            ids.append(conv)
    if node:
        yield row()


def _digests(it):
    """Rows come sorted by (x1, x2, first): one running digest, whatever the number of parts."""
    node, sha = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([sha.hexdigest()])], names=["x1", "x2", "ends_sha256"])

    for batch in it:
        for x1, x2, part in zip(*[batch.column(c).to_pylist() for c in ("x1", "x2", "part")], strict=True):
            if (x1, x2) == node:
                sha.update(b"," + part.encode())
                continue
            if node:
                yield row()
            node, sha = (x1, x2), hashlib.sha256(part.encode())
    if node:
        yield row()


def member_digests(ends: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of the ids of ``ends`` (x1, x2, conv_id), ascending and joined by commas.

    A digest runs over its bytes in order. Ids are joined into parts by ranges of (x1, x2, conv_id) first, which split a node
    with very many ids; its parts, a few thousandths as many rows, then pass one running digest, which holds one at a time.
    """
    n = partitions(ends.sparkSession)
    key = ["x1", "x2", "conv_id"]
    parts = staged(ends.select(*key).repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(_texts, "x1 long, x2 long, first long, part string"), "parts")
    found = parts.repartition(n, "x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInArrow(_digests, "x1 long, x2 long, ends_sha256 string")
    found = staged(found, "digests")
    discard(parts)
    return found


def trie_report(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation
    is rebuilt as the first h turns of the one whose id ends its group of 100, then its own turns after its first h. Null
    role and text are empty, rows without a conv_id belong to no conversation, repeated rows are turns of their own, ties in
    turn are ordered by role and a hash of role and text. An empty table has no members, so no node. Other columns are not
    read. Staged tables are written while the plan is built.
    """
    placed = numbered_turns(turns.select("conv_id", "turn", "role", "text"))
    prefixes = rebuilt_prefixes(placed)
    discard(placed)
    last = F.any_value(F.struct("y1", "y2", "chars")).alias("last")
    nodes = prefixes.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), last)
    nodes = staged(nodes.select(
        F.struct("x1", "x2").alias("id"), F.when(F.col("depth") > 0, F.struct(F.col("last.y1").alias("x1"), F.col("last.y2").alias("x2"))).alias("parent"),
        "conv_id", F.col("depth").cast("long").alias("depth"), "n_convs", ((F.col("n_convs") - 1) * F.col("last.chars")).alias("saved")), "nodes")
    children = staged(nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    known = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = staged(known, "known")
    totals = subtree_totals(known.select("id", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), "saved"), ["n_leaves", "saved"])
    digests = member_digests(prefixes.filter("depth = size"))
    ends = digests.select(F.struct("x1", "x2").alias("id"), "ends_sha256")
    full = known.drop("saved").join(totals, "id").join(ends, "id", "left")
    full = staged(full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))), "full")
    discard(prefixes, children, known, totals, digests)
    up = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(up, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


#: A node's subtree are the nodes whose smallest member starts with it. Node ids are chains of digests of 64 characters.
SQL = f"""
WITH own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
named AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM own),
conv AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS top, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % {HEADS} AS head FROM named),
part AS (SELECT c.conv_id, 0 AS side, pos, role, text FROM conv c JOIN own o ON o.conv_id = c.top AND o.pos <= c.head
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.head),
turns AS (SELECT conv_id, text, sha256(concat(length(role), ':', role, text)) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS d FROM part),
member AS (SELECT conv_id, d, text, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS id FROM turns
  UNION ALL SELECT conv_id, 0, '', '' FROM conv),
node AS (SELECT id, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(length(text)) AS saved FROM member GROUP BY id),
child AS (SELECT left(id, length(id) - 64) AS id, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
val AS (SELECT node.*, coalesce(child.n, 0) AS kids FROM node LEFT JOIN child USING (id)),
sub AS (SELECT m.id, count(*) FILTER (v.kids = 0) AS leaves, sum(v.saved) AS saved FROM val v JOIN member m ON m.conv_id = v.conv_id AND m.d <= v.depth GROUP BY m.id),
fin AS (SELECT id, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, id, d, max(d) OVER (PARTITION BY conv_id) AS top FROM member) WHERE d = top GROUP BY id)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
  CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(fin.ids, '')) AS ends_sha256
FROM val v JOIN sub USING (id) LEFT JOIN fin USING (id) LEFT JOIN node p ON v.depth > 0 AND p.id = left(v.id, length(v.id) - 64)
"""
