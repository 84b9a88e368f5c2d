"""Removal of repeated word sequences by suffix automata of bounded reference shards."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.llm.common import chunks, discard, drop, first_texts, mix, partitions, powers, prefix_hash, span_hash, staged, text_keys, utf8, word_bounds

WINDOW = 20
GRAM = 6
SHARD_WORDS = 1 << 16
_STEP = np.uint64(0x9FB21C651E98DF25)

SEGMENTS = "h long, s long, k1 long, k2 int, doc {kind}, some boolean, start int, size int, own int"
RUNS = "h long, s long, a int, b int, doc {kind}, some boolean, at int"


# --- suffix automaton ------------------------------------------------------------------------------------------------


class SuffixAutomaton:
    """Suffix automaton of several word sequences. Each state keeps the rank of its earliest occurrence, where the caller
    ranks every word position; a sequence of words occurs at the positions of one state."""

    def __init__(self, sequences: list[list[int]], ranks: list[list[int]]):
        step: list[dict[int, int]] = [{}]
        link, length, rank = [-1], [0], [1 << 62]
        for words, places in zip(sequences, ranks, strict=True):
            last = 0
            for word, place in zip(words, places, strict=True):
                known = step[last].get(word)
                if known is not None and length[known] == length[last] + 1:
                    last = known
                    if place < rank[last]:
                        rank[last] = place
                    continue
                if known is None:
                    new = len(step)
                    step.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    rank.append(place)
                    p = last
                    while p >= 0 and word not in step[p]:
                        step[p][word] = new
                        p = link[p]
                    last = new
                    if p < 0:
                        continue
                    q = step[p][word]
                    if length[q] == length[p] + 1:
                        link[new] = q
                        continue
                else:
                    new, p, q = -1, last, known
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                rank.append(1 << 62)
                link[q] = copy
                if new >= 0:
                    link[new] = copy
                else:
                    last = copy
                    rank[copy] = place
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
        for state in sorted(range(1, len(step)), key=length.__getitem__, reverse=True):  # longer sequences occur where their ends do
            up = link[state]
            if rank[state] < rank[up]:
                rank[up] = rank[state]
        self.step, self.link, self.length, self.rank = step, link, length, rank

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """Per position (length, state) of the longest match that ends there."""
        step, link, length = self.step, self.link, self.length
        state, size, out = 0, 0, []
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            if word in step[state]:
                state, size = step[state][word], size + 1
            out.append((size, state))
        return out

    def earliest(self, words: list[int], window: int = WINDOW) -> list[int]:
        """Rank of the earliest occurrence of every window of ``words`` (-1: none), by its last word."""
        link, length, rank = self.link, self.length, self.rank
        out = []
        for size, state in self.statistics(words)[window - 1:]:
            if size < window:
                out.append(-1)
                continue
            while length[link[state]] >= window:
                state = link[state]
            out.append(rank[state])
        return out


# --- word hashes and stretches ---------------------------------------------------------------------------------------


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (a word never crosses texts), and the place of each text's first word."""
    start, end = word_bounds(data)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    at = np.searchsorted(end, inner, "right")
    cut = inner[(at < len(start)) & (start[np.minimum(at, max(0, len(start) - 1))] < inner)] if len(start) else inner[:0]
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


def stretches(word: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Stretches of texts whose windows share their smallest n-gram hash: (text, first word, words, h, s, own).

    Each window lies in exactly one stretch, and equal windows in stretches of one hash ``h``. ``s`` identifies the words of
    a stretch; ``own`` is 1 where the n-gram stands at several places of it, which may then repeat within itself.
    """
    none = np.zeros(0, np.int64)
    n = len(word)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = mix(grams * _STEP + word[k: k + len(grams)])
    low = grams
    width, reach = window - gram + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach:])
    stop = np.repeat(bounds[1:], np.diff(bounds))[: n - window + 1]
    at = np.flatnonzero(np.arange(n - window + 1) + window <= stop)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    h = low[at]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(new[1:], len(at)) - 1
    first, size = at[new], at[last] - at[new] + window
    leaves = np.concatenate([[0], np.cumsum(grams[at] == h)])
    own = (leaves[last] > leaves[new]).astype(np.int64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(word) * powers(n + 1)[0][:-1], out=prefix[1:])
    return np.searchsorted(bounds, first, "right") - 1, first, size, h[new], span_hash(prefix, first, first + size), own


def _word_chunks(batch):
    data, offsets = utf8(batch.column("text"))
    for i, j in chunks(offsets):
        lo = offsets[i]
        part = data[lo: offsets[j]]
        start, end, bounds = text_words(part, offsets[i: j + 1] - lo)
        yield i, part, start, end, bounds


def _segments(it):
    for batch in it:
        for i, part, start, end, bounds in _word_chunks(batch):
            row, first, size, h, s, own = stretches(span_hash(prefix_hash(part), start, end), bounds)
            if len(row):
                at = pa.array(i + row)
                cols = [pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), *[batch.column(c).take(at) for c in ("k1", "k2", "doc", "some")]]
                cols += [pa.array(x.astype(np.int32)) for x in (first - bounds[row], size, own)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "s", "k1", "k2", "doc", "some", "start", "size", "own"])


def _cut(it):
    """Word hashes, as packed longs, of the stretches wanted of each text."""
    for batch in it:
        wanted = batch.column("wanted").to_pylist()
        h, s, at, words = [], [], [], []
        for i, part, start, end, bounds in _word_chunks(batch):
            word = span_hash(prefix_hash(part), start, end).tobytes()
            for d in range(len(bounds) - 1):
                for w in wanted[i + d]:
                    a = bounds[d] + w["start"]
                    h.append(w["h"])
                    s.append(w["s"])
                    at.append(i + d)
                    words.append((w["start"], word[8 * a: 8 * (a + w["size"])]))
        docs = batch.column("doc").take(pa.array(at, pa.int64()))
        some = batch.column("some").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.int64()), docs, some, pa.array([w[0] for w in words], pa.int32()), pa.array([w[1] for w in words], pa.binary())],
                                         names=["h", "s", "doc", "some", "start", "words"])


def _shard_runs(rows: list[tuple], kind):
    """Builds the automaton of one shard of stretches (h, s, doc, some, start, words) and streams them through it.

    Returns runs of windows of equal earliest document: (h, s, a, b, doc, some, at): of stretch (h, s), the windows that
    start at words a to b - 1, first seen in ``doc`` from word ``at`` on (window a at ``at``, and so on). A rank is the place
    of a document among those of the shard, then the end of the word in it.
    """
    docs = sorted({(r[3], r[2]) if r[3] else (False, None) for r in rows}, key=lambda d: (d[0], d[1] if d[0] else 0))
    base = {d: n << 32 for n, d in enumerate(docs)}
    first = [base[(r[3], r[2]) if r[3] else (False, None)] + r[4] + 1 for r in rows]
    sequences = [array("q", r[5]).tolist() for r in rows]
    machine = SuffixAutomaton(sequences, [range(f, f + len(words)) for f, words in zip(first, sequences, strict=True)])
    out = []
    for (h, s, *_), words in zip(rows, sequences, strict=True):
        ranks = machine.earliest(words)
        a = 0
        for b in range(1, len(ranks) + 1):
            if b == len(ranks) or ranks[b] != ranks[b - 1] + 1:
                some, doc = docs[ranks[a] >> 32]
                out.append((h, s, a, b, doc, some, (ranks[a] & 0xFFFFFFFF) - WINDOW))
                a = b
    h, s, a, b, doc, some, at = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(doc, kind), pa.array(some, pa.bool_()), pa.array(at, pa.int32())],
                                      names=["h", "s", "a", "b", "doc", "some", "at"])


def _shards(it):
    """Rows come sorted by h: a shard ends between two values of h once it holds SHARD_WORDS words."""
    rows, size, last = [], 0, None
    for batch in it:
        kind = batch.schema.field("doc").type
        for row in zip(*[batch.column(c).to_pylist() for c in ("h", "s", "doc", "some", "start", "words")], strict=True):
            if size >= SHARD_WORDS and row[0] != last:
                yield _shard_runs(rows, kind)
                rows, size = [], 0
            rows.append(row)
            size += len(row[5]) // 8
            last = row[0]
    if rows:
        yield _shard_runs(rows, kind)


def _windows(it):
    """Stretches of very common n-grams as single windows, dealt by all their words: (h: hash of the window, s: as before,
    a: place of the window in the stretch)."""
    for batch in it:
        cols = [batch.column(c).to_pylist() for c in ("h", "s", "start", "words")]
        h, s, a, start, at, words = [], [], [], [], [], []
        for i, (home, stretch, first, raw) in enumerate(zip(*cols, strict=True)):
            word = np.frombuffer(raw, "<u8")
            g = np.full(len(word) - WINDOW + 1, np.uint64(home & 0xFFFFFFFFFFFFFFFF))
            for k in range(WINDOW):
                g = mix(g * _STEP + word[k: k + len(g)])
            for j, x in enumerate(g.view(np.int64).tolist()):
                h.append(x)
                s.append(stretch)
                a.append(j)
                start.append(first + j)
                at.append(i)
                words.append(raw[8 * j: 8 * (j + WINDOW)])
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("h").take(at), pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(a, pa.int32()), batch.column("doc").take(at), batch.column("some").take(at), pa.array(start, pa.int32()), pa.array(words, pa.binary())],
                                         names=["home", "h", "s", "a", "doc", "some", "start", "words"])


# --- tables ----------------------------------------------------------------------------------------------------------


def earlier_spans(texts: DataFrame, kind: str) -> DataFrame:
    """Spans of words of ``texts`` (k1, k2, doc, some, text) that a window covers which also starts earlier.

    Windows are dealt by their smallest n-gram hash: equal windows meet, each in one stretch. Hashes seen once drop out after
    a count that combines before the shuffle. Equal stretches are stored once, with the earliest place. A reference shard
    holds the stretches of some hashes, about SHARD_WORDS words; its automaton gives the earliest start of every window of
    the stretches that are streamed through it. Hashes of more words than a shard, as at the edge of a passage in a third of
    all texts, are dealt anew, window by window, by a hash of the whole window; equal windows are combined first, so one
    shard never holds more than it should.
    """
    spark = texts.sparkSession
    seg = staged(texts.select("k1", "k2", "doc", "some", "text").mapInArrow(_segments, SEGMENTS.format(kind=kind)), "segments")
    many = seg.groupBy("h").agg(F.sum(1 + F.col("own")).alias("occ")).filter("occ > 1").select("h")
    hits = staged(seg.join(many, "h", "left_semi").drop("own"), "hits")
    discard(seg)
    place = F.struct("some", "doc", "start", "k1", "k2", "size").alias("rep")
    kept = staged(hits.groupBy("h", "s").agg(F.min(place).alias("rep")).select("h", "s", "rep.*"), "stretches")
    wanted = kept.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "s", "start", "size")).alias("wanted"))
    pieces = texts.join(wanted, ["k1", "k2"]).select("doc", "some", "text", "wanted").mapInArrow(
        _cut, f"h long, s long, doc {kind}, some boolean, start int, words binary")
    pieces = staged(pieces, "pieces")
    weight = pieces.groupBy("h").agg(F.sum(F.octet_length("words")).alias("bytes"))
    large = staged(weight.filter(F.col("bytes") > 8 * SHARD_WORDS).select("h"), "large")
    runs = RUNS.format(kind=kind)
    plain = pieces.join(large, "h", "left_anti").repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_shards, runs)
    single = pieces.join(large, "h", "left_semi").mapInArrow(_windows, f"home long, h long, s long, a int, doc {kind}, some boolean, start int, words binary")
    single = staged(single, "windows")
    distinct = single.groupBy("h").agg(F.min(F.struct("some", "doc", "start", "words")).alias("rep"))
    distinct = distinct.select("h", F.col("h").alias("s"), "rep.doc", "rep.some", "rep.start", "rep.words")
    judged = staged(distinct.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_shards, runs), "judged")
    back = single.select("home", "h", "s", F.col("a").alias("place")).join(judged.select("h", "doc", "some", "at"), "h")
    runs = staged(plain.unionByName(back.select(F.col("home").alias("h"), "s", F.col("place").alias("a"), (F.col("place") + 1).alias("b"), "doc", "some", "at")), "runs")
    discard(pieces, large, single, judged)
    seen = hits.join(runs.select("h", "s", "a", "b", F.col("doc").alias("first"), F.col("some").alias("known"), "at"), ["h", "s"])
    same = F.col("doc").eqNullSafe(F.col("first"))
    later = ~same & (F.col("some") & (~F.col("known") | (F.col("doc") > F.col("first")))) | same & (F.col("start") + F.col("a") > F.col("at"))
    spans = seen.filter(later).select("k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (WINDOW - 1)).alias("b"))
    spans = staged(spans, "spans")
    discard(hits, kept, runs)
    return spans


def _strip(it):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("n_removed", pa.int64()), ("kept", pa.binary())])
    for batch in it:
        wanted = batch.column("spans").to_pylist()
        count, merged, removed, kept = [], [], [], []
        for i, part, start, end, bounds in _word_chunks(batch):
            gone = np.zeros(len(start) + 1, np.int64)
            for d in range(len(bounds) - 1):
                for span in wanted[i + d] or ():
                    gone[bounds[d] + span["a"]] += 1
                    gone[bounds[d] + span["b"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            for d in range(len(bounds) - 1):
                a, b = bounds[d], bounds[d + 1]
                own = gone[a:b]
                step = np.diff(np.concatenate([[0], own, [0]]).astype(np.int8))
                merged.append([{"a": int(x), "b": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                count.append(b - a)
                removed.append(int(own.sum()))
                keep = np.flatnonzero(~own) + a
                kept.append(_joined(part, start[keep], end[keep]))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(count, pa.int64()), pa.array(merged, schema.field("spans").type), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=schema)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words from start to end, joined by one space."""
    if not len(start):
        return b""
    size = end - start + 1
    total = np.cumsum(size)
    at = np.arange(total[-1]) - np.repeat(total - size, size) + np.repeat(start, size)
    out = data[np.minimum(at, len(data) - 1)]
    out[total - 1] = 32
    return out[:-1].tobytes()


def strip_repeated_words(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Per distinct text of ``docs``, for its row of smallest doc_id: (k1, k2, n_words, spans, n_removed, kept, doc, some).

    A word goes if a window of WINDOW words covers it whose words also start earlier: at a smaller (doc_id, start). A null
    doc_id is smaller than any other; rows that share a doc_id count as one document, of which windows at equal starts are
    not earlier than each other. Rows of larger doc_id with the same text lose every word if there are WINDOW or more. Null
    and wordless texts have no words; an empty table gives no rows; columns other than doc_id and text are not read.

    With it come the table of distinct texts that it reads and its name, to ``drop`` when it is written. Staged tables are
    written while the plan is built.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts, label = first_texts(docs, "texts")
    spans = earlier_spans(texts, kind)
    grouped = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = texts.join(grouped, ["k1", "k2"], "left")
    stripped = joined.select("k1", "k2", "text", "spans").mapInArrow(_strip, "k1 long, k2 int, n_words long, spans array<struct<a:int,b:int>>, n_removed long, kept binary")
    return stripped, texts, label


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def automata_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``, from ``strip_repeated_words``."""
    stripped, texts, label = strip_repeated_words(docs)
    digest = stripped.select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    digest = staged(digest, "digest")
    owner = staged(texts.select("k1", "k2", F.col("doc").alias("owner")).join(digest, ["k1", "k2"]), "owner")
    drop(texts, label)
    discard(digest)
    k1, k2 = text_keys(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", k1, k2).join(owner, ["k1", "k2"])
    copy = ~F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("n_words") >= WINDOW)
    return rows.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                       F.when(copy, F.lit(_sha(b""))).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


#: The windows of every text with their earliest start.
SQL = rf"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos FROM split WHERE len(w) >= {WINDOW}),
win AS (SELECT r, coalesce(doc_id, -9223372036854775808) AS d, pos, array_to_string(list_slice(w, pos, pos + {WINDOW - 1}), ' ') AS t FROM spot),
head AS (SELECT t, min(row(d, pos)) AS least FROM win GROUP BY t HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(pos, pos + {WINDOW})) AS pos FROM win JOIN head USING (t) WHERE row(d, pos) > least),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM split),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN hit USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""
