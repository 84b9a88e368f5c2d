"""Removal of long repeated byte strings with a run-length index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.llm.common import batches, chunks, discard, distinct_texts, drop, mix, partitions, powers, prefix_hash, span_hash, staged, text_keys, utf8

WINDOW = 200
GRAM = 32
BLOCK_BYTES = 1 << 20

SEGMENT = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("copies", pa.int64()), ("own", pa.int32())])
SPAN = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
GRAMS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("a", pa.int32()), ("occ", pa.int64())])


def owned_segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Stretches of texts whose windows share their smallest gram hash.

    Each window of a text lies in exactly one stretch. Equal windows have equal smallest hashes, wherever they stand, so
    two copies of a window are always in stretches of one hash ``h``: (row, start, end, h, hash of the stretch, own).
    ``own`` is 1 where the gram stands at several places of the stretch, which may then repeat within itself.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    if n < window:
        return empty
    prefix = prefix_hash(data)
    inverse = powers(n + 1)[1]
    low = grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    width, reach = window - gram + 1, 1
    while reach * 2 <= width:  # minimum over a power of two, then over the rest
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach:])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - window + 1]
    at = np.flatnonzero(np.arange(n - window + 1) + window <= ends)
    if not len(at):
        return empty
    h = low[at]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)]))
    end = np.append(new[1:], len(at)) - 1
    first, last = at[new], at[end]
    leaves = np.concatenate([[0], np.cumsum(grams[at] == h)])  # windows that start at their gram: the next has another one
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first, last + window, h[new], span_hash(prefix, first, last + window), (leaves[end] > leaves[new]).astype(np.int64)


def _segments(it):
    for batch in it:
        data, offsets = utf8(batch.column("text"))
        k1, k2, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "copies"))
        for i, j in chunks(offsets):
            lo = offsets[i]
            row, start, end, h, s, own = owned_segments(data[lo: offsets[j]], offsets[i: j + 1] - lo)
            at = row + i
            yield from batches({"h": h.view(np.int64), "s": s.view(np.int64), "k1": k1[at], "k2": k2[at], "start": start - (offsets[at] - lo), "size": end - start, "copies": copies[at], "own": own}, SEGMENT)


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sorted suffixes of stretches laid end to end; ``rest`` is the distance to the end of the own stretch (0 on its
    separator). Separators are smaller than any byte and ordered by place. Prefix doubling, resorting only ties."""
    n = len(text)
    code = text.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        part = np.zeros(n, np.int64)
        part[: n - j] = code[j:]
        key |= np.where(rest > j, part, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    depth = 7
    stop = np.arange(n) + rest
    place = np.arange(n)
    while True:
        first = np.maximum.accumulate(np.where(head, place, 0))
        rank[order] = first
        tied = ~(head & np.append(head[1:], True))
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        which = order[at]
        nxt = np.where(rest[which] > depth, rank[np.minimum(which + depth, n - 1)], stop[which] - n - 1)
        again = np.argsort(first[at] * (2 * n + 2) + nxt + n + 1, kind="stable")
        which, nxt, group = which[again], nxt[again], first[at][again]
        order[at] = which
        head[at] = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        depth *= 2


def common_lengths(prefix: np.ndarray, rest: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes p and q, by bisection on hashes."""
    high = np.minimum(rest[p], rest[q])
    low = np.zeros(len(p), np.int64)
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        mid = (low[at] + high[at] + 1) // 2
        same = span_hash(prefix, p[at], p[at] + mid) == span_hash(prefix, q[at], q[at] + mid)
        low[at[same]] = mid[same]
        high[at[~same]] = mid[~same] - 1
    return low


def matching_statistics(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For every position the length of the longest match that starts at another position.

    Run-length index: the Burrows-Wheeler transform of the stretches is cut into runs of equal bytes, and only the ends
    of runs keep their text position and the length of the match with their neighbour in suffix order. Inside a run the
    match of the following position is one shorter, so a pass over the text in order gives every other length.
    """
    order = suffix_array(text, rest)
    before = np.full(len(text), -1, np.int64)
    inner = np.flatnonzero(rest[:-1] > 1) + 1  # the first byte of a stretch has no byte before it
    before[inner] = text[inner - 1]
    bwt = before[order]
    cut = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
    prefix = prefix_hash(text)
    place = np.arange(len(text))
    best = np.zeros(len(text), np.int64)
    for ends, near in ((np.flatnonzero(cut) + 1, -1), (np.flatnonzero(cut), 1)):
        sample = order[ends]
        length = np.full(len(text), -1, np.int64)
        length[order[0 if near < 0 else -1]] = 0  # no neighbour on this side
        length[sample] = common_lengths(prefix, rest, sample, order[ends + near])
        last = np.maximum.accumulate(np.where(length >= 0, place, -1))
        best = np.maximum(best, np.where(last >= 0, length[last] - (place - last), 0))
    return np.maximum(best, 0)


def long_matches(pieces: list[tuple], window: int = WINDOW):
    """Covered spans (k1, k2, a, b) of one block. ``pieces``: (k1, k2, start, bytes), overlaps of one text laid once."""
    pieces = sorted(pieces, key=lambda p: p[:3])
    parts, homes, owner, reach = [], [], None, 0
    for k1, k2, start, raw in pieces:
        if (k1, k2) == owner and start <= reach:
            if start + len(raw) > reach:
                parts[-1].append(raw[reach - start:])
                reach = start + len(raw)
            continue
        owner, reach = (k1, k2), start + len(raw)
        parts.append([raw])
        homes.append((k1, k2, start))
    joined = [b"".join(p) for p in parts]
    sizes = np.array([len(p) for p in joined])
    text = np.frombuffer(b"\0".join([*joined, b""]), np.uint8)
    stops = np.cumsum(sizes + 1) - 1
    base = stops - sizes
    rest = np.repeat(stops, sizes + 1) - np.arange(len(text))
    match = matching_statistics(text, rest)
    at = np.flatnonzero(match >= window)
    if not len(at):
        return {c: np.zeros(0, np.int64) for c in SPAN.names}
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + match[at], -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    step = np.diff(inside.astype(np.int8))
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    home = np.searchsorted(base, a, "right") - 1
    k1, k2, start = (np.array([h[i] for h in homes]) for i in range(3))
    return {"k1": k1[home], "k2": k2[home], "a": a - base[home] + start[home], "b": b - base[home] + start[home]}


def _index_blocks(it):
    """Rows come sorted by h; a block ends between two values of h once it holds BLOCK_BYTES."""
    pieces, size, last = [], 0, None
    for batch in it:
        cols = [batch.column(c).to_pylist() for c in ("h", "k1", "k2", "start", "piece")]
        for h, k1, k2, start, raw in zip(*cols, strict=True):
            if size >= BLOCK_BYTES and h != last:
                yield from batches(long_matches(pieces), SPAN)
                pieces, size = [], 0
            pieces.append((k1, k2, start, raw))
            size += len(raw)
            last = h
    if pieces:
        yield from batches(long_matches(pieces), SPAN)


def _grams(it):
    for batch in it:
        for h, k1, k2, start, raw, occ in zip(*[batch.column(c).to_pylist() for c in ("h", "k1", "k2", "start", "piece", "occ")], strict=True):
            at = np.arange(len(raw) - WINDOW + 1)
            g = span_hash(prefix_hash(np.frombuffer(raw, np.uint8)), at, at + WINDOW).view(np.int64)
            m = len(at)
            yield from batches({"h": np.full(m, h), "g": g, "k1": np.full(m, k1), "k2": np.full(m, k2), "a": at + start, "occ": np.full(m, occ)}, GRAMS)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Spans of ``texts`` (k1, k2, copies, text) covered by a string of WINDOW bytes that starts anywhere else.

    Returns (k1, k2, spans: array of (a, b) byte offsets, not merged) for texts that have one. Windows meet by their
    smallest gram hash; hashes seen once drop out after a count that combines before the shuffle. A stretch seen more than
    once is stored once with its number: all its windows repeat. The distinct stretches of a hash are indexed in blocks of
    about BLOCK_BYTES, cut between hashes. Hashes with more text than a block, such as the edge of a passage in a third of
    all texts, are counted window by window instead, which no task has to hold.
    """
    spark = texts.sparkSession
    seg = staged(texts.filter(F.octet_length("text") >= WINDOW).select("k1", "k2", "copies", "text").mapInArrow(
        _segments, "h long, s long, k1 long, k2 int, start int, size int, copies long, own int"), "segments")
    many = seg.groupBy("h").agg(F.sum(F.col("copies") + F.col("own")).alias("occ")).filter("occ > 1").select("h")
    hits = staged(seg.join(many, "h", "left_semi"), "hits")
    kept = hits.groupBy("h", "s").agg(F.sum("copies").alias("occ"), F.max("own").alias("own"), F.min(F.struct("k1", "k2", "start", "size")).alias("rep"))
    kept = staged(kept.select("h", "s", "occ", "own", "rep.*"), "stretches")
    weight = kept.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.max("own").alias("self"), F.sum("size").alias("bytes"))
    varied = kept.join(weight.filter("variants > 1 or self > 0"), "h")
    piece = F.expr("substring(cast(text as binary), start + 1, size)").alias("piece")
    pieces = varied.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).select("h", "k1", "k2", "start", "occ", "bytes", piece)
    pieces = staged(pieces, "pieces")
    cold = pieces.filter(F.col("bytes") <= BLOCK_BYTES).select("h", "k1", "k2", "start", "piece")
    found = cold.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_index_blocks, "k1 long, k2 int, a int, b int")
    grams = pieces.filter(F.col("bytes") > BLOCK_BYTES).mapInArrow(_grams, "h long, g long, k1 long, k2 int, a int, occ long")
    twice = grams.groupBy("h", "g").agg(F.sum("occ").alias("n")).filter("n > 1").select("h", "g")
    windows = grams.join(twice, ["h", "g"], "left_semi").select("k1", "k2", "a", (F.col("a") + WINDOW).alias("b"))
    whole = hits.join(kept.filter("occ > 1").select("h", "s"), ["h", "s"], "left_semi").select(
        "k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    spans = found.unionByName(windows).unionByName(whole)
    spans = staged(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    discard(seg, hits, kept, pieces)
    return spans


def _strip(it):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("kept", pa.binary())])
    for batch in it:
        data, offsets = utf8(batch.column("text"))
        out_spans, out_kept = [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            raw = data[offsets[i]: offsets[i + 1]]
            if not spans:
                out_spans.append([])
                out_kept.append(raw.tobytes())
                continue
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, [s["a"] for s in spans], 1)
            np.add.at(edge, [s["b"] for s in spans], -1)
            gone = np.cumsum(edge)[:-1] > 0
            step = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            out_spans.append([{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
            out_kept.append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out_spans, schema.field("spans").type), pa.array(out_kept, pa.binary())], schema=schema)


def strip_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Per distinct text of ``docs``: (k1, k2, spans, kept), the maximal removed spans and the bytes that remain.

    With it come the table of distinct texts that it reads and its name, to ``drop`` when it is written.

    Rows are documents: equal rows repeat each other, whatever their doc_id (null included). A null text is an empty one,
    and texts shorter than WINDOW bytes are kept whole. Matches never cross documents. An empty table gives no rows.
    ``text_keys`` of a document's text gives its key; columns other than ``text`` are not read.
    """
    texts, label = distinct_texts(docs, "texts")
    joined = texts.join(repeated_spans(texts), ["k1", "k2"], "left").select("k1", "k2", "text", "spans")
    return joined.mapInArrow(_strip, "k1 long, k2 int, spans array<struct<a:int,b:int>>, kept binary"), texts, label


def repeats_report(docs: DataFrame) -> DataFrame:
    """Digest of ``strip_repeats`` per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    stripped, texts, label = strip_repeats(docs)
    digest = stripped.select(
        "k1", "k2", F.octet_length("kept").cast("long").alias("n_kept"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    digest = staged(digest, "digest")
    drop(texts, label)
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = text_keys(text)
    rows = docs.select("doc_id", k1, k2, F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.join(digest, ["k1", "k2"]).select("doc_id", "n_bytes", (F.col("n_bytes") - F.col("n_kept")).alias("n_removed"), "n_spans", "kept_sha256")
