"""Secret scans: fixed patterns, and strings more likely under a character model of random strings than of identifiers."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.llm.common import chunks, staged, utf8
from acadspark.llm.rules import with_text

# The base patterns, in the order of their kinds.
ASSIGN = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_ASSIGN, _ACCESS = re.compile(ASSIGN, re.IGNORECASE), re.compile(ACCESS)
ALPHABET = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
N = len(ALPHABET)
CODE = np.full(256, -1, np.int16)
CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(N)
HEXES = np.zeros(256, bool)
HEXES[np.frombuffer(b"0123456789abcdef", np.uint8)] = True

MARGIN = 12.0  # log-likelihood ratio of a secret
EVERY = 0.3  # and least mean per character
BACK_OFF = 200.0  # a pair seen a few times is no evidence yet
UNIFORM = 0.3
UNSEEN = 0.05  # share of an even choice in ordinary strings, so that one rare character proves nothing
NUMBER = 2 / 3  # share of digits among the letters and digits of a number-like string, which has models of its own
HELD_OUT = 5  # one text in so many sets the margins instead of the models
FALSE_SHARE = 1e-4  # of held-out ordinary strings that may reach the margin
_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true of at least ``least``."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    return start[long], end[long]


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text the base spans (start, kind, end) in bytes of ``data``.

    The patterns are ASCII, so bytes match as code points do. Runs of hexadecimal digits come from array operations; the
    other two run on texts that hold a mark they need.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    mask = HEXES[data]
    start, end = runs(mask, LEAST["hex"])
    for a, b in zip(start, end, strict=True):  # a run that crosses a border of texts is cut there
        cuts = [a, *(a + 1 + np.flatnonzero(ends[a + 1: b])), b]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x >= LEAST["hex"]:
                found[int(np.searchsorted(offsets, x, "right")) - 1].append((int(x), 2, int(y)))
    for d in range(len(offsets) - 1):
        a = int(offsets[d])
        raw = data[a: offsets[d + 1]].tobytes()
        if b":" in raw or b"=" in raw:
            found[d] += [(a + m.start(), 0, a + m.end()) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
        if b"AKIA" in raw:
            found[d] += [(a + m.start(), 1, a + m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
        found[d].sort()
    return found


def strings(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the alphabet within texts."""
    mask = np.zeros(len(data) + len(offsets), bool)  # one gap before each text
    row = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    mask[np.arange(len(data)) + row] = CODE[data] >= 0
    start, end = runs(mask, least)
    shift = np.searchsorted(offsets + np.arange(len(offsets)), start, "right")
    return start - shift, end - shift


def transitions(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Counts of character pairs in stretches (in order, without overlaps); the row N is the start of a stretch. Characters outside
    the alphabet are passed over."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    code = CODE[data].astype(np.int64)
    at = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (code >= 0))
    own = np.searchsorted(start, at, "right")
    code = code[at]
    before = np.concatenate([[N], code[:-1]])
    before[np.flatnonzero(np.diff(own, prepend=-1))] = N
    return np.bincount(before * N + code, minlength=(N + 1) * N)


class Model:
    """Log-likelihood ratios of character pairs, random strings over ordinary ones, and margins: for strings at large (0) and for
    number-like ones (1): dates, book, card and account numbers are mostly digits and are compared with each other only."""

    def __init__(self, ratio: np.ndarray, margin: tuple[float, float]):
        self.ratio, self.margin = ratio, margin


def number_like(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 for stretches whose letters and digits are digits to NUMBER or more, else 0."""
    digits, letters = (np.concatenate([[0], np.cumsum(mask[data])]) for mask in (_DIGIT, _LETTER))
    d, n = digits[end] - digits[start], letters[end] - letters[start]
    return ((d > 0) & (d >= NUMBER * (d + n))).astype(np.int64)


def labelled_strings(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random strings (values that base patterns find) and ordinary ones (all strings that hold none) of texts: starts and ends."""
    secret = np.zeros(len(part) + 1, bool)
    labelled = []
    for spans in base_spans(part, at):
        for a, kind, b in spans:
            secret[a:b] = True
            if kind == 0:  # the value after the sign
                a += _ASSIGN.match(part[a:b].tobytes()).start(2)
            labelled.append((a, b))
    start, end = strings(part, at, 1)
    inside = np.concatenate([[0], np.cumsum(secret)])
    plain = inside[end] == inside[start]  # the rest of a run beside a secret is not ordinary
    return np.array(labelled, np.int64).reshape(-1, 2), np.stack([start[plain], end[plain]], 1)


def apart(spans: np.ndarray) -> list[np.ndarray]:
    """Spans as sets in order without overlaps; values of different base patterns may overlap."""
    spans, sets = spans[np.lexsort((spans[:, 1], spans[:, 0]))], []
    while len(spans):
        reach = np.maximum.accumulate(np.concatenate([[0], spans[:-1, 1]]))
        free = spans[:, 0] >= reach
        sets.append(spans[free])
        spans = spans[~free]
    return sets


def texts_of(docs: DataFrame, held_out: bool) -> DataFrame:
    """(text): every text that sets the margins, or every other one. Copies of a text are on the same side and count each."""
    held = F.pmod(F.xxhash64(F.lit(4), "text"), F.lit(HELD_OUT)) == 0
    return docs.select("text").filter(F.col("text").isNotNull()).filter(held if held_out else ~held)


def train(docs: DataFrame) -> Model:
    """Models and margins from all texts: one in HELD_OUT sets the margins, the others give the counts.

    The strings labelled random are those that base patterns find, the ordinary ones all strings of any length that hold none
    of them. Pair counts are summed by Spark: tables of fixed size reach the driver. Pairs back off to single characters, and
    these to equal shares, so an empty table gives a ratio of 0. A random string may be of any alphabet: UNIFORM of its
    model is an even choice; UNSEEN of the model of ordinary strings is one too. A margin is MARGIN or the least above it that
    no more than FALSE_SHARE of the held-out ordinary strings reach.
    """

    def run(it):
        tables = np.zeros((4, (N + 1) * N), np.int64)
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
                for label, both in enumerate(labelled_strings(part, at)):
                    kind = number_like(part, both[:, 0], both[:, 1])
                    for k in (0, 1):
                        for own in apart(both[kind == k]):
                            tables[2 * k + label] += transitions(part, own[:, 0], own[:, 1])
        label, pair = np.nonzero(tables)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(tables[label, pair])], names=["label", "pair", "n"])

    counted = texts_of(docs, False).mapInArrow(run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    tables = np.zeros((4, N + 1, N))
    for r in counted.collect():  # at most 4 (N + 1) N rows
        tables[r["label"]].ravel()[r["pair"]] += r["n"]
    single = (tables.sum(1) + 1) / (tables.sum((1, 2)) + N)[:, None]
    pairs = (tables + BACK_OFF * single[:, None, :]) / (tables.sum(2, keepdims=True) + BACK_OFF)
    pairs[::2] = (1 - UNIFORM) * pairs[::2] + UNIFORM / N
    pairs[1::2] = (1 - UNSEEN) * pairs[1::2] + UNSEEN / N
    model = Model(np.log(pairs[::2]) - np.log(pairs[1::2]), (MARGIN, MARGIN))
    rates = held_out_scores(docs, model)
    margin = []
    for kind in (0, 1):
        plain = sorted(((s, n) for (label, k, s), n in rates.items() if label == 1 and k == kind), reverse=True)
        allowed, least = FALSE_SHARE * sum(n for _, n in plain), MARGIN
        for score, n in plain:
            allowed -= n
            if allowed < 0:
                least = max(least, score + 1.0)
                break
        margin.append(least)
    return Model(model.ratio, (margin[0], margin[1]))


def held_out_scores(docs: DataFrame, model: Model) -> dict[tuple[int, int, int], int]:
    """Numbers of held-out strings by (label: 0 random, 1 ordinary; number-like; whole part of the ratio, 0 for all that fall
    below it or below EVERY per character): some hundreds of rows reach the driver."""

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
                for label, both in enumerate(labelled_strings(part, at)):
                    both = both[np.lexsort((both[:, 1], both[:, 0]))]
                    if len(both):
                        score, kind = ratios(part, both[:, 0], both[:, 1], model)
                        score = np.where(score >= EVERY * (both[:, 1] - both[:, 0]), np.clip(score, 0, 500), 0).astype(np.int64)
                        pair, n = np.unique(kind * 1000 + score, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), label)), pa.array(pair // 1000), pa.array(pair % 1000), pa.array(n)], names=["label", "kind", "score", "n"])

    found = texts_of(docs, True).mapInArrow(run, "label long, kind long, score long, n long").groupBy("label", "kind", "score").agg(F.sum("n").alias("n"))
    return {(r["label"], r["kind"], r["score"]): r["n"] for r in found.collect()}


def ratios(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio and kind (number-like or not) of stretches of alphabet characters in order; characters of none, as in
    labelled values, count 0."""
    kind = number_like(data, start, end)
    code = CODE[data].astype(np.int64)
    score = np.zeros(len(start))
    for k in (0, 1):
        own = np.flatnonzero(kind == k)
        if not len(own):
            continue
        before = np.concatenate([[N], code[:-1]])
        before[start[own]] = N
        known = (code >= 0) & (before >= 0)
        each = np.where(known, model.ratio[k][np.where(before < 0, N, before), np.maximum(code, 0)], 0.0)
        total = np.concatenate([[0.0], np.cumsum(each)])
        score[own] = total[end[own]] - total[start[own]]
    return score, kind


def outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of strings (in order) that lie in none of ``spans`` (in order of their starts)."""
    if not spans:
        return start, end
    joined: list[list[int]] = []
    for x, y in spans:
        if joined and x <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], y)
        else:
            joined.append([x, y])
    lo, hi = np.array(joined).T
    first, last = np.searchsorted(hi, start, "right"), np.searchsorted(lo, end, "left")  # spans that cut a string
    whole = first >= last
    parts = list(zip(start[whole].tolist(), end[whole].tolist(), strict=True))
    for i in np.flatnonzero(~whole):
        at = int(start[i])
        for x, y in joined[first[i]: last[i]]:
            parts.append((at, x))
            at = y
        parts.append((at, int(end[i])))
    parts = sorted(p for p in parts if p[0] < p[1])
    both = np.array(parts, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def markov_spans(data: np.ndarray, offsets: np.ndarray, model: Model, base: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Strings outside the spans ``base`` whose log-likelihood ratio and mean ratio reach the margin and EVERY, in bytes of
    ``data``. No length is asked for: strings too short to come to a margin at the highest ratio are left out beforehand."""
    top = max(float(model.ratio.max()), 1e-9)
    start, end = outside(*strings(data, offsets, max(1, math.ceil(min(model.margin) / top))), base or [])
    if not len(start):
        return []
    score, kind = ratios(data, start, end, model)
    good = (score >= np.array(model.margin)[kind]) & (score >= EVERY * (end - start))
    return list(zip(start[good].tolist(), end[good].tolist(), strict=True))


def scan(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (row: a struct, text: no null) with n_assign, n_access, n_hex, base and spans (kind:start:end by code
    points, comma-joined) and redacted, the text with each span, overlaps joined, replaced by [SECRET].

    Base spans stay as they are; the model judges the strings, or parts of strings, that lie outside them.
    """
    row_type = rows.schema["row"].dataType.simpleString()

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            counts, bases, every, redacted = [], [], [], []
            for i, j in chunks(offsets):
                lo = offsets[i]
                part, at = data[lo: offsets[j]], offsets[i: j + 1] - lo
                found = base_spans(part, at)
                added: list[list] = [[] for _ in found]
                for a, b in markov_spans(part, at, model, [(x, y) for base in found for x, _, y in base]):
                    added[int(np.searchsorted(at, a, "right")) - 1].append((a, 3, b))
                for d, base in enumerate(found):
                    a, b = int(at[d]), int(at[d + 1])
                    counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                    spans = sorted(base + added[d])
                    if not spans:
                        bases.append("")
                        every.append("")
                        redacted.append(part[a:b].tobytes().decode())
                        continue
                    point = np.concatenate([[0], np.cumsum((part[a:b] & 0xC0) != 0x80)])
                    say = lambda xs: ",".join(f"{KINDS[k]}:{point[x - a]}:{point[y - a]}" for x, k, y in xs)  # noqa: E731, B023
                    bases.append(say(base))
                    every.append(say(spans))
                    raw, done, out = part[a:b].tobytes(), 0, []
                    for x, _, y in spans:
                        if x - a >= done:
                            out += [raw[done: x - a], b"[SECRET]"]
                        done = max(done, y - a)
                    redacted.append(b"".join([*out, raw[done:]]).decode())
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(n[:, k]) for k in range(3)), pa.array(bases, pa.string()), pa.array(every, pa.string()), pa.array(redacted, pa.string())],
                names=["row", "n_assign", "n_access", "n_hex", "base", "spans", "redacted"])

    return rows.select("row", "text").mapInArrow(run, f"row {row_type}, n_assign long, n_access long, n_hex long, base string, spans string, redacted string")


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``.

    A null text is an empty one and has no spans; null and repeated ids stay rows, equal texts give equal spans; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = scan(rows, train(docs)).select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
    return staged(found, "secrets")


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced; null texts stay null, n_chars is counted anew, other columns are as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.when(F.col("row")["text"].isNotNull(), F.col("redacted"))
    return scan(rows, train(docs)).select(*[with_text(docs, c, text, F.col("row")[c]) for c in docs.columns])
