"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from labels of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.llm.common import chunks, lowered, mix, prefix_hash, span_hash, staged, utf8

BUCKETS = 1 << 18
STEMS = (4, 5, 6, 7, 8)
SAMPLE_ROWS = 2500  # labelled documents of each class that the model is fitted on
SAMPLE_BYTES = 5_000_000  # of each class; texts of any length count until the sum reaches it
LEAST_DOCUMENTS = 4  # sampled documents that hold a feature; the prior keeps rare ones small
EPOCHS, RATE, DECAY = 150, 0.15, 0.3
LEAN = 0.5  # power of a class's share: 1 keeps the shares of the labels, 0 makes the classes equal

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Features of texts as buckets, with the sentence of each, and per sentence its text, first and last byte.

    A sentence ends at . ! ? or a line break; one without words does not count. Words are runs of letters, digits and
    non-ASCII characters, letters A to Z in lower case. A feature is a word or its first STEMS bytes, so that forms of one
    stem share a weight; each counts once in a sentence.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    inner = np.flatnonzero(border[1:-1] & (inside[1:-2] == 1) & (inside[2:-1] == 1)) + 1  # a word never crosses texts
    edges = np.diff(inside)
    start = np.sort(np.concatenate([np.flatnonzero(edges == 1), inner]))
    end = np.sort(np.concatenate([np.flatnonzero(edges == -1), inner]))
    low = lowered(data)
    hashes = prefix_hash(low)
    breaks = np.cumsum(np.concatenate([[0], _STOP[data]]) + border)
    sentence = breaks[start]
    new = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(start) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, start[new], "right") - 1
    last = np.append(new[1:], len(start)) - 1
    own = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(start))))
    parts = []
    for k in (0, *STEMS):
        at = np.arange(len(start)) if not k else np.flatnonzero(end - start > k)
        feature = span_hash(hashes, start[at], start[at] + k if k else end[at]) + np.uint64(k)
        parts.append(own[at] * BUCKETS + (mix(feature) & np.uint64(BUCKETS - 1)).astype(np.int64))
    pair = np.unique(np.concatenate(parts))
    return pair % BUCKETS, pair // BUCKETS, text, start[new], end[last] if len(start) else start[new]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(word: np.ndarray, sentence: np.ndarray, text: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Word weights and bias that maximise the likelihood of document labels.

    A sentence is toxic with p = 1 / (1 + exp(-z)), z the bias and its features' weights; a document is clean if all
    its sentences are: -log(1 - P) is the sum of log(1 + exp(z)). Adam steps on the weighted log-likelihood.
    """
    w, b = np.zeros(BUCKETS), -4.0
    if not len(label) or label.min() == label.max():
        return w, -12.0 if not len(label) or not label.max() else 4.0
    doc_word = np.unique(text[sentence] * BUCKETS + word) % BUCKETS
    common = np.bincount(doc_word, minlength=BUCKETS) >= LEAST_DOCUMENTS
    kept = common[word]
    sentence, word = sentence[kept], word[kept]
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    share = weight / weight.sum()
    for step in range(1, EPOCHS + 1):
        z = b + np.bincount(sentence, w[word], minlength=len(text))
        q = np.bincount(text, softplus(z), minlength=len(label)) + 1e-9
        slope = np.where(label == 1, -1 / np.expm1(np.minimum(q, 50)), 1.0) * share
        dz = slope[text] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, dz[sentence], minlength=BUCKETS) + DECAY * share.mean() * w, dz.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad ** 2
        move = RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Model from labelled rows that are not held out: of each class the ``rows`` ids of the smallest hash, as long as their texts
    do not come to SAMPLE_BYTES, weighted by the share of the class to the power of LEAN. Nothing but text and ``toxic`` is read. One text
    counts per id, whatever its length. Word buckets of this bounded sample reach the driver; without labels of both classes
    the score is constant."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda y: usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = F.broadcast(pick(0).unionByName(pick(1)))  # 2 x SAMPLE_ROWS ids
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of SAMPLE_ROWS rows
    found = found.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).filter(F.col("before") < SAMPLE_BYTES)

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            toxic = batch.column("toxic").to_pylist()
            for i in range(len(toxic)):
                part = data[offsets[i]: offsets[i + 1]]
                word, sentence, text, *_ = sentences(part, np.array([0, len(part)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic[i]], pa.int32()), pa.array([word.astype("<u4").tobytes()], pa.binary()), pa.array([sentence.astype("<u4").tobytes()], pa.binary()), pa.array([len(text)])],
                    names=["toxic", "word", "sentence", "n"])

    got = found.select("toxic", "text").mapInArrow(run, "toxic int, word binary, sentence binary, n long").collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["word"]), bytes(r["sentence"])))  # reruns agree
    base = np.cumsum([0, *(r["n"] for r in got)])
    whole = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    word = whole(np.frombuffer(bytes(r["word"]), "<u4") for r in got)
    sentence = whole(np.frombuffer(bytes(r["sentence"]), "<u4") + b for r, b in zip(got, base[:-1], strict=True))
    label = np.array([r["toxic"] for r in got], np.int64)
    times = {y: size.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)}
    text = np.repeat(np.arange(len(got)), [r["n"] for r in got])
    del got  # the arrays are made
    each = {y: times[y] / max(1, size.get(y, 0)) ** (1 - LEAN) for y in (0, 1)}
    return fit(word, sentence, text, label, np.array([each[y] for y in label]))


def score_texts(rows: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``rows`` (doc_id, text: no null) with score, sentences, toxic_sentences (of p >= 0.5), and the worst sentence: its
    p and its first and last UTF-8 byte (end exclusive; null without words)."""
    w, b = model[0].astype(np.float32), model[1]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "score", "sentences", "toxic_sentences", "worst", "worst_start", "worst_end"]

    def run(it):
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            cols: list[list] = [[] for _ in names[1:]]
            for i, j in chunks(offsets):
                lo = offsets[i]
                at = offsets[i: j + 1] - lo
                word, sentence, text, start, end = sentences(data[lo: offsets[j]], at)
                n = j - i
                z = b + np.bincount(sentence, w[word], minlength=len(text))
                q = np.bincount(text, softplus(z), minlength=n)
                worst = np.full(n, -1, np.int64)
                order = np.lexsort((-start, z))  # the highest, then the first, is written last
                worst[text[order]] = order
                has = worst >= 0
                some = np.where(has, worst, 0)
                pick = lambda v: [x if h else None for x, h in zip((v[some] if len(v) else np.zeros(n)).tolist(), has, strict=True)]  # noqa: E731, B023
                p = 1 / (1 + np.exp(-z))
                for c, v in zip(cols, (
                        (-np.expm1(-q)).tolist(), np.bincount(text, minlength=n).tolist(), np.bincount(text, p >= 0.5, minlength=n).astype(np.int64).tolist(),
                        pick(p), pick(start - at[text]), pick(end - at[text])), strict=True):
                    c.extend(v)
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, score double, sentences long, toxic_sentences long, worst double, worst_start long, worst_end long")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of every row of ``docs``.

    A text without words, null included, scores 0 and has no worst sentence; null ids are never held out, repeated ids stay
    rows; without labels, or with those of one class, the score is constant; an empty table gives no rows; other columns are
    not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = staged(score_texts(rows, train(docs, labels)), "scores")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_sentences", "worst_start", "worst_end")
