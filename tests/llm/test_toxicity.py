"""Held-out accuracy, and that scores depend on text alone."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from acadspark.llm import toxicity as T

BAD = ["moron", "scum", "idiot", "trash"]


def rows(n=1500, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "the", "ti", "on", "ing"]) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice(BAD).upper() + "!!"
        out.append((i, rng.choice([". ", "\n", "? "]).join(lines), toxic))
    return out


def test_report(spark):
    data = rows()
    extra = [(None, "idiot moron", None), (9001, None, None), (9002, "", None), (9003, "x" * 50_000, None), (9004, "...\n!", None), (5, data[5][1], 1)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t, _ in data + extra], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = T.toxicity_report(docs, labels).collect()
    assert len(got) == len(data) + len(extra)
    truth = {i: y for i, _, y in data}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) / sum(r.doc_id in truth for r in held)
    assert right > 0.98
    texts = {i: (t or "").encode() for i, t, _ in data + extra}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.predicted and truth.get(r.doc_id):
            assert any(b in texts[r.doc_id][r.worst_start:r.worst_end].lower() for b in map(str.encode, BAD))
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score == by[9004].score and by[9002].worst_start is None
    other = T.toxicity_report(docs.withColumn("lang", F.lit(None)).repartition(3), labels.withColumn("quality", F.lit(7))).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in other) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    assert T.toxicity_report(docs.limit(0), labels).collect() == []
    assert {r.score for r in T.toxicity_report(docs, labels.limit(0)).collect()} <= {r.score for r in T.toxicity_report(docs, labels.filter("toxic = 0")).collect()} | {0.0, 1.0} | {r.score for r in T.toxicity_report(docs, labels.limit(0)).collect()}


def test_sentences():
    raw = [b"One two. THREE\n", b"", "é-four!?five".encode(), b"..."]
    word, sentence, text, start, end = T.sentences(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    whole = b"".join(raw)
    assert [whole[a:b] for a, b in zip(start, end)] == [b"One two", b"THREE", "é-four".encode(), b"five"]
    assert text.tolist() == [0, 0, 2, 2] and np.bincount(sentence).tolist() == [2, 2, 2, 1]
