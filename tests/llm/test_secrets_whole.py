"""Counts and margins come from every text."""

import numpy as np

from acadspark.llm import secrets as S


def one_by_one(data, spans):
    out = np.zeros((S.N + 1) * S.N, np.int64)
    for a, b in spans:
        code = S.CODE[data[a:b]]
        code = code[code >= 0].astype(np.int64)
        np.add.at(out, np.concatenate([[S.N], code[:-1]])[: len(code)] * S.N + code, 1)
    return out


def test_pairs_are_those_of_each_string():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        data = np.frombuffer(bytes(rnd.choice(list(b"abAB01.+ -"), 60).tolist()), np.uint8)
        spans = np.sort(rnd.integers(0, 61, (rnd.integers(0, 8), 2)), 1)
        spans = spans[spans[:, 0] < spans[:, 1]]
        got = sum((S.transitions(data, s[:, 0], s[:, 1]) for s in S.apart(spans)), np.zeros((S.N + 1) * S.N, np.int64))
        assert (got == one_by_one(data, spans)).all()


def test_every_text_is_read(spark):
    rows = [(i, f"plain text number {i} ordinary words") for i in range(7000)] + [(7000, "password=Zq8Xw2Lk9Pv4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [S.texts_of(docs, held) for held in (False, True)]
    assert sum(p.count() for p in parts) == len(rows) and parts[0].intersect(parts[1]).isEmpty()
