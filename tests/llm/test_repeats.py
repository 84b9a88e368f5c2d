"""Repeat removal against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from acadspark.llm import repeats as R


def brute(texts, w=R.WINDOW):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - w + 1):
            seen.setdefault(b[i:i + w], []).append((d, i))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i:i + w] = b"\1" * w
    out = []
    for b, g in zip(raw, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    base = prose(150)
    docs = [prose(80) + " " + rng.choice(passages) + " " + prose(rng.randint(0, 30)) for _ in range(20)]
    docs += [base, base, base.replace(base[300:310], "@@@@"), base[40:700], base[:230] + "zz" + base[200:600]]
    docs += ["x" * 1500, "x" * 250, "xy" * 400, "ab" * 99, "", None, passages[0][:199], passages[0][:200], passages[0][1:202]]
    docs += [passages[1] * 2, "same tail " + passages[2][-203:], prose(5)]
    return docs


def rows(spark, docs):
    df = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, k1 int")
    return df


@pytest.mark.parametrize("block", [R.BLOCK_BYTES, 3000, 0])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)  # 3000: many blocks and hot hashes; 0: every hash counted by windows
    docs = corpus()
    got = sorted(tuple(r)[1:] for r in R.repeats_report(rows(spark, docs)).collect())
    assert got == sorted(brute(docs))


def test_empty_table(spark):
    assert R.repeats_report(rows(spark, []).limit(0)).collect() == []


def test_small_blocks_in_one_index():
    rng = random.Random(5)
    raw = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    text = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
    sizes = np.array([len(x) for x in raw])
    stops = np.cumsum(sizes + 1) - 1
    rest = np.repeat(stops, sizes + 1) - np.arange(len(text))
    got = R.matching_statistics(text, rest)
    suffix = [bytes(text[i:i + rest[i]]) for i in range(len(text))]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i in range(len(text)):
        assert got[i] == max(common(suffix[i], suffix[j]) for j in range(len(text)) if j != i)
