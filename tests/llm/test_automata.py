"""Removal of repeated windows of words against a table of all windows."""

import hashlib
import random
import re

import duckdb
import pytest

from acadspark.llm import automata as A

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words int, owner string"


def brute(docs):
    key = lambda d: (d is not None, d or 0)
    least, split = {}, [(d, W.findall(t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - 19):
            x = tuple(w[i:i + 20])
            least[x] = min(least.get(x, (key(d), i)), (key(d), i))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 19):
            if (key(d), i) > least[tuple(w[i:i + 20])]:
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß,", "the", "A", "a"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 40, 75)]
    docs = [None, "", " \n\t", "one two", " ".join(prose(20)), "x " * 19, "x " * 20, "x " * 21, "x " * 90, "a b " * 60, " ".join(prose(25)) * 3]
    for _ in range(70):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 4)
            parts += [p[cut:] if rng.random() < 0.5 else p, prose(rng.randint(0, 5))]
        docs.append(rng.choice([" ", "\n", "  "]).join(x for p in parts for x in p))
    docs += docs[-6:] + [docs[12]] * 4 + [" ".join(passages[4])]
    ids = [rng.choice([None, 3, 5]) if rng.random() < 0.15 else 100 + i for i in range(len(docs))]
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("seed,words", [(1, 1 << 16), (2, 64), (3, 8), (4, 400)])
def test_report(spark, monkeypatch, seed, words):
    monkeypatch.setattr(A, "SHARD_WORDS", words)
    docs = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], SCHEMA)
    got = A.automata_report(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)
    if seed == 1:
        documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
        assert sorted(duckdb.sql(A.SQL).fetchall(), key=str) == brute(docs)


def test_empty_and_long(spark):
    assert A.automata_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))
    docs = [(1, long), (2, "y " + long), (3, "z" * 3_000_000)]
    assert sorted(map(tuple, A.automata_report(spark.createDataFrame([(*r, 1, "x") for r in docs], SCHEMA)).collect())) == brute(docs)


def test_automaton():
    rng = random.Random(4)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(3, 25))] for _ in range(rng.randint(1, 5))]
        ranks, n = [], 0
        for s in seqs:
            ranks.append(list(range(n, n + len(s))))
            n += len(s)
        machine = A.SuffixAutomaton(seqs, ranks)
        for text in [*seqs, [rng.randrange(4) for _ in range(30)]]:
            seen = {}
            for s, r in zip(seqs, ranks, strict=True):
                for i in range(len(s) - 2):
                    seen.setdefault(tuple(s[i:i + 3]), r[i + 2])
            assert machine.earliest(text, 3) == [seen.get(tuple(text[i:i + 3]), -1) for i in range(len(text) - 2)]
            for i, (size, _) in enumerate(machine.statistics(text)):
                holds = lambda k, i=i, text=text: any(text[i + 1 - k:i + 1] == s[j:j + k] for s in seqs for j in range(len(s) - k + 1))
                assert holds(size) and (size == i + 1 or not holds(size + 1))
