"""Groups of near copies against all pairs compared on word tuples."""

import random
import re

import numpy as np
import pytest

from acadspark.llm import ngrams as G

W = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed, families=6, size=25):
    rng = random.Random(seed)
    vocab = ["Éa", "the", "x,", "ON", "st", "é", "ß", "r2", "..", "w"] + [f"v{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [None, "", "  \n", "one", "ONE", "one two three four", "ONE two three\tfour", "one two three four five", "a b c d e f"] * 2
    line = prose(9)
    for _ in range(families):
        base = prose(rng.randint(12, 160))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(t))
                t[k:k + rng.choice([0, 1, 1])] = prose(1)
            if rng.random() < 0.3:
                t = t[: len(t) - rng.randint(0, max(1, len(t) // 8))]
            texts.append(" ".join(t) if rng.random() < 0.8 else "  ".join(t).upper())
    texts += [" ".join(line + prose(rng.randint(5, 60))) for _ in range(60)]
    texts += ["aa " * 300, "aa " * 4, "aa " * 5]
    rng.shuffle(texts)
    return [(i if rng.random() < 0.95 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,common", [(1, 16), (2, 1), (3, 5), (4, 1 << 30)])
def test_report(spark, monkeypatch, seed, common):
    monkeypatch.setattr(G, "COMMON", common)
    docs = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, root string")
    assert sorted(map(tuple, G.jaccard_report(df).collect()), key=str) == brute(docs)
    if seed == 1:
        kept = G.unique_documents(df)
        assert kept.columns == df.columns
        groups = {c for d, n, c in brute(docs) if n}
        rows = kept.collect()
        assert sorted(r.doc_id for r in rows if plain_set(r.text) and r.doc_id is not None) == sorted(c for c in groups if c is not None)
        assert sum(not plain_set(r.text) for r in rows) == sum(not plain_set(t) for _, t in docs)
        assert G.unique_documents(df.limit(0)).collect() == [] and G.jaccard_report(df.limit(0)).collect() == []


def test_sets():
    raw = [t.encode() for t in ("a b c d e f", "", "a b c d e f", "q", "a B\x0bc\x0cD e", "é a b c d e f g")]
    sets = G.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [len(s) for s in sets] == [2, 0, 2, 1, 1, 4]
    assert set(sets[0]) == set(sets[2]) and set(sets[4]) < set(sets[0]) and set(sets[0]) < set(sets[5])
