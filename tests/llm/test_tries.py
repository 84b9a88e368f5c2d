"""The conversation trie against one built in memory."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from acadspark.llm import tries as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, id string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in convs.items()}
    nodes, ends, kids = defaultdict(set), defaultdict(list), Counter()
    for c, own in sorted(convs.items()):
        h = zlib.crc32(str(c).encode()) % 6
        turns = convs.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in nodes.items()), key=str)


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(100, 130), *range(205, 240), 10**15 + 3]:
        base = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "bb", "", None])) for _ in range(rng.randint(1, 9))]
        same = [("user", "x"), ("assistant", "yy"), ("user", "z" * 7)]
        turns = same if rng.random() < 0.3 else same[:2] + base if rng.random() < 0.6 else base
        first = rng.choice([0, 1, 5])
        rows += [(c, first + 2 * i if i or rng.random() < 0.8 else None, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "lost"), (310, 3, "user", "same"), (310, 3, "user", "same"), (300, 1, "u", "top")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = T.trie_report(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    conversations = df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    assert sorted(duckdb.sql(T.SQL).fetchall(), key=str) == brute(rows)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    rows = [(7, i, "user", f"turn {i}") for i in range(30)] + [(c, 0, "user", "hello") for c in range(1000, 1090)]
    rows += [(7, 29, "user", "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want, got = brute(rows), sorted(map(tuple, T.trie_report(df).collect()), key=str)
    assert [r[1:7] for r in got] == [r[1:7] for r in want] and len(got) == len(want)
    assert T.trie_report(df.limit(0)).collect() == []


def test_contraction(spark):
    rng = random.Random(6)
    for shape in ("random", "chain", "star"):
        n = 25
        parent = {i: None if i == 0 else rng.randrange(i) if shape == "random" else i - 1 if shape == "chain" else 0 for i in range(n)}
        parent[n] = None  # a second tree of one node
        value = {i: rng.randint(0, 9) for i in parent}
        want = dict.fromkeys(parent, 0)
        for i in parent:
            j = i
            while j is not None:
                want[j] += value[i]
                j = parent[j]
        df = spark.createDataFrame([(i, p, value[i], 1) for i, p in parent.items()], "id long, parent long, v long, one int")
        got = {r.id: (r.v, r.one) for r in T.subtree_totals(df, ["v", "one"]).collect()}
        assert {i: v for i, (v, _) in got.items()} == want and got[0][1] == n and got[n] == (value[n], 1)
