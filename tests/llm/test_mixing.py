"""Targets against the step-by-step definition; takes against their bounds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from acadspark.llm import mixing as M


def stepwise(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, row string, id string")


def sample(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["hot"] * 6 + ["é", "B", "a", "Z", None, "", "tiny"])
        if s == "tiny" and rng.random() < 0.8:
            continue
        words = rng.choice([0, 1, 3, 17, 50, rng.randint(1, 400)])
        rows.append((i if rng.random() < 0.9 else None, rng.choice(["w", "é\tä"]) .split("\t")[0] and " ".join(["w"] * words) if rng.random() < 0.95 else None, s, 1, "x", "y"))
    rows += [(7777, "same text here", "hot", 1, "x", "y")] * (n // 3)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = sample(seed)
    df = docs(spark, rows)
    got = M.mix_report(df).withColumn("source", F.lit(0)).drop("source").collect()
    assert len(got) == len(rows)
    sizes, by = defaultdict(int), defaultdict(list)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = stepwise(sizes)
    for r in got:
        by[r.source_size, round(r.target, 6)].append(r)
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
    assert sorted(by) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    for (size, target), rs in by.items():
        assert sum({id(r): r.size for r in rs}.values()) % size == 0 if size else True
        if sum(1 for s in sizes if (sizes[s], round(want[s], 6)) == (size, target)) == 1 and size:
            full, reach = round(target) // size, 1
            for r in rs:
                reach |= reach << r.size
            near = min(abs(full * size + k - round(target)) for k in range(size + 1) if reach >> k & 1)
            assert abs(sum(r.taken for r in rs) - round(target)) == near
    assert sorted(map(str, M.mix_report(df.repartition(5)).collect())) == sorted(map(str, got))


def test_documents_repeat(spark):
    rows = sample(3, 100)
    df = docs(spark, rows)
    taken = M.mixed_documents(df)
    assert taken.columns == df.columns
    assert taken.select(M.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == M.mix_report(df).agg(F.sum("taken")).first()[0]
    assert M.mixed_documents(df.limit(0)).collect() == [] and M.mix_report(df.limit(0)).collect() == []
    assert M.mix_report(docs(spark, [(1, None, None, 1, "", ""), (2, "", "s", 1, "", "")])).agg(F.sum("taken")).first()[0] == 0


def test_fit_lengths_is_exact_where_possible():
    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(1, 60), rng.randint(1, 8))
        counts = [rng.randint(1, 5) for _ in lengths]
        whole = sum(n * c for n, c in zip(lengths, counts))
        for budget in (0, 1, whole // 3, whole - 1, whole):
            take = M.fit_lengths(lengths, counts, budget, exact=rng.choice([10, 50, 1 << 15]))
            assert all(0 <= t <= c for t, c in zip(take, counts))
            assert abs(sum(n * t for n, t in zip(lengths, take)) - budget) <= max(lengths)
    assert sum(n * t for n, t in zip([7, 5], M.fit_lengths([7, 5], [3, 3], 17))) == 17


def test_short_documents_of_a_small_source_are_drawn_in_proportion():
    rng = random.Random(8)
    for n in (60, 400, 5000):
        lengths = sorted(rng.sample(range(5, 60_000 if n == 5000 else 3000), n))
        counts = [rng.choice([1, 1, 2]) for _ in lengths]
        whole = sum(a * c for a, c in zip(lengths, counts, strict=True))
        for part in (0.25, 0.5, 0.8):
            budget = int(whole * part)
            take = M.fit_lengths(lengths, counts, budget)
            assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
            assert sum(a * t for a, t in zip(lengths, take, strict=True)) == budget
            half = n // 2
            short, long = sum(take[:half]) / sum(counts[:half]), sum(take[half:]) / sum(counts[half:])
            assert abs(short - part) < 0.15 and abs(long - part) < 0.15, (n, part, short, long)
