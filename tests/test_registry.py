"""Entity ids over successive batches."""

import random

from acadspark.operators import registry as R


def batch(spark, rows):
    return spark.createDataFrame(rows, "node string, hubs array<string>, low bigint")


def groups(nodes):
    """Connected groups of {node: hubs}."""
    left, out = dict(nodes), []
    while left:
        node, hubs = left.popitem()
        group, reach = {node}, set(hubs)
        while True:
            more = [n for n, h in left.items() if reach & set(h)]
            if not more:
                break
            for n in more:
                reach |= set(left.pop(n))
                group.add(n)
        out.append(group)
    return out


def entities(registry):
    return {r.node: r.entity for r in registry.collect()}


def test_ids_stay_merge_and_split(spark):
    r, log = R.update(R.empty_registry(spark), batch(spark, [("a", ["x"], 10), ("b", ["x"], 11), ("c", ["y"], 12), ("d", [], 13)]), 1)
    assert entities(r) == {"a": 10, "b": 10, "c": 12, "d": 13} and {x.kind for x in log.collect()} == {"new"}
    r, log = R.update(r, batch(spark, [("e", ["x", "z"], 1), ("f", ["w"], 2), ("a", ["x"], 3)]), 2)
    assert entities(r) == {"a": 10, "b": 10, "c": 12, "d": 13, "e": 10, "f": 2}
    r, log = R.update(r, batch(spark, [("g", ["z", "y"], 20), ("h", ["w", "v"], 21)]), 3)
    assert entities(r) == {"a": 10, "b": 10, "c": 10, "d": 13, "e": 10, "f": 2, "g": 10, "h": 2}
    assert [tuple(x) for x in log.collect()] == [(3, "merge", 12, 10)]
    r, log = R.update(r, batch(spark, []), 4, spark.createDataFrame([("g",), ("d",)], "node string"))
    now = entities(r)
    assert now["a"] == now["b"] == now["e"] == 10 and now["c"] not in (10, 12) and "d" not in now and "g" not in now
    assert sorted((x.kind, x.entity) for x in log.collect()) == [("gone", 13), ("new", now["c"]), ("split", 10)]
    r, _ = R.update(r, batch(spark, [("i", ["y"], 30)]), 5)
    assert entities(r)["i"] == now["c"]


def test_random_batches_against_whole_groups(spark):
    rng = random.Random(5)
    r, nodes, before, low = R.empty_registry(spark), {}, {}, 0
    for number in range(1, 5):
        rows = []
        for _ in range(30):
            low += 1
            rows.append((f"n{low}", [f"h{rng.randrange(60)}" for _ in range(rng.randint(0, 2))], low))
        r, log = R.update(r, batch(spark, rows), number)
        nodes |= {n: h for n, h, _ in rows}
        now = entities(r)
        assert sorted(map(sorted, groups(nodes))) == sorted(sorted(n for n in now if now[n] == e) for e in set(now.values()))
        moved = {(before[n], now[n]) for n in before if before[n] != now[n]}
        assert moved == {(x.entity, x.other) for x in log.collect() if x.kind == "merge"}
        for group in groups(nodes):
            old = [before[n] for n in group if n in before]
            assert len({now[n] for n in group}) == 1 and (not old or now[next(iter(group))] == min(old))
        before = now
