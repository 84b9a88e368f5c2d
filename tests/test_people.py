"""Deduplication, resolution, folds, upserts and views: invariants and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from acadspark.operators import dedup as D
from acadspark.operators import views as V
from acadspark.sources import sinks
from acadspark.sources.fixtures import view

SCHEMA = ("obs_id long, name string, university string, department string, title string, email string, phone string, profile_url string, personal_website string, "
          "lab_website string, lab_name string, research_interests string, confidence_score double, scraped_at timestamp_ntz")


def make(spark, rows):
    out = []
    for i, (name, uni, mail) in enumerate(rows):
        out.append((i, name, uni, "Physics", None, mail, None, None, None, None, None, None, (50 + i % 50) / 100, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)))
    return spark.createDataFrame(out, SCHEMA)


def test_dedup_ignores_titles_and_initials(spark):
    df = make(spark, [("Dr. Ann Lee", "U", None), ("Ann Q. Lee", "u", "a@x.edu"), ("Ann Lee", "V", None)])
    people, _ = D.dedup_people(df)
    assert {(r["dedup_key"], r["n_obs"]) for r in people.collect()} == {("u::ann::lee", 2), ("v::ann::lee", 1)}


def test_dedup_is_independent_of_input_order(spark, sf_dir):
    o = view(spark, sf_dir, "observations").limit(2000)
    a = D.dedup_people(o)[0].orderBy("dedup_key").collect()
    b = D.dedup_people(o.orderBy(F.rand(3)).repartition(5))[0].orderBy("dedup_key").collect()
    assert a == b


def test_resolution_follows_chains(spark):
    # a-b share an e-mail, b-c share a university; d is a homonym elsewhere
    df = make(spark, [("Ann Lee", "U1", "a@x"), ("Ann Lee", "U2", "a@x"), ("Ann Lee", "U2", "c@x"), ("Ann Lee", "U9", "d@x"), ("Bob Lee", "U1", "a@x")])
    got = {r["obs_id"]: r["entity"] for r in D.resolve_person(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_groups_equal_union_find(spark):
    rnd = random.Random(11)
    nodes = [(i, f"n{rnd.randrange(60)}" if rnd.random() < 0.9 else None, f"s{rnd.randrange(60)}" if rnd.random() < 0.6 else None) for i in range(150)]
    # a long chain
    nodes += [(1000 + i, f"c{i}", f"d{i // 2}" if i % 2 else f"d{(i + 1) // 2}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b in nodes:
        for h in (a and f"a{a}", b and f"b{b}"):
            if h:
                ra, rb = find(("n", i)), find(("h", h))
                parent[ra] = rb
    groups = {}
    for i, _, _ in nodes:
        groups.setdefault(find(("n", i)), []).append(i)
    want = {i: min(g) for g in groups.values() for i in g}
    got = D.connected_groups(spark.createDataFrame(nodes, "node long, a string, b string"), "node", ("a", "b"))
    assert {r["node"]: r["root"] for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 5, 63, 64, 65, 66, 200])
def test_fold_equals_sequential(spark, n):
    df = make(spark, [("Ann Lee", "U", None)] * n).withColumn("k", F.lit("k"))
    df = df.withColumn("confidence_score", F.when(F.col("obs_id") % 7 != 3, F.col("confidence_score")))
    rows = sorted(df.collect(), key=lambda r: r["obs_id"])
    c = rows[0]["confidence_score"] if rows[0]["confidence_score"] is not None else 0.8
    for r in rows[1:]:
        c = (c + (r["confidence_score"] if r["confidence_score"] is not None else 0.5)) / 2
    got = D.fold_confidence(df, "k").first()
    assert got["n_merged"] == n and got["confidence"] == pytest.approx(c, abs=1e-14)


def test_nameless_people_and_unknown_universities(spark):
    df = make(spark, [("", "U", "a@x.edu"), (None, "U", None), ("Ann Lee", None, None), ("Ann Lee", None, None), ("Ann Lee", "", "b@x.edu"), ("Ann Lee", "U", "b@x.edu")])
    ids = sorted(r["obs_id"] for r in df.collect())
    got = {r["obs_id"]: r["entity"] for r in D.resolve_person(df).collect()}
    assert sorted(got) == ids[2:] and got[ids[4]] == got[ids[5]]
    assert len({got[ids[2]], got[ids[4]]}) == 2
    assert sorted((r["obs_id"], r["issue"]) for r in D.nameless(df).collect()) == [(i, "missing name") for i in ids[:2]]


def test_upsert_twice_is_once(spark):
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    old = F.lit("2024-01-01").cast("timestamp_ntz")
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").withColumns({"created_at": old, "updated_at": old})
    batch = spark.createDataFrame([(2, "B"), (3, None)], "k long, v string")
    once = sinks.upsert_table(cur, batch, ("k",), now)
    twice = sinks.upsert_table(once, batch, ("k",), now)
    assert sorted(once.collect()) == sorted(twice.collect())
    got = {r["k"]: (r["v"], r["created_at"].day, r["updated_at"].day) for r in once.collect()}
    assert got == {1: ("a", 1, 1), 2: ("B", 1, 2), 3: (None, 2, 2)}


def test_with_edges_is_a_left_join(spark):
    ents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, n string")
    edges = spark.createDataFrame([(1, 10)] * 50 + [(2, 20)], "k long, e long")
    assert sorted(map(tuple, V.with_edges(ents, edges, "k").collect()), key=str) == sorted(map(tuple, ents.join(edges, "k", "left").collect()), key=str)


def test_lab_rollup_counts(spark):
    rows = [(i, f"P {chr(97 + i)}xx", "U", d, None, None, None, None, None, w, "Big Lab", ri, 0.5, dt.datetime(2024, 1, 1))
            for i, (d, w, ri) in enumerate([("Physics", "https://x.edu/lab", "a one, b two"), ("History", "https://x.edu/lab", "a one, c three")])]
    labs, values = D.lab_rollup(spark.createDataFrame(rows, SCHEMA))
    r = labs.first()
    assert (r["n_records"], r["n_departments"], r["n_websites"], r["n_areas"], r["interdisciplinary"]) == (2, 2, 1, 3, True)
    assert values.filter("kind = 'member'").count() == 2


def test_plans_have_no_cross_product(spark, sf_dir):
    import __spark_entry__ as e

    for name in ("link_report", "relationship_map", "dedup_people", "person_labs", "lab_people", "verify_candidates", "validate_links", "merge_structures"):
        plan = e.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_html_is_pruned_after_extraction(spark, sf_dir):
    from acadspark.operators import pages as G
    from acadspark.sources.fixtures import table

    plan = G.page_social(G.page_links(table(spark, sf_dir, "pages")))._jdf.queryExecution().executedPlan().toString()
    above_shuffle = plan[: plan.index("Exchange hashpartitioning")]
    assert "html" not in above_shuffle


def test_listing_pages_are_dealt_over_many_tasks_whatever_their_departments(spark, sf_dir):
    from acadspark.sources.fixtures import directory_pages

    plan = directory_pages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [university" not in plan and "REPARTITION_BY_NUM" in plan


def test_overview_reads_pages_only_for_tables_that_need_them(spark):
    from acadspark.plans import conversion

    broken = spark.range(1).selectExpr("raise_error('read') AS html", "1L AS page_id", "'u' AS university", "'d' AS department", "'x' AS url").drop("id")
    source = spark.createDataFrame([("u", "d", "https://u.edu/d", 1)], "university string, department string, url string, seq long")
    got = conversion.university_overview(broken, [source], broken, parts=("departments",))
    assert set(got) == {"departments"} and got["departments"].count() == 1


def test_only_pages_of_sparse_people_are_parsed_at_any_number(spark, sf_dir):
    from acadspark.plans import enrichment
    from acadspark.sources.fixtures import view

    plan = enrichment.enhance_sparse(view(spark, sf_dir, "observations"), view(spark, sf_dir, "profile_pages"))._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" not in plan and "LeftSemi" in plan  # no filter that fills up
    assert " AS body" in plan.split("LeftSemi")[0] and " AS body" not in plan.split("LeftSemi")[1]  # pages are made after the join


def test_names_of_people_need_no_fold(spark, sf_dir):
    from acadspark.catalog.registry import QUERIES
    import acadspark.catalog.entity_queries  # noqa: F401

    assert "pow" not in QUERIES["person_departments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
