"""Candidates whose outcome follows from their URL are made, checked and ranked once for all rows that share them."""

import pytest
from pyspark.sql import functions as F

from acadspark.catalog.link_queries import fetched_each
from acadspark.operators import candidates as C
from acadspark.operators import links as L
from acadspark.plans import links as J


@pytest.fixture
def people(spark):
    rows = [(i, (None, "Dr. Ann Lee", "Bo Cy", "", "A/b Q?z")[i % 5], (None, "U", "MIT")[i % 3], (f"https://x.edu/{i}", f"https://www.linkedin.com/{i}", None, "")[i % 4],
             f"https://twitter.com/{i}" if i % 5 else None, None, 200) for i in range(180)]
    return spark.createDataFrame(rows, "obs_id long, name string, university string, profile_url string, personal_website string, lab_website string, http_status int")


@pytest.fixture
def asked(monkeypatch):
    seen, made = [], C.classed_candidates
    monkeypatch.setattr(C, "classed_candidates", lambda rows, keep: (seen.append(rows.count()), made(rows, keep))[1])
    return seen


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def _each(rows):
    return rows.withColumn("is_accessible", F.substring(F.md5("url"), 1, 1) < "8")


def _groups(people):
    return C.with_domains(people).select("name", "university", "domains").distinct().count()


def test_every_candidate_of_every_row_is_returned(people, asked):
    got = J.all_candidates(people)
    assert asked == [_groups(people)] and asked[0] < 180 / 2
    each = L.categorize_url(C.url_candidates(people, ("obs_id",)).withColumnRenamed("pct", "prior_pct"), "url")
    assert _same(got, C.candidate_confidence(each)) and got.count() > 180 * 40


def test_primary_links_are_those_of_each_row(people, asked):
    got = J.primary_links(people, fetched_each)
    assert asked == [_groups(people)]
    assert _same(got, C.best_primary_link(L.attach_links(people), C.top_candidates(J.checked_candidates(people, _each)))) and got.filter("site_replaced").count() > 20


def test_better_links_are_those_of_each_row(people, asked):
    got = J.find_better_links(people, fetched_each)
    flagged = L.secondary_candidates(L.attach_links(people)).filter("needs_replacement")
    assert asked == [_groups(flagged)]
    assert _same(got, J.find_better_links(people, _each)) and got.count() == 180
