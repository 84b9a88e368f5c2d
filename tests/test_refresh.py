"""Work of the refresh job that rows share is done once for all of them."""

from acadspark.operators import candidates as C
from acadspark.operators import links as L
from acadspark.plans import conversion as P
from acadspark.plans import links as J


def _people(spark):
    rows = [(i, (None, "Dr. Ann Lee", "Bo Cy", "")[i % 4], (None, "U")[i % 2], (f"https://x.edu/{i}", f"https://www.linkedin.com/{i}", None)[i % 3],
             f"https://twitter.com/{i}" if i % 5 else None, None, 200) for i in range(120)]
    return spark.createDataFrame(rows, "obs_id long, name string, university string, profile_url string, personal_website string, lab_website string, http_status int")


def _pages(spark, people):
    urls = [r.url for r in C.url_candidates(people, ("obs_id",)).select("url").distinct().collect()]
    return spark.createDataFrame([(u, i % 3 > 0) for i, u in enumerate(sorted(urls))], "url string, is_accessible boolean")


def test_candidates_are_made_once_for_rows_that_share_them(spark, monkeypatch):
    people, asked = _people(spark), []
    pages = _pages(spark, people)
    found = C.indexed_candidates
    monkeypatch.setattr(C, "indexed_candidates", lambda rows, *rest: (asked.append(rows.count()), found(rows, *rest))[1])
    got = J.find_better_links(people, pages)
    flagged = L.secondary_candidates(L.attach_links(people)).filter("needs_replacement")
    assert asked == [C.with_domains(flagged).select("name", "university", "domains").distinct().count()] and asked[0] < flagged.count() / 4
    each = J.find_better_links(people, lambda rows: rows.join(pages.filter("is_accessible"), "url"))
    assert sorted(map(str, got.collect())) == sorted(map(str, each.select(got.columns).collect()))
    assert got.count() == 120 and got.filter("NOT personal_website <=> concat('https://twitter.com/', obs_id) AND personal_website IS NOT NULL").count() > 0


def test_refresh_classes_links_once(spark, monkeypatch, tmp_path):
    from acadspark.catalog.store_queries import enr, obs
    from acadspark.sources.fixtures import view

    sf, calls, attach = "/root/testdata/sf0.001", [], L.attach_links
    monkeypatch.setattr(L, "attach_links", lambda *a, **k: (calls.append(1), attach(*a, **k))[1])
    rows = P.full_refresh(spark, obs(spark, sf), view(spark, sf, "page_fetches"), enr(spark, sf), view(spark, sf, "candidate_fetches"), str(tmp_path / "r")).collect()
    assert len(calls) == 1 and len(rows) == 15
    better = spark.read.parquet(str(tmp_path / "r" / "people"))
    each = J.find_better_links(obs(spark, sf), lambda c: c.join(view(spark, sf, "candidate_fetches").filter("is_accessible"), "url")).drop("replacement_reasons")
    assert sorted(map(str, better.collect())) == sorted(map(str, each.select(better.columns).collect()))


def test_ranked_departments_read_no_pages(spark):
    first = spark.createDataFrame([("U", "Physics", "https://x.edu/faculty/physics", 1)], "university string, department string, url string, seq long")
    second = spark.createDataFrame([("U", "Physics", "https://x.edu/staff/physics", 2), ("U", "Other", "https://x.edu/faculty/physics", 0)], first.schema)
    got = P.university_overview(None, [first, second], None, parts=("departments",))
    rows = sorted((r.department, r.url, r.source, r["rank"]) for r in got["departments"].collect())
    assert list(got) == ["departments"] and rows == [("Physics", "https://x.edu/faculty/physics", 0, 1), ("Physics", "https://x.edu/staff/physics", 1, 2)]


def test_ranked_departments_join_and_group_people_once(spark, sf_dir):
    from acadspark.catalog import load_all

    df = load_all()[0]["university_departments_ranked"](spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Join [o_custkey") == 1 and final.count("FileScan parquet") == 2
