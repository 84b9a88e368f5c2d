"""Link replacement looks at every candidate of a person."""

from acadspark.catalog import load_all
from acadspark.catalog.link_queries import people, scored
from acadspark.operators import candidates as C


def test_replacement_does_not_depend_on_a_list_of_fetched_pages(spark, sf_dir):
    queries, sql = load_all()
    for name in ("best_primary_link", "find_better_links", "process_links_full"):
        assert "candidate_fetches" not in sql[name] and "md5(url)" in sql[name]
    best = queries["best_primary_link"](spark, sf_dir)
    listed = C.best_primary_link(people(spark, sf_dir), C.top_candidates(scored(spark, sf_dir)))
    assert best.filter("site_replaced").count() > listed.filter("site_replaced").count()
