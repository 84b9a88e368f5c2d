"""Text expressions on hand-written rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from acadspark.functions import names as N
from acadspark.functions import text as X
from acadspark.functions import urls as U


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


def test_clean_text_keeps_letters(spark):
    assert one(spark, "  José &amp; Ana  \t x\x07 ", X.clean_text) == "José & Ana x"
    assert one(spark, None, X.clean_text) == ""


def test_entities_agree_with_full_unescape(spark):
    text = "a &lt;b&gt; &quot;c&quot; &#39;d&#39; &ndash; &hellip; e &amp; f"
    assert one(spark, text, X.clean_text) == re.sub(r"\s+", " ", html.unescape(text)).strip()


def test_phones(spark):
    got = one(spark, "call (520) 621-1234 or 520-621-1234, 520.621.9999; 5206210000 and 520 621 7777", X.phones)
    assert got == ["(520) 621-0000", "(520) 621-1234", "(520) 621-7777", "(520) 621-9999"]


def test_phone_context(spark):
    pad = " x" * 60
    got = one(spark, f"Office: 520-111-2222{pad} the lab 520-333-4444{pad} 520-555-6666{pad} 520-777-8888", X.phone_context)
    assert (got["office"], got["lab"], got["main"]) == ("520-111-2222", "520-333-4444", "520-555-6666")


@pytest.mark.parametrize("raw,name,key", [
    ("Dr. Andrew Stone", "Andrew Stone", "andrew::stone"), ("Prof. Ann  Lee, Ph.D.", "Ann Lee", "ann::lee"), ("", "", ""), ("José O'Neil PhD", "José O'Neil", "josé::oneil")])
def test_names(spark, raw, name, key):
    assert one(spark, raw, N.display_name) == name
    assert one(spark, raw, N.person_key) == key


@pytest.mark.parametrize("raw,want", [
    ("Research interests: Memory; Attention", ["Memory", "Attention"]), ("vision", ["vision"]), ("abc, robotics", ["robotics"]), ("abc", []), (None, [])])
def test_interests(spark, raw, want):
    assert one(spark, raw, X.interests) == want


def test_named_before_equals_plain_pattern(spark):
    text = "We have a new imaging system and Eye Tracking equipment; x ray device. bare system"
    want = [m.strip() for m in re.findall(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:system|equipment|device|instrument)", text, re.I)]
    got = one(spark, text, lambda c: X.named_before(c, "system|equipment|device|instrument", 0))
    assert got == want


@pytest.mark.parametrize("href,want", [
    ("/a/b", "https://x.edu/a/b"), ("c", "https://x.edu/d/c"), ("?p=2", "https://x.edu/d/e?p=2"), ("https://y.org/z", "https://y.org/z"),
    ("mailto:a@b", None), ("", None), ("//y.org/q", "https://y.org/q")])
def test_resolve(spark, href, want):
    assert one(spark, href, lambda c: U.resolve(c, F.lit("https://x.edu/d/e"))) == want


def test_office_and_lab(spark):
    assert one(spark, "Office: Room 210, Main", lambda c: X.first_field(c, X.OFFICE_PATTERNS, 3, 100)) == "Room 210"
    assert one(spark, "Director, Memory Lab", lambda c: X.first_field(c, X.LAB_NAME_PATTERNS, 5)) == "Memory Lab"


def test_anchored_patterns_find_the_same(spark):
    import random

    from acadspark.functions import text as X

    rnd = random.Random(3)
    texts = ["".join(rnd.choices((",", "\n", "a", " ", "Lab", "LABORATORY", "center", "Director", "Institute", "La", "é"), k=rnd.randint(0, 14))) for _ in range(2000)] + ["x" * 3000, "", "lab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for plain, anchored in X.ANCHORED.items():
        assert anchored != plain
        got = df.select(F.regexp_extract("t", plain, 1).alias("a"), F.regexp_extract("t", anchored, 1).alias("b")).filter("a <> b")
        assert got.count() == 0


def test_lab_profile_reads_a_text_once_for_each_field(spark):
    from acadspark.plans.enrichment import lab_profiles

    docs = spark.createDataFrame([(1, "About: a &amp; b work on memory together with many others. More follows here. Lab Manager: Ann Lee\nfunded by NSF core, x"), (2, None)], "doc_id long, text string")
    got = lab_profiles(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(w) for w in ("PhD Student", "Ongoing Research", "About|Overview", "Instrumentation", "onr|afosr")] == [1] * 5
    assert not any(w in plan for w in ("laboratory space", "Dataset|Database", "Recruiting", "methodology"))  # fields that no column needs
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].size_class, rows[1].themes, rows[1].funding_diversity, rows[1].richness, rows[1].presentation) == ("minimal", "cognitive", 0.25, 0.5, 0.8)
    assert (rows[2].size_class, rows[2].themes, rows[2].richness, rows[2].presentation) == ("minimal", "", 0.0, 0.6)
