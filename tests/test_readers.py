"""Readers of pages and texts give what a plainer reading gives, and do less for it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from acadspark.functions import constants as K
from acadspark.functions import text as X
from acadspark.functions.dom import Node, parse, parse_any
from acadspark.operators import listings as H
from tests.test_dom import PIECES


def _texts(n, sep):
    return " ".join(sep.join(p for p in (k.strip() for k in n.walk() if isinstance(k, str)) if p).split())


def test_stretches_of_a_page_are_what_a_walk_finds():
    rnd = random.Random(2)
    for _ in range(4000):
        page = "".join(rnd.choices(PIECES, k=rnd.randint(1, 30)))
        for root in (parse(page), parse_any(page)):
            for n in (root, *(k for k in root.walk() if isinstance(k, Node))):
                assert n.nodes() == [k for k in n.walk() if isinstance(k, Node)]
                assert n.text() == _texts(n, " ") and n.text(" | ") == _texts(n, " | ")


def test_a_page_is_walked_once(monkeypatch):
    walks, walk, lay = [], Node.walk, Node.lay_out
    monkeypatch.setattr(Node, "walk", lambda self: (walks.append("walk"), walk(self))[1])
    monkeypatch.setattr(Node, "lay_out", lambda self: (walks.append("lay out"), lay(self))[1])
    page = '<html><body><h3>Research Interests</h3><ul><li>Memory</li></ul><p>Department of Physics</p><p>Our <a href="/lab">laboratory</a> works</p></body></html>'
    assert next(H._detail_rows(page, ""))["interests_text"] == "Memory" and list(H._nearby_rows(page, ""))
    assert walks == ["lay out"] * 2


@pytest.mark.parametrize("words", [H.INTERESTS, H.EDUCATION, H.UNIT_WORDS])
def test_words_are_found_as_by_the_pattern(words):
    rnd, pattern, test = random.Random(3), re.compile("|".join(words), re.I), H.word_test(words)
    parts = ["research", "Research", " ", "-", "\n", "interest", "INTEREST", "expertise", "ſpecialization", "degree", "Educatıon", "institute", "İnstitute", "college", "x", "center", "ſchool"]
    for _ in range(5000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 5)))
        assert test(t) == (pattern.search(t) is not None), t


def test_patterns_are_tried_only_where_they_may_match(spark):
    texts = ["", None, "Director, Mind Lab", "x Building, Room 12\nOffice: Hall 3", "PI Brain Laboratory", "he/him (they/them) Pronouns: she", "Ann Lee, PhD and Bo Cy - MS", "PhD Student: Cy", "graduate student: no",
             "Current Projects: memory of mice. Study: rats and mice too", "Our  lab works. It is good. Yes", "EQUIPMENT: scanners. Rooms: 12 and more. 30 sq ft", "a@b.edu (520) 621-7268 520-621-7268 520.621.7268", "Interested in collaborating? contact: us all today",
             "Seeking: many students", "Building: Old Main", "Openings for students", "Location: Tucson", "ABOUT this: one. two. three. four. five.", "Database: things of note", "a &amp; b &lt; &nbsp;c", "a &amp;lt; b\t\tc \xa0 d\xa0", "&", "  a  b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").cache()
    t = F.coalesce("t", F.lit(""))
    for p in X.NEEDED:
        rows = df.select(F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("a"), X._all_matches(t, p, 0).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.a for r in rows), p
    plan = df.select(X.first_field(F.col("t"), X.LAB_NAME_PATTERNS, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") >= 5


def test_clean_text_as_by_plain_replacement(spark):
    rnd = random.Random(4)
    parts = ["a", " ", "  ", "\t", "\n", "\xa0", "&amp;", "&lt;", "&nbsp;", "&#38;", "&", "amp;", "lt;", "\x01", "b"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(3000)]

    def plain(t):
        for name, char in K.ENTITIES:
            t = t.replace(name, char)
        return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", re.sub("[ \t\n\x0b\f\r\xa0]+", " ", t).strip(" "))

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_text(F.col("t")).alias("c")).collect()
    assert len(got) == 3000 and all(r.c == plain(r.t) for r in got)
