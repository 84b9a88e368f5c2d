"""Line rules against a plain version, and against their SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from acadspark.llm import rules as R
from acadspark.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck

W = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The people of the town walked slowly along the river, and nobody said a word about the rain that fell."


OTHER = "Later in the evening a lamp was lit at the old mill, which had not been used since the war."


def plain(text):
    t = text or ""
    words = W.findall(t)
    lines = t.split("\n")
    worded = [x for x in lines if W.search(x)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(worded) - len(set(worded)), len(hit), failed


CASES = [
    None, "", " \t\n", GOOD, GOOD + "\n" + GOOD, GOOD * 3, "word " * 40, "é\x0bà\x0cü\r" * 30, "a\xa0b " * 25, "\n".join([GOOD, "", "  ", GOOD, "x y z"]),
    "# * $ % & | < > " * 5, "\U0001F600 " * 30, "0 1 2 3 4 5 6 7 " * 2 + GOOD,
]


def test_counts_match_plain_version(spark):
    rng = random.Random(1)
    cases = CASES + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(cases)] + [(None, GOOD, 1, "y")], "doc_id long, text string, words int, id string")
    got = {r.doc_id: r for r in R.rules_report(df).collect()}
    assert len(got) == len(cases) + 1
    for i, t in enumerate(cases):
        assert tuple(got[i])[1:7] == plain(t), t
    assert R.rules_report(df.limit(0)).collect() == []


def test_lines_fall_first(spark):
    nav, stock, junk = "Home | News | About | Contact", "(c) Acme. All rights reserved.", "*** $$$ %%% ---"
    docs = [(1, f"{GOOD}\n{nav}\n{OTHER}\n{stock}\n{junk}\n\nend", 9, "a"), (2, f"{GOOD}\n" + "\n".join(f"Menu {i} | Part {i} | Page {i} and more links to it" for i in range(20)), 9, "b"), (3, GOOD, 9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, kept string")
    got = {r.doc_id: r for r in R.cleaned_documents(df).collect()}
    assert R.cleaned_documents(df).columns == df.columns
    assert set(got) == {1, 3}
    assert got[1].text == f"{GOOD}\n{OTHER}\n\nend" and got[1].n_chars == len(got[1].text) and got[1].kept == "a"
    assert got[3].text == GOOD


def test_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, sf, QUERIES["op4_line_rules"], ORACLES["op4_line_rules"], duck(sf)) is None
