"""Each stage of the pipeline against brute force on what it was given."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from acadspark.llm.rules import SQL, line_fails
from tests.llm.test_mixing import stepwise
from tests.llm.test_ngrams import brute, plain_set
from tests.llm.test_packing import direct
from tests.llm.test_secrets import base

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5))
    con, out = duckdb.connect(), {}
    given = docs
    for name, stage in P.STAGES:
        stage(spark, given, SF).write.parquet(str(tmp_path / name))
        before, given = given, spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or given.columns == docs.columns
        out[name] = before.collect(), given.collect()

    docs.write.parquet(str(tmp_path / "documents"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT doc_id FROM ({SQL}) WHERE kept").fetchall()
    was, now = out["quality_rules"]
    assert sorted(r.doc_id for r in now) == sorted(x for x, in want)
    lines = spark.createDataFrame([(x,) for r in was for x in (r.text or "").split("\n")], "line string").distinct()
    bad = {r.line for r in lines.filter(line_fails(F.col("line"))).collect()}
    assert Counter(r.text for r in now) == Counter("\n".join(x for x in r.text.split("\n") if x not in bad) for r in was if (r.doc_id,) in set(want))

    was, now = out["near_duplicates"]
    named = brute([(r.doc_id, r.text) for r in was])
    assert sorted(r.doc_id for r in now) == sorted({c for _, n, c in named if n})

    was, now = out["secrets"]
    assert sorted(r.doc_id for r in was) == sorted(r.doc_id for r in now) and not any(base(r.text) for r in now)
    old = {r.doc_id: r.text for r in was}
    for r in now:
        assert (r.text == old[r.doc_id]) or "[SECRET]" in r.text
        assert not base(old[r.doc_id]) or r.text != old[r.doc_id]

    was, now = out["mixture"]
    size, took = Counter(), Counter()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in was:
        size[r.source] += count(r.text)
    for r in now:
        took[r.source] += count(r.text)
    target = stepwise(dict(size))
    assert max(Counter(r.doc_id for r in now).values()) <= 3
    longest = max(count(r.text) for r in was)
    assert all(abs(took[s] - target[s]) <= longest for s in size)

    was, now = out["packing"]
    pieces = defaultdict(list)
    for r in now:
        pieces[r.doc_id].append(r)
    times = Counter(r.doc_id for r in was)
    for r in was:
        own = pieces[r.doc_id]
        assert sum(p.length for p in own) == times[r.doc_id] * len(direct(r.text)) and {p.doc_tokens for p in own} == {len(direct(r.text))}
    assert sorted(r.sequence_id for r in now) == list(range(len(now))) and all(r.length & (r.length - 1) == 0 for r in now)
    assert np.all([len(plain_set(r.text)) > 0 for r in was])
