"""Very long texts, and stages that are given nothing or texts that are null."""

import random

import corpus_pipeline as P
from acadspark.llm import media, mixing, ngrams, repeats, rules, sharding

SF = "/root/testdata/sf0.001"


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10**7)) for _ in range(120_000))
    texts = {1: long, 2: long + " and a tail", 3: None, 4: "short text"}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    size = {i: len((t or "").encode()) for i, t in texts.items()}
    got = {r.doc_id: r for r in repeats.repeats_report(docs).collect()}
    assert {i: (got[i].n_bytes, got[i].n_removed) for i in texts} == {1: (size[1], size[1]), 2: (size[2], size[1]), 3: (0, 0), 4: (10, 0)}
    got = {r.doc_id: r for r in ngrams.jaccard_report(docs).collect()}
    assert {i: got[i].component_id for i in texts} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1].n_shingles == 119_996
    got = {r.doc_id: r for r in rules.rules_report(docs).collect()}
    assert {i: got[i].n_words for i in texts} == {1: 120_000, 2: 120_003, 3: 0, 4: 2} and got[2].word_chars == len(texts[2].replace(" ", ""))
    got = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert got[1].size == 120_000 and sum(r.taken for r in got.values()) == 240_005
    got = {r.doc_id: r for r in media.media_report(docs).collect()}
    assert all(got[i].n_bytes == size[i] and got[i].payload_bytes >= size[i] for i in texts)
    got = {r.doc_id: r for r in sharding.shard_report(docs).collect()}
    assert {i: got[i].size for i in texts} == {i: size[i] + 1 for i in texts}


def test_stages_without_rows_and_with_null_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(1, None, "en", "s", None), (None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in P.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == [] and (name == "packing" or empty.columns == docs.columns)
        got = stage(spark, nulls, SF)
        rows = got.collect()
        if name == "packing":
            assert [(r.length, r.doc_tokens) for r in rows] == [(1, 1)] * 3
        else:
            assert len(rows) == {"quality_rules": 0, "near_duplicates": 3, "secrets": 3, "mixture": 0}[name]
            assert name != "secrets" or sum(r.text is None for r in rows) == 2
