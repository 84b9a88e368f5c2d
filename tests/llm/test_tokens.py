"""Separator scan against tokenization document by document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acadspark.llm import tokens as T
from acadspark.llm.encoding import default_path


def direct(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return len(t.encode(text or "", add_special_tokens=False).ids) + 1


def test_report(spark):
    texts = ["one two", "", None, "<|endoftext|> in a text", "word " * 3000, "é, à", "one two"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "z", 1)], "doc_id long, text string, tokens int")
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in T.tokens_report(docs).collect())
    assert got == [(False, i, direct(t)) for i, t in enumerate(texts)] + [(True, None, direct("z"))]
    assert T.tokens_report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for name in ("a.bin", "b.bin", "c.bin", "empty.bin"):
        ids = rng.choice(np.array([7, 8, 9, T.SEPARATOR], "<u2"), 0 if name == "empty.bin" else 41)
        if name == "c.bin":
            ids[-1] = 7
        (tmp_path / name).write_bytes(ids.tobytes())
        start = 0
        for place, e in enumerate([*np.flatnonzero(ids == T.SEPARATOR)]):
            want.append((name, place, start, int(e) + 1 - start, True))
            start = int(e) + 1
        if start < len(ids):
            want.append((name, sum(ids == T.SEPARATOR), start, len(ids) - start, False))
    got = T.token_counts(spark, str(tmp_path), block=block).select("file", "place", "start", "tokens", "ended")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.agg(F.sum("tokens")).first()[0] == 123
