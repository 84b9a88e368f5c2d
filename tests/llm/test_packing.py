"""Packing against direct tokenization; pieces must give back every id once."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from acadspark.llm.encoding import Encoder, default_path
from acadspark.llm.packing import END, binary_lengths, pack_report, pieces

TEXTS = [
    "Hello, World! don't I'LL x's 12 3", "a\xa0b c\x1cd\x85e", "<|endoftext|> x <|startoftext|>", "<|ENDOFTEXT|> y", "é ́x ﬁ İ ẞ", "", None, "  ", "\n\n",
    "a\x0bb\x0cc", "日本 語 — “x”,y", "word " * 5000, "x" * 3000, "l'été, c'est (fini). a,b;c -- d''s", "A.B.C a1b2 _x_ 'S", "!!!é,é!", "\x00 \x7f~",
]


def direct(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, END]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_units_give_the_same_ids(text):
    raw = np.frombuffer((text + "tail" + text).encode(), np.uint8)
    cut = np.array([0, len(text.encode()), len(text.encode()) + 4, len(raw)])
    ids, at = Encoder(default_path()).encode(raw, cut)
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [direct(x)[:-1] for x in (text, "tail", text)]


def test_binary_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        assert sum(binary_lengths(n)) == n and all(x & (x - 1) == 0 and x <= 2048 for x in binary_lengths(n))


def test_pieces_restore_documents(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = defaultdict(list)
    for r in pieces(docs).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        parts = sorted(got[i], key=lambda r: r.start)
        once = parts[::2] if i == 3 else parts
        assert b"".join(bytes(p.ids) for p in once) == np.array(direct(t), "<u4").tobytes()
    report = pack_report(docs).collect()
    assert sorted(r.sequence_id for r in report) == list(range(len(report)))
    by_id = sorted(report, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in report), reverse=True)
    one = next(r for r in report if r.doc_id == 0 and r.start == 0)
    assert one.ids_crc32 == zlib.crc32(np.array(direct(TEXTS[0])[: one.length], "<u4").tobytes())
    assert pack_report(docs.limit(0)).collect() == []
