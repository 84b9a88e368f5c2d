"""Packing of documents into sequences by power-of-two decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.llm.common import chunks, gapless, staged, utf8
from acadspark.llm.encoding import Encoder, default_path

SEQUENCE = 2048
END = 1


def binary_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """``n`` as falling powers of two of at most ``most``."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of binary length of every document: (doc_id, start, length, ids, doc_tokens); ids little-endian, 32 bits.

    A null or empty text is the end id alone. Equal rows each give their own pieces.
    """
    path = tokenizer or default_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        encoder = Encoder.shared(path)
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets, 1 << 19):
                lo = offsets[i]
                ids, at = encoder.encode(data[lo: offsets[j]], offsets[i: j + 1] - lo)
                row, start, length, parts, tokens = [], [], [], [], []
                for d in range(j - i):
                    own = np.append(ids[at[d]: at[d + 1]], np.uint32(end)).astype("<u4")
                    done = 0
                    for size in binary_lengths(len(own), sequence):
                        row.append(i + d)
                        start.append(done)
                        length.append(size)
                        parts.append(own[done: done + size].tobytes())
                        tokens.append(len(own))
                        done += size
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(parts, pa.binary()), pa.array(tokens, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long")


def sequences(parts: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to staged pieces. Pieces of one length form a bucket, longest first; a piece is a whole
    sequence of that length, which needs no padding and never holds two documents. Ids run from 0 without gaps."""
    own = [c for c in ("doc_id", "start", "ids", "ids_crc32") if c in parts.columns]  # what a piece holds parts rows without an id
    ranked = gapless(parts, ["length"], own, "_rank")
    sizes = parts.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as there are powers of two
    below = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("length", below.alias("_base"))
    return ranked.join(bases, "length").select(*parts.columns, (F.col("_base") + F.col("_rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack_report(docs: DataFrame) -> DataFrame:
    """Digest of the packing per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and repeated ids stay rows with pieces of their own; an empty table gives no rows; other columns are not read.
    """
    narrow = pieces(docs).select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens")
    return sequences(staged(narrow, "pieces"))
