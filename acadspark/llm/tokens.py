"""Token counts of documents in flat token files without an index."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acadspark.llm.common import chunks, discard, remove, staged, utf8
from acadspark.llm.encoding import Encoder, default_path
from acadspark.session import stage_dir

SEPARATOR = 49407
BLOCK_TOKENS = 1 << 20


def open_store(path: str):
    """File system and path within it of a folder that all executors reach."""
    from pyarrow import fs

    local = path.removeprefix("file:")
    return (fs.LocalFileSystem(), "/" + local.lstrip("/")) if ":" not in local else fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer: str | None = None, separator: int = SEPARATOR) -> tuple[str, DataFrame]:
    """Flat little-endian 16-bit token files in a new shared folder, one per task, documents ended by ``separator``.

    Returns the folder and (file, place, doc_id) of every row. A file counts only if its task's rows are in that table, so
    a task that runs twice does no harm. Strings of special tokens in a text are ordinary text.
    """
    spark = docs.sparkSession
    folder = stage_dir(spark, "tokens")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    path = tokenizer or default_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        encoder = Encoder.shared(path, special=False)
        store, root = open_store(folder)
        name, out, place = f"part-{uuid.uuid4().hex}.bin", None, 0
        for batch in it:
            if out is None:
                out = store.open_output_stream(f"{root}/{name}")
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets, 1 << 19):
                lo = offsets[i]
                ids, at = encoder.encode(data[lo: offsets[j]], offsets[i: j + 1] - lo)
                out.write(np.insert(ids, at[1:], separator).astype("<u2").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), batch.column("doc_id")], names=["file", "place", "doc_id"])
            place += n
        if out is not None:
            out.close()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"file string, place long, doc_id {id_type}")
    return folder, staged(rows, "places")


def scan_blocks(spark: SparkSession, files: DataFrame, folder: str, separator: int, block: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, tokens, ends: places of separators in the block) of every block of ``files`` (file, tokens)."""
    last = F.greatest(F.lit(0), F.floor((F.col("tokens") - 1) / block))
    parts = files.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    dealt = parts.repartition("file", "block")

    def run(it):
        store, root = open_store(folder)
        for batch in it:
            for file, tokens, k in zip(*[batch.column(c).to_pylist() for c in ("file", "tokens", "block")], strict=True):
                n = min(block, tokens - k * block)
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(k * block * width)
                    ids = np.frombuffer(f.read(n * width), f"<u{width}")
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], names=["file", "block", "tokens", "ends"])

    return dealt.mapInArrow(run, "file string, block long, tokens long, ends array<int>")


def token_counts(spark: SparkSession, folder: str, files: DataFrame | None = None, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, place, start, tokens, ended) of every document in the flat files of ``folder``.

    Blocks are searched at once, each on its own; a prefix scan over the blocks of a file then gives the number of documents
    before a block and the place of the last separator before it, which joins a document that crosses blocks. ``tokens``
    counts the separator. Ids after the last separator are a document with ``ended`` false; an empty file has none.
    ``files`` (file) limits the scan to complete files.
    """
    listed = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / 2).cast("long").alias("tokens"))
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    blocks = staged(scan_blocks(spark, listed.filter("tokens > 0"), folder, separator, block), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("block") * block
    seen = F.when(F.size("ends") > 0, base + F.element_at("ends", -1))
    scan = blocks.select(
        "file", "ends", base.alias("base"), F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
        F.coalesce(F.last(seen, ignorenulls=True).over(before) + 1, F.lit(0)).alias("open"))
    starts = F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("place"), F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", i - 1) + 1).alias("start"), (F.col("base") + e + 1).alias("stop")))
    whole = scan.select("file", F.inline(starts)).select("file", "place", "start", (F.col("stop") - F.col("start")).alias("tokens"), F.lit(True).alias("ended"))
    rest = blocks.groupBy("file").agg(F.sum("tokens").alias("all"), F.sum(F.size("ends")).cast("long").alias("place"), F.coalesce(F.max(seen) + 1, F.lit(0)).alias("start"))
    tail = rest.filter("`all` > start").select("file", "place", "start", (F.col("all") - F.col("start")).alias("tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def tokens_report(docs: DataFrame) -> DataFrame:
    """doc_id and tokens (separator included) of every row of ``docs``, counted from flat files written for it.

    A null or empty text has the separator alone. Null ids and repeated rows stay rows.
    """
    folder, places = write_tokens(docs)
    counted = token_counts(docs.sparkSession, folder, places)
    report = staged(places.join(counted, ["file", "place"]).select("doc_id", F.col("tokens").alias("n_tokens")), "counts")
    discard(places)
    remove(docs.sparkSession, folder)
    return report
