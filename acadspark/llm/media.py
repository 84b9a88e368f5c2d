"""Media columns: Netpbm and BMP images decoded to arrays, resized by area, written as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.llm.common import discard, staged

ROW = 576
TILE = 32
REPORT_TILE = 16


GAP = rb"(?:\s|#[^\n]*(?:\n|$))+"
HEADER = re.compile(rb"P([1-6])" + (GAP + rb"(\d{1,9})") * 2)
DEEP = re.compile(GAP + rb"(\d{1,9})")


def decode_netpbm(raw: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as an array of (height, width, 1 or 3) and its largest possible sample: samples 0 to maxval, bitmaps 0 (black)
    and 255 (white). A ValueError tells what is wrong with a broken image; nothing is laid out before the sizes are checked."""
    m = HEADER.match(raw)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, width, height = (int(x) for x in m.groups())
    at, most = m.end(), 1
    if kind not in (1, 4):
        deep = DEEP.match(raw, at)
        if not deep or not 0 < int(deep[1]) < 65536:
            raise ValueError("no largest sample from 1 to 65535")
        at, most = deep.end(), int(deep[1])
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if not n:
        raise ValueError("empty image")
    if kind > 3 and raw[at: at + 1] not in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"):
        raise ValueError("no white space after the header")
    need = n if kind < 4 else height * ((width + 7) // 8) if kind == 4 else n * (1 if most < 256 else 2)
    if need > len(raw) - at - (kind > 3):
        raise ValueError("image data ends early")
    if kind == 1:
        samples = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*\n?", b"", raw[at:])), np.uint8)[:n] - 48
    elif kind in (2, 3):
        words = re.sub(rb"#[^\n]*\n?", b" ", raw[at:]).split()[:n]
        if not all(w.isdigit() and len(w) < 10 for w in words):
            raise ValueError("samples that are no numbers")
        samples = np.array(words, np.int64)
    elif kind == 4:
        rows = np.frombuffer(raw, np.uint8, need, at + 1).reshape(height, -1)
        samples = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(raw, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(samples) < n:
        raise ValueError("image data ends early")
    if kind in (1, 4):
        samples, most = (1 - samples) * 255, 255
    if int(samples.max()) > most:
        raise ValueError("a sample above the largest one")
    return samples.astype(np.uint8 if most < 256 else np.uint16).reshape(height, width, depth), most


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of ``mask`` in each pixel, scaled to 0 to 255; an empty mask gives 0."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    if top & (top + 1):
        raise ValueError("colour mask with gaps")
    return (((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.int64) * 255 + top // 2) // top


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 2, 4, 8, 16, 24 or 32 bits, with masks or without, of the short (12 bytes) or a long header, as
    (height, width, 3) in red, green, blue; rows from the top. A ValueError tells what is wrong with a broken image."""
    if raw[:2] != b"BM" or len(raw) < 26:
        raise ValueError("not a BMP image")
    data, head = struct.unpack_from("<II", raw, 10)
    used = packed = 0
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", raw, 18)
    elif head >= 40 and len(raw) >= 54:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", raw, 18)
        used = struct.unpack_from("<I", raw, 46)[0]
    else:
        raise ValueError("unknown BMP header")
    if bits not in (1, 2, 4, 8, 16, 24, 32) or packed not in ((0, 3, 6) if bits in (16, 32) else (0,)):
        raise ValueError("compressed BMP or unknown number of bits")
    upward, height = height > 0, abs(height)
    if width <= 0 or not height:
        raise ValueError("empty image")
    stride = (width * bits + 31) // 32 * 4
    if data + stride * height > len(raw):
        raise ValueError("image data ends early")
    rows = np.frombuffer(raw, np.uint8, stride * height, data).reshape(height, stride)
    if bits in (16, 32):
        pixels = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :width].astype(np.uint32)
        masks = struct.unpack_from("<III", raw, 54) if packed else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        image = np.stack([_channel(pixels, m) for m in masks], 2).astype(np.uint8)
    elif bits == 24:
        image = rows[:, : width * 3].reshape(height, width, 3)[:, :, ::-1]
    else:
        entry = 3 if head == 12 else 4
        colours = min(used or 1 << bits, 1 << bits)
        palette = np.frombuffer(raw, np.uint8, colours * entry, 14 + head).reshape(-1, entry)[:, 2::-1]
        per = 8 // bits
        index = np.stack([(rows >> (8 - bits * (k + 1))) & ((1 << bits) - 1) for k in range(per)], 2).reshape(height, -1)[:, :width]
        if int(index.max()) >= colours:
            raise ValueError("colour outside the palette")
        image = palette[index]
    return np.ascontiguousarray(image[::-1] if upward else image)


def read_image(raw: bytes) -> tuple[np.ndarray, int]:
    """Array of (height, width, 1 or 3) and the largest sample that its format allows."""
    return (decode_bmp(raw), 255) if raw[:2] == b"BM" else decode_netpbm(raw)


def decode(raw: bytes) -> np.ndarray:
    return read_image(raw)[0]


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples (height, width) as a binary grey map."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """(height, width) of doubles; colours by the weights of ITU-R BT.601."""
    return image[:, :, 0].astype(np.float64) if image.shape[2] == 1 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each output cell covers, cells cut at fractions of a pixel, from one integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0), 1, out=total[1:, 1:])

    def at(edges: np.ndarray, size: int):
        low = np.minimum(edges.astype(np.int64), size - 1)
        return low, edges - low

    ys, fy = at(np.arange(height + 1) * (h / height), h)
    xs, fx = at(np.arange(width + 1) * (w / width), w)
    rows = total[ys] * (1 - fy)[:, None] + total[ys + 1] * fy[:, None]
    corner = rows[:, xs] * (1 - fx) + rows[:, xs + 1] * fx
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cells / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 rows of 9 resized cells rises to the next cell."""
    small = np.round(resize_area(image, 8, 9), 6)
    return int("".join("1" if x else "0" for x in (small[:, 1:] > small[:, :-1]).ravel()), 2)


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


TILES = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("samples", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])


def media_tiles(rows: DataFrame, column: str = "media", side: int = TILE) -> DataFrame:
    """Adds height, width, samples (the decoded bytes), tile (NPY of side x side 8-bit cells), dhash and error. Tiles and hashes
    are of lightness, whatever the largest sample.

    One image at a time is in memory. A null or broken image gives nulls and its error; the row stays.
    """
    taken = {f.name for f in TILES} & set(rows.columns)
    kept = rows.drop(*taken)  # a clashing input column is replaced

    def one(raw: bytes | None) -> dict:
        if raw is None:
            return dict.fromkeys(TILES.names) | {"error": "null"}
        try:
            image, most = read_image(raw)
            light = grey(image) * (255 / most)
            tile = np.clip(np.floor(resize_area(light, side, side) + 0.5), 0, 255).astype(np.uint8)
            return {"height": image.shape[0], "width": image.shape[1], "samples": image.tobytes(), "tile": npy(tile), "dhash": f"{difference_hash(light):016x}", "error": None}
        except (ValueError, ArithmeticError, LookupError, TypeError, MemoryError, struct.error) as e:  # of this image alone
            return dict.fromkeys(TILES.names) | {"error": str(e)[:200]}

    def run(it):
        for batch in it:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = pa.Table.from_pylist([one(x) for x in part.column(column).to_pylist()], schema=TILES).to_batches()
                yield pa.RecordBatch.from_arrays([*part.columns, *made[0].columns], names=[*part.schema.names, *TILES.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, height int, width int, samples binary, tile binary, dhash string, error string")


def text_images(docs: DataFrame) -> DataFrame:
    """UTF-8 bytes of each text (null: none), filled with 255 to a positive multiple of ROW, as a grey map ROW wide."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for batch in it:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                media, sizes = [], []
                for raw in part.column("raw").to_pylist():
                    sizes.append(len(raw))
                    payload = np.frombuffer(raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\xff"), np.uint8)
                    media.append(encode_pgm(payload.reshape(-1, ROW)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return raw.mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def media_report(docs: DataFrame) -> DataFrame:
    """Digest per document of the stored image and of what is read back from it.

    The images are written to the shared folder and read again; so are the NPY tiles made of them. ``feature`` is the
    difference hash and the SHA-256 of the stored tile's cells. Equal texts give equal values; a null text is an empty one,
    repeated rows and null ids stay rows, an empty table gives no rows, other columns are not read.
    """
    stored = staged(text_images(docs), "media")
    tail = F.expr("substring(samples, -32, 32)")
    tiles = media_tiles(stored, side=REPORT_TILE).select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).cast("long").alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "dhash", "tile")
    tiles = staged(tiles, "tiles")
    discard(stored)
    cells = F.expr(f"substring(tile, -{REPORT_TILE * REPORT_TILE}, {REPORT_TILE * REPORT_TILE})")  # the header of a tile comes first
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "dhash", F.sha2(cells, 256)).alias("feature"))
