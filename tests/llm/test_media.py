"""Image formats, area resizing and the stored form of texts."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from acadspark.llm import media as M


def bmp(image, bits, top_down=False):
    h, w, _ = image.shape
    palette, rows = b"", image[:, :, ::-1]
    if bits == 8:
        colours, index = np.unique(rows.reshape(-1, 3), axis=0, return_inverse=True)
        palette = b"".join(bytes(c) + b"\0" for c in colours)
        rows = index.reshape(h, w, 1).astype(np.uint8)
    if bits == 32:
        rows = np.concatenate([rows, np.zeros((h, w, 1), np.uint8)], 2)
    raw = [r.tobytes().ljust((w * bits + 31) // 32 * 4, b"\0") for r in (rows if top_down else rows[::-1])]
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + head + palette + b"".join(raw)


@pytest.mark.parametrize("bits,top", [(24, False), (24, True), (32, False), (8, False)])
def test_bmp(bits, top):
    image = np.random.default_rng(1).integers(0, 6, (5, 7, 3), np.uint8) * 40
    assert (M.decode(bmp(image, bits, top)) == image).all()


def test_netpbm():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (M.decode(M.encode_pgm(a))[:, :, 0] == a).all()
    assert (M.decode(b"P2 # c\n4 3\n15\n" + b" ".join(b"%d" % x for x in a.ravel()))[:, :, 0] == a).all()
    assert M.decode(b"P6 2 2 255\n" + bytes(range(12))).tobytes() == bytes(range(12))
    assert M.decode(b"P3\n1 1 255\n7 8 9").tolist() == [[[7, 8, 9]]]
    assert M.decode(b"P1\n3 1\n1 0 1")[0, :, 0].tolist() == [0, 255, 0]
    assert M.decode(b"P4\n9 1\n\x80\x80")[0, :, 0].tolist() == [0] + [255] * 7 + [0]
    assert M.decode(b"P5 1 1 1000\n\x03\xe7")[0, 0, 0] == 999
    with pytest.raises(ValueError):
        M.decode(b"P5 9 9 255\nabc")


@pytest.mark.parametrize("size", [(8, 9), (3, 5), (1, 1), (20, 31)])
def test_area(size):
    image = np.random.default_rng(2).random((11, 13))
    fine = np.kron(image, np.ones(size))  # every cell is then a whole block
    want = fine.reshape(size[0], 11, size[1], 13).mean((1, 3))
    assert np.allclose(M.resize_area(image, *size), want)


def test_report(spark):
    texts = ["", None, "a" * 576, "b" * 577, "é" * 400, "x"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "x", "m")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in M.media_report(docs).collect()}
    assert len(got) == 7 and [got[None][k] for k in ("payload_sha256", "feature")] == [got[5][k] for k in ("payload_sha256", "feature")]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-32:])
        stored = b"P5\n576 %d\n255\n" % (len(pad) // 576) + pad
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert M.media_report(docs.limit(0)).collect() == []


def test_broken_media_keeps_rows(spark):
    rows = spark.createDataFrame([(1, b"P5 9 9 255\nabc", "t"), (2, None, "t"), (3, b"GIF", "t"), (4, M.encode_pgm(np.eye(40, dtype=np.uint8)), "t")], "id int, media binary, tile string")
    got = {r.id: r for r in M.media_tiles(rows).collect()}
    assert len(got) == 4 and all(got[i].error and got[i].tile is None for i in (1, 2, 3))
    assert np.load(io.BytesIO(bytes(got[4].tile))).shape == (32, 32) and got[4].error is None


def test_broken_headers_end_no_job(spark):
    broken = [b"P5 3 3", b"P5", b"P5 3 3 0 aaaaaaaaa", b"P5 3 3 70000 " + b"a" * 99, b"P5 100000000000000000000 2 255 aaaa", b"P5 999999999 999999999 255 aaaa", b"P2 1 1 255\n5000000000", b"P2 1 1 9\n10",
              b"P2 1 1 255\nx", b"P2 2 1 255\n1", b"P1 2 2\n1 0", b"P4 99 99\nab", b"P6 1 1 255", b"P5 0 3 255 ", b"P7 1 1 255 a", b"", b"B", b"BM", b"BM" + b"\0" * 60, b"BM" + b"\xff" * 80, bmp(np.zeros((2, 2, 3), np.uint8), 24)[:-3],
              b"P5 2 2 255#abcd", b"P5 1 1 255"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(broken)] + [(99, M.encode_pgm(np.full((2, 2), 7, np.uint8)))], "id int, media binary")
    got = {r.id: r for r in M.media_tiles(rows).collect()}
    assert len(got) == len(broken) + 1 and got[99].error is None
    assert [i for i in range(len(broken)) if not got[i].error or got[i].tile is not None or got[i].dhash is not None] == []


def test_lightness_does_not_depend_on_the_largest_sample(spark):
    ramp = np.tile(np.linspace(0, 1, 64), (64, 1))
    make = lambda most: b"P5 64 64 %d\n" % most + np.round(ramp * most).astype(">u2" if most > 255 else np.uint8).tobytes()
    got = {r.id: r for r in M.media_tiles(spark.createDataFrame([(m, make(m)) for m in (15, 255, 1000, 65535)], "id int, media binary")).collect()}
    tiles = {m: np.load(io.BytesIO(bytes(r.tile))).astype(int) for m, r in got.items()}
    assert all(abs(tiles[m] - tiles[255]).max() <= (9 if m == 15 else 1) for m in tiles) and tiles[65535].max() >= 250 and tiles[15].min() <= 4
    assert got[1000].dhash == got[255].dhash == got[65535].dhash == "f" * 16


def test_bmp_of_short_headers_masks_and_few_bits():
    index = np.array([[0, 1, 2, 3, 1], [3, 2, 1, 0, 2]], np.uint8)
    colours = np.array([[0, 0, 0], [10, 20, 30], [200, 100, 50], [255, 255, 255]], np.uint8)
    for bits in (2, 4, 8):
        rows = np.zeros((2, 8), np.uint8)
        for y in range(2):
            for x in range(5):
                rows[y, x * bits // 8] |= index[y, x] << (8 - bits - x * bits % 8)
        stride = (5 * bits + 31) // 32 * 4
        body = b"".join(r[:stride].tobytes() for r in rows[::-1])
        short = struct.pack("<IHHHH", 12, 5, 2, 1, bits) + colours[:, ::-1].tobytes() + b"\0" * 3 * ((1 << bits) - 4)
        assert (M.decode(b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + len(short)) + short + body) == colours[index]).all()
    pixels = np.array([[0x7C00, 0x03E0], [0x001F, 0x7FFF]], "<u2")
    head = struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 16, 0, 0, 0, 0, 0, 0)
    assert M.decode(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + head + pixels.tobytes()).tolist() == [[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 255]]]
    pixels = np.array([[0xF800, 0x07E0]], "<u2")
    head = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 3, 0, 0, 0, 0, 0) + struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    assert M.decode(b"BM" + struct.pack("<IHHI", 0, 0, 0, 66) + head + pixels.tobytes()).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    pixels = np.array([[0x0000FF00 | 0x01020000]], "<u4")
    head = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 0, 0, 0, 0, 0) + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)
    assert M.decode(b"BM" + struct.pack("<IHHI", 0, 0, 0, 66) + head + pixels.tobytes()).tolist() == [[[0, 255, 2]]]
