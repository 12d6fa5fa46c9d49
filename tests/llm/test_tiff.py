import hashlib
import struct
import zlib

import numpy as np
import pytest

from tests.llm.cases import frame, odd_documents
from tidewell.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(compression)
    pages = [rng.integers(0, 4, (37, 65), dtype=np.uint8), np.zeros((1, 1), np.uint8), rng.integers(0, 256, (50, 20, 3), dtype=np.uint8), np.repeat(np.arange(100, dtype=np.uint8), 70).reshape(70, 100)]
    got = list(tiff.decode_pages(tiff.encode(pages, compression, predictor, 10, tile, order)))
    assert [p.index for p in got] == [0, 1, 2, 3]
    for page, want in zip(got, pages):
        assert np.array_equal(page.pixels, want if want.ndim == 3 else want[:, :, None]) and page.tiled == bool(tile) and page.compression == compression


def test_lzw_table_wraps():
    data = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(b"ab" * 30_000), 60_000) == b"ab" * 30_000


def test_known_codes():
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # codes 256, 7, 258, 8, 8, 257 of nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 257))
    assert tiff.unpack_lzw(int(bits.ljust(56, "0"), 2).to_bytes(7, "big"), 5) == bytes([7, 7, 7, 8, 8])


def test_damaged_files(spark):
    good = tiff.encode([np.ones((4, 4), np.uint8)], tiff.NONE)
    loop = bytearray(good)
    (at,) = struct.unpack_from("<I", loop, 4)
    (count,) = struct.unpack_from("<H", loop, at)
    struct.pack_into("<I", loop, at + 2 + 12 * count, at)
    rows = [(1, good), (2, None), (3, b""), (4, good[:20]), (5, bytes(loop)), (6, b"MM\0\x2a\0\0\0\0"), (1, good)]
    got = tiff.tiff_pages(spark.createDataFrame([(i, f, "x") for i, f in rows], "id long, file binary, page string"), "id", "file").collect()
    assert sorted((r["id"], r["page"]) for r in got) == [(1, 0), (1, 0), (3, -1), (4, -1), (5, -1), (5, 0)]
    assert all((r["error"] is None) == (r["page"] >= 0) for r in got)


def test_text_media(spark):
    rows = odd_documents(2, 20)
    got = tiff.text_media(frame(spark, rows)).collect()
    assert len(got) == len(rows) and tiff.text_media(frame(spark, [])).count() == 0
    texts, by_text = {}, {}
    for d, t, *_ in rows:
        texts.setdefault(d, (t or "").encode())
    for r in got:
        b = texts[r["doc_id"]]
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert by_text.setdefault(b, r[1:]) == r[1:]


def with_field(data, tag, value):
    """The file with a field of its first directory set to one number."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    (count,) = struct.unpack_from("<H", out, at)
    for i in range(count):
        if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<HII", out, at + 4 + 12 * i, 4, 1, value)
            return bytes(out)
    raise KeyError(tag)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tag, value", [(tiff.WIDTH, 2**32 - 1), (tiff.LENGTH, 2**32 - 1), (tiff.WIDTH, 0), (tiff.LENGTH, 0), (tiff.SAMPLES, 0), (tiff.SAMPLES, 2**31), (tiff.ROWS, 0), (tiff.STRIP_OFFSETS, 2**32 - 1), (tiff.STRIP_BYTES, 0), (tiff.BITS, 16), (tiff.PREDICTOR, 9), (tiff.COMPRESSION, 7), (tiff.WIDTH, 1 << 20)])
def test_damaged_fields(compression, tag, value):
    good = tiff.encode([np.ones((40, 64), np.uint8)], compression)
    with pytest.raises(tiff.TiffError):
        list(tiff.decode_pages(with_field(good, tag, value)))


def test_large_claims_and_bombs():
    huge = with_field(with_field(tiff.encode([np.ones((4, 4), np.uint8)], tiff.DEFLATE), tiff.WIDTH, 1 << 20), tiff.LENGTH, 1 << 20)
    with pytest.raises(tiff.TiffError):
        list(tiff.decode_pages(huge))
    good = tiff.encode([np.zeros((64, 64), np.uint8)], tiff.DEFLATE, 1)
    bomb = zlib.compress(bytes(50_000_000))
    at = len(good) + len(good) % 2
    bad = with_field(with_field(good, tiff.STRIP_OFFSETS, at), tiff.STRIP_BYTES, len(bomb)).ljust(at, b"\0") + bomb
    (page,) = tiff.decode_pages(bad)  # no more is inflated than the strip has
    assert page.pixels.shape == (64, 64, 1) and not page.pixels.any()


def test_random_damage():
    rng = np.random.default_rng(3)
    for compression in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        good = tiff.encode([rng.integers(0, 3, (30, 64), dtype=np.uint8)] * 2, compression, 2, 8)
        for _ in range(300):
            bad = bytearray(good)
            for _ in range(rng.integers(1, 4)):
                bad[rng.integers(len(bad))] = rng.integers(256)
            try:
                for page in tiff.decode_pages(bytes(bad[: rng.integers(8, len(bad) + 1)])):
                    assert page.pixels.nbytes <= tiff.MOST_PIXELS
            except tiff.TiffError:
                pass


def test_fill_order():
    pixels = np.arange(256, dtype=np.uint8).reshape(4, 64)
    data = bytearray(tiff.encode([pixels], tiff.NONE, 1))
    data[8 : 8 + 256] = bytes(data[8 : 8 + 256]).translate(tiff.REVERSED)
    (at,) = struct.unpack_from("<I", data, 4)
    (count,) = struct.unpack_from("<H", data, at)
    for i in range(count):  # the photometric field, which is not read, gives its place to the fill order
        if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tiff.PHOTOMETRIC:
            struct.pack_into("<HHII", data, at + 2 + 12 * i, tiff.FILL_ORDER, 4, 1, 2)
    (page,) = tiff.decode_pages(bytes(data))
    assert np.array_equal(page.pixels[:, :, 0], pixels)


def test_text_pages(spark):
    rows = [(i, f"text {i} " * (i * 7), None, None) for i in range(60)] + [(60, None, None, None), (61, "", None, None), (62, "more than a page " * 70_000, None, None)]
    got = {}
    for r in tiff.text_pages(frame(spark, rows)).collect():
        assert r["error"] is None
        got.setdefault(r["id"], []).append(r)
    media = {r["doc_id"]: r for r in tiff.text_media(frame(spark, rows)).collect()}
    for d, t, *_ in rows:
        own = sorted(got[d], key=lambda r: r["page"])
        payload = tiff.text_payload((t or "").encode())
        parts = [payload[i : i + tiff.PAGE_BYTES] for i in range(0, len(payload), tiff.PAGE_BYTES)]
        assert [r["sha256"] for r in own] == [hashlib.sha256(p).hexdigest() for p in parts] and [r["page"] for r in own] == list(range(len(parts)))
        assert media[d]["pages"] == len(parts)
    assert len(got[62]) == 2
    assert {(r["compression"], r["tiled"]) for x in got.values() for r in x} == {(c, bool(t)) for c, t, _ in tiff.LAYOUTS}
