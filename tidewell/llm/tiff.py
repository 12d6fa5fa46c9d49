"""TIFF columns: write rasters as multi-page TIFF files, walk image directories and decode each page.

`decode_pages` follows the chain of image directories in a file of either byte order; it reads strips and tiles that
are plain, PackBits, LZW or deflate coded, undoes the horizontal difference predictor, and yields one page a directory.
`tiff_pages` emits one row per page of a binary column; `encode` writes a file whose pages it can read back.

Edge cases: a null file gives no pages; an empty, truncated or otherwise damaged file, an unknown compression, a loop of
directories, or dimensions that the stored bytes cannot fill give the pages before the fault and one row with page -1
and the reason in `error`, and the job goes on. No page takes more than MOST_PIXELS bytes, however large it says it is,
and nothing is inflated beyond the size of its strip or tile. Bits of either fill order are read. Repeated rows each
give their pages. Columns besides those named are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 specification: tags, compressions and the sizes of its field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER = 266
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: What a stored byte can become at most: PackBits repeats 128 of two, LZW's longest entry of 12 bits, deflate's 258 of two bits.
MOST_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 2730, DEFLATE: 1032, OLD_DEFLATE: 1032}
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


#: Bytes of pixels that a page may have at most.
MOST_PIXELS = 1 << 28
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class TiffError(ValueError):
    """The bytes are not a TIFF file that this module reads."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # uint8, height x width x samples


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count byte, then that many literal bytes or one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """The inverse: runs of three or more equal bytes become repeats, the rest literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.concatenate([begin, [len(a)]]))
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            out.append(len(literal[i : i + 128]) - 1)
            out.extend(literal[i : i + 128])
        literal.clear()

    for b, n in zip(begin.tolist(), size.tolist()):
        if n < 3:
            literal.extend(data[b : b + n])
            continue
        flush()
        while n > 0:
            part = min(n, 128)
            if part == 1:
                literal.extend(data[b : b + 1])
            else:
                out += bytes([257 - part]) + data[b : b + 1]
            n -= part
    flush()
    return bytes(out)


def _lzw_width(entries: int) -> int:
    """Code width once the table has this many entries; TIFF widens one code early."""
    return 9 if entries < 511 else 10 if entries < 1023 else 11 if entries < 2047 else 12


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out, table, last, acc, have = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], None, 0, 0
    for byte in data:
        acc, have = (acc << 8) | byte, have + 8
        width = _lzw_width(len(table))
        if have < width:
            continue
        have -= width
        code, acc = acc >> have, acc & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            last = None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse of unpack_lzw."""
    out, acc, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    seen = 258  # entries the reader has when it reads the next code

    def put(code: int, width: int) -> None:
        nonlocal acc, have
        acc, have = (acc << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(acc >> have)
            acc &= (1 << have) - 1

    put(256, 9)
    word, first = b"", True
    for i in range(len(data)):
        c = data[i : i + 1]
        longer = word + c
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0], _lzw_width(seen))
        if not first:
            seen += 1
        first = False
        table[longer] = 258 + len(table)
        if len(table) + 258 >= 4094:
            put(256, _lzw_width(seen))
            table, seen, first = {}, 258, True
        word = c
    if word:
        put(table[word] if len(word) > 1 else word[0], _lzw_width(seen))
        if not first:
            seen += 1
    put(257, _lzw_width(seen))
    if have:
        out.append((acc << (8 - have)) & 255)
    return bytes(out)


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file with one image directory for each uint8 raster (height x width, or height x width x samples)."""
    code = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), OLD_DEFLATE: lambda b: zlib.compress(b, 1)}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for raster in pages:
        raster = raster[:, :, None] if raster.ndim == 2 else raster
        h, w, s = raster.shape
        if tile:
            th, tw = tile
            grid = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            grid[:h, :w] = raster
            blocks = [grid[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            blocks = [raster[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            body = code(np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            sizes.append(len(body))
            out += body + b"\0" * (len(body) & 1)
        tags = {WIDTH: [w], LENGTH: [h], BITS: [8] * s, COMPRESSION: [compression], PHOTOMETRIC: [1 if s == 1 else 2], SAMPLES: [s], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[1]], TILE_LENGTH: [tile[0]], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS: [rows_per_strip], STRIP_BYTES: sizes}
        entries = b""
        for tag in sorted(tags):
            values = tags[tag]
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                packed, at = struct.pack(order + "I", len(out)), packed
                out += at
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + packed
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The whole-number fields of the image directory at this place, and the place of the next."""
    (count,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = TYPE_SIZE.get(kind, 0) * n
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind in (1, 3, 4):
            found[tag] = list(struct.unpack_from(f"{order}{n}{'B' if kind == 1 else 'H' if kind == 3 else 'I'}", data, place))
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def decode_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file with 8-bit samples, in the order of its image directories."""
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TiffError("no TIFF header")
        (at,) = struct.unpack_from(order + "I", data, 4)
        been, index = set(), 0
        while at:
            if at in been:
                raise TiffError("image directories form a loop")
            been.add(at)
            f, at = _fields(data, at, order)
            w, h, s = f[WIDTH][0], f[LENGTH][0], f.get(SAMPLES, [1])[0]
            how, predictor = f.get(COMPRESSION, [NONE])[0], f.get(PREDICTOR, [1])[0]
            if any(b != 8 for b in f.get(BITS, [1])) or predictor not in (1, 2):
                raise TiffError("only 8-bit samples without or with horizontal differences")
            if how not in MOST_GROWTH:
                raise TiffError(f"compression {how}")
            tiled = TILE_OFFSETS in f
            bw, bh = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (w, min(f.get(ROWS, [h])[0], h))
            places, sizes = f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_BYTES if tiled else STRIP_BYTES]
            if not (w and h and s and bw and bh):
                raise TiffError("a page, strip or tile without pixels")
            across, down = -(-w // bw), -(-h // bh)
            stored = sum(min(n, len(data)) for n in sizes[: across * down])
            if min(len(places), len(sizes)) < across * down or across * down * bw * bh * s > MOST_GROWTH[how] * stored + across * bw * bh * s or max(h * w * s, bw * bh * s) > MOST_PIXELS:
                raise TiffError("more pixels than the stored bytes can hold")
            pixels = np.zeros((h, w, s), np.uint8)
            for i in range(across * down):
                y, x = (i // across) * bh, (i % across) * bw
                rows = bh if tiled else min(bh, h - y)
                size, raw = rows * bw * s, data[places[i] : places[i] + sizes[i]]
                if size > MOST_GROWTH[how] * len(raw):
                    raise TiffError("truncated strip or tile")
                if f.get(FILL_ORDER, [1])[0] == 2:
                    raw = raw.translate(REVERSED)
                if how in (DEFLATE, OLD_DEFLATE):
                    raw = zlib.decompressobj().decompress(raw, size)
                elif how == PACKBITS:
                    raw = unpack_bits(raw, size)
                elif how == LZW:
                    raw = unpack_lzw(raw, size)
                if len(raw) < size:
                    raise TiffError("truncated strip or tile")
                block = np.frombuffer(raw, np.uint8, count=size).reshape(rows, bw, s)
                if predictor == 2:
                    block = np.add.accumulate(block, axis=1, dtype=np.uint8)
                pixels[y : y + rows, x : x + bw] = block[: h - y, : w - x]
            yield Page(index, w, h, s, how, predictor, tiled, pixels)
            index += 1
    except TiffError:
        raise
    except (struct.error, LookupError, zlib.error, ArithmeticError, ValueError, MemoryError) as e:
        raise TiffError(f"damaged file: {e}") from e


def page_feature(histogram: np.ndarray, columns: np.ndarray, count: int) -> str:
    """16 hex digits of column means against their mean for 64 columns, then entropy in bits and mean sample."""
    if count == 0:
        return "0" * 16 + ":0.0000:0.0000"
    share = histogram[histogram > 0] / count
    means = np.add.reduceat(columns, np.arange(0, len(columns), max(1, len(columns) // 64)))[:64]
    bits = np.packbits(means * len(means) > means.sum()).tobytes().hex().ljust(16, "0")
    return f"{bits}:{-(share * np.log2(share)).sum():.4f}:{(histogram * np.arange(256)).sum() / count:.4f}"


def tiff_pages(df: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """One row per page: id, page, width, height, samples, compression, predictor, tiled, sha256 of the samples, feature, error."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["id"].to_pylist(), batch["file"].to_pylist()):
                if data is None:
                    continue
                try:
                    for p in decode_pages(data):
                        rows.append((key, p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, hashlib.sha256(p.pixels.tobytes()).hexdigest(), page_feature(np.bincount(p.pixels.ravel(), minlength=256), p.pixels.sum((0, 2), dtype=np.int64), p.pixels.size), None))
                except TiffError as e:
                    rows.append((key, -1, *[None] * 8, str(e)))
            names = ["id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "sha256", "feature", "error"]
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(11)], names=names)

    ddl = "id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, sha256 string, feature string, error string"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(file_col).alias("file")).mapInArrow(pages, ddl)


#: Samples across a page, and bytes on a page at most: longer payloads go on to further pages.
PAGE_WIDTH, PAGE_BYTES = 64, 1 << 20
#: Compression, tile or none, and predictor of the stored forms; a payload's checksum chooses one. The slow codecs come seldom.
LAYOUTS = [(DEFLATE, None, 2), (DEFLATE, (64, 64), 1), (NONE, None, 1), (DEFLATE, (128, 32), 2), (PACKBITS, None, 1), (DEFLATE, None, 1), (LZW, (64, 64), 1), (PACKBITS, (32, 64), 2)]
NAMES = {NONE: "plain", PACKBITS: "packbits", LZW: "lzw", DEFLATE: "deflate"}


def layout_of(payload: bytes) -> tuple[int, tuple[int, int] | None, int]:
    return LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]


def payload_to_tiff(payload: bytes, compression: int = DEFLATE, tile: tuple[int, int] | None = None, predictor: int = 2) -> bytes:
    """A payload of a multiple of 64 bytes as 8-bit grey pages, 64 samples across."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    rows = PAGE_BYTES // PAGE_WIDTH
    return encode([a[i : i + rows] for i in range(0, len(a), rows)], compression, predictor, tile=tile)


def text_payload(text: bytes) -> bytes:
    """The bytes, filled with zeros up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def text_files(docs: DataFrame) -> DataFrame:
    """(doc_id, file): every whole text stored as a TIFF file, in the layout that its payload chooses."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                payloads = [text_payload(t) for t in pc.cast(pc.fill_null(part["text"], ""), pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([payload_to_tiff(p, *layout_of(p)) for p in payloads], pa.binary())], names=["doc_id", "file"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store, "doc_id long, file binary")


def text_pages(docs: DataFrame) -> DataFrame:
    """One row per page of the files that `text_files` makes of all texts."""
    return tiff_pages(text_files(docs), "doc_id", "file")


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text through a TIFF file and back: digests of the payload read back and of the file, and a feature.

    Null text counts as empty, whose payload is 64 zero bytes. The payload's checksum chooses the file's layout, so that
    equal texts give equal files and all codecs, strips and tiles are in use. Each text is encoded, decoded and reduced by itself,
    so memory is bounded by the longest text; there is no shuffle.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in pc.cast(pc.fill_null(batch["text"], ""), pa.binary()).to_pylist():
                payload = text_payload(text)
                layout = layout_of(payload)
                media = payload_to_tiff(payload, *layout)
                sha, tail, hist, cols, got, pages = hashlib.sha256(), b"", np.zeros(256, np.int64), np.zeros(PAGE_WIDTH, np.int64), 0, 0
                for page in decode_pages(media):
                    pages += 1
                    raw = page.pixels.tobytes()
                    sha.update(raw)
                    tail = (tail + raw)[-64:]
                    hist += np.bincount(page.pixels.ravel(), minlength=256)
                    cols += page.pixels.sum((0, 2), dtype=np.int64)
                    got += len(raw)
                rows.append((len(text), got, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), page_feature(hist, cols, got), pages, f"{NAMES[layout[0]]}{'-tiles' if layout[1] else ''}"))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "layout"])

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long, layout string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, ddl)
