"""TIFF files in a binary column: directories, strips and tiles, three compressions, predictors.

``pages`` walks the image file directories of one file and decodes each; ``decode``
emits a row per page. Grey and RGB samples of 8 or 16 bits, chunky, are supported; both
byte orders; uncompressed, PackBits, LZW and deflate; predictor 1 and 2.
``encode`` writes the same kinds of file.

Defined cases: a null or empty file has no page; a file that can't be read gives the pages before its fault
and a row with page -1 and the error; a directory chain that returns to itself, and an image that is larger than
the file's bytes can give, are errors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import blocks, in_arrow

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4)}


def unpackbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        run = 1
        while run < 128 and i + run < len(raw) and raw[i + run] == raw[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, raw[i]])
            i += run
            continue
        end = i + 1
        while end < len(raw) and end - i < 128 and not (end + 2 < len(raw) and raw[end] == raw[end + 1] == raw[end + 2]):
            end += 1
        out += bytes([end - i - 1]) + raw[i:end]
        i = end
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = list(base), 9, b""
                continue
            if not table:
                table = list(base)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw(raw: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table: dict[bytes, int] = {}
    width, run = 9, b""
    for i in range(len(raw)):
        byte = raw[i : i + 1]
        if not run or run + byte in table:
            run += byte
            continue
        codes.append((run[0] if len(run) == 1 else table[run], width))
        table[run + byte] = 258 + len(table)
        n = 258 + len(table)
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            codes.append((256, width))
            table, width = {}, 9
        run = byte
    if run:
        codes.append((run[0] if len(run) == 1 else table[run], width))
        n = 259 + len(table)
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    codes.append((257, width))
    held = bits = 0
    out = bytearray()
    for code, width in codes:
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            out.append((held >> (bits - 8)) & 255)
            bits -= 8
            held &= (1 << bits) - 1
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


UNPACK = {NONE: bytes, PACKBITS: unpackbits, LZW: unlzw, DEFLATE: zlib.decompress, DEFLATE_OLD: zlib.decompress}
#: No compression here makes more than so many bytes of one (deflate's bound is the highest).
MOST_GROWTH = 1040
PACK = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda raw: zlib.compress(raw, 1)}


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A multi-page file of images (rows x columns, or rows x columns x samples) of unsigned samples."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        a = image if image.ndim == 3 else image[:, :, None]
        h, w, s = a.shape
        th, tw = tile or (max(1, min(rows_per_strip, h)), w)
        places, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = a[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = PACK[compression](np.ascontiguousarray(part, dtype=a.dtype.newbyteorder(order)).tobytes())
                places.append(len(out))
                sizes.append(len(raw))
                out += raw
        tags: dict[int, tuple[int, list[int]]] = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * a.itemsize] * s), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if s == 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            tags |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, places), TILE_COUNTS: (4, sizes)}
        else:
            tags |= {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [th]), STRIP_COUNTS: (4, sizes)}
        entries = bytearray()
        for tag in sorted(tags):
            kind, values = tags[tag]
            code, size = FIELD[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image file directory, in the order they are linked."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if kind not in FIELD:
                continue
            code, size = FIELD[kind]
            where = at + 10 + 12 * i
            if size * count > 4:
                where = struct.unpack_from(order + "I", raw, where)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        yield order, tags
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def pages(raw: bytes) -> Iterator[np.ndarray]:
    """The images of a file, as rows x columns x samples."""
    if not raw:
        return
    for order, t in directories(raw):
        w, h = t[WIDTH][0], t[HEIGHT][0]
        s, bits = t.get(SAMPLES, (1,))[0], set(t.get(BITS, (1,)))
        if bits not in ({8}, {16}) or t.get(PLANAR, (1,))[0] != 1:
            raise ValueError("only chunky samples of 8 or 16 bits are supported")
        kind = np.dtype(np.uint8 if bits == {8} else np.uint16)
        if not (w and h and s) or w * h * s * kind.itemsize > len(raw) * MOST_GROWTH:
            raise ValueError(f"an image of {w} x {h} x {s} samples can't be in {len(raw)} bytes")
        unpack = UNPACK[t.get(COMPRESSION, (NONE,))[0]]
        tiled = TILE_OFFSETS in t
        tw, th = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (w, min(t.get(ROWS_PER_STRIP, (h,))[0], h))
        if not (tw and th) or tiled and tw * th * s * kind.itemsize > len(raw) * MOST_GROWTH:
            raise ValueError("a strip or tile of no or impossible size")
        places, sizes = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[STRIP_OFFSETS], t[STRIP_COUNTS])
        image = np.zeros((h, w, s), kind)
        across = -(-w // tw)
        for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
            y, x = i // across * th, i % across * tw
            rows = th if tiled else min(th, h - y)
            flat = np.frombuffer(unpack(raw[place : place + size]), kind.newbyteorder(order), rows * tw * s)
            part = flat.reshape(rows, tw, s).astype(kind)
            if t.get(PREDICTOR, (1,))[0] == 2:
                part = np.cumsum(part, axis=1, dtype=kind)
            image[y : y + th, x : x + tw] = part[: h - y, : w - x]
        yield image


def decode(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per page: key, page, width, height, samples, pixels (row by row), error."""
    ddl = f"`{key}` {files.schema[key].dataType.simpleString()}, page int, width int, height int, samples int, pixels binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, out = batch.column(1)[i].as_py() or b"", []
                try:
                    for n, image in enumerate(pages(raw)):
                        out.append((n, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None))
                except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    out.append((-1, None, None, None, None, f"{type(e).__name__}: {e}"))
                if out:
                    n = len(out)
                    cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), *cols], [key, "page", "width", "height", "samples", "pixels", "error"])

    return in_arrow(files.select(key, media), run, ddl)


# ---- texts as images -------------------------------------------------------------------

UNIT = 576
PAGE_ROWS = 512


def text_images(payload: np.ndarray) -> list[np.ndarray]:
    """A payload of whole units as grey pages, a unit to the row."""
    rows = payload.reshape(-1, UNIT)
    return [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]


def store_texts(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """doc_id, n_bytes and media: each text, padded with 255 to whole units, as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for lo, hi, data, offsets in blocks(batch.column(1), 1 << 22):
                media, sizes = [], np.diff(offsets)
                for i in range(hi - lo):
                    n = int(sizes[i])
                    payload = np.full(max(1, -(-n // UNIT)) * UNIT, 255, np.uint8)
                    payload[:n] = data[offsets[i] : offsets[i + 1]]
                    media.append(encode(text_images(payload), compression, predictor))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, hi - lo), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                row = hi

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def feature(image: np.ndarray) -> str:
    """An 8 x 8 difference hash of the page's mean brightness by region, and its mean and deviation."""
    a = image[:, :, 0]
    ys = np.linspace(0, a.shape[0], 9).astype(int)[:-1]
    xs = np.linspace(0, a.shape[1], 10).astype(int)[:-1]
    across = np.add.reduceat(a, xs, axis=1, dtype=np.int64)
    if a.shape[0] >= 8:
        cells = np.add.reduceat(across, ys, axis=0)
    else:
        cells = across[np.linspace(0, a.shape[0] - 1, 8).astype(int)]
    bits = np.packbits(cells[:, 1:] > cells[:, :-1])
    total, n = int(a.sum(dtype=np.int64)), a.size
    squares = int(np.bincount(a.ravel(), minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    return f"{bits.tobytes().hex()}-{total // n}-{(squares - total * total // n) // n}"


def read_features(files: DataFrame) -> DataFrame:
    """Decode stored texts page by page and digest what was read: sizes, hashes and a feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item in batch.column(2):
                raw = item.as_py()
                size, sha, tail, marks = 0, hashlib.sha256(), b"", []
                for image in pages(raw):
                    read = image.tobytes()
                    size += len(read)
                    sha.update(read)
                    tail = (tail + read[-32:])[-32:]
                    marks.append(feature(image))
                mark = marks[0] if len(marks) == 1 else f"{len(marks)}x{hashlib.sha256(' '.join(marks).encode()).hexdigest()[:16]}"
                out.append((size, sha.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), mark))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    key = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {key}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
