"""TIFF media columns: a writer, and a reader that walks image directories and emits one row for each page.

The reader takes either byte order, strips and tiles, no compression, PackBits, LZW and deflate, and undoes horizontal
differencing of 8- and 16-bit samples. Damaged files raise ValueError in `read_pages`; `page_rows` gives such a row one
page of number -1 with the reason in `error`. Null media give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import arrow

# Fixed values of the TIFF 6.0 format: tags, compression schemes, field sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

#: Bytes in a row of a stored payload, and rows on a page of it.
ROW, PAGE_ROWS = 576, 64


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, made = [], 0, 0
    while i < len(data) and made < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
            continue
        made += len(out[-1])
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), data[i]))
        else:
            j = i + 1
            while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def un_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from the high bit down; the code width grows one code early."""
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, bits, held, have, last = list(roots), 9, 0, 0, b""
    out, made = [], 0
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < bits:
            continue
        have -= bits
        code = held >> have & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            entries, bits, last = list(roots), 9, b""
            continue
        if code < len(entries):
            word = entries[code]
        elif code == len(entries) and last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(word)
        made += len(word)
        if last:
            entries.append(last + word[:1])
        last = word
        bits = min(12, (len(entries) + 1).bit_length())
        if made >= size:
            break
    return b"".join(out)


def to_lzw(data: bytes) -> bytes:
    held, have, out = 0, 0, bytearray()
    known = {bytes((i,)): i for i in range(256)}
    bits, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << bits | code, have + bits
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
            held &= (1 << have) - 1

    put(256)
    count = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = count
        count += 1
        if count == 4094:
            put(256)
            known, bits, count = {bytes((k,)): k for k in range(256)}, 9, 258
        else:
            bits = count.bit_length()
        word = data[i : i + 1]
    if word:
        put(known[word])
        bits = min(12, (count + 1).bit_length())
    put(257)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    pixels: np.ndarray  # height x width x samples


def _directory(blob: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", blob, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
        if kind not in FIELD_CODE:
            continue
        place = at + 10 + 12 * i
        if FIELD_SIZE[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", blob, place)
        fields[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", blob, place)
    (following,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)
    return fields, following


def _block(blob: bytes, offset: int, count: int, scheme: int, size: int) -> bytes:
    if offset + count > len(blob):
        raise ValueError("a strip or tile lies beyond the file's end")
    data = blob[offset : offset + count]
    if scheme == NONE:
        out = data
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompress(data)
    elif scheme == PACKBITS:
        out = unpack_bits(data, size)
    elif scheme == LZW:
        out = un_lzw(data, size)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def read_pages(blob: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(blob[:2])]
        magic, at = struct.unpack_from(order + "HI", blob, 2)
        if magic != 42:
            raise ValueError("not a TIFF file")
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            fields, at = _directory(blob, at, order)
            yield _page(blob, fields, order, len(seen) - 1)
    except (KeyError, struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e!r}") from e


def _page(blob: bytes, fields: dict[int, tuple], order: str, number: int) -> Page:
    get = lambda tag, default: fields.get(tag, (default,))[0]
    w, h, samples, bits = fields[WIDTH][0], fields[LENGTH][0], get(SAMPLES, 1), get(BITS, 1)
    if bits not in (8, 16) or get(PLANAR, 1) != 1:
        raise ValueError("only chunky 8- and 16-bit samples are supported")
    kind = np.dtype(f"{order}u{bits // 8}")
    scheme, predictor = get(COMPRESSION, NONE), get(PREDICTOR, 1)
    tiled = TILE_OFFSETS in fields
    bw, bh = (fields[TILE_WIDTH][0], fields[TILE_LENGTH][0]) if tiled else (w, min(get(ROWS_PER_STRIP, h), h) or 1)
    offsets, counts = (fields[TILE_OFFSETS], fields[TILE_COUNTS]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_COUNTS])
    across = -(-w // bw)
    pixels = np.zeros((h, w, samples), kind.newbyteorder("="))
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        top, left = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - top)
        block = np.frombuffer(_block(blob, offset, count, scheme, rows * bw * samples * kind.itemsize), kind).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        there = pixels[top : top + rows, left : left + bw]
        there[...] = block[: there.shape[0], : there.shape[1]]
    return Page(number, w, h, samples, scheme, pixels)


_ENCODERS = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 3), PACKBITS: pack_bits, LZW: to_lzw}


def write_pages(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None, int]]) -> bytes:
    """A little-endian file of 8-bit grey pages: (rows x width samples, compression, predictor, tile (width, height) or None, rows per strip)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for pixels, scheme, predictor, tile, strip in pages:
        h, w = pixels.shape
        if tile:
            tw, th = tile
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw), np.uint8)
            full[:h, :w] = pixels
            blocks = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            blocks = [pixels[y : y + strip] for y in range(0, h, strip)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1), np.uint8))
            data = _ENCODERS[scheme](np.ascontiguousarray(b).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        fields = {WIDTH: (w,), LENGTH: (h,), BITS: (8,), COMPRESSION: (scheme,), PHOTOMETRIC: (1,), SAMPLES: (1,), PREDICTOR: (predictor,)}
        fields |= {TILE_WIDTH: (tile[0],), TILE_LENGTH: (tile[1],), TILE_OFFSETS: tuple(offsets), TILE_COUNTS: tuple(counts)} if tile else {STRIP_OFFSETS: tuple(offsets), ROWS_PER_STRIP: (strip,), STRIP_COUNTS: tuple(counts)}
        out += b"\0" * (len(out) % 2)
        at = len(out)
        struct.pack_into("<I", out, link, at)
        tail = at + 6 + 12 * len(fields)
        entries, extra = bytearray(struct.pack("<H", len(fields))), bytearray()
        for tag, values in sorted(fields.items()):
            entries += struct.pack("<HHI", tag, 4, len(values))
            if len(values) == 1:
                entries += struct.pack("<I", values[0])
            else:
                entries += struct.pack("<I", tail + len(extra))
                extra += struct.pack(f"<{len(values)}I", *values)
        link = at + len(entries)
        out += entries + b"\0\0\0\0" + extra
    return bytes(out)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with bytes 255 up to a positive multiple of the row size; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * ((-len(data)) % ROW or (0 if data else ROW))


def store(payload: bytes) -> bytes:
    """A payload as pages of 8-bit samples: deflate with horizontal differencing, in strips and tiles by turns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_pages([(rows[a : a + PAGE_ROWS], DEFLATE, 2, (ROW, 32) if a // PAGE_ROWS % 2 else None, 32) for a in range(0, len(rows), PAGE_ROWS)])


def media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_bytes, media)."""
    arrow(docs.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([store(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(files, "doc_id long, n_bytes long, media binary")


_PAGES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, pages int, page int, width int, height int, samples int, compression int, pixels binary, error string"


def page_rows(files: DataFrame) -> DataFrame:
    """files(doc_id, n_bytes, media) as one row for each page; the pages of a file follow each other."""
    arrow(files.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _PAGES.split(", "))])
        for batch in batches:
            out, size = [], 0
            for doc_id, n_bytes, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if blob is None:
                    continue
                about = (doc_id, n_bytes, len(blob), hashlib.sha256(blob).hexdigest())
                try:
                    pages = [(p.number, p.width, p.height, p.samples, p.compression, p.pixels.tobytes(), None) for p in read_pages(blob)]
                except ValueError as e:
                    pages = [(-1, None, None, None, None, None, str(e))]
                for p in pages:
                    out.append((*about, len(pages), *p))
                    size += len(p[5] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(rows, _PAGES)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(counts: np.ndarray, pages: int) -> str:
    """Pages, mean, spread and entropy of the samples."""
    n = counts.sum()
    p, values = counts / n, np.arange(256)
    mean = float((p * values).sum())
    spread = float(np.sqrt((p * (values - mean) ** 2).sum()))
    some = p[p > 0]
    return f"pages={pages};mean={mean:.4f};std={spread:.4f};entropy={max(0.0, float(-(some * np.log2(some)).sum())):.4f}"


def digests(pages: DataFrame) -> DataFrame:
    """One row for each file from its page rows, which must follow each other within a partition, as page_rows leaves them."""
    arrow(pages.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        sha, tail, counts, size = hashlib.sha256(), b"", np.zeros(256, np.int64), 0
        for batch in batches:
            out = []
            for doc_id, n_bytes, media_bytes, media_sha, of, page, pixels, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "pages", "page", "pixels", "error")), strict=True):
                if error is not None:
                    raise ValueError(f"document {doc_id}: {error}")
                sha.update(pixels)
                tail, size = pixels[-32:], size + len(pixels)
                counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                if page == of - 1:
                    out.append((doc_id, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha, features(counts, of)))
                    sha, tail, counts, size = hashlib.sha256(), b"", np.zeros(256, np.int64), 0
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "pages", "page", "pixels", "error").mapInArrow(fold, _DIGEST)
