"""Lossless 8-bit PNG media columns and low-frequency cosine hashes.

Written and read without an image library: PNG chunks with CRC-32 tests, zlib
streams with their Adler-32 test, and numpy row filters (all five are read).
The feature is a perceptual hash: the image is averaged to 32 x 32, the 8 x 8
lowest cosine coefficients are taken, and each gives one bit, set if above
their median.

Defined cases: a null text counts as empty; an empty payload is padded to one
row of zeros; equal texts, repeated rows among them, give equal values and a row
each; an empty table gives an empty table; columns other than doc_id and text
are not looked at, whatever their names.  A long text needs memory of a few
times its size, one image at a time; the feature is summed band by band.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import materialise, utf8_spans

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Row filter of the stored media: each byte less the one before it, which packs
#: text best of the four that change anything.
SUB = 1
#: Bytes of an IDAT chunk at most.
IDAT = 1 << 16


class BadMedia(ValueError):
    """The stored bytes are not a PNG that this reader takes."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """Rows filtered by one PNG filter type (8-bit gray: one byte a pixel)."""
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up = np.zeros_like(image)
    up[1:] = image[:-1]
    if kind == 0:
        return image
    if kind == 1:
        return image - left
    if kind == 2:
        return image - up
    if kind == 3:
        return image - ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    return image - _paeth(left, up, corner)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def encode_png(image: np.ndarray, kind: int = 0, level: int = 1) -> bytes:
    """PNG of a (rows, columns) uint8 array; ``kind`` is the row filter."""
    h, w = image.shape
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = _filtered(image, kind)
    packed = zlib.compress(rows.data, level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def decode_png(stored: bytes) -> np.ndarray:
    """The (rows, columns) uint8 array of an 8-bit gray PNG.

    Raises BadMedia where a signature, length, CRC-32, Adler-32, size or
    filter is wrong.
    """
    view = memoryview(stored).cast("B")
    if view[:8] != SIGNATURE:
        raise BadMedia("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(view):
            raise BadMedia("cut short")
        (n,) = struct.unpack_from(">I", view, at)
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + n]
        if at + 12 + n > len(view):
            raise BadMedia("cut short")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", view, at + 8 + n)[0]:
            raise BadMedia(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise BadMedia("not an 8-bit gray image without interlace")
    w, h = head[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if len(raw) != h * (w + 1):
        raise BadMedia("size of the image data")
    rows = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
    return _unfiltered(rows[:, 0], rows[:, 1:])


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if not kinds.any():
        return rows
    if (kinds == 2).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    if (kinds == 1).all():
        return np.cumsum(rows, axis=1, dtype=np.uint8)
    if (kinds > 4).any():
        raise BadMedia(f"row filter {int(kinds.max())}")
    # each pixel needs the one before it, the one above and the corner, so the
    # pixels of a diagonal (column + row) are done together
    h, w = rows.shape
    done = np.zeros((h + 1, w + 1), np.int16)  # a row above and a column before, of zeros
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = done[y + 1, x], done[y, x + 1], done[y, x], kinds[y]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, _paeth(left, up, corner)], 0)
        done[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return done[1:, 1:].astype(np.uint8)


def _area(size: int, to: int) -> np.ndarray:
    """(to, size) weights that average ``size`` samples to ``to`` cells."""
    edge = np.arange(to + 1) * size / to
    low = np.maximum(edge[:-1, None], np.arange(size)[None])
    high = np.minimum(edge[1:, None], np.arange(1, size + 1)[None])
    return np.maximum(high - low, 0) * (to / size)


@lru_cache(maxsize=512)
def _basis(size: int, side: int = 32, keep: int = 8) -> np.ndarray:
    """(keep, size): averaging to ``side`` cells, then the lowest cosines."""
    k, x = np.arange(keep)[:, None], np.arange(side)[None]
    cosine = np.cos(np.pi * (2 * x + 1) * k / (2 * side)) * np.where(k == 0, np.sqrt(1 / side), np.sqrt(2 / side))
    return cosine @ _area(size, side)


def _cells(image: np.ndarray, side: int = 32) -> np.ndarray:
    """(side, columns): the rows averaged to ``side`` bands, without a copy of
    the image; a row that two bands share counts for each by its part."""
    h = len(image)
    edge = np.arange(side + 1) * h / side
    whole = np.minimum(edge.astype(np.int64), h - 1)
    total = np.add.reduceat(image, whole[:-1], axis=0, dtype=np.float64)
    total[whole[:-1] == whole[1:]] = 0  # no row ends in such a band
    if whole[-2] == whole[-1]:
        total[-1] = 0
    else:  # the last band goes to the end, its last row is added below
        total[-1] -= image[-1]
    part = (edge - whole)[:, None] * image[whole]
    return (total + part[1:] - part[:-1]) * (side / h)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: bit (u, v) is set if that coefficient is above the median."""
    low = np.round(_basis(32) @ _cells(image) @ _basis(image.shape[1]).T, 6).ravel()
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts, ends = utf8_spans(batch.column(1))
        media = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            rows = max(1, -(-(b - a) // WIDTH))
            image = np.zeros(rows * WIDTH, np.uint8)
            image[: b - a] = raw[a:b]
            media.append(encode_png(image.reshape(rows, WIDTH), SUB))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a gray PNG 64 pixels wide."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for stored in batch.column(2):
            stored = stored.as_buffer()
            image = np.ascontiguousarray(decode_png(stored))
            payload = image.data.cast("B")
            rows.append((image.size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), stored.size, hashlib.sha256(stored).hexdigest(), cosine_hash(image)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_features(media: DataFrame) -> DataFrame:
    """Decode each stored PNG, with its checksum tests, and describe it."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)


def store_and_describe(docs: DataFrame) -> DataFrame:
    """Store each text as media in a table of the shared folder, then read
    the stored bytes back and compute their features.  One row per input row."""
    return media_features(materialise(encode_media(docs), "media"))
