"""The media that the query stores pass through the row filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from spanweave.llm import media


def _hash(image: np.ndarray) -> str:
    """The feature by its definition: averaged cells, cosines, medians."""
    def area(n):
        return np.array([[max(0.0, min((k + 1) * n / 32, i + 1) - max(k * n / 32, i)) * 32 / n for i in range(n)] for k in range(32)])

    cells = area(image.shape[0]) @ image.astype(float) @ area(image.shape[1]).T
    cosine = np.array([[np.cos(np.pi * (2 * x + 1) * k / 64) * np.sqrt((1 if k == 0 else 2) / 32) for x in range(32)] for k in range(8)])
    low = np.round(cosine @ cells @ cosine.T, 6).ravel()
    return f"{int(''.join('1' if v > np.median(low) else '0' for v in low), 2):016x}"


def test_feature():
    rng = np.random.default_rng(2)
    for h in (1, 2, 31, 32, 33, 64, 100, 257):
        image = rng.integers(0, 256, (h, 64), np.uint8)
        assert media.cosine_hash(image) == _hash(image)


def test_mixed_filters():
    """Rows of all five filters in one image, against a pixel at a time."""
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 64), np.uint8)
    kinds = rng.integers(0, 5, 40)
    rows = np.stack([media._filtered(image, int(k))[y] for y, k in enumerate(kinds)])
    assert (media._unfiltered(kinds, rows) == image).all()


def test_stored_media_are_filtered(monkeypatch):
    texts = ["", "a", "naïve ß " * 40, "word " * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    kinds, unfiltered = [], media._unfiltered
    monkeypatch.setattr(media, "_unfiltered", lambda k, rows: kinds.append(k.tolist()) or unfiltered(k, rows))
    (stored,) = media._encode([batch])
    for text, n, png in zip(texts, stored.column(1).to_pylist(), stored.column(2).to_pylist(), strict=True):
        raw = text.encode()
        assert n == len(raw)
        assert np.ascontiguousarray(media.decode_png(png)).tobytes() == raw.ljust(max(1, -(-n // media.WIDTH)) * media.WIDTH, b"\0")
    assert all(set(k) == {media.SUB} for k in kinds) and len(kinds) == len(texts)
