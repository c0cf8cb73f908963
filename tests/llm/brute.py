"""Brute-force versions of the contracts, on lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, key string, path string, at int"

_PASSAGE = " ".join(f"shared{i}" for i in range(60))
#: Nulls, empty, blank, very long, odd characters, ties and repeated rows.
EDGE = [
    (900001, None, "en", "s1"),
    (900002, "", None, "s1"),
    (900003, "  \t\n ", "en", None),
    (900004, "12 34 !? 56", "en", "s2"),
    (900005, "one", "en", "s2"),
    (900006, "One two", "en", "s2"),
    (None, "a row without an id, " + _PASSAGE, "en", "s3"),
    (900007, _PASSAGE + " tail of the first", "en", "s3"),
    (900008, "head " + _PASSAGE, None, None),
    (900008, "head " + _PASSAGE, None, None),
    (900009, "word " * 60_000, "en", "s1"),
    (900010, "x" * 30_000, "en", "s1"),
    (900011, "  two  spaces <|endoftext|> and▁marks ▁▁ here nbsp em \U0001f600 café ǅ <unk> </s> <0x41>", "en", "s4"),
    (900012, "nul\x00 byte\x1f and​ zero width ﻿ é\r\n\r\n  done   ", "en", "s4"),
    (900013, "Ça va très bien, merci. 中文 テキスト العربية हिन्दी", "fr", "s4"),
    (900014, "abc　def １２３ ﬁ ½ ①", "fr", "s4"),
    (900015, "don't you'll they've I'M IT'S 1234567890 a1b2c3 __init__ ...!!!???", "en", "s5"),
]


def rows() -> list[tuple]:
    """sf0.001 with the edge rows and columns of clashing names."""
    some = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in some] + EDGE
    return [(d, t, lang, s, None if t is None else len(t), 0.5, "size", None, "p", 1) for d, t, lang, s in out]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None) -> int:
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs: list[tuple]) -> dict[int, tuple[str, int]]:
    """doc_id: (fingerprint, component); ids must be distinct and not null."""
    fp = {d: fingerprint(t) for d, t in docs}
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def spans(docs: list[tuple], window: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) for each row; a null id is
    larger than all."""
    least: dict[tuple, float] = defaultdict(lambda: float("inf"))
    split = [(float("inf") if d is None else d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least[k], d)
    out = []
    for (d, _), (order, w) in zip(docs, split, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order:
                gone[i : i + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), sha(kept)))
    return out


def media(text: str | None) -> tuple[int, int, str, int]:
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    return len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:])


def neighbours(vectors: dict[int, list[float]], k: int = 5) -> dict[int, list[tuple[int, float]]]:
    ok = {i: np.array(v, np.float64) for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        near = sorted((-float(ok[q] @ v / (np.linalg.norm(ok[q]) * np.linalg.norm(v))), i) for i, v in ok.items() if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), share=1.5, cap=2.0) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return out


def temporary(path: Path, name: str, table) -> str:
    """A folder with one table, as queries read it."""
    path.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path / f"{name}.parquet")
    return str(path)
