"""The pipeline's near-duplicate stage against all pairs' five-word Jaccard."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as cp
from spanweave.llm import shingles, simhash
from tests.llm import brute


def five(text: str | None) -> frozenset:
    w = brute.words(brute.lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def kept(rows: list[tuple]) -> Counter:
    """(doc_id, text) of the least row of each group."""
    keys = sorted({((r[0] is None, r[0] or 0), r[1] or "") for r in rows})
    sets, root = [five(t) for _, t in keys], list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return Counter(k for i, k in enumerate(keys) if find(i) == i)


def near_copies() -> list[tuple]:
    """Texts with 0 to 14 words changed, on both sides of the similarity, and a chain of steps."""
    rng, out = random.Random(5), []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 9, 60, 300]))]
        for changes in (0, 1, 2, 4, 6, 14):
            words = words.copy() if changes == 4 else words
            edited = words.copy()
            for at in rng.sample(range(len(words)), min(changes, len(words))):
                edited[at] = "changed"
            out.append((1000 * i + rng.randrange(1000), " ".join(edited), "en", "s"))
    step = [f"c{k}" for k in range(200)]
    for k in range(30):
        out.append((50_000 + k, " ".join(step), "en", "s"))
        step = step[5:] + [f"d{k}x{x}" for x in range(5)]
    return [(*r, len(r[1]), 0.5, "size", None, "p", 1) for r in out]


def test_stage(spark):
    rows = brute.rows() + near_copies()
    got = dict(cp.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, brute.COLUMNS), "unused").collect()
    want = kept(rows)
    assert Counter(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in got) == want
    assert len(want) < len(rows) - 100


def test_recall():
    """Pairs at a similarity just above 0.8 share a band."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 220, np.uint64)
        a, b = np.unique(x[:198]), np.unique(x[22:])
        assert np.intersect1d(shingles.bands(a), shingles.bands(b)).size


@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=12), min_size=2, max_size=14))
@settings(max_examples=150, deadline=None)
def test_groups_of_a_bucket(sets):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    got = shingles.groups([np.array(sorted(s), np.uint64) for s in sets], [list(range(len(sets)))])
    assert got.tolist() == root


def bit_groups(fps: list[int], budget: int) -> dict[int, int]:
    """fingerprint: least of those that steps of at most ``budget`` bits reach, over all pairs."""
    least = {f: f for f in fps}
    while True:
        now = {f: min(least[g] for g in fps if (f ^ g).bit_count() <= budget) for f in fps}
        if now == least:
            return now
        least = now


@given(st.sets(st.integers(0, 30), max_size=30))
@settings(max_examples=50, deadline=None)
def test_fingerprint(found):
    hashes = [x * 0x9E3779B97F4A7C15 % 2**64 for x in found]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))
    got = shingles.fingerprint(np.array(sorted(hashes), np.uint64))
    assert got is None if not found else got % 2**64 == want


def test_block_links(spark, monkeypatch):
    """The trie join over many blocks, walked in parts, against all pairs."""
    monkeypatch.setattr(simhash, "SUBTREE", 20)
    monkeypatch.setattr(simhash, "COPIES", 30)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    keys = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(4)}
    rows = [(k - (k >> 63 << 64),) for k in keys]
    pairs = simhash.block_links(spark.createDataFrame(rows, "fp long"), shingles.BUDGET).collect()
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        x, y = sorted((find(r.u % 2**64), find(r.v % 2**64)))
        root[y] = x
    assert {k: find(k) for k in keys} == bit_groups(sorted(keys), shingles.BUDGET)


def test_walk_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "PART", 10)
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 12, 400, np.uint64) << np.uint64(50) | rng.integers(0, 4, 400, np.uint64))
    for a, b in ((keys, None), (keys[::2], keys[1::2])):
        got = Counter((int(x), int(y)) for u, v in simhash.walk(a, b, 0, 0, 4) for x, y in zip(u, v, strict=True))
        other = a if b is None else b
        assert got == Counter((int(x), int(y)) for x in a for y in other if (int(x) ^ int(y)).bit_count() <= 4 and (b is not None or x < y))


def test_trie_links_near_copies(spark):
    """The trie alone, without bands, links what is within its budget."""
    rng, rows = random.Random(6), []
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(3):
            rows.append((10 * i + k, " ".join(words)))
            words[rng.randrange(400)] = "changed"
    node = {shingles.node_of(t.encode()): shingles.shingles(t.encode()) for _, t in rows}
    fps = {n: shingles.fingerprint(s) % 2**64 for n, s in node.items()}
    nodes = spark.createDataFrame([(n, f - (f >> 63 << 64), []) for n, f in fps.items()], "node long, fp long, bands array<long>")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = bit_groups(sorted(set(fps.values())), shingles.BUDGET)
    want = defaultdict(set)
    for n, f in fps.items():
        want[of[f]].add(n)
    got = defaultdict(set)
    for r in shingles.roots(docs, nodes).collect():
        got[r.root].add(r.node)
    # near copies of 400 words with one or two words changed are at 0.95 or more
    assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)
    assert len(got) >= 20
