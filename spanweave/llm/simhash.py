"""SimHash fingerprints and near-duplicate groups by a binary-trie self-join.

Fingerprints are the leaves of a binary trie.  The join walks pairs of nodes
of one depth together, adds up the bits in which their paths differ and drops
a pair as soon as that exceeds the budget; what is left at the leaves are the
links.  The trie is cut below its top bits (the most balanced ones), and every
pair of subtrees that is within the budget is one unit of distributed work, so
no unit holds more than two subtrees.  The top bits are those that cut a sample
of PLAN fingerprints into the most even parts together; which bits they are
changes the work, never the links.  Equal fingerprints are one leaf, and a
unit returns a spanning forest of its links, never all pairs of a group.

Defined cases: a text without words (null, empty, blank) has fingerprint zero
and links like any other; rows with equal text or repeated rows share a
fingerprint; a null doc_id takes part, but is the component's id only if no
member has an id; an empty table gives an empty table; a long text is hashed
whole; columns other than doc_id and text are not looked at, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import byte_texts, materialise, release
from spanweave.llm.components import components

#: Fingerprints of a subtree on average, and leaves that are compared outright.
SUBTREE, LEAF = 16_000, 8
#: Fingerprints by which the top bits are chosen.
PLAN = 20_000
#: Blocks that a block of ``block_links`` is compared with, at most, and
#: fingerprints of a part of a block whose nodes are walked level by level.
COPIES, PART = 128, 4096


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included.

    Words: runs without ASCII white space, A-Z in lower case.  Fewer words
    than ``width``: the whole sequence is one shingle.  No words: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.dtype("<u8"), n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in byte_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        release()

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


# --- the trie -----------------------------------------------------------------


class _Trie:
    """Nodes of a sorted array of distinct numbers below the first ``top`` bits."""

    def __init__(self, keys: np.ndarray, top: int) -> None:
        self.keys = keys
        self.low, self.high = [np.array([0])], [np.array([len(keys)])]
        self.zero: list[np.ndarray] = []
        self.one: list[np.ndarray] = []
        for bit in range(63 - top, -1, -1):
            low, high = self.low[-1], self.high[-1]
            inner = high - low > LEAF
            if not inner.any():
                break
            step = np.uint64(1) << np.uint64(bit)
            cut = np.searchsorted(keys, (keys[low] >> np.uint64(bit + 1) << np.uint64(bit + 1)) | step)
            cut = np.clip(cut, low, high)
            has0, has1 = inner & (cut > low), inner & (cut < high)
            zero, one = np.full(len(low), -1), np.full(len(low), -1)
            zero[has0] = np.arange(has0.sum())
            one[has1] = has0.sum() + np.arange(has1.sum())
            self.zero.append(zero)
            self.one.append(one)
            self.low.append(np.concatenate([low[has0], cut[has1]]))
            self.high.append(np.concatenate([cut[has0], high[has1]]))


def trie_links(a: np.ndarray, b: np.ndarray | None, top: int, apart: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``budget`` differing bits: of ``a`` with ``b``, or, where b
    is None, within ``a``.  Both sorted, distinct, each with one ``top``-bit
    prefix; the prefixes differ in ``apart`` bits."""
    ta = _Trie(a, top)
    tb = ta if b is None else _Trie(b, top)
    keys_b = tb.keys
    same = b is None
    i, j, far = np.array([0]), np.array([0]), np.array([apart])
    left, right = [], []

    def compare(level: int, i: np.ndarray, j: np.ndarray) -> None:
        al, bl = ta.low[level][i], tb.low[level][j]
        na, nb = ta.high[level][i] - al, tb.high[level][j] - bl
        size = na * nb
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + 2_000_000, side="right")))
            n = size[at:to]
            row = np.repeat(np.arange(at, to), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = al[row] + k // nb[row], bl[row] + k % nb[row]
            ok = np.bitwise_count(ta.keys[x] ^ keys_b[y]) <= budget
            if same:
                ok &= x < y
            left.append(ta.keys[x[ok]])
            right.append(keys_b[y[ok]])
            at = to

    for level in range(64 - top + 1):
        if not len(i):
            break
        size_a = ta.high[level][i] - ta.low[level][i]
        size_b = tb.high[level][j] - tb.low[level][j]
        leaf = (size_a <= LEAF) | (size_b <= LEAF)
        compare(level, i[leaf], j[leaf])
        i, j, far = i[~leaf], j[~leaf], far[~leaf]
        if not len(i):
            break
        a0, a1, b0, b1 = ta.zero[level][i], ta.one[level][i], tb.zero[level][j], tb.one[level][j]
        parts = [(a0, b0, far), (a1, b1, far), (a0, b1, far + 1), (a1, b0, far + 1)]
        if same:  # a node with itself: one of its two mixed pairs is enough
            parts[3] = (np.where(i == j, -1, a1), b0, far + 1)
        i, j, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (i >= 0) & (j >= 0) & (far <= budget)
        i, j, far = i[keep], j[keep], far[keep]
    if not left:
        none = np.zeros(0, np.uint64)
        return none, none
    return np.concatenate(left), np.concatenate(right)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components: (node, least node), loops left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], least)
        np.minimum.at(root, before[y], least)
        root = root[root]
        if (root == before).all() and (root[x] == root[y]).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _swap(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit order[0] becomes the highest bit, order[1] the next, and so on."""
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(order):
        out |= (fps >> np.uint64(bit) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _even_bits(fps: np.ndarray, top: int) -> list[int]:
    """All bits, first ``top`` that part the fingerprints most evenly together,
    one by one: that with the least sum of squared part sizes is next."""
    part, chosen = np.zeros(len(fps), np.int64), []
    for _ in range(top):
        best = None
        for bit in (b for b in range(64) if b not in chosen):
            both = part * 2 + (fps >> np.uint64(bit) & np.uint64(1)).astype(np.int64)
            size = np.bincount(np.unique(both, return_inverse=True)[1]) if len(fps) else np.zeros(0)
            cost = float((size.astype(np.float64) ** 2).sum())
            if best is None or cost < best[0]:
                best = (cost, bit, both)
        chosen.append(best[1])
        part = np.unique(best[2], return_inverse=True)[1] if len(fps) else part
    return chosen + [b for b in range(64) if b not in chosen]


def links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """(u, v): a forest whose components are those of all links between the
    distinct fingerprints ``fp`` that differ in at most ``budget`` bits."""
    n = distinct.count()
    top = min(24, max(1, math.ceil(math.log2(max(2, n / SUBTREE)))))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(PLAN).select("fp").collect()
    order = _even_bits(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), top)
    prefix = F.lit(0)
    for k in order[:top]:
        prefix = prefix * 2 + F.getbit("fp", F.lit(k)).cast("int")
    masks = [sum(1 << k for k in c) for m in range(min(budget, top) + 1) for c in combinations(range(top), m)]
    units = distinct.select("fp", prefix.alias("p")).select("fp", "p", F.explode(F.array(*[F.lit(m) for m in masks])).alias("m"))
    units = units.select("fp", "p", F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("x"), F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("y"))

    def unit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(key[0]), int(key[1])
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        side = pdf["p"].to_numpy() == x
        a = fps[side]
        swapped = np.sort(_swap(a, order))
        if x == y:
            u, v = trie_links(swapped, None, top, 0, budget)
        elif side.all() or not side.any():
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        else:
            u, v = trie_links(swapped, np.sort(_swap(fps[~side], order)), top, (x ^ y).bit_count(), budget)
        u, v = spanning(u, v)
        back = [0] * 64  # the inverse order
        for k, bit in enumerate(order):
            back[63 - bit] = 63 - k
        return pd.DataFrame({"u": _swap(u, back).view(np.int64), "v": _swap(v, back).view(np.int64)})

    return units.groupBy("x", "y").applyInPandas(unit, "u long, v long")


def walk(a: np.ndarray, b: np.ndarray | None, top: int, apart: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``trie_links`` in parts of ``PART`` fingerprints: the upper nodes are
    walked depth first, so that memory does not grow with the block."""
    if top == 64 or max(len(a), 0 if b is None else len(b)) <= PART:
        yield trie_links(a, b, top, apart, budget)
        return
    bit = np.uint64(63 - top)
    a0, a1 = np.split(a, [int((a >> bit & np.uint64(1)).argmax()) if a[-1] >> bit & np.uint64(1) else len(a)])
    if b is None:
        parts = [(a0, None, apart), (a1, None, apart), (a0, a1, apart + 1)]
    else:
        b0, b1 = np.split(b, [int((b >> bit & np.uint64(1)).argmax()) if b[-1] >> bit & np.uint64(1) else len(b)])
        parts = [(a0, b0, apart), (a1, b1, apart), (a0, b1, apart + 1), (a1, b0, apart + 1)]
    for x, y, far in parts:
        if far <= budget and len(x) and (y is None or len(y)):
            yield from walk(x, y, top + 1, far, budget)


def block_links(distinct: DataFrame, budget: int) -> DataFrame:
    """``links`` for a wider budget.  The fingerprints of a prefix move as one
    sorted array, eight bytes a copy, and a block goes to ``COPIES`` pairs of
    blocks at most: fewer top bits make larger blocks, and leave out nothing."""
    n = distinct.count()
    top = min(24, max(1, math.ceil(math.log2(max(2, n / SUBTREE)))))
    while top > 1 and sum(math.comb(top, m) for m in range(min(budget, top) + 1)) > COPIES:
        top -= 1
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(PLAN).select("fp").collect()
    order = _even_bits(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), top)
    back = [0] * 64  # the inverse order
    for k, bit in enumerate(order):
        back[63 - bit] = 63 - k
    prefix = F.lit(0)
    for k in order[:top]:
        prefix = prefix * 2 + F.getbit("fp", F.lit(k)).cast("int")
    masks = [sum(1 << k for k in c) for m in range(min(budget, top) + 1) for c in combinations(range(top), m)]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(_swap(pdf["fp"].to_numpy(np.int64).view(np.uint64), order))
        return pd.DataFrame({"p": [int(key[0])], "fps": [fps.astype("<u8").tobytes()]})

    def unit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(key[0]), int(key[1])
        blocks = {p: np.frombuffer(fps, "<u8") for p, fps in zip(pdf["p"], pdf["fps"], strict=True)}
        found = []
        if x == y or len(blocks) == 2:
            found = [spanning(u, v) for u, v in walk(blocks[x], None if x == y else blocks[y], top, (x ^ y).bit_count(), budget) if len(u)]
        none = [np.zeros(0, np.uint64)]
        u, v = spanning(np.concatenate([u for u, _ in found] or none), np.concatenate([v for _, v in found] or none))
        return pd.DataFrame({"u": _swap(u, back).view(np.int64), "v": _swap(v, back).view(np.int64)})

    blocks = materialise(distinct.select("fp", prefix.alias("p")).groupBy("p").applyInPandas(pack, "p int, fps binary"), "blocks")
    units = blocks.select("p", "fps", F.explode(F.array(*[F.lit(m) for m in masks])).alias("m"))
    units = units.select("p", "fps", F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("x"), F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("y"))
    # so many parts that small blocks are not put together in a few tasks
    return units.repartition(min(2048, len(masks) << top), "x", "y").groupBy("x", "y").applyInPandas(unit, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row.

    component_id is the smallest doc_id reachable over links.
    """
    prints = materialise(fingerprints(docs, width), "fingerprints")
    return _with_components(prints, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _with_components(prints: DataFrame, budget: int) -> DataFrame:
    """prints (fp and doc_id) with ``least``, the least doc_id of the component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("own")), "distinct")
    roots = materialise(components(links(distinct.select("fp"), budget)), "roots").select(F.col("node").alias("fp"), "root")
    linked = distinct.join(roots, "fp")
    least = materialise(linked.groupBy("root").agg(F.min("own").alias("all")), "least")  # a table, as ``whole`` below
    whole = distinct.join(linked.join(least, "root").select("fp", "all"), "fp", "left").select("fp", F.coalesce("all", "own").alias("least"))
    whole = materialise(whole, "groups")  # a table, so that the rows of one fingerprint can be split over tasks
    return prints.join(whole, "fp")
