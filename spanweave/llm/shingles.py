"""Near-duplicate groups by the Jaccard similarity of five-word shingles.

Two texts are linked if their sets of shingles have a similarity of 0.8 or
more, and a group is what links connect.  As for op5, fingerprints (SimHash, of
a set) are joined in a binary trie, and star contraction makes groups of links:

1. The trie joins fingerprints within ``BUDGET`` bits.  What it connects is a
   candidate group, and each of its texts is compared with one of them.
2. Pairs at 0.8 differ in about ten of 64 bits, a budget at which a trie drops
   hardly any pair.  So that no link is lost, texts also are candidates if they
   share one of ``BANDS`` bands of ``ROWS`` least hashes (a pair at 0.8 shares
   none with probability 5e-8, one above it less).  Bands and candidate groups
   whose texts the first step made one group are done; nodes that the others
   connect are one unit of work, in which each text comes once.  In a unit the
   texts of a band are tested until those left are one group, the texts of
   small groups first: a band of near copies costs one comparison a text, not
   one a pair.
3. Star contraction of the links of both steps.

Every link is confirmed on the whole shingle sets.  Texts of equal words are
one node.

Words: runs without ASCII white space, A-Z in lower case.  Fewer words than the
width: the whole sequence is one shingle.

Defined cases: texts without words (null, empty, blank) are one node, linked to
no other; of repeated rows one stays; an empty table gives an empty table; a
long text is hashed whole; columns of any other name are kept and do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from spanweave.llm import simhash
from spanweave.llm.common import byte_texts, materialise, release, unused
from spanweave.llm.components import components
from spanweave.llm.substrings import _mix, text_hashes, window_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Bits in which fingerprints that the trie joins differ, at most.
BUDGET = 4
#: Bands of a text, least hashes of a band, shingles that are hashed at once.
BANDS, ROWS, BLOCK = 32, 4, 1024

_A, _B = (np.random.default_rng(20_240_501).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles."""
    words = text_hashes(text.lower(), 0)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words))))


def fingerprint(found: np.ndarray) -> int | None:
    """64-bit SimHash of a set, as a signed number: a bit is 1 if set in over
    half the hashes.  None for an empty set."""
    if not len(found):
        return None
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 4096):
        part = np.ascontiguousarray(found[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(len(_A), np.iinfo(np.uint64).max)
    for i in range(0, len(found), BLOCK):
        np.minimum(least, ((found[None, i : i + BLOCK] ^ _B) * _A).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def node_of(text: bytes) -> int:
    """A 64-bit key of the words of a text."""
    return int.from_bytes(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=8).digest(), "little", signed=True)


def groups(sets: list[np.ndarray], buckets: list[list[int]], similarity: float = SIMILARITY, root: np.ndarray | None = None) -> np.ndarray:
    """The least member of each set's group; two sets are compared if a bucket
    has both and their groups are not one yet.  ``root``: groups to begin with."""
    size = np.array([len(s) for s in sets])
    root = np.arange(len(sets)) if root is None else root.copy()
    for bucket in buckets:
        left = np.array(bucket)
        while len(left) > 1:
            of = root[left]
            kinds, back, n = np.unique(of, return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                break
            pivot = left[np.argmin(n[back])]
            near = left[of != root[pivot]]
            near = near[np.minimum(size[near], size[pivot]) >= (similarity - 1e-9) * np.maximum(size[near], size[pivot])]
            if len(near):
                flat = np.concatenate([sets[x] for x in near])
                at = np.minimum(np.searchsorted(sets[pivot], flat), size[pivot] - 1)
                both = np.add.reduceat((sets[pivot][at] == flat).astype(np.int64), np.cumsum(size[near]) - size[near])
                hit = near[both >= similarity * (size[near] + size[pivot] - both) - 1e-9]
                if len(hit):
                    one = np.unique(root[np.append(hit, pivot)])
                    root[np.isin(root, one)] = one[0]
            left = left[left != pivot]
    return root


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(1))
            keys = [hashlib.blake2b(t, digest_size=16).hexdigest() for t in texts]
            fps, each = [], []
            for t in texts:
                found = shingles(t, width)
                fps.append(fingerprint(found))
                each.append(bands(found).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.string()),
                    pa.array([node_of(t) for t in texts], pa.int64()),
                    pa.array(fps, pa.int64()),
                    pa.array(each, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "node", "fp", "bands"],
            )
        release()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = byte_texts(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())], names=["node", "packed"])


def _confirmed(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pivot, of = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            hit = []
            for p, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if p != pivot:
                    pivot, of = p, shingles(unpack.decompress(b), width)
                hit.append(not groups([of, shingles(unpack.decompress(a), width)], [[0, 1]], similarity).any())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "root"]).filter(pa.array(hit, pa.bool_()))

    return run


def _unit(width: int, similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        pdf = pdf.sort_values("node")
        sets = [shingles(unpack.decompress(p), width) for p in pdf["packed"]]
        buckets: dict[tuple, list[int]] = {}
        for i, (found, tree) in enumerate(zip(sets, pdf["tree"].tolist(), strict=True)):
            for key in [("tree", tree), *(("band", k) for k in bands(found).tolist())]:
                buckets.setdefault(key, []).append(i)
        each = {tuple(b) for b in buckets.values() if len(b) > 1}  # many bands have the same texts
        nodes = pdf["node"].to_numpy()
        _, first, back = np.unique(pdf["label"].to_numpy(), return_index=True, return_inverse=True)
        root = groups(sets, [list(b) for b in sorted(each, key=lambda b: (-len(b), b))], similarity, first[back])
        return pd.DataFrame({"node": nodes, "root": nodes[root]})

    return run


def trees(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(node, bands, tree) of the nodes with words; tree is one fingerprint of
    those that the trie connects with the node's."""
    nodes = nodes.where("fp is not null")
    near = simhash.block_links(materialise(nodes.select("fp").distinct(), "fingerprints"), budget)
    near = materialise(components(near), "trees").withColumnRenamed("node", "fp")
    return nodes.join(near, "fp", "left").select("node", "bands", F.coalesce("root", "fp").alias("tree"))


def roots(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the nodes that have links; root is the group's least node."""
    keyed = materialise(trees(nodes), "keyed")
    each = keyed.select("node", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("tree"), F.col("tree").alias("of"))), F.transform("bands", lambda b: F.struct(F.lit(False).alias("tree"), b.alias("of"))))).alias("bucket"))
    each = each.select("node", F.col("bucket.tree").alias("is_tree"), F.col("bucket.of").alias("bucket"))
    on = ["is_tree", "bucket"]
    many = each.groupBy(*on).agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    many = materialise(many, "buckets")  # a table, so that a common band's rows can be split over tasks
    shared = materialise(each.join(many, on), "shared")
    packed = docs.select("text").mapInArrow(_packed, "node long, packed binary")
    # one text of a node before anything moves: partly in each task, then by node
    texts = packed.groupBy("node").agg(F.first("packed").alias("packed")).join(shared.select("node").distinct(), "node")
    texts = materialise(texts, "texts")
    # the trie's links: each node of a tree with the least one
    pairs = shared.where("is_tree and node != low").select("node", F.col("low").alias("pivot"))
    pairs = pairs.join(texts, "node").join(texts.select(F.col("node").alias("pivot"), F.col("packed").alias("other")), "pivot").select("node", "pivot", "packed", "other")
    first = materialise(pairs.mapInArrow(_confirmed(width, similarity), "node long, root long"), "tree_links")
    # the rest: buckets whose nodes are not one group yet
    label = shared.join(first, "node", "left").select("node", "low", *on, F.coalesce("root", "node").alias("label"))
    left = label.groupBy(*on).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").drop("a", "b")
    edges = shared.join(materialise(left, "left"), on).where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    coarse = materialise(components(edges), "units").withColumnRenamed("root", "unit")
    units = texts.join(coarse, "node").join(keyed.select("node", "tree"), "node").join(first, "node", "left")
    units = units.select("unit", "node", "tree", "packed", F.coalesce("root", "node").alias("label"))
    rest = units.groupBy("unit").applyInPandas(_unit(width, similarity), "node long, root long")
    links = first.union(rest.where("node != root"))
    return components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))


def _text_keys(at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(t, digest_size=16).hexdigest() for t in byte_texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*batch.schema.names, name])

    return run


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates.

    The row with the least (doc_id, text digest) stays, a null id last; of rows
    equal in both the first by all other columns, so that reruns agree.
    """
    prints = docs.select("doc_id", "text").mapInArrow(_prints(width), "doc_id long, text_key string, node long, fp long, bands array<long>")
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    prints = materialise(prints.withColumn("key", last), "shingles")
    nodes = materialise(prints.groupBy("node").agg(F.min("key").alias("own"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    linked = nodes.select("node", "own").join(materialise(roots(docs, nodes, width, similarity), "roots"), "node", "left")
    kept = linked.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("own").alias("least"))
    key, k_doc, k_text = unused(docs.columns, "_text_key", "_k_doc", "_k_text")
    kept = kept.select(F.col("least.doc_id").alias(k_doc), F.col("least.text_key").alias(k_text))
    keyed = docs.mapInArrow(_text_keys(docs.columns.index("text"), key), StructType([*docs.schema.fields, StructField(key, StringType())]))
    on = F.col("doc_id").eqNullSafe(F.col(k_doc)) & (F.col(key) == F.col(k_text))
    left = keyed.join(kept, on, "left_semi")
    # the text of equal rows is equal, so it need not be compared
    rest = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    (row,) = unused([*docs.columns, key], "_row")
    left = left.groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), F.struct(*rest)).alias(row)) if rest else left.groupBy("doc_id", key).agg(F.first(F.struct(*docs.columns)).alias(row))
    return left.select(f"{row}.*")
