"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits the vectors by one random direction a level, at the median of
a bounded sample in each node.  A query walks all trees through one priority
queue: the closest unopened branch of any tree is next, a branch's priority
being the squared distance by which the query misses it.  Every vector of the
leaves it reaches is ranked by its exact cosine.

Equal vectors are one entry of the index with its least ids (no more than can
appear in an answer), so a very common vector is no large leaf; queries with
equal vectors are searched once.

Fitted on at most MOST_SAMPLE vectors; every vector is indexed.  Defined cases:
null, empty, zero vectors, vectors with null or non-finite components, with a
null id, or of another length than most, take no part; rows that share an id
and a vector are one; with fewer candidates than k all are returned; an empty
table gives an empty table; other columns are not looked at, whatever their
names; ids and components of other number types are cast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from spanweave.llm.common import materialise

#: Vectors that the forest is fitted on: a SHARE of all, within these bounds,
#: so that trees grow deeper with the index and leaves stay small.
SHARE, SAMPLE, MOST_SAMPLE = 0.02, 20_000, 200_000
TREES, LEAF = 8, 100
#: Queries that are also answered exactly, to set how many leaves a query
#: opens, and the share of their nearest neighbours that must be found.
CALIBRATION, RECALL = 128, 0.98
#: Index entries of a unit of work, about.
UNIT = 40_000


class Forest:
    """Directions (trees, levels, dims) and a threshold for each node."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        most = int(math.log2(max(1, len(sample) / 4))) if len(sample) else 0
        self.levels = max(0, min(most, math.ceil(math.log2(max(1.0, n / leaf)))))
        dims = sample.shape[1]
        self.trees = trees if self.levels else 1
        axis = rng.standard_normal((self.trees, self.levels, dims))
        self.axis = axis / np.linalg.norm(axis, axis=2, keepdims=True) if self.levels else axis
        self.cut = np.zeros((self.trees, (1 << self.levels) - 1))
        unit = self.unit(sample)
        for t in range(self.trees):
            node = np.zeros(len(unit), np.int64)
            for d in range(self.levels):
                at = unit @ self.axis[t, d]
                order = np.lexsort((at, node))
                first = (1 << d) - 1
                size = np.bincount(node - first, minlength=1 << d)
                start = np.cumsum(size) - size
                middle = at[order[np.minimum(start + size // 2, len(order) - 1)]]
                self.cut[t, first : first + (1 << d)] = np.where(size > 0, middle, 0.0)
                node = 2 * node + 1 + (at >= self.cut[t][node])

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector in each tree, from 0."""
        out = np.zeros((len(x), self.trees), np.int64)
        unit = self.unit(x)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for d in range(self.levels):
                node = 2 * node + 1 + (unit @ self.axis[t, d] >= self.cut[t][node])
            out[:, t] = node - ((1 << self.levels) - 1)
        return out

    def order(self, x: np.ndarray) -> np.ndarray:
        """(trees, leaves): the place of each leaf in the order of ``search``."""
        side = self.axis @ (x / np.linalg.norm(x))
        miss = np.zeros((self.trees, 1))
        for d in range(self.levels):
            gap = side[:, d, None] - self.cut[:, (1 << d) - 1 : (2 << d) - 1]
            both = np.stack([miss + np.where(gap >= 0, gap * gap, 0), miss + np.where(gap >= 0, 0, gap * gap)], axis=2)
            miss = both.reshape(self.trees, -1)
        place = np.empty(miss.size, np.int64)
        place[np.argsort(miss, axis=None, kind="stable")] = np.arange(miss.size)
        return place.reshape(miss.shape)

    def search(self, x: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one query opens, the closest first."""
        side = self.axis @ (x / np.linalg.norm(x))  # (trees, levels)
        inner = (1 << self.levels) - 1
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        out = []
        while queue and len(out) < probes:
            miss, t, node, d = heapq.heappop(queue)
            cut, along = self.cut[t], side[t]
            while node < inner:
                gap = along[d] - cut[node]
                near = 2 * node + (2 if gap >= 0 else 1)
                heapq.heappush(queue, (miss + gap * gap, t, 4 * node + 3 - near, d + 1))
                node, d = near, d + 1
            out.append((t, node - inner))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec: the distinct rows that take part."""
    single = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    vec = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = v.where(~F.exists("vec", bad)).where(F.exists("vec", lambda x: x != 0))
    usual = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("vec") == (usual[0]["n"] if usual else 0))


def _entries(forest, units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = f.leaves(_matrix(batch.column(1)))
            rows = np.repeat(np.arange(batch.num_rows), f.trees)
            whole = batch.take(pa.array(rows))
            tree = np.tile(np.arange(f.trees), batch.num_rows)
            unit = _units(tree, leaf.ravel(), units)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(tree, pa.int32()), pa.array(leaf.ravel()), whole.column(0), whole.column(1)], names=["unit", "tree", "leaf", "cid", "vec"])

    return run


def _units(tree: np.ndarray, leaf: np.ndarray, units: int) -> np.ndarray:
    """The unit of work of each leaf."""
    with np.errstate(over="ignore"):
        h = (tree.astype(np.uint64) << np.uint64(40)) + leaf.astype(np.uint64)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((h >> np.uint64(11)) % np.uint64(units)).astype(np.int64)


def _probes(forest, probes: int, units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        for batch in batches:
            rows, unit, trees, leaves = [], [], [], []
            for r, x in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                pairs = np.array(f.search(x, probes), np.int64)
                own = _units(pairs[:, 0], pairs[:, 1], units)
                for u in np.unique(own):
                    rows.append(r)
                    unit.append(u)
                    trees.append(pairs[own == u, 0].astype(np.int32))
                    leaves.append(pairs[own == u, 1])
            whole = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit, pa.int64()), whole.column(0), whole.column(1), pa.array(trees, pa.list_(pa.int32())), pa.array(leaves, pa.list_(pa.int64()))], names=["unit", "cid", "vec", "tree", "leaf"]
            )

    return run


def _best(qcid: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different entries of each query."""
    o = np.lexsort((cid, -score, qcid))
    qcid, cid, score = qcid[o], cid[o], score[o]
    _, first = np.unique(np.stack([qcid, cid]), axis=1, return_index=True)
    first.sort()
    qcid, cid, score = qcid[first], cid[first], score[first]
    start = np.flatnonzero(np.append(True, qcid[1:] != qcid[:-1])) if len(qcid) else np.zeros(0, np.int64)
    place = np.arange(len(qcid)) - np.repeat(start, np.diff(np.append(start, len(qcid))))
    return qcid[place < k], cid[place < k], score[place < k]


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with each of c, in double precision; a pair's
    value does not depend on the rows around it."""
    norm = np.sqrt(np.einsum("id,id->i", q, q))[:, None] * np.sqrt(np.einsum("jd,jd->j", c, c))
    return np.einsum("id,jd->ij", q, c) / norm


def _scored(q: np.ndarray, qids: np.ndarray, c: np.ndarray, cids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries nearest to each query, block by block."""
    out = []
    for a in range(0, len(q), 256):
        for b in range(0, len(c), 4096):
            s, ids = cosines(q[a : a + 256], c[b : b + 4096]), cids[b : b + 4096]
            if s.shape[1] > k:  # all that tie with the k-th stay for now
                keep = s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            else:
                keep = np.ones(s.shape, bool)
            i, j = np.nonzero(keep)
            out.append(_best(qids[a : a + 256][i], ids[j], s[i, j], k))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)


def _rank(k: int):
    """Within a unit: the ``k`` entries nearest to each query."""

    def run(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(entries):
            groups = entries.groupby(["tree", "leaf"], sort=False).indices
            ids, vecs = entries["cid"].to_numpy(), np.stack(entries["vec"].to_numpy()).astype(np.float64)
            qids, qvecs = queries["cid"].to_numpy(), np.stack(queries["vec"].to_numpy()).astype(np.float64)
            asks: dict[tuple[int, int], list[int]] = {}
            for r, (trees, leaves) in enumerate(zip(queries["tree"], queries["leaf"], strict=True)):
                for at in zip(trees.tolist(), leaves.tolist(), strict=True):
                    asks.setdefault(at, []).append(r)
            for at, rows in asks.items():
                here = groups.get(at)
                if here is not None:
                    out.append(_scored(qvecs[rows], qids[rows], vecs[here], ids[here], k))
        best = _best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)
        return pd.DataFrame(dict(zip(("qcid", "cid", "score"), best, strict=True)))

    return run


def _exact(queries, k: int):
    """The ``k`` entries of each partition nearest to each query sent along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qids = queries.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            if batch.num_rows:
                found.append(_scored(q, qids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k))
                found = [_best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["qcid", "cid", "score"])

    return run


def exact(classes: DataFrame, queries: np.ndarray, qids: np.ndarray, k: int) -> DataFrame:
    """qcid, cid, score of the ``k`` nearest entries, by brute force; for a
    bounded number of queries."""
    sent = classes.sparkSession.sparkContext.broadcast((queries, qids))
    found = classes.select("cid", "vec").mapInArrow(_exact(sent, k), "qcid long, cid long, score double")
    best = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def leaves_to_open(classes: DataFrame, forest: Forest, k: int, recall: float = RECALL) -> int:
    """How many leaves a query must open to find ``recall`` of its ``k``
    nearest: measured on CALIBRATION entries against all entries."""
    few = classes.orderBy(F.xxhash64(F.lit(66), "cid")).select("cid", "vec").limit(CALIBRATION).toArrow()
    q, qids = _matrix(few["vec"]), few["cid"].to_numpy()
    true = exact(classes, q, qids, k + 1).join(classes.select("cid", "vec"), "cid").select("qcid", "cid", "vec").toArrow()
    leaf = forest.leaves(_matrix(true["vec"]))
    order = {int(i): forest.order(x) for i, x in zip(qids, q, strict=True)}
    place = [order[int(i)][np.arange(forest.trees), row].min() for i, c, row in zip(true["qcid"].to_numpy(), true["cid"].to_numpy(), leaf, strict=True) if i != c]
    return int(np.quantile(place, recall, method="higher")) + 1 if place else 1


def nearest(vectors: DataFrame, is_query, k: int = 5, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each row
    of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors).distinct(), "vectors")
    # one entry for equal vectors, with its k + 1 least ids
    mine = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(mine)).where(F.col("_n") <= k + 1)
    classes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialise(classes.select(F.element_at("ids", 1).alias("cid"), "vec", "ids"), "classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64(F.lit(6), "cid")).select("vec").limit(min(MOST_SAMPLE, max(SAMPLE, int(SHARE * n)))).toArrow()["vec"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(_matrix(sample), n, trees, leaf)
    sent = spark.sparkContext.broadcast(forest)
    asked = rows.where(is_query(F.col("vec_id"))).join(classes.select("cid", "vec"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid"))
    asked = materialise(asked, "asked")
    asking = classes.join(asked.select(F.col("qcid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "vec")
    probes = leaves_to_open(classes, forest, k, recall)
    units = max(1, -(-n * forest.trees // UNIT))
    vec = classes.schema["vec"].dataType.simpleString()
    entries = classes.select("cid", "vec").mapInArrow(_entries(sent, units), f"unit long, tree int, leaf long, cid long, vec {vec}")
    opened = asking.mapInArrow(_probes(sent, probes, units), f"unit long, cid long, vec {vec}, tree array<int>, leaf array<bigint>")
    found = opened.groupBy("unit").cogroup(entries.groupBy("unit")).applyInPandas(_rank(k + 1), "qcid long, cid long, score double")
    found = found.groupBy("qcid", "cid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    best = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    best = best.join(classes.select("cid", "ids"), "cid").groupBy("qcid").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    each = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("vec_id")))))
    out = asked.join(best, "qcid").select("query_id", F.filter(each, lambda e: e["vec_id"] != F.col("query_id")).alias("c"))
    out = out.select("query_id", F.posexplode(F.slice(F.array_sort("c"), 1, k)).alias("p", "e"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
