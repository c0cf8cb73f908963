"""Level-synchronous reachability.

One loop serves any number of starts: every row carries the query it belongs
to.  A level is one join with the edges, one distinct and one anti join
with what has been visited, written to the shared folder, so the plan of a
level never holds the levels before it.  Edges are read as they are: only those
whose near end lies between the least and the greatest id of the frontier take
part, so most are passed over before anything moves.  A frontier that is small
is sent to the edges by the optimizer, from the size of its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.model import Graph, TraversalQuery
from spanweave.tables import stored, stored_ranged


@dataclass
class Subgraph:
    """reach: qid, id, depth; edges: qid and the edges that were traversed;
    seen: reach before utility nodes were taken out."""

    nodes: DataFrame
    edges: DataFrame
    reach: DataFrame
    seen: DataFrame


def _step(graph: Graph, frontier: DataFrame, low: str, high: str, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The frontier (at, ...), whose ids ``at`` lie from ``low`` to ``high``, with the
    far ends ``dst`` of its edges; a pair may repeat and a far end be no node."""
    e = graph.edges if kinds is None else graph.edges.where(F.col("kind").isin(*kinds))
    src, dst = ("fromId", "toId") if direction == "Forward" else ("toId", "fromId")
    adjacent = e.where(F.col(src).between(low, high)).select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return frontier.join(adjacent, F.col("at") == F.col("src"))


def _existing(graph: Graph, rows: DataFrame) -> DataFrame:
    """The rows (id, ...) whose node exists.  An inner join, which can send few
    rows to all nodes, where a semi join would move the nodes."""
    return rows.join(graph.nodes.select("id"), "id").select(*rows.columns)


def reach(graph: Graph, starts: DataFrame, direction: str = "Forward", max_depth: int = 20, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """qid, id, depth (fewest hops) of all nodes within ``max_depth`` of the
    starts (qid, id).  An unknown start reaches nothing."""
    seeds = _existing(graph, starts.select("qid", "id").distinct()).distinct()
    known, n, low, high = stored_ranged(seeds.withColumn("depth", F.lit(0)), "id", "reach")
    frontier = known
    for depth in range(1, max_depth + 1):
        if not n:
            break
        new = _step(graph, frontier.select("qid", F.col("id").alias("at")), low, high, direction, kinds).select("qid", F.col("dst").alias("id")).distinct()
        new = _existing(graph, new.join(known, ["qid", "id"], "left_anti")).distinct()
        frontier, n, low, high = stored_ranged(new.withColumn("depth", F.lit(depth)), "id", "reach")
        known = known.unionByName(frontier)
    return known


def induced_edges(graph: Graph, found: DataFrame, direction: str, query: TraversalQuery) -> DataFrame:
    """The edges the walk traversed: those out of a node nearer than the depth
    limit, of an allowed kind, to an existing node; each once."""
    e = graph.edges if query.edge_kinds is None else graph.edges.where(F.col("kind").isin(*query.edge_kinds))
    near, far = ("fromId", "toId") if direction == "Forward" else ("toId", "fromId")
    tails = found.where(F.col("depth") < query.max_depth).select("qid", F.col("id").alias(near))
    heads = found.select("qid", F.col("id").alias(far))  # of such an edge, a far end that exists is found
    return e.join(tails, near).join(heads, ["qid", far], "left_semi").select("qid", *graph.edges.columns)


def without_utility(graph: Graph, found: DataFrame, starts: DataFrame) -> DataFrame:
    """Take utility nodes out of a finished reach; starts stay."""
    dull = graph.nodes.where("utility").select("id")
    keep = starts.select("qid", "id", F.lit(True).alias("_start")).distinct()
    marked = found.join(keep, ["qid", "id"], "left")
    return marked.where("_start").drop("_start").unionByName(marked.where("_start is null").drop("_start").join(dull, "id", "left_anti").select("qid", "id", "depth"))


def subgraph(graph: Graph, starts: DataFrame, direction: str = "Forward", query: TraversalQuery | None = None) -> Subgraph:
    """Nodes, traversed edges and depths of one or many starts (qid, id).

    Thinning utility nodes changes the result only, never what is reached.
    """
    query = query or TraversalQuery()
    seen = reach(graph, starts, direction, query.max_depth, query.edge_kinds)
    found = seen
    edges = induced_edges(graph, seen, direction, query)
    if not query.include_utility:
        found = stored(without_utility(graph, seen, starts), "thin")
        for end in ("fromId", "toId"):
            edges = edges.join(found.select("qid", F.col("id").alias(end)), ["qid", end], "left_semi").select("qid", *graph.edges.columns)
    # depth as reached, not as stored
    nodes = found.join(graph.nodes.drop("depth"), "id").select("qid", "id", *[c for c in graph.nodes.columns if c not in ("id", "depth")], "depth")
    return Subgraph(nodes, edges, found, seen)


def start(graph: Graph, node_id: str, qid: str = "q") -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(qid, node_id)], "qid string, id string")


def forward(graph: Graph, node_id: str, max_depth: int = 20) -> DataFrame:
    return reach(graph, start(graph, node_id), "Forward", max_depth).drop("qid")


def backward(graph: Graph, node_id: str, max_depth: int = 20) -> DataFrame:
    return reach(graph, start(graph, node_id), "Backward", max_depth).drop("qid")


def find(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id)


def contains(graph: Graph, node_id: str) -> bool:
    return not find(graph, node_id).isEmpty()


def reaches_data(graph: Graph, kinds: tuple[str, ...]) -> DataFrame:
    """Ids from which a node of these kinds can be reached: one walk backward
    from all of them, not one walk per node."""
    ends = graph.nodes.where(F.col("kind").isin(*kinds)).select(F.lit("data").alias("qid"), "id")
    return reach(graph, ends, "Backward").select("id").distinct()


def reached_sets(graph: Graph, ends: DataFrame, direction: str = "Backward", max_depth: int = 20) -> DataFrame:
    """id, n: how many of the ``ends`` (id) each node reaches, itself included.

    A node's set of ends is kept as 64-bit words, one row for a word, and only
    words that have changed move on: the state is a 64th of all pairs.
    """
    ends = stored(_existing(graph, ends.select("id").distinct()).distinct(), "ends")
    # numbered in one task, which only passes the ids through, so that numbers have no gaps and words are full
    numbered, n, low, high = stored_ranged(ends.coalesce(1).withColumn("_k", F.monotonically_increasing_id()), "id", "ends")
    word = numbered.select("id", F.shiftright("_k", 6).alias("word"), F.expr("shiftleft(1L, cast(_k & 63 as int))").alias("bits"))
    key = ["id"] if n <= 64 else ["id", "word"]  # without a word to tell, rows move once for all joins on the id
    known = frontier = word.select(*key, "bits")
    for _ in range(max_depth):
        if not n:
            break
        new = _step(graph, frontier.withColumnRenamed("id", "at"), low, high, direction).groupBy(F.col("dst").alias("id"), *key[1:]).agg(F.bit_or("bits").alias("bits"))
        # known has a row for each level that brought ends; grouped by the keys of the join, so it moves once
        old = known.groupBy(*key).agg(F.bit_or("bits").alias("_old"))
        new = new.join(old, key, "left").withColumn("_old", F.coalesce("_old", F.lit(0).cast("long"))).withColumn("bits", F.col("bits").bitwiseOR(F.col("_old")))
        new = _existing(graph, new.where("bits <> _old").select(*key, "bits"))
        frontier, n, low, high = stored_ranged(new, "id", "sets")
        known = known.unionByName(frontier)
    known = known.groupBy(*key).agg(F.bit_or("bits").alias("bits"))
    return known.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("n"))


def routes(graph: Graph, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """qid, path: the lexicographically least of the shortest CALLS routes of
    each pair (qid, id, target); the start is not part of a path."""
    seeds = pairs.select("qid", "id", "target").distinct()
    known, n, low, high = stored_ranged(seeds.select("qid", "id", "target", F.array().cast("array<string>").alias("path")), "id", "routes")
    frontier, done = known, []
    for _ in range(max_hops):
        new = _step(graph, frontier.withColumnRenamed("id", "at"), low or "", high or "", "Forward", ("Calls",))
        new = _existing(graph, new.select("qid", F.col("dst").alias("id"), "target", F.array_append("path", F.col("dst")).alias("path")))
        new = new.groupBy("qid", "id", "target").agg(F.min("path").alias("path")).join(known, ["qid", "id"], "left_anti")
        new, n, low, high = stored_ranged(new.select("qid", "id", "target", "path"), "id", "routes")
        done.append(new.where("id = target").select("qid", "path"))
        # a pair that has arrived goes no further
        frontier = new.join(new.where("id = target").select("qid"), "qid", "left_anti")
        if not n:
            break
        known = known.unionByName(new)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def recursive_reach_sql(view: str, start_id: str, max_depth: int) -> str:
    """The recursive form, for shallow graphs that are known to have no cycle:
    UNION ALL enumerates walks, and the least depth of each node is kept."""
    start_id = start_id.replace("'", "''")
    return (
        f"WITH RECURSIVE r(id, depth) AS (SELECT '{start_id}', 0 UNION ALL SELECT e.toId, r.depth + 1 FROM r JOIN {view} e ON e.fromId = r.id "
        f"WHERE r.depth < {int(max_depth)}) SELECT id, min(depth) AS depth FROM r GROUP BY id"
    )
