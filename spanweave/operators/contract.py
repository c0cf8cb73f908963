"""Contracted flow diagrams.

A diagram keeps the layer nodes of a flow.  Routes through dropped nodes
become one edge: a level loop carries, for every kept source, the sequence of
sibling ranks that leads to each dropped node.  The least sequence is the order
in which a queue would have met it, so each level is one group-by-minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.text import source_files
from spanweave.model import DATA_KINDS, LAYER_KINDS, Graph, first_site, location, ordinal
from spanweave.operators.traverse import Subgraph, reaches_data, subgraph
from spanweave.tables import stored


@dataclass
class FlowDiagram:
    nodes: DataFrame
    edges: DataFrame
    hidden: DataFrame
    sub: Subgraph


def interface_siblings(nodes: DataFrame, *keys: str) -> DataFrame:
    """Ids of interface members that have an implementation beside them: same
    member name, some but not all named like ``IName``."""
    member = F.substring_index("displayName", ".", -1)
    iface = F.col("displayName").rlike(r"^I\p{Lu}")
    w = Window.partitionBy(*keys, "_member")
    marked = nodes.withColumn("_member", member).withColumn("_iface", iface)
    marked = marked.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.count_if("_iface").over(w))
    return marked.where("_iface and _i < _n").select(*keys, "id")


def weight(kind: Column) -> Column:
    return F.when(kind.isin("Publishes", "Consumes"), 4).when(kind == "Writes", 3).when(kind == "Reads", 2).when(kind == "MapsTo", 1).otherwise(0)


def _style(w: Column) -> Column:
    return F.when(w == 4, "Async").when(w > 0, "Data").otherwise("Call")


def sibling_order() -> list[Column]:
    s = first_site(F.col("callSites"))
    return [
        s.isNull(), F.coalesce(s["filePath"], F.lit("")), F.coalesce(s["line"], F.lit(0)), F.coalesce(s["column"], F.lit(0)), F.col("toId"),
        ordinal(F.col("kind"), "EdgeKind"), ordinal(F.col("mechanism"), "EdgeMechanism"), F.coalesce("evidence", F.lit("")),
    ]


def contract(edges: DataFrame, nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """qid, fromId, toId, kind, label, ambiguous, callSites between kept nodes.

    edges: qid and the flow's edges; nodes: qid, id, kind, displayName of all
    its nodes; kept: qid, id.
    """
    rank = F.row_number().over(Window.partitionBy("qid", "fromId").orderBy(*sibling_order())).cast("int")
    known = nodes.select("qid", F.col("id").alias("toId"), F.col("kind").alias("toKind"), F.col("displayName").alias("toName"))
    stays = kept.select("qid", F.col("id").alias("toId"), F.lit(True).alias("stays"))
    step = edges.withColumn("rank", rank).join(known, ["qid", "toId"]).join(stays, ["qid", "toId"], "left")
    step = step.select(
        "qid", "fromId", "toId", "rank", weight(F.col("kind")).alias("w"), "ambiguous", "callSites", F.coalesce("stays", F.lit(False)).alias("stays"),
        F.when(F.col("toKind") == "Entity", F.substring_index("toName", ".", -1)).otherwise("").alias("name"),
    )
    step = stored(step, "steps")
    first = step.join(kept.select("qid", F.col("id").alias("fromId")), ["qid", "fromId"])
    site = F.struct(F.col("callSites").alias("origin"))
    cols = ["qid", F.col("fromId").alias("source"), "toId", F.array("rank").alias("path"), "w", F.lit(0).alias("through"), F.lit("").alias("label"), "ambiguous", site["origin"].alias("origin"), "stays", "name"]
    level = stored(first.select(*cols), "level")
    found, seen = [level.where("stays")], None
    depth = 0
    while True:  # ends: each dropped node comes once a source
        depth += 1
        # each dropped node once a source: by the least path of ranks
        new = level.where("not stays").groupBy("qid", "source", "toId").agg(F.min_by(F.struct("path", "w", "origin", "name"), "path").alias("b"))
        if seen is not None:
            new = new.join(seen, ["qid", "source", "toId"], "left_anti")
        new = stored(new, "frontier")
        if new.isEmpty():
            break
        visited = new.select("qid", "source", "toId")
        seen = visited if seen is None else seen.unionByName(visited)
        at = new.select("qid", "source", F.col("toId").alias("fromId"), F.col("b.path").alias("p"), F.col("b.w").alias("pw"), F.col("b.origin").alias("origin"), F.col("b.name").alias("pname"))
        level = at.join(step, ["qid", "fromId"]).select(
            "qid", "source", "toId", F.array_append("p", F.col("rank")).alias("path"), F.greatest("pw", "w").alias("w"), F.lit(depth).alias("through"),
            (F.col("pname") if depth == 1 else F.lit("")).alias("label"), "ambiguous", "origin", "stays", "name",
        )
        level = stored(level, "level")
        found.append(level.where("stays"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    kind = _style(F.col("w"))
    s = first_site(F.col("origin"))
    order = F.struct(
        F.when(kind == "Async", 0).when(kind == "Data", 1).otherwise(2).alias("r"), F.col("label").alias("label"), F.col("ambiguous").alias("amb"), s.isNull().alias("none"),
        s["filePath"].alias("f"), s["line"].alias("l"), s["column"].alias("c"), F.size("path").alias("d"), F.col("path").alias("p"),
    )
    best = every.where("source <> toId").groupBy("qid", "source", "toId").agg(F.min_by(F.struct(kind.alias("kind"), "label", "ambiguous", F.col("origin").alias("callSites")), order).alias("b"))
    return best.select("qid", F.col("source").alias("fromId"), "toId", "b.kind", "b.label", "b.ambiguous", "b.callSites")


def layer_edges(graph: Graph, starts: DataFrame) -> DataFrame:
    """Edges of the diagrams of many starts (qid, id) that keep every layer node
    but utilities, those that reach no data and interface members too."""
    sub = subgraph(graph, starts)
    nodes = stored(sub.nodes, "flow")
    return contract(sub.edges, nodes, nodes.where(~F.col("utility") & F.col("kind").isin(*LAYER_KINDS)).select("qid", "id"))


def flow_diagram(graph: Graph, starts: DataFrame) -> FlowDiagram:
    """Diagrams of many starts (qid, id) at once."""
    sub = subgraph(graph, starts)
    nodes = stored(sub.nodes, "flow")
    noted = None
    if graph.diagnostics is not None:
        noted = graph.diagnostics.select(F.explode(source_files(F.col("text"))).alias("f")).select(F.lower("f").alias("f")).distinct()
    layer = nodes.where((~F.col("utility")) & F.col("kind").isin(*LAYER_KINDS))
    ifaces = stored(interface_siblings(layer, "qid"), "interfaces")
    after = layer.join(ifaces, ["qid", "id"], "left_anti")
    if noted is not None:
        mark = noted.select("f", F.lit(True).alias("noted"))
        after = after.join(mark, F.lower("filePath") == F.col("f"), "left").drop("f").withColumn("noted", F.coalesce("noted", F.lit(False)))
    else:
        after = after.withColumn("noted", F.lit(False))
    useful = reaches_data(graph, DATA_KINDS).withColumn("useful", F.lit(True))
    first = starts.select("qid", "id", F.lit(True).alias("first")).distinct()
    after = stored(after.join(useful, "id", "left").join(first, ["qid", "id"], "left"), "candidates")
    stay = F.coalesce("useful", F.lit(False)) | F.col("noted") | F.coalesce("first", F.lit(False))
    kept = stored(after.where(stay).drop("useful", "first"), "kept")
    edges = contract(sub.edges, nodes, kept.select("qid", "id"))
    counts = nodes.groupBy("qid").agg(F.count("*").alias("total"), F.count_if("utility").alias("utility"), F.count_if(~F.col("utility") & ~F.col("kind").isin(*LAYER_KINDS)).alias("intermediate"))
    counts = counts.join(ifaces.groupBy("qid").agg(F.count("*").alias("interfaces")), "qid", "left").join(after.where(~stay).groupBy("qid").agg(F.count("*").alias("dataless")), "qid", "left").na.fill(0)
    shown = kept.select("qid", "id", "kind", "displayName", "module", location(F.col("filePath"), F.col("line")).alias("location"), "ambiguous", "noted")
    return FlowDiagram(shown, edges, counts, sub)


def call_steps(edges: DataFrame) -> DataFrame:
    """Edges with ``step``: the call sites of a source numbered from 1, for
    sources with more than one edge; null without a call site."""
    s = first_site(F.col("callSites"))
    many = Window.partitionBy("qid", "fromId")
    e = edges.withColumn("_file", s["filePath"]).withColumn("_line", s["line"]).withColumn("_col", s["column"]).withColumn("_n", F.count("*").over(many)).where("_n > 1")
    numbered = F.dense_rank().over(many.orderBy(F.col("_file").asc_nulls_last(), F.col("_line").asc_nulls_last(), F.col("_col").asc_nulls_last()))
    return e.withColumn("step", F.when(F.col("_file").isNotNull(), numbered)).drop("_file", "_line", "_col", "_n")


def shown_numbers(edges: DataFrame) -> DataFrame:
    """The step numbers that a drawing shows: only where there are several."""
    w = Window.partitionBy("qid", "fromId")
    return call_steps(edges).withColumn("_m", F.max("step").over(w)).where("_m > 1 and step is not null").drop("_m")
