"""Dependencies between modules, and what each module holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.model import Graph, location, ordinal
from spanweave.operators.answers import diagnostics_for_files
from spanweave.operators.traverse import reached_sets

SHARED = "Shared"


def layer_of(node_id: Column, root: str | None = None) -> Column:
    """Layer of a node by its id: third segment below the root namespace.

    ``root`` None takes any first segment.
    """
    bare = F.regexp_replace(node_id, "^(event|entity|external):", "")
    parts = F.split(bare, r"\.")
    fits = F.size(parts) >= 3 if root is None else (F.size(parts) >= 3) & (F.element_at(parts, 1) == root)
    return F.when(node_id.rlike("^(endpoint|table|column):"), "Api").when(fits, F.try_element_at(parts, F.lit(3))).otherwise("?")


#: Evidence texts of an edge between modules that are kept with it.
EVIDENCE = 50


def _cross(graph: Graph) -> DataFrame:
    f = graph.nodes.select(F.col("id").alias("fromId"), F.col("module").alias("from"), F.col("displayName").alias("fromName"))
    t = graph.nodes.select(F.col("id").alias("toId"), F.col("module").alias("to"), F.col("displayName").alias("toName"), location(F.col("filePath"), F.col("line")).alias("place"))
    return graph.edges.select("fromId", "toId", "kind").join(f, "fromId").join(t, "toId").where("from <> to")


def dependencies(graph: Graph, root: str | None = None) -> DataFrame:
    """from, to, kind, n, distinct_evidence, evidence of each edge between
    modules; edges into the shared module are counted apart.

    evidence: the first EVIDENCE texts, as a page shows them; all of them are
    the rows of ``evidence_rows``.
    """
    e = evidence_rows(graph, root).groupBy("from", "to", "kind", "evidence").agg(F.count("*").alias("n"))
    n = e.groupBy("from", "to", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_evidence"))
    first = F.row_number().over(Window.partitionBy("from", "to", "kind").orderBy("evidence"))  # a top-k, cut in each partition before the shuffle
    few = e.withColumn("_n", first).where(F.col("_n") <= EVIDENCE).groupBy("from", "to", "kind").agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))
    return n.join(few, ["from", "to", "kind"]).withColumn("ordinal", ordinal(F.col("kind"), "ModuleEdgeKind"))


def evidence_rows(graph: Graph, root: str | None = None) -> DataFrame:
    """from, to, kind, evidence: one row for each edge between modules."""
    kind = F.when(F.col("kind").isin("Publishes", "Consumes"), "Event").when(F.col("kind") == "Calls", F.when(layer_of(F.col("toId"), root) == "Contracts", "Contract").otherwise("Direct"))
    e = _cross(graph).where(F.col("to") != SHARED).withColumn("kind", kind).where("kind is not null")
    text = F.concat("fromName", F.lit(" -> "), "toName", F.lit(" ("), "place", F.lit(")"))
    return e.select("from", "to", "kind", text.alias("evidence"))


def dependency_counts(graph: Graph) -> DataFrame:
    """from, to, n: ``dependencies`` added up, without their evidence.  Edges are
    counted by the module they come from before they meet the other end."""
    e = graph.edges.where(F.col("kind").isin("Publishes", "Consumes", "Calls")).select("fromId", "toId")
    module = graph.nodes.select("id", "module")
    out = e.join(module, e["fromId"] == module["id"]).groupBy(F.col("module").alias("from"), "toId").agg(F.count("*").alias("n"))
    to = module.select(F.col("id").alias("toId"), F.col("module").alias("to"))
    return out.join(to, "toId").where((F.col("from") != F.col("to")) & (F.col("to") != SHARED)).groupBy("from", "to").agg(F.sum("n").alias("n"))


def shared_dependents(graph: Graph) -> DataFrame:
    """module, n: edges into the shared module by where they come from."""
    return _cross(graph).where(F.col("to") == SHARED).groupBy(F.col("from").alias("module")).agg(F.count("*").alias("n"))


def endpoint_tables(graph: Graph) -> DataFrame:
    """id, displayName, module, tables: how many tables each endpoint reaches,
    by one walk of table sets back from all tables."""
    n = reached_sets(graph, graph.nodes.where("kind = 'Table'")).select("id", F.col("n").alias("tables"))
    return graph.nodes.where("kind = 'Endpoint'").select("id", "displayName", "module").join(n, "id", "left").select("id", "displayName", "module", F.coalesce("tables", F.lit(0).cast("long")).alias("tables"))


def table_module(table: Column) -> Column:
    return F.substring_index(table, ".", 1)


def rollup(graph: Graph) -> DataFrame:
    """module, endpoints, with_data, tables, events, edges_out, edges_in."""
    ends = endpoint_tables(graph).groupBy("module").agg(F.count("*").alias("endpoints"), F.count_if(F.col("tables") > 0).alias("with_data"))
    own = graph.nodes.groupBy("module").agg(F.count_if(F.col("kind") == "Table").alias("tables"), F.count_if(F.col("kind") == "Event").alias("events"))
    deps = dependency_counts(graph)
    out = deps.groupBy(F.col("from").alias("module")).agg(F.sum("n").alias("edges_out"))
    in_ = deps.groupBy(F.col("to").alias("module")).agg(F.sum("n").alias("edges_in"))
    zero = F.lit(0).cast("long")
    joined = own.join(ends, "module", "left").join(out, "module", "left").join(in_, "module", "left")
    return joined.select("module", *[F.coalesce(c, zero).alias(c) for c in ("endpoints", "with_data", "tables", "events", "edges_out", "edges_in")])


def module_diagnostics(graph: Graph) -> DataFrame:
    """module, text: diagnostics that name a file of the module."""
    if graph.diagnostics is None:
        return graph.nodes.sparkSession.createDataFrame([], "module string, text string")
    return diagnostics_for_files(graph.diagnostics, graph.nodes.select(F.col("module").alias("qid"), "filePath")).select(F.col("qid").alias("module"), "text")


def event_consumers(graph: Graph) -> DataFrame:
    """event, consumer: display names, the id where a node is missing."""
    c = graph.edges.where("kind = 'Consumes'").select(F.col("fromId").alias("event"), F.col("toId").alias("id")).distinct()
    return c.join(graph.nodes.select("id", "displayName"), "id", "left").select("event", F.coalesce("displayName", "id").alias("consumer"))


def layer_pivot(methods: DataFrame, layers: list[str]) -> DataFrame:
    """Methods by module and layer; no layer is ``(other)``."""
    m = methods.withColumn("layer", F.coalesce("layer", F.lit("(other)")))
    return m.groupBy("module").pivot("layer", [*layers, "(other)"]).agg(F.count(F.lit(1))).na.fill(0)


def merge_breakdowns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (module, layer, n) tables added up."""
    return a.unionByName(b).groupBy("module", "layer").agg(F.sum("n").alias("n"))
