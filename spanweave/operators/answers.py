"""Answers over a traversed subgraph; all keyed by query, so many at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.model import DIRECT, Graph, TraversalQuery, column_name, column_table, first_site, location, ordinal, schema_of
from spanweave.operators.traverse import Subgraph, subgraph

RAW_SQL = "raw SQL reaches the database outside the model"
UNMAPPED = "property written but not mapped to a column"
MESSAGES = {
    "raw-sql": "This flow uses raw SQL; the table it touches is not in this list.",
    "unmapped-column": "A property that is written has no column (ignored, computed or inside JSON).",
    "second-class-evidence": "Some write claims rest on indirect evidence: a construction, or a save with an entity parameter.",
    "ambiguous-implementation": "An interface call opens to more than one implementation; which one runs is not recorded.",
    "interceptor-columns": "Tables written by an interceptor are right as tables, and have no columns here.",
    "truncated": "The walk stopped at its depth limit with edges left; ask again with a larger limit.",
}


def access_by_table(edges: DataFrame) -> DataFrame:
    """qid, table (id), access: ``W`` if written, then ``R`` if read.

    A written entity counts for the tables it maps to, a written column for
    its table.
    """
    use = edges.where(F.col("kind").isin("Reads", "Writes")).select("qid", "toId", (F.col("kind") == "Writes").alias("w")).distinct()
    maps = edges.where((F.col("kind") == "MapsTo") & F.col("fromId").startswith("entity:")).select("qid", F.col("fromId").alias("toId"), F.col("toId").alias("table")).distinct()
    through = use.join(maps, ["qid", "toId"]).select("qid", "table", "w")
    straight = use.where("w").where(F.col("toId").startswith("column:")).select("qid", F.concat(F.lit("table:"), column_table(F.col("toId"))).alias("table"), "w")
    flags = through.unionByName(straight).groupBy("qid", "table").agg(F.bool_or("w").alias("w"), F.bool_or(~F.col("w")).alias("r"))
    return flags.select("qid", "table", F.concat(F.when(F.col("w"), "W").otherwise(""), F.when(F.col("r"), "R").otherwise("")).alias("access"))


def column_claims(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, table, column, file, line, mechanisms, confidence of each column."""
    named = edges.where((F.col("kind") == "Writes") & F.col("toId").startswith("column:")).groupBy("qid", F.col("toId").alias("id"))
    named = named.agg(F.array_sort(F.collect_set("mechanism")).alias("mechanisms"))
    cols = nodes.where("kind = 'Column'").join(named, ["qid", "id"], "left")
    used = F.coalesce("mechanisms", F.array().cast("array<string>"))
    confidence = (
        F.when(F.arrays_overlap(used, F.array(*[F.lit(m) for m in DIRECT])), "Direct")
        .when(F.array_contains(used, "RowInsert"), "RowLevel")
        .when(F.array_contains(used, "SaveChangesInterceptor"), "Inferred")
        .otherwise("SecondClass")
    )
    return cols.select("qid", column_table(F.col("id")).alias("table"), column_name(F.col("id")).alias("column"), "filePath", "line", used.alias("mechanisms"), confidence.alias("confidence"))


def data_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, table, schema, module, filePath, line, access, columns (sorted)."""
    tables = nodes.where("kind = 'Table'").select("qid", F.col("id").alias("_id"), F.col("displayName").alias("table"), "module", "filePath", "line")
    access = access_by_table(edges).withColumnRenamed("table", "_id")
    columns = column_claims(nodes, edges).groupBy("qid", "table").agg(F.array_sort(F.collect_list(F.struct("column", "filePath", "line", "mechanisms", "confidence"))).alias("columns"))
    out = tables.join(access, ["qid", "_id"], "left").join(columns, ["qid", "table"], "left")
    return out.select(
        "qid", "table", schema_of(F.col("table")).alias("schema"), "module", "filePath", "line", F.coalesce("access", F.lit("")).alias("access"),
        F.coalesce("columns", F.from_json(F.lit("[]"), columns.schema["columns"].dataType)).alias("columns"),
    )


def table_catalogue(graph: Graph) -> DataFrame:
    """The data layer of the whole graph, not of one flow."""
    return data_layer(graph.nodes.withColumn("qid", F.lit("all")), graph.edges.withColumn("qid", F.lit("all"))).drop("qid")


def entry_points(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """qid, rootKind, ordinal, total, roots (by depth, name, id)."""
    roots = nodes.where("rootKind <> 'None'").join(starts.select("qid", "id"), ["qid", "id"], "left_anti")
    ref = F.struct("depth", "displayName", "id", "kind", "module", "filePath", "line")
    return roots.groupBy("qid", "rootKind").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(ref)).alias("roots")).withColumn("ordinal", ordinal(F.col("rootKind"), "RootKind"))


def entry_point_totals(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """qid, rootKind, total, nearest: ``entry_points`` without their list, which
    is one row for all roots of a kind."""
    roots = nodes.where("rootKind <> 'None'").join(starts.select("qid", "id"), ["qid", "id"], "left_anti")
    return roots.groupBy("qid", "rootKind").agg(F.count("*").alias("total"), F.min("depth").alias("nearest"))


def event_bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, event, name, module, location, publishedBy, consumedBy."""
    pub = edges.where("kind = 'Publishes'").groupBy("qid", F.col("toId").alias("event")).agg(F.array_sort(F.collect_set("fromId")).alias("publishedBy"))
    sub = edges.where("kind = 'Consumes'").groupBy("qid", F.col("fromId").alias("event")).agg(F.array_sort(F.collect_set("toId")).alias("consumedBy"))
    none = F.array().cast("array<string>")
    events = nodes.where("kind = 'Event'").select("qid", F.col("id").alias("event"), F.col("displayName").alias("name"), "module", location(F.col("filePath"), F.col("line")).alias("location"))
    out = events.join(pub, ["qid", "event"], "left").join(sub, ["qid", "event"], "left")
    return out.select("qid", "event", "name", "module", "location", F.coalesce("publishedBy", none).alias("publishedBy"), F.coalesce("consumedBy", none).alias("consumedBy"))


def hidden_utility(graph: Graph, sub: Subgraph, starts: DataFrame, query: TraversalQuery) -> DataFrame:
    """qid, hidden: utility nodes that thinning took out, in the direction of
    the answer itself."""
    if query.include_utility:
        return sub.seen.groupBy("qid").agg(F.lit(0).cast("long").alias("hidden"))
    all_ = sub.seen.groupBy("qid").agg(F.count("*").alias("n"))
    left = sub.reach.groupBy("qid").agg(F.count("*").alias("m"))
    return all_.join(left, "qid", "left").select("qid", F.greatest(F.lit(0).cast("long"), F.col("n") - F.coalesce("m", F.lit(0))).alias("hidden"))


def truncated(graph: Graph, sub: Subgraph, direction: str, query: TraversalQuery) -> DataFrame:
    """qid, truncated: whether an edge leaves a node at the depth limit for a
    node that was not reached; judged before thinning, on allowed kinds."""
    e = graph.edges if query.edge_kinds is None else graph.edges.where(F.col("kind").isin(*query.edge_kinds))
    near, far = ("fromId", "toId") if direction == "Forward" else ("toId", "fromId")
    rim = sub.seen.where(F.col("depth") >= query.max_depth).select("qid", F.col("id").alias(near))
    out = rim.join(e.select(near, far), near).select("qid", F.col(far).alias("id")).distinct()
    out = out.join(sub.seen.select("qid", "id"), ["qid", "id"], "left_anti").join(graph.nodes.select("id"), "id").select("qid").distinct().withColumn("truncated", F.lit(True))
    return sub.seen.select("qid").distinct().join(out, "qid", "left").select("qid", F.coalesce("truncated", F.lit(False)).alias("truncated"))


#: Letters of a file's end by which texts are searched for it.
END = 16


def mentions(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (text, file) where a text has a file in it, whatever the case;
    texts: text; files: file, in lower case, not empty.

    Exact, by an equi join: a text has the file's last ``END`` letters (all, if
    fewer) as one of its own stretches of that length, of which it has no more
    than letters; the whole file is then looked for in the texts so found.
    """
    f = files.select("file").distinct().withColumn("end", F.right("file", F.least(F.lit(END), F.length("file"))))
    sizes = sorted(r[0] for r in f.select(F.length("end")).distinct().collect())  # END of them at most
    t = texts.select("text").distinct().withColumn("low", F.lower("text"))
    none = F.array().cast("array<string>")
    stretch = lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substr("low", i, F.lit(n)))).otherwise(none)
    each = t.select("text", "low", F.explode(F.array_distinct(F.concat(none, *[stretch(n) for n in sizes]))).alias("end"))
    return each.join(f, "end").where(F.contains("low", F.col("file"))).select("text", "file").distinct()


def diagnostics_for_files(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (qid, text) of diagnostics that contain a file of a query,
    whatever the case."""
    f = files.where(F.coalesce(F.trim("filePath"), F.lit("")) != "").select("qid", F.lower("filePath").alias("file")).distinct()
    return mentions(diagnostics, f).join(f, "file").select("qid", "text").distinct()


def limitations(graph: Graph, sub: Subgraph, direction: str, query: TraversalQuery) -> DataFrame:
    """qid, seq, code, message, locations: in fixed order, only what applies."""
    spark = graph.nodes.sparkSession
    parts = []

    def add(seq: int, code: str, rows: DataFrame) -> None:
        """rows: qid, place."""
        got = rows.groupBy("qid").agg(F.array_sort(F.collect_set("place")).alias("locations"))
        parts.append(got.select("qid", F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"), "locations"))

    if graph.diagnostics is not None:
        marked = graph.diagnostics.where(F.col("text").contains(RAW_SQL) | F.col("text").contains(UNMAPPED))
        hits = diagnostics_for_files(marked, sub.nodes.select("qid", "filePath"))
        add(1, "raw-sql", hits.where(F.col("text").contains(RAW_SQL)).select("qid", F.col("text").alias("place")))
        add(2, "unmapped-column", hits.where(F.col("text").contains(UNMAPPED)).select("qid", F.col("text").alias("place")))
    weak = sub.edges.where(F.col("mechanism").isin("EntityConstruction", "SaveChangesWithEntityParameter") & F.col("evidence").isNotNull())
    add(3, "second-class-evidence", weak.select("qid", F.col("evidence").alias("place")))
    add(4, "ambiguous-implementation", sub.nodes.where("ambiguous").select("qid", location(F.col("filePath"), F.col("line")).alias("place")))
    add(5, "interceptor-columns", sub.edges.where("mechanism = 'SaveChangesInterceptor'").select("qid", F.col("toId").alias("place")))
    cut = truncated(graph, sub, direction, query).where("truncated")
    parts.append(cut.select("qid", F.lit(6).alias("seq"), F.lit("truncated").alias("code"), F.lit(MESSAGES["truncated"]).alias("message"), F.array().cast("array<string>").alias("locations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class TraceAnswer:
    """Lazy parts of an answer; forward answers have no entry points, backward
    ones no data layer."""

    direction: str
    query: TraversalQuery
    sub: Subgraph
    tables: DataFrame | None
    entry_points: DataFrame | None
    event_bridges: DataFrame
    limitations: DataFrame
    hidden: DataFrame
    truncated: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.sub.nodes

    @property
    def edges(self) -> DataFrame:
        return self.sub.edges


def trace(graph: Graph, starts: DataFrame, direction: str = "Forward", query: TraversalQuery | None = None) -> TraceAnswer:
    """The whole answer of one or many starts (qid, id)."""
    query = query or TraversalQuery()
    sub = subgraph(graph, starts, direction, query)
    ahead = direction == "Forward"
    return TraceAnswer(
        direction, query, sub,
        data_layer(sub.nodes, sub.edges) if ahead else None,
        None if ahead else entry_points(sub.nodes, starts),
        event_bridges(sub.nodes, sub.edges),
        limitations(graph, sub, direction, query),
        hidden_utility(graph, sub, starts, query),
        truncated(graph, sub, direction, query),
    )


def endpoint_list(graph: Graph, module: str | None = None) -> DataFrame:
    """id, verb, route, module, filePath, line; a module whatever its case."""
    e = graph.nodes.where("kind = 'Endpoint'")
    if module is not None:
        e = e.where(F.lower("module") == module.lower())
    cut = F.instr("displayName", " ")
    verb = F.when(cut > 0, F.substring_index("displayName", " ", 1)).otherwise("")
    route = F.when(cut > 0, F.substr("displayName", cut + 1)).otherwise(F.col("displayName"))
    return e.select("id", verb.alias("verb"), route.alias("route"), "module", "filePath", "line", "displayName")


def stats(graph: Graph) -> DataFrame:
    """group, name, n: the counts that are stored with a graph."""
    n, e = graph.nodes, graph.edges
    rows = n.groupBy(F.col("kind").alias("name")).count().select(F.lit("node").alias("group"), "name", F.col("count").alias("n"))
    rows = rows.unionByName(e.groupBy(F.col("kind").alias("name")).count().select(F.lit("edge").alias("group"), "name", F.col("count").alias("n")))
    by = e.where("mechanism <> 'None'").groupBy(F.col("mechanism").alias("name")).count()
    rows = rows.unionByName(by.select(F.lit("mechanism").alias("group"), "name", F.col("count").alias("n")))
    flags = n.agg(F.count_if("ambiguous").alias("ambiguous"), F.count_if("utility").alias("utility"), F.count_if(F.col("rootKind") != "None").alias("roots"))
    flags = flags.unpivot([], ["ambiguous", "utility", "roots"], "name", "n")
    return rows.unionByName(flags.select(F.lit("flag").alias("group"), "name", "n"))


def widest_fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy("fromId").count().agg(F.coalesce(F.max("count"), F.lit(0).cast("long")).alias("widest"))


def edges_with_order(edges: DataFrame) -> DataFrame:
    """Edges with ``site``, their first call site."""
    return edges.withColumn("site", first_site(F.col("callSites")))


def stats_lines(graph: Graph) -> DataFrame:
    """group, place, line: counts as they are printed, in each group the largest
    first, the name in 14 columns and the number in 6."""
    rows = stats(graph)
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "name"))  # a group is one enumeration
    return rows.select("group", place.alias("place"), F.format_string("%-14s %6d", "name", "n").alias("line"))
