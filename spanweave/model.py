"""The property graph: schemas, enumerations, ids and validity.

Enumerations are strings in tables; their order is the order of declaration,
never that of their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENUMS: dict[str, tuple[str, ...]] = {
    "NodeKind": ("Endpoint", "Handler", "Method", "Repository", "Event", "Entity", "Table", "Column", "ExternalCall"),
    "RootKind": ("None", "Endpoint", "Consumer", "BackgroundService"),
    "EdgeKind": ("Calls", "Publishes", "Consumes", "Reads", "Writes", "MapsTo"),
    "EdgeMechanism": (
        "None", "DbSetProperty", "SetOfT", "FluentChainHead", "ExecuteUpdateSetProperty", "PropertyAssignment", "OwnedCollectionAdd",
        "EntityConstructorAssignment", "SaveChangesWithEntityParameter", "EntityConstruction", "SaveChangesInterceptor", "RowInsert",
        "EfModelMapping", "HttpClientInvocation", "DomainEventRegistry", "ConsumerRegistration",
    ),
    "TraversalDirection": ("Forward", "Backward"),
    "ClaimConfidence": ("Direct", "RowLevel", "Inferred", "SecondClass"),
    "BuilderOriginKind": ("Root", "Parameter", "Unknown"),
    "ImplementationPolicy": ("AllImplementations", "DeclaringModuleOnly"),
    "BridgeStatus": ("Published", "InternalDomainEvent", "RaiseArgumentUnresolved"),
    "DiagramEdgeKind": ("Call", "Data", "Async"),
    "ModuleEdgeKind": ("Contract", "Event", "Direct"),
    "LineKind": ("Frame", "Unparsed", "Separator", "Text"),
    "FrameVerdict": ("Matched", "Ambiguous", "NotInGraph", "Foreign"),
    "LinkVerdict": ("Verified", "LineMismatch", "MissingEdge", "SkippedFrames", "SameMethod", "NotChecked"),
    "RepoOrigin": ("Given", "DerivedFromStackTrace", "NotFound"),
    "ColumnKind": ("Write", "Read"),
    "FacetKind": ("Table", "ColumnWrite", "ColumnRead", "Root", "Event", "ExternalStore", "Limitation", "Node"),
    "EfScope": ("None", "Inside", "Outside"),
    "EvidenceOutcome": ("ExpectedMechanism", "DifferentButValid", "NotFound"),
}

#: Mechanisms that read the claim itself from the code or the model.
DIRECT = ("DbSetProperty", "SetOfT", "FluentChainHead", "ExecuteUpdateSetProperty", "PropertyAssignment", "OwnedCollectionAdd", "EntityConstructorAssignment", "EfModelMapping")
#: Mechanisms by which the object mapper itself issues the statement.
MAPPER_ISSUED = ("DbSetProperty", "SetOfT", "FluentChainHead", "ExecuteUpdateSetProperty", "SaveChangesInterceptor", "OwnedCollectionAdd", "RowInsert")
DATA_KINDS = ("Table", "Event", "ExternalCall")
LAYER_KINDS = ("Endpoint", "Handler", "Repository", *DATA_KINDS)

CALL_SITE = T.StructType(
    [T.StructField("filePath", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("conditional", T.BooleanType())]
)
NODE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("id", "kind", "displayName", "module", "filePath")),
        T.StructField("line", T.IntegerType()),
        *(T.StructField(n, T.BooleanType()) for n in ("ambiguous", "truncated", "utility")),
        T.StructField("depth", T.IntegerType()),
        T.StructField("rootKind", T.StringType()),
    ]
)
EDGE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("fromId", "toId", "kind", "evidence")),
        T.StructField("ambiguous", T.BooleanType()),
        T.StructField("mechanism", T.StringType()),
        T.StructField("callSites", T.ArrayType(CALL_SITE)),
    ]
)
STATS = T.StructType(
    [
        *(T.StructField(n, T.MapType(T.StringType(), T.LongType())) for n in ("nodesByKind", "edgesByKind", "edgesByMechanism")),
        *(T.StructField(n, T.LongType()) for n in ("ambiguousNodes", "utilityNodes", "rootCount")),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("solution", T.StringType()),
        T.StructField("stats", STATS),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("edges", T.ArrayType(EDGE)),
        T.StructField("diagnostics", T.ArrayType(T.StringType())),
    ]
)
VERSION = 1


@dataclass(frozen=True)
class TraversalQuery:
    max_depth: int = 20
    include_utility: bool = True
    edge_kinds: tuple[str, ...] | None = None


@dataclass
class Graph:
    """Nodes keyed by id, a directed multigraph of edges, and diagnostics."""

    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame | None = None
    solution: str = ""
    meta: dict = field(default_factory=dict)


def ordinal(col: Column, enum: str) -> Column:
    """Place of an enumeration value in its declaration, from 0."""
    return (F.array_position(F.array(*[F.lit(v) for v in ENUMS[enum]]), col) - 1).cast("int")


# --- ids ----------------------------------------------------------------------

PREFIXES = {"Endpoint": "endpoint:", "Event": "event:", "Entity": "entity:", "Table": "table:", "Column": "column:", "ExternalCall": "external:"}


def endpoint_id(verb: Column, route: Column) -> Column:
    return F.concat(F.lit("endpoint:"), F.upper(verb), F.lit(" "), route)


def table_id(schema: Column, name: Column) -> Column:
    return F.concat(F.lit("table:"), F.concat_ws(".", schema, name))


def column_id(table: Column, column: Column) -> Column:
    """``table`` is a qualified name without prefix."""
    return F.concat(F.lit("column:"), table, F.lit("."), column)


def method_id(namespace_type: Column, name: Column, parameters: Column) -> Column:
    return F.concat(namespace_type, F.lit("."), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def column_table(column_id_: Column) -> Column:
    """Qualified table of a column id: what is before the last dot."""
    return F.regexp_replace(F.regexp_replace(column_id_, "^column:", ""), r"\.[^.]*$", "")


def column_name(column_id_: Column) -> Column:
    return F.substring_index(column_id_, ".", -1)


# --- small projections ----------------------------------------------------------


def location(file: Column, line: Column) -> Column:
    """``file:line``, or the file where the line is not known."""
    return F.when(line > 0, F.concat_ws(":", file, line.cast("string"))).otherwise(file)


def first_site(sites: Column) -> Column:
    return F.try_element_at(sites, F.lit(1))


def schema_of(table: Column) -> Column:
    """Text before the first dot, or null."""
    return F.when(F.instr(table, ".") > 1, F.substring_index(table, ".", 1))


def classify_method(type_name: Column, namespace: Column) -> Column:
    """Kind of a method by the name of its type and its namespace."""
    return (
        F.when(type_name.endswith("Repository") | type_name.endswith("Queries"), F.lit("Repository"))
        .when(type_name.endswith("Handler") & namespace.contains(".Application"), F.lit("Handler"))
        .otherwise(F.lit("Method"))
    )


def distinct_symbols(methods: DataFrame) -> DataFrame:
    """One row per canonical id."""
    return methods.dropDuplicates(["id"])


# --- validity -------------------------------------------------------------------


class InvalidGraph(ValueError):
    """What is wrong with a graph: at most 20 problems, and their true number."""

    def __init__(self, problems: list[str], total: int) -> None:
        super().__init__(f"{total} problems: " + "; ".join(problems))
        self.problems, self.total = problems, total


def problems(graph: Graph) -> DataFrame:
    """(rule, subject): each broken rule of a graph."""
    n, e = graph.nodes, graph.edges
    ids = n.select("id")
    found = n.where(F.coalesce(F.trim("filePath"), F.lit("")) == "").select(F.lit("blank-file").alias("rule"), F.col("id").alias("subject"))
    found = found.unionByName(n.where(F.coalesce(F.col("line"), F.lit(0)) <= 0).select(F.lit("no-line").alias("rule"), F.col("id").alias("subject")))
    found = found.unionByName(n.where((F.col("rootKind") != "None") & F.col("utility")).select(F.lit("utility-root").alias("rule"), F.col("id").alias("subject")))
    found = found.unionByName(n.groupBy("id").count().where("count > 1").select(F.lit("repeated-id").alias("rule"), F.col("id").alias("subject")))
    for end in ("fromId", "toId"):
        loose = e.select(F.col(end).alias("id")).distinct().join(ids, "id", "left_anti")
        found = found.unionByName(loose.select(F.lit(f"dangling-{end}").alias("rule"), F.col("id").alias("subject")))
    return found


def validate(graph: Graph) -> None:
    """Raise InvalidGraph if any rule is broken."""
    found = problems(graph)
    first = found.orderBy("rule", "subject").limit(20).collect()
    if first:
        raise InvalidGraph([f"{r['rule']}: {r['subject']}" for r in first], found.count())


def canonical_order(edges: DataFrame) -> list[Column]:
    site = first_site(F.col("callSites"))
    return [
        F.col("fromId"), F.col("toId"), ordinal(F.col("kind"), "EdgeKind"), ordinal(F.col("mechanism"), "EdgeMechanism"), F.coalesce("evidence", F.lit("")),
        F.col("ambiguous"), F.coalesce(site["filePath"], F.lit("")), F.coalesce(site["line"], F.lit(0)), F.coalesce(site["column"], F.lit(0)),
    ]
