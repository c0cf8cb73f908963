"""Reading and writing graphs, facts, questions, traces and payloads."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.text import package_name, package_version
from spanweave.model import DOCUMENT, EDGE, NODE, VERSION, Graph, InvalidGraph, canonical_order, first_site, ordinal, validate
from spanweave.operators.answers import stats
from spanweave.operators.link import FACTS


class BadDocument(ValueError):
    """A stored document that cannot be used."""


def _whole(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _meta(df: DataFrame):
    """Version and solution of a one-document file; the parser's own complaint
    becomes ours."""
    try:
        return df.select("version", "solution").first()
    except Exception as e:
        if "MALFORMED" not in str(e) and "FAILED_READ_FILE" not in str(e):
            raise
        raise BadDocument(f"not a graph document: {str(e)[:200]}") from e


# --- graph documents --------------------------------------------------------------------


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph from its JSON document; the version must be known."""
    doc = _whole(spark, path, DOCUMENT)
    head = _meta(doc)
    if head is None or head["version"] is None:
        raise BadDocument("the document is empty")
    if head["version"] != VERSION:
        raise BadDocument(f"version {head['version']} is not {VERSION}")
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    notes = doc.select(F.explode("diagnostics").alias("text"))
    graph = Graph(nodes, edges, notes, head["solution"] or "")
    _no_repeats(graph)
    return graph


def _no_repeats(graph: Graph) -> None:
    twice = graph.nodes.groupBy("id").count().where("count > 1").select("id").limit(1).collect()
    if twice:
        raise BadDocument(f"node id {twice[0]['id']!r} occurs twice")


def write_graph_json(graph: Graph, path: str) -> None:
    """One indented document in canonical order; nothing is written if the
    graph breaks a rule.  For graphs that fit a document; else ``write_graph``."""
    validate(graph)
    nodes = graph.nodes.orderBy("id").select(F.to_json(F.struct("*")).alias("j"))
    edges = graph.edges.select("*").orderBy(*canonical_order(graph.edges)).select(F.to_json(F.struct("*")).alias("j"))
    notes = sorted(r["text"] for r in graph.diagnostics.select("text").collect()) if graph.diagnostics is not None else []
    counts: dict[str, dict[str, int]] = {}
    for r in stats(graph).collect():
        counts.setdefault(r["group"], {})[r["name"]] = r["n"]
    flags = counts.get("flag", {})
    by = lambda g, enum: {k: counts.get(g, {})[k] for k in enum if k in counts.get(g, {})}
    from spanweave.model import ENUMS

    doc = {
        "version": VERSION,
        "solution": graph.solution,
        "stats": {
            "nodesByKind": by("node", ENUMS["NodeKind"]),
            "edgesByKind": by("edge", ENUMS["EdgeKind"]),
            "edgesByMechanism": by("mechanism", ENUMS["EdgeMechanism"]),
            "ambiguousNodes": flags.get("ambiguous", 0),
            "utilityNodes": flags.get("utility", 0),
            "rootCount": flags.get("roots", 0),
        },
        "nodes": [json.loads(r["j"]) for r in nodes.toLocalIterator()],
        "edges": [json.loads(r["j"]) for r in edges.toLocalIterator()],
        "diagnostics": notes,
    }
    Path(path).write_text(json.dumps(doc, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_graph(graph: Graph, path: str) -> None:
    """Parquet tables below ``path``: nodes and edges, sorted by id within
    files, diagnostics and one row of meta; for graphs of any size."""
    validate(graph)
    spark = graph.nodes.sparkSession
    graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("fromId").sortWithinPartitions(*canonical_order(graph.edges)).write.mode("overwrite").parquet(f"{path}/edges")
    notes = graph.diagnostics if graph.diagnostics is not None else spark.createDataFrame([], "text string")
    notes.write.mode("overwrite").parquet(f"{path}/diagnostics")
    spark.createDataFrame([(VERSION, graph.solution)], "version int, solution string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_graph(spark: SparkSession, path: str) -> Graph:
    head = spark.read.parquet(f"{path}/meta").first()
    if head is None or head["version"] != VERSION:
        raise BadDocument(f"version {head and head['version']} is not {VERSION}")
    return Graph(spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.schema(EDGE).parquet(f"{path}/edges"), spark.read.parquet(f"{path}/diagnostics"), head["solution"])


def canonical(graph: Graph) -> Graph:
    """The graph in its canonical order."""
    notes = None if graph.diagnostics is None else graph.diagnostics.orderBy("text")
    return Graph(graph.nodes.orderBy("id"), graph.edges.orderBy(*canonical_order(graph.edges)), notes, graph.solution)


def canonical_rank(edges: DataFrame) -> DataFrame:
    """Edges with their sort keys as columns."""
    return edges.withColumn("site", first_site(F.col("callSites"))).withColumn("kindOrdinal", ordinal(F.col("kind"), "EdgeKind")).withColumn("mechanismOrdinal", ordinal(F.col("mechanism"), "EdgeMechanism"))


def register(graph: Graph, prefix: str = "") -> None:
    """Temporary views ``nodes``, ``edges`` and ``diagnostics`` for SQL."""
    graph.nodes.createOrReplaceTempView(f"{prefix}nodes")
    graph.edges.createOrReplaceTempView(f"{prefix}edges")
    if graph.diagnostics is not None:
        graph.diagnostics.createOrReplaceTempView(f"{prefix}diagnostics")


# --- where a graph is, and whether it changed ----------------------------------------------


@dataclass
class Located:
    path: Path | None
    tried: list[str]


def find_graph(given: str | None = None, name: str = "graph.json", markers: tuple[str, ...] = (".git",), cwd: Path | None = None) -> Located:
    """A given path and no other; else the working folder; else the folders
    above it up to the repository's root."""
    tried = []
    if given is not None:
        tried.append(str(Path(given)))
        return Located(Path(given) if Path(given).is_file() else None, tried)
    at = (cwd or Path.cwd()).resolve()
    for folder in (at, *at.parents):
        tried.append(str(folder / name))
        if (folder / name).is_file():
            return Located(folder / name, tried)
        if any((folder / m).exists() for m in markers):
            break
    return Located(None, tried)


@dataclass
class Snapshot:
    graph: Graph
    path: str
    modified_ns: int
    size: int
    loaded_at: float
    load_seconds: float
    n_nodes: int
    n_edges: int


@dataclass
class GraphSource:
    """The graph of a file, read again only if its time or size changed; a
    broken file never replaces the last good graph."""

    spark: SparkSession
    path: str
    current: Snapshot | None = None
    error: str | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def refresh(self) -> Snapshot | None:
        try:
            now = Path(self.path).stat()
        except OSError as e:
            self.error = str(e)
            return self.current
        same = lambda: self.current and (self.current.modified_ns, self.current.size) == (now.st_mtime_ns, now.st_size)
        if same():
            return self.current
        with self._lock:
            if same():
                return self.current
            began = time.perf_counter()
            try:
                graph = read_graph_json(self.spark, self.path)
                graph = Graph(graph.nodes.cache(), graph.edges.cache(), graph.diagnostics.cache(), graph.solution)
                n, m = graph.nodes.count(), graph.edges.count()
            except (BadDocument, InvalidGraph) as e:
                self.error = str(e)
                return self.current
            old, self.error = self.current, None
            self.current = Snapshot(graph, self.path, now.st_mtime_ns, now.st_size, time.time(), time.perf_counter() - began, n, m)
            if old:
                for df in (old.graph.nodes, old.graph.edges, old.graph.diagnostics):
                    df.unpersist()
        return self.current


# --- facts, questions, traces --------------------------------------------------------------


def read_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The facts tables below ``path`` (Parquet); what is missing is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(hadoop)}
    out = {}
    for name, schema in FACTS.items():
        file = next((f for f in (f"{name}.parquet", name) if f in there), None)
        out[name] = spark.read.schema(schema).parquet(f"{path}/{file}") if file else spark.createDataFrame([], schema)
    return out


QUESTION = (
    "id string, question string, category string, selector struct<node:string,direction:string>, population struct<class:string,count:int,representative:boolean,howCounted:string>, "
    "expected struct<columnKind:string,tables:array<struct<name:string,access:string,operation:string,columns:array<string>>>,roots:struct<endpoint:array<string>,consumer:array<string>,backgroundJob:array<string>>,"
    "events:struct<consumedBy:array<string>,publishedBy:array<string>>,externalStores:array<string>,limitations:array<string>,nodes:array<string>>, "
    "expectedToFail array<struct<id:string,closedIn:string>>, notes struct<derivation:string,evidence:array<string>,why:string>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a truth set; comments are allowed, an empty set is not."""
    doc = spark.read.schema(f"questions array<struct<{_fields(QUESTION)}>>").option("multiLine", True).option("allowComments", True).option("mode", "FAILFAST").json(path)
    out = doc.select(F.explode("questions").alias("q")).select("q.*")
    if out.isEmpty():
        raise BadDocument("the question set is empty")
    return out


def _fields(ddl: str) -> str:
    """``name type, ...`` at the outer level as ``name:type,...``."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(ddl[begin:i])
            begin = i + 1
    parts.append(ddl[begin:])
    return ",".join(p.strip().replace(" ", ":", 1) for p in parts)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """question, verdict, sourceEvidence, note; of repeats the last; no file,
    no verdicts."""
    schema = "question string, verdict string, sourceEvidence string, note string"
    if not Path(path).exists():
        return spark.createDataFrame([], schema)
    doc = spark.read.schema(f"verdicts array<struct<{_fields(schema)}>>").option("multiLine", True).option("allowComments", True).json(path)
    each = doc.select(F.posexplode("verdicts").alias("pos", "v")).select("pos", "v.*")
    return each.groupBy("question").agg(F.max_by(F.struct("verdict", "sourceEvidence", "note"), "pos").alias("v")).select("question", "v.*")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """trace_id (file), text: one whole text per file."""
    return spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("trace_id"), F.col("value").alias("text"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """package, version of the libraries of a dependency file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "libraries map<string,struct<type:string>>").alias("d"))
    key = doc.select(F.explode(F.map_keys("d.libraries")).alias("k"))
    return key.select(package_name(F.col("k")).alias("package"), package_version(F.col("k")).alias("version"))


MODEL = (
    "version int, snapshots array<struct<contextClrTypeName:string,defaultSchema:string,entities:array<struct<clrTypeName:string,schema:string,tableName:string,ownerClrTypeName:string,isMappedToJson:boolean,"
    "properties:array<struct<name:string,columnName:string,jsonPropertyName:string,declaringClrTypeName:string,isShadow:boolean,isRowVersion:boolean,storeType:string,complexPropertyName:string,complexPropertyOwnerClrTypeName:string>>>>>>"
)


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ef_entities, ef_properties) facts of a versioned model payload."""
    doc = _whole(spark, path, MODEL)
    head = doc.select("version").first()
    if head is None or head["version"] != 1:
        raise BadDocument(f"model version {head and head['version']} is not 1")
    each = doc.select(F.explode("snapshots").alias("s")).select(F.col("s.contextClrTypeName").alias("context"), F.col("s.defaultSchema").alias("ds"), F.explode("s.entities").alias("e"))
    entities = each.select("context", F.col("e.clrTypeName").alias("clr_name"), F.coalesce("e.schema", "ds").alias("schema"), F.col("e.tableName").alias("table"), F.col("e.ownerClrTypeName").alias("owner_clr"), F.col("e.isMappedToJson").alias("mapped_to_json"))
    p = each.select("context", F.col("e.clrTypeName").alias("clr_name"), F.explode("e.properties").alias("p"))
    names = dict(name="name", columnName="column", jsonPropertyName="json_name", declaringClrTypeName="declaring_clr", isShadow="shadow", isRowVersion="row_version", storeType="store_type", complexPropertyName="complex_name", complexPropertyOwnerClrTypeName="complex_owner")
    return entities, p.select("context", "clr_name", *[F.col(f"p.{k}").alias(v) for k, v in names.items()])


def write_model(entities: DataFrame, properties: DataFrame, path: str) -> None:
    """The payload of model facts, as text of one JSON document per part."""
    names = dict(name="name", column="columnName", json_name="jsonPropertyName", declaring_clr="declaringClrTypeName", shadow="isShadow", row_version="isRowVersion", store_type="storeType", complex_name="complexPropertyName", complex_owner="complexPropertyOwnerClrTypeName")
    p = properties.groupBy("context", "clr_name").agg(F.array_sort(F.collect_list(F.struct(*[F.col(k).alias(v) for k, v in names.items()]))).alias("properties"))
    e = entities.join(p, ["context", "clr_name"], "left")
    item = F.struct(F.col("clr_name").alias("clrTypeName"), "schema", F.col("table").alias("tableName"), F.col("owner_clr").alias("ownerClrTypeName"), F.col("mapped_to_json").alias("isMappedToJson"), "properties")
    snaps = e.groupBy("context").agg(F.array_sort(F.collect_list(item)).alias("entities")).select(F.struct(F.col("context").alias("contextClrTypeName"), "entities").alias("s"))
    doc = snaps.agg(F.array_sort(F.collect_list("s")).alias("snapshots")).select(F.to_json(F.struct(F.lit(1).alias("version"), "snapshots")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_commits(text: DataFrame) -> DataFrame:
    """file, seq, sha, subject of log lines (file, seq, line)."""
    from spanweave.functions.text import commit_sha, commit_subject

    return text.where(F.trim("line") != "").select("file", "seq", commit_sha(F.trim("line")).alias("sha"), commit_subject(F.trim("line")).alias("subject"))


def git_commits(spark: SparkSession, root: str, files: list[str], most: int = 5, seconds: int = 20) -> DataFrame:
    """The latest commits of some files of a repository, asked of git on the
    driver; what fails for one file is its one row without a sha."""
    import subprocess

    rows = []
    for file in sorted(set(files)):
        try:
            got = subprocess.run(["git", "-C", root, "log", f"--max-count={int(most)}", "--oneline", "--", file], capture_output=True, text=True, timeout=seconds, check=True)
            rows += [(file, i, line) for i, line in enumerate(got.stdout.splitlines())]
        except (OSError, subprocess.SubprocessError) as e:
            rows.append((file, 0, f" {type(e).__name__}"))
    return read_commits(spark.createDataFrame(rows, "file string, seq int, line string"))


def count_project_lines(spark: SparkSession, path: str) -> int:
    """Projects that a solution file names."""
    return spark.read.text(path).where(F.contains("value", F.lit(".csproj"))).count()
