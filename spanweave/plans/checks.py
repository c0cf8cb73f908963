"""Queries over gates, merges and text functions, on tables shaped from the
sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.operators import evals, link, modules, traces, traverse
from spanweave.plans import fixtures
from spanweave.plans.queries import _graph, _graph_sql, _reach_sql, query


def _t(spark, sf_dir, name: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, name)


# --- gates ---------------------------------------------------------------------------------------


@query("preflight_problems", "SELECT 'c' || c_custkey AS context, CASE WHEN c_acctbal < 0 THEN 'context could not be read' WHEN c_nationkey % 3 = 0 THEN 'fewer entities than declared' WHEN c_nationkey % 3 = 1 THEN 'more entities than declared' ELSE 'context has no table' END AS problem FROM customer WHERE c_acctbal < 0 OR c_nationkey % 3 < 2 OR c_custkey % 2 = 0")
def preflight_problems(spark, sf_dir):
    k = F.col("c_nationkey") % 3
    rows = _t(spark, sf_dir, "customer").select(fixtures.key("c", "c_custkey").alias("context"), F.lit(5).alias("declared"), F.when(k == 0, 4).when(k == 1, 6).otherwise(5).alias("loaded"), (F.col("c_acctbal") < 0).alias("failed"), (F.col("c_custkey") % 2).alias("tables"))
    return link.preflight(rows)


@query("version_skew", "SELECT 'p' || p_partkey AS package FROM part WHERE p_size % 5 <> p_partkey % 3 OR p_partkey % 7 < 3")
def version_skew(spark, sf_dir):
    """The target is size % 5 . 1 . 3, the loaded version key % 3 . 1 . key % 7."""
    p = _t(spark, sf_dir, "part")
    target = p.select(fixtures.key("P", "p_partkey").alias("package"), F.array((F.col("p_size") % 5).cast("int"), F.lit(1), F.lit(3)).alias("version"))
    loaded = p.select(fixtures.key("p", "p_partkey").alias("package"), F.array((F.col("p_partkey") % 3).cast("int"), F.lit(1), (F.col("p_partkey") % 7).cast("int")).alias("version"))
    return link.version_skew(target, loaded).select("package")


@query("stale_output", "WITH s AS (SELECT o_custkey AS k, max(o_orderdate) AS at FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT 'c' || s.k AS project FROM s LEFT JOIN b USING (k) WHERE b.at IS NULL OR s.at > b.at")
def stale_output(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(fixtures.key("c", "o_custkey").alias("project"), F.col("o_orderdate").alias("modified"), "o_orderstatus")
    return link.stale_output(o, o.where("o_orderstatus = 'F'"))


@query("compile_check", "SELECT o_custkey AS project, count(*) FILTER (o_orderstatus = 'F') AS errors, count(*) FILTER (o_orderstatus = 'O') AS warnings FROM orders GROUP BY 1")
def compile_check(spark, sf_dir):
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), severity.alias("severity"), fixtures.key("order ", "o_orderkey").alias("text"))
    return link.compile_check(rows).select("project", "errors", "warnings")


@query("compile_samples", "WITH r AS (SELECT o_custkey AS project, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity, 'order ' || o_orderkey AS text FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY severity, text) AS n FROM r) SELECT project, string_agg(text, ',' ORDER BY text) AS samples FROM n WHERE n <= 3 GROUP BY project")
def compile_samples(spark, sf_dir):
    """The first three messages of each project, errors first."""
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), severity.alias("severity"), fixtures.key("order ", "o_orderkey").alias("text"))
    return link.compile_check(rows).select("project", F.array_join("samples", ",").alias("samples"))


@query("load_diagnostics", "SELECT CASE WHEN event_type = 'error' THEN 'failure' ELSE 'warning' END AS kind, event_type AS message, count(*) AS n FROM events GROUP BY 1, 2")
def load_diagnostics(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failure").otherwise("warning").alias("kind"), F.col("event_type").alias("message"))
    return link.load_diagnostics(e)


# --- merges --------------------------------------------------------------------------------------


@query("node_merge", "SELECT 's' || l_suppkey AS id, bool_or(l_returnflag = 'R') AS ambiguous, CAST(min(l_linenumber) AS INTEGER) AS depth, arg_min(l_linestatus, (l_linenumber, l_linestatus, l_orderkey)) AS \"module\" FROM lineitem GROUP BY l_suppkey")
def node_merge(spark, sf_dir):
    n = F.lit(None).cast("string")
    rows = _t(spark, sf_dir, "lineitem").select(
        fixtures.key("s", "l_suppkey").alias("id"), F.lit("Method").alias("kind"), n.alias("displayName"), F.col("l_linestatus").alias("module"), F.col("l_linestatus").alias("filePath"), F.col("l_orderkey").cast("int").alias("line"),
        (F.col("l_returnflag") == "R").alias("ambiguous"), F.lit(False).alias("truncated"), F.lit(False).alias("utility"), F.col("l_linenumber").cast("int").alias("depth"), F.lit("None").alias("rootKind"),
    )
    return link.merge_nodes(rows).select("id", "ambiguous", "depth", "module")


@query("overlay_edge_dedupe", "SELECT 's' || l_suppkey AS fromId, 'p' || l_partkey AS toId, l_returnflag AS mechanism, min(l_linestatus) AS evidence, bool_or(l_linenumber = 1) AS ambiguous FROM lineitem GROUP BY 1, 2, 3")
def overlay_edge_dedupe(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(fixtures.key("s", "l_suppkey").alias("fromId"), fixtures.key("p", "l_partkey").alias("toId"), F.lit("Writes").alias("kind"), F.col("l_linestatus").alias("evidence"), (F.col("l_linenumber") == 1).alias("ambiguous"), F.col("l_returnflag").alias("mechanism"), F.array().cast(f"array<{link.SITE}>").alias("callSites"))
    return link.merge_edges(rows, by_mechanism=True).select("fromId", "toId", "mechanism", "evidence", "ambiguous")


@query("root_stamps", "WITH r AS (SELECT o_custkey AS k, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS v FROM orders GROUP BY 1) SELECT 'endpoint:c' || c_custkey AS id, CASE v WHEN 3 THEN 'BackgroundService' WHEN 2 THEN 'Consumer' ELSE 'Endpoint' END AS rootKind FROM customer LEFT JOIN r ON k = c_custkey")
def root_stamps(spark, sf_dir):
    """A background service over a consumer over an endpoint."""
    kind = F.when(F.col("o_orderstatus") == "F", "BackgroundService").when(F.col("o_orderstatus") == "O", "Consumer").otherwise("Endpoint")
    roots = _t(spark, sf_dir, "orders").select(kind.alias("kind"), fixtures.key("endpoint:c", "o_custkey").alias("id"))
    return link.stamp_roots(_graph(spark, sf_dir).nodes.where("kind = 'Endpoint'"), roots).select("id", "rootKind")


@query("breakdown_merge", "SELECT c_mktsegment AS module, 'N' || c_nationkey AS layer, count(*) + coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'), 0) AS n FROM customer GROUP BY c_mktsegment, c_nationkey UNION ALL SELECT 'BUILDING', 'N' || s_nationkey, count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY s_nationkey")
def breakdown_merge(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("module"), fixtures.key("N", "c_nationkey").alias("layer")).agg(F.count("*").alias("n"))
    b = _t(spark, sf_dir, "supplier").groupBy(F.lit("BUILDING").alias("module"), fixtures.key("N", "s_nationkey").alias("layer")).agg(F.count("*").alias("n"))
    return modules.merge_breakdowns(a, b)


@query("limitation_merge", "WITH a AS (SELECT o_custkey AS q, 'late' AS code, 'o' || o_orderkey AS place, 'of orders' AS message, 0 AS s FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'late' ELSE 'rich' END, 'c' || c_custkey, 'of customers', 1 FROM customer) SELECT 'q' || q AS qid, code, arg_min(message, s) AS message, string_agg(DISTINCT place, ',' ORDER BY place) AS places FROM a GROUP BY q, code")
def limitation_merge(spark, sf_dir):
    """Two lists of limits put together: places joined, the first message."""
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(fixtures.key("q", "o_custkey").alias("qid")).agg(F.collect_list(fixtures.key("o", "o_orderkey")).alias("locations")).select("qid", F.lit("late").alias("code"), F.lit("of orders").alias("message"), "locations")
    c = _t(spark, sf_dir, "customer").select(fixtures.key("q", "c_custkey").alias("qid"), F.when(F.col("c_acctbal") < 0, "late").otherwise("rich").alias("code"), F.lit("of customers").alias("message"), F.array(fixtures.key("c", "c_custkey")).alias("locations"))
    return traces.merge_limitations(o, c).select("qid", "code", "message", F.array_join("locations", ",").alias("places"))


# --- graph odds and ends -------------------------------------------------------------------------


@query("shared_dependents", f"{_graph_sql()} SELECT f.module, count(*) AS n FROM edges e JOIN nodes f ON f.id = e.fromId JOIN nodes t ON t.id = e.toId WHERE t.module = 'Shared' AND f.module <> 'Shared' GROUP BY 1")
def shared_dependents(spark, sf_dir):
    return modules.shared_dependents(_graph(spark, sf_dir))


@query("event_consumers", f"{_graph_sql()} SELECT DISTINCT e.fromId AS event, n.displayName AS consumer FROM edges e JOIN nodes n ON n.id = e.toId WHERE e.kind = 'Consumes'")
def event_consumers(spark, sf_dir):
    return modules.event_consumers(_graph(spark, sf_dir)).distinct()


@query("reaches_data", f"WITH RECURSIVE {_graph_sql()[5:]}, walk(id) AS (SELECT id FROM nodes WHERE kind = 'Table' UNION SELECT e.fromId FROM walk JOIN edges e ON e.toId = walk.id) SELECT id FROM walk")
def reaches_data(spark, sf_dir):
    return traverse.reaches_data(_graph(spark, sf_dir), ("Table",))


@query("induced_edges_no_utility", f"{_reach_sql()}, kept AS (SELECT r.id FROM reach r JOIN nodes n ON n.id = r.id WHERE NOT n.utility OR r.id = 'endpoint:c0') SELECT e.fromId, e.toId, e.kind, e.mechanism FROM edges e JOIN reach r ON r.id = e.fromId WHERE r.depth < 20 AND e.fromId IN (SELECT id FROM kept) AND e.toId IN (SELECT id FROM kept)")
def induced_edges_no_utility(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return traverse.subgraph(g, traverse.start(g, "endpoint:c0"), query=traverse.TraversalQuery(include_utility=False)).edges.select("fromId", "toId", "kind", "mechanism")


@query("point_lookup", f"{_graph_sql()} SELECT id, kind, displayName FROM nodes WHERE id = 'event:n3'")
def point_lookup(spark, sf_dir):
    return traverse.find(_graph(spark, sf_dir), "event:n3").select("id", "kind", "displayName")


@query("canonical_sites", f"{_graph_sql()} SELECT fromId, min(toId) AS toId FROM edges WHERE kind = 'Calls' GROUP BY fromId")
def canonical_sites(spark, sf_dir):
    """The first call of each node in the canonical order, which goes by the far
    end first, so the rest of it need not be sorted."""
    return _graph(spark, sf_dir).edges.where("kind = 'Calls'").groupBy("fromId").agg(F.min("toId").alias("toId"))


# --- matching and text ---------------------------------------------------------------------------


@query("suffix_matches", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Cache' ELSE '' END AS missing, CASE WHEN c_custkey % 2 = 0 THEN 'C.Db' ELSE '' END AS rest FROM customer")
def suffix_matches(spark, sf_dir):
    """Wanted names take actual ones that end with them, each one once."""
    c = _t(spark, sf_dir, "customer")
    wanted = F.concat(F.array(F.lit("Db"), F.lit("Db")), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Cache"))).otherwise(F.array().cast("array<string>")))
    actual = F.concat(F.array(F.lit("B.Db"), F.lit("A.Db")), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("C.Db"))).otherwise(F.array().cast("array<string>")))
    m = c.select(F.col("c_custkey").alias("k"), evals.suffix_match(wanted, actual).alias("m"))
    return m.select("k", F.array_join("m.missing", ",").alias("missing"), F.array_join("m.rest", ",").alias("rest"))


@query("repo_roots", "SELECT 't' || s_suppkey AS trace_id, 'C:/work/r' || (s_suppkey % 4) AS root FROM supplier WHERE s_suppkey % 5 <> 0")
def repo_roots(spark, sf_dir):
    """What is left of a frame's file without the file's path in the graph."""
    s = _t(spark, sf_dir, "supplier")
    tail = F.concat(F.lit("Src\\N"), "s_nationkey", F.lit("\\S"), "s_suppkey", F.lit(".cs"))
    frames = s.select(fixtures.key("t", "s_suppkey").alias("trace_id"), F.concat(F.lit("C:\\work\\r"), F.col("s_suppkey") % 4, F.lit("\\"), tail).alias("file"))
    files = s.where("s_suppkey % 5 <> 0").select(F.lower(F.translate(tail, "\\", "/")).alias("filePath"))
    return traces.repo_root(frames, files)


@query("diagnostic_hits", f"{_graph_sql()} SELECT 't' || s.s_suppkey AS trace_id, n_nationkey AS line, n_nationkey > 0 AND n_nationkey = s.s_suppkey AS exact FROM supplier s, nation WHERE s.s_nationkey % 2 = 0")
def diagnostic_hits(spark, sf_dir):
    """Diagnostics that name the file of an error point, and those of its line."""
    g = _graph(spark, sf_dir)
    points = _t(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(fixtures.key("t", "s_suppkey").alias("trace_id"), F.lit("event:n1").alias("node"), F.col("s_suppkey").cast("int").alias("line"))
    return traces.diagnostic_hits(g, points).select("trace_id", F.col("line").cast("long").alias("line"), "exact")


@query("commit_lines", "SELECT event_id AS k, 'c' || event_id AS sha, CASE WHEN user_id % 3 = 0 THEN '' ELSE event_type || ' of user ' || user_id END AS subject FROM events")
def commit_lines(spark, sf_dir):
    line = F.concat(fixtures.key("c", "event_id"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" of user "), "user_id")))
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("k"), line.alias("line"))
    return rows.select("k", X.commit_sha(F.col("line")).alias("sha"), X.commit_subject(F.col("line")).alias("subject"))


@query("access_letters", "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 'RW' WHEN 'A' THEN 'R' ELSE '' END AS access FROM lineitem")
def access_letters(spark, sf_dir):
    written = F.when(F.col("l_returnflag") == "R", "w, r").when(F.col("l_returnflag") == "A", " r ").otherwise("-")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), X.access_letters(written).alias("access"))


@query("project_classes", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Shared' WHEN 2 THEN 'Host' ELSE 'unknown' END AS module, CASE WHEN c_custkey % 4 = 0 THEN 'Domain' END AS layer, c_custkey % 8 = 0 AS is_test FROM customer")
def project_classes(spark, sf_dir):
    """Module, layer and test flag of a project by its path and name."""
    k = F.col("c_custkey") % 4
    test = F.when(F.col("c_custkey") % 8 == 0, "tests/").otherwise("src/")
    path = F.when(k == 0, F.concat(test, F.lit("Modules/"), "c_mktsegment", F.lit("/x.csproj"))).when(k == 1, "src/Shared/x.csproj").when(k == 2, "src/Bootstrapper/x.csproj").otherwise("lib\\other\\x.csproj")
    name = F.when(k == 0, F.concat(F.lit("Shop."), "c_mktsegment", F.lit(".Domain"))).otherwise("Shop.Other")
    facts = X.project_facts(path, name)
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *[facts[c].alias(c) for c in ("module", "layer", "is_test")])


@query("generated_files", "SELECT p_partkey AS k, p_partkey % 4 < 3 AS generated, CASE WHEN p_partkey % 4 = 0 THEN 'src/Migrations/' || p_partkey || '.cs' WHEN p_partkey % 4 = 1 THEN 'a.Designer.cs' WHEN p_partkey % 4 = 2 THEN 'b/DbModelSnapshot.cs' ELSE 'c/Plain.cs' END AS file FROM part")
def generated_files(spark, sf_dir):
    """Generated code, and files below the root of a repository."""
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("C:\\repo\\src\\Migrations\\"), "p_partkey", F.lit(".cs"))).when(k == 1, "a.Designer.cs").when(k == 2, "C:/repo/b/DbModelSnapshot.cs").otherwise("C:/repo/c/Plain.cs")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.generated_code(path).alias("generated"), X.relative_file(path, "C:\\repo").alias("file"))


@query("package_versions", "SELECT p_partkey AS k, 'Lib.P' || p_partkey AS package, p_size || '.0.' || (p_partkey % 9) AS version FROM part")
def package_versions(spark, sf_dir):
    key = F.concat(F.lit("Lib.P"), "p_partkey", F.lit("/"), "p_size", F.lit(".x."), F.col("p_partkey") % 9, F.lit("-beta.1"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.package_name(key).alias("package"), F.array_join(X.package_version(key).cast("array<string>"), ".").alias("version"))


@query("source_files", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'a/b' || p_partkey || '.cs,c.cs' WHEN p_partkey % 3 = 1 THEN 'c.cs' ELSE '' END AS files FROM part")
def source_files(spark, sf_dir):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("see a/b"), "p_partkey", F.lit(".cs:12 and c.cs:3 and c.cs:4"))).when(k == 1, "c.cs:9").otherwise("no file.cs here")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(X.source_files(text), ",").alias("files"))
