"""Text of diagrams, pages and reports.

Diagram text is made by DataFrame functions, for many diagrams at once; pages
are rows of (path, content), so any sink can write them.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.text import diagram_link, slug
from spanweave.model import Graph, ordinal
from spanweave.operators.contract import FlowDiagram, call_steps, shown_numbers
from spanweave.tables import stored


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, '"', "#quot;"), r"[\r\n]+", " ")


def _shape(kind: Column, name: Column) -> Column:
    q = lambda a, b: F.concat(F.lit(a + '"'), name, F.lit('"' + b))
    return F.when(kind == "Endpoint", q("([", "])")).when(kind == "Table", q("[(", ")]")).when(kind == "Event", q("{{", "}}")).when(kind == "ExternalCall", q("[[", "]]")).otherwise(q("[", "]"))


def flow_text(d: FlowDiagram) -> DataFrame:
    """qid, code, link: one diagram per query; ids ``n0`` onwards by node id,
    top-down while no node has more than seven edges."""
    num = F.concat(F.lit("n"), (F.row_number().over(Window.partitionBy("qid").orderBy("id")) - 1).cast("string"))
    nodes = stored(d.nodes.withColumn("n", num), "shown")
    lines = nodes.select("qid", F.lit(1).alias("part"), F.col("id").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("    "), "n", _shape(F.col("kind"), escape(F.col("displayName")))).alias("line"))
    ids = nodes.select("qid", "id", "n")
    steps = shown_numbers(d.edges).select("qid", "fromId", "toId", "step")
    e = d.edges.join(steps, ["qid", "fromId", "toId"], "left")
    e = e.join(ids.toDF("qid", "fromId", "a"), ["qid", "fromId"]).join(ids.toDF("qid", "toId", "b"), ["qid", "toId"])
    words = F.concat_ws(" · ", F.col("step").cast("string"), F.nullif("label", F.lit("")))
    arrow = F.when(F.col("kind") == "Async", "-.->").when(F.col("kind") == "Data", "==>").otherwise("-->")
    label = F.when(words != "", F.concat(F.lit('|"'), escape(words), F.lit('"|'))).otherwise("")
    lines = lines.unionByName(e.select("qid", F.lit(2).alias("part"), F.col("fromId").alias("k1"), F.col("toId").alias("k2"), F.concat(F.lit("    "), "a", F.lit(" "), arrow, label, F.lit(" "), "b").alias("line")))
    noted = nodes.where("noted").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("ns"))
    lines = lines.unionByName(noted.select("qid", F.lit(3).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("    class "), "ns", F.lit(" noted")).alias("line")))
    fan = d.edges.groupBy("qid", "fromId").count().groupBy("qid").agg(F.max("count").alias("fan"))
    body = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k1", "k2", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(F.coalesce("fan", F.lit(0)) <= 7, "flowchart TD").otherwise("flowchart LR")
    code = F.concat(head, F.lit("\n    classDef noted stroke-dasharray: 4 3\n"), "body", F.lit("\n"))
    return body.join(fan, "qid", "left").select("qid", code.alias("code")).withColumn("link", diagram_link("code"))


def module_text(deps: DataFrame) -> DataFrame:
    """code: the module graph; targets of direct edges are marked."""
    names = deps.select(F.explode(F.array("from", "to")).alias("m")).distinct()
    n = names.withColumn("n", F.concat(F.lit("m"), (F.row_number().over(Window.orderBy("m")) - 1).cast("string")))  # one row a module
    n = stored(n, "names")
    arrow = F.when(F.col("kind") == "Event", "-.->").when(F.col("kind") == "Direct", "==>").otherwise("-->")
    e = deps.join(n.toDF("from", "a"), "from").join(n.toDF("to", "b"), "to")
    lines = n.select(F.lit(1).alias("part"), F.col("m").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("    "), "n", F.lit('["'), escape(F.col("m")), F.lit('"]')).alias("line"))
    lines = lines.unionByName(e.select(F.lit(2).alias("part"), F.col("from").alias("k1"), F.concat("to", F.lit("|"), "kind").alias("k2"), F.concat(F.lit("    "), "a", F.lit(" "), arrow, F.lit("|"), F.lower("kind"), F.lit(" "), F.col("n").cast("string"), F.lit("| "), "b").alias("line")))
    marks = e.where("kind = 'Direct'").select("b").distinct()
    lines = lines.unionByName(marks.select(F.lit(3).alias("part"), F.col("b").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("    class "), "b", F.lit(" direct")).alias("line")))
    return lines.agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k1", "k2", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("code"))


# --- pages ----------------------------------------------------------------------------------


def _bullets(rows: DataFrame, key: str, order: list, line: Column, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n").alias(name))


def flow_pages(graph: Graph, d: FlowDiagram, tables: DataFrame, limits: DataFrame) -> DataFrame:
    """path, content: a page per flow: diagram, steps, data, what is hidden,
    limits and a link."""
    title = d.nodes.join(graph.nodes.select("id"), "id").where(F.col("qid") == F.col("id")).select("qid", F.col("displayName").alias("title"), "module", "location")
    text = flow_text(d)
    steps = call_steps(d.edges).where("step is not null").join(graph.nodes.select(F.col("id").alias("toId"), F.col("displayName").alias("to")), "toId")
    steps = _bullets(steps, "qid", ["fromId", "step", "toId"], F.concat(F.col("step").cast("string"), F.lit(". "), "to"), "steps")
    data = _bullets(tables, "qid", ["table"], F.concat(F.lit("| "), "table", F.lit(" | "), "access", F.lit(" | "), F.array_join(F.transform("columns", lambda c: c["column"]), ", "), F.lit(" |")), "data")
    lim = _bullets(limits, "qid", ["seq"], F.concat(F.lit("- "), "code", F.lit(": "), "message"), "limits")
    hid = d.hidden.select("qid", F.format_string("%d steps, %d utilities, %d interfaces and %d branches without data are not drawn (of %d nodes).", "intermediate", "utility", "interfaces", "dataless", "total").alias("hidden"))
    page = title.join(text, "qid").join(steps, "qid", "left").join(data, "qid", "left").join(lim, "qid", "left").join(hid, "qid", "left")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {head}\n\n"), c, F.lit("\n"))).otherwise("")
    table = F.when(F.col("data").isNotNull(), F.concat(F.lit("\n## Data\n\n| Table | Access | Columns |\n|---|---|---|\n"), "data", F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("# "), "title", F.lit("\n\n"), "module", F.lit(", "), "location", F.lit("\n\n```mermaid\n"), "code", F.lit("```\n"), part("Calls in order", "steps"), table, part("Not drawn", "hidden"), part("Limits", "limits"), F.lit("\n[Open the diagram]("), "link", F.lit(")\n"))
    return page.select(F.concat(F.lit("flows/"), slug(F.col("title")), F.lit(".md")).alias("path"), content.alias("content"), "qid", "title", "module")


def module_pages(rollup: DataFrame, deps: DataFrame) -> DataFrame:
    out = _bullets(deps, "from", ["to", "kind"], F.concat(F.lit("- to "), "to", F.lit(" ("), F.lower("kind"), F.lit(", "), F.col("n").cast("string"), F.lit(")")), "out").withColumnRenamed("from", "module")
    in_ = _bullets(deps, "to", ["from", "kind"], F.concat(F.lit("- from "), "from", F.lit(" ("), F.lower("kind"), F.lit(", "), F.col("n").cast("string"), F.lit(")")), "in").withColumnRenamed("to", "module")
    r = rollup.join(out, "module", "left").join(in_, "module", "left")
    content = F.concat(
        F.lit("# "), "module", F.format_string("\n\n%d endpoints, %d with data; %d tables; %d events.\n", "endpoints", "with_data", "tables", "events"), F.lit("\n## Depends on\n\n"), F.coalesce("out", F.lit("nothing")), F.lit("\n\n## Used by\n\n"), F.coalesce("in", F.lit("nothing")), F.lit("\n")
    )
    return r.select(F.concat(F.lit("modules/"), "module", F.lit(".md")).alias("path"), content.alias("content"))


def index_page(flows: DataFrame) -> DataFrame:
    body = flows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("module", "title", "path"))), lambda x: F.concat(F.lit("- "), x["module"], F.lit(": ["), x["title"], F.lit("]("), x["path"], F.lit(")"))), "\n").alias("b"))
    return body.select(F.lit("README.md").alias("path"), F.concat(F.lit("# Flows\n\n"), "b", F.lit("\n")).alias("content"))


def write_pages(pages: DataFrame, folder: str) -> int:
    """Write rows of (path, content) below a folder of the driver."""
    n = 0
    for r in pages.select("path", "content").toLocalIterator():
        at = Path(folder) / r["path"]
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(r["content"], encoding="utf-8", newline="\n")
        n += 1
    return n


def docs_site(graph: Graph, folder: str, module: str | None = None) -> int:
    """Pages of all endpoints, or of one module's; only the whole site has
    module pages and an index."""
    from spanweave.operators import answers, contract, modules
    from spanweave.model import TraversalQuery

    ends = graph.nodes.where("kind = 'Endpoint'")
    if module is not None:
        ends = ends.where(F.lower("module") == module.lower())
    starts = ends.select(F.col("id").alias("qid"), "id")
    d = contract.flow_diagram(graph, starts)
    layer = answers.data_layer(d.sub.nodes, d.sub.edges)
    flows = stored(flow_pages(graph, d, layer, answers.limitations(graph, d.sub, "Forward", TraversalQuery())), "pages")
    n = write_pages(flows, folder)
    if module is None:
        deps = stored(modules.dependencies(graph), "dependencies")
        n += write_pages(module_pages(modules.rollup(graph), deps), folder)
        dep = module_text(deps).select(F.lit("modules/dependencies.md").alias("path"), F.concat(F.lit("# Dependencies\n\n```mermaid\n"), "code", F.lit("```\n")).alias("content"))
        n += write_pages(dep.unionByName(index_page(flows)), folder)
    return n


# --- reports -----------------------------------------------------------------------------------


def _table(rows: list, head: list[str]) -> str:
    cell = lambda x: "—" if x is None else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)])


def percent(x: float | None) -> str | None:
    return None if x is None else f"{100 * x:.1f} %"


def eval_report(metrics: DataFrame, evidence: DataFrame, categories: DataFrame, boxes: DataFrame, meta: DataFrame, results: DataFrame, unresolved: DataFrame, verdicts: DataFrame) -> str:
    """Markdown of a scored run."""
    m = [(r["facet"], r["scope"], f"{r['found']}/{r['expected']}", percent(r["recall"]), percent(r["precision"])) for r in metrics.orderBy("ordinal", "scope").collect()]
    e = evidence.first().asDict()
    c = [(r["class"], r["questions"], r["misses"], r["false_positives"]) for r in categories.collect()]
    b = [(r["row"], r["realised"], r["n"], ", ".join(r["ids"])) for r in boxes.orderBy("row", F.desc("realised")).collect()]
    q = [(r["qid"], r["node"], r["misses"], r["false_positives"], r["verdict"]) for r in results.orderBy("qid").collect()]
    t = [(r["limit"], ", ".join(r["questions"]), r["reason"]) for r in meta.orderBy("family", "number").collect()]
    u = [(r["id"], r["selector"]) for r in unresolved.orderBy("id").collect()]
    v = [(r["verdict"], r["n"]) for r in verdicts.orderBy("verdict").collect()]
    parts = [
        ("Metrics", _table(m, ["facet", "scope", "found", "recall", "precision"])), ("Evidence", _table(sorted(e.items()), ["outcome", "n"])), ("Categories", _table(c, ["class", "questions", "misses", "false positives"])),
        ("Predictions", _table(b, ["row", "realised", "n", "questions"])), ("Questions", _table(q, ["id", "node", "misses", "false positives", "verdict"])), ("Known limits", _table(t, ["limit", "questions", "reason"])),
        ("Not measurable", _table(u, ["id", "selector"])), ("Verdicts", _table(v, ["verdict", "n"])), ("Scope", "Inside: the mapper itself reads or writes the table."),
    ]
    return "# Evaluation\n\n" + "\n\n".join(f"## {h}\n\n{x}" for h, x in parts) + "\n"


def triage_report(t, trace_id: str) -> str:
    """Markdown of one incident; every frame has a row."""
    one = lambda df, key="trace_id": df.where(F.col(key) == trace_id)
    head, counts, point = one(t.headers).first(), one(t.counts).first(), one(t.points).first()
    rows = [(r["idx"], r["key"], r["verdict"], r["node"], f"{r['file']}:{r['line']}" if r["file"] else None) for r in one(t.frames).orderBy("idx").collect()]
    links = [(r["caller"], r["callee"], r["verdict"], r["via"] or ", ".join(map(str, r["known_lines"])) or " > ".join(r["route"])) for r in one(t.links).orderBy("callee").collect()]
    roots = [(r["rootKind"], x["displayName"], x["depth"]) for r in one(t.backward.entry_points, "qid").orderBy("ordinal").collect() for x in r["roots"]]
    down = [(r["table"], r["access"], len(r["columns"])) for r in one(t.forward.tables, "qid").orderBy("table").collect()]
    lims = [(r["code"], r["message"]) for r in one(t.limitations, "qid").orderBy("code").collect()]
    diag = [(r["exact"], r["text"]) for r in one(t.diagnostics).orderBy(F.desc("exact"), "line", "text").collect()]
    log = [(r["file"], r["sha"], r["subject"]) for r in t.history.orderBy("file", "seq").collect()] if t.history is not None else []
    at = f"{point['node']}, line {point['line']}" if point else one(t.reasons).first()["reason"]
    parts = [
        ("Input", _table([(k, v) for k, v in counts.asDict().items() if k != "trace_id"] if counts else [], ["what", "n"])), ("Error point", at), ("Frames", _table(rows, ["#", "frame", "verdict", "node", "place"])),
        ("Links", _table(links, ["caller", "callee", "verdict", "detail"])), ("Entry points", _table(roots, ["kind", "name", "depth"])), ("Downstream", _table(down, ["table", "access", "columns"])),
        ("Limits", _table(lims, ["code", "message"])), ("Diagnostics", _table(diag, ["exact line", "text"])), ("Commits", _table(log, ["file", "sha", "subject"])),
    ]
    title = f"{head['type']}: {head['message']}" if head else trace_id
    return f"# {title}\n\n" + "\n\n".join(f"## {h}\n\n{x}" for h, x in parts) + "\n"


def eval_json(metrics: DataFrame, evidence: DataFrame, categories: DataFrame, boxes: DataFrame, meta: DataFrame, results: DataFrame, unresolved: DataFrame, verdicts: DataFrame) -> DataFrame:
    """section, n, json: the rows of a scored run as JSON, one row each, in
    the order of the sections and of their rows."""
    parts = {
        "metrics": (metrics, ["ordinal", "scope"]), "evidence": (evidence, []), "categories": (categories, ["class"]), "predictions": (boxes, ["row", "realised"]), "meta": (meta, ["family", "number"]),
        "questions": (results, ["qid"]), "unresolved": (unresolved, ["id"]), "verdicts": (verdicts, ["verdict"]),
    }
    return _json_rows(parts)


def triage_json(t) -> DataFrame:
    """section, trace_id, n, json: the rows of all incidents as JSON."""
    parts = {
        "headers": (t.headers, []), "points": (t.points, []), "reasons": (t.reasons, []), "counts": (t.counts, []), "frames": (t.frames, ["idx"]), "links": (t.links, ["callee"]),
        "diagnostics": (t.diagnostics, ["line", "text"]), "limitations": (t.limitations.withColumnRenamed("qid", "trace_id"), ["code"]), "tables": (t.forward.tables.withColumnRenamed("qid", "trace_id"), ["table"]),
        "entryPoints": (t.backward.entry_points.withColumnRenamed("qid", "trace_id"), ["ordinal"]),
    }
    return _json_rows(parts, "trace_id")


def _json_rows(parts: dict[str, tuple[DataFrame, list[str]]], key: str | None = None) -> DataFrame:
    out = None
    for name, (df, order) in parts.items():
        own = [key] if key else []
        n = F.row_number().over(Window.partitionBy(*(own or [F.lit(0)])).orderBy(*(order or [F.lit(0)])))
        rows = df.select(F.lit(name).alias("section"), *own, n.alias("n"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def trace_text(answer) -> str:
    """A traced flow as text: nodes by kind, then the data layer."""
    out = []
    for r in answer.nodes.orderBy(ordinal(F.col("kind"), "NodeKind"), "depth", "displayName", "id").select("kind", "depth", "displayName", "module").toLocalIterator():
        out.append(f"{r['kind']:<13}{r['depth']:>3}  {r['displayName']}  [{r['module']}]")
    if answer.tables is not None:
        out += [f"{r['access']:<3}{r['table']} ({len(r['columns'])} columns)" for r in answer.tables.orderBy("table").toLocalIterator()]
    return "\n".join(out)


def tree_text(nodes: list[tuple[str, str]], edges: list[tuple[str, str, int]], root: str) -> str:
    """A collected flow as a tree, depth first, repeats marked; nodes (id,
    name), edges (from, to, kind ordinal)."""
    names, below = dict(nodes), {}
    for a, b, k in sorted(set(edges), key=lambda e: (e[0], e[2], e[1])):
        below.setdefault(a, []).append(b)
    out, seen, stack = [], set(), [(root, 0)]
    while stack:
        at, depth = stack.pop()
        mark = "" if at not in seen else " (seen)"
        out.append("  " * depth + names.get(at, at) + mark)
        if at not in seen:
            seen.add(at)
            stack += [(b, depth + 1) for b in reversed(below.get(at, []))]
    return "\n".join(out)
