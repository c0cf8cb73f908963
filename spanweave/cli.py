"""``python -m spanweave.cli``: build, endpoints, trace, docs, triage, eval, scan."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from spanweave.api import BadRequest, Engine, NotFound, Unavailable
from spanweave.model import Graph, InvalidGraph

OK, LOAD_FAILED, BAD_INPUT, NOTHING_FOUND, NOT_RESOLVED, INVALID, PREFLIGHT, USAGE = 0, 1, 2, 3, 4, 5, 6, 64


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanweave")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(*a, **k) for a, k in args)]
    graph = (("--graph",), {})
    add("build", (("facts",), {}), (("out",), {}))
    add("scan", (("facts",), {}))
    add("endpoints", graph, (("--module",), {}))
    add("trace", (("node",), {}), graph, (("--backward",), {"action": "store_true"}), (("--max-depth",), {"type": int, "default": 20}), (("--no-utility",), {"action": "store_true"}), (("--tree",), {"action": "store_true"}))
    add("docs", (("out",), {}), graph, (("--module",), {}))
    add("triage", (("stack",), {"help": "a file, or - for standard input"}), graph)
    add("eval", (("questions",), {}), graph, (("--verdicts",), {}))
    return p


def load(spark: SparkSession, given: str | None) -> Graph:
    from spanweave.sources.store import find_graph, read_graph, read_graph_json

    if given and Path(given).is_dir():
        return read_graph(spark, given)
    at = find_graph(given)
    if at.path is None:
        raise Unavailable(at.tried)
    return read_graph_json(spark, str(at.path))


def run(spark: SparkSession, argv: list[str]) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code in (0, None) else USAGE
    try:
        return _run(spark, a)
    except BadRequest as e:
        print(e, file=sys.stderr)
        return BAD_INPUT
    except NotFound as e:
        print(e, file=sys.stderr)
        return NOT_RESOLVED
    except Unavailable as e:
        print(e, file=sys.stderr)
        return BAD_INPUT
    except InvalidGraph as e:
        print(e, file=sys.stderr)
        return INVALID


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    from spanweave.operators import evals, link, modules, render
    from spanweave.sources import store

    if a.command == "build":
        facts = store.read_facts(spark, a.facts)
        graph = link.build(facts)
        if graph.nodes.where("rootKind <> 'None'").isEmpty():
            return NOTHING_FOUND
        store.write_graph(graph, a.out)
        return OK
    if a.command == "scan":
        from spanweave.functions.text import LAYERS

        methods = store.read_facts(spark, a.facts)["methods"]
        if methods.isEmpty():
            return LOAD_FAILED
        modules.layer_pivot(methods.where("not is_test"), list(LAYERS)).orderBy("module").show(1000, False)
        return OK
    engine = Engine(load(spark, a.graph))
    if a.command == "endpoints":
        rows = engine.endpoints(a.module).collect()
        print("\n".join(f"{r['module']:<20}{r['verb']:<8}{r['route']}" for r in rows))
        return OK if rows else NOTHING_FOUND
    if a.command == "trace":
        got = engine.trace(a.node, "Backward" if a.backward else "Forward", a.max_depth, not a.no_utility)
        if a.tree:
            nodes = [(r["id"], r["displayName"]) for r in got.nodes.select("id", "displayName").collect()]
            from pyspark.sql import functions as F

            from spanweave.model import ordinal

            edges = [(r["fromId"], r["toId"], r["o"]) for r in got.edges.select("fromId", "toId", ordinal(F.col("kind"), "EdgeKind").alias("o")).collect()]
            if a.backward:
                edges = [(b, x, o) for x, b, o in edges]
            print(render.tree_text(nodes, edges, engine.node(a.node)))
        else:
            print(render.trace_text(got))
        return OK
    if a.command == "docs":
        return OK if render.docs_site(engine.graph, a.out, a.module) else NOTHING_FOUND
    if a.command == "triage":
        text = sys.stdin.read() if a.stack == "-" else Path(a.stack).read_text(encoding="utf-8")
        t = engine.triage(text)
        print(render.triage_report(t, "trace"))
        if t.frames.isEmpty():
            return NOTHING_FOUND
        return OK if not t.points.isEmpty() else NOT_RESOLVED
    questions = store.read_questions(spark, a.questions)
    verdicts = store.read_verdicts(spark, a.verdicts) if a.verdicts else None
    r = engine.evaluate(questions, verdicts)
    boxes = evals.prediction_boxes(evals.predictions(questions, r.results))
    print(render.eval_report(evals.metric_rows(r.comparisons), evals.evidence_tally(r.evidence), evals.category_rows(questions, r.results), boxes, evals.meta_coverage(questions), r.results, r.unresolved, evals.verdict_tally(r.results)))
    if not r.unresolved.isEmpty():
        return NOT_RESOLVED
    return NOTHING_FOUND if not r.results.where("verdict = 'pending'").isEmpty() else OK


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("spanweave").getOrCreate(), sys.argv[1:]))
