"""The query surface: five questions over one graph, with typed errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from spanweave.model import Graph, TraversalQuery
from spanweave.operators import answers, contract, evals, modules, resolve, traces
from spanweave.operators.traverse import start

MIN_DEPTH, MAX_DEPTH, DEFAULT_DEPTH = 1, 50, 20
#: What no answer can know, published with the counts.
CAVEATS = {
    "raw-sql": "Tables reached by raw SQL only are missing.",
    "non-relational-stores": "Stores that are not relational are seen as calls, not as tables.",
    "owned-navigation-reads": "Reads through owned members are not seen.",
    "column-reads": "Columns that are only read are not seen.",
}


class BadRequest(ValueError):
    """An argument is missing or out of range (status 400)."""


class NotFound(LookupError):
    """No node fits (status 404); ``near`` names some that almost do."""

    def __init__(self, text: str, near: list[str]) -> None:
        super().__init__(f"no node for {text!r}" + (f"; near: {', '.join(near)}" if near else ""))
        self.near = near


class Unavailable(RuntimeError):
    """There is no graph to ask (status 503); ``tried`` lists the places."""

    def __init__(self, tried: list[str]) -> None:
        super().__init__("no graph at " + ", ".join(tried))
        self.tried = tried


@dataclass
class Engine:
    graph: Graph

    def endpoints(self, module: str | None = None) -> DataFrame:
        return answers.endpoint_list(self.graph, module).orderBy("module", "displayName", "id")

    def tables(self) -> DataFrame:
        return answers.table_catalogue(self.graph).orderBy("table")

    def stats(self) -> DataFrame:
        return answers.stats(self.graph)

    def node(self, selector: str | None) -> str:
        if selector is None or not selector.strip():
            raise BadRequest("a node is required")
        found = resolve.resolve(self.graph, selector)
        if found is None:
            raise NotFound(selector, [r["displayName"] for r in resolve.near_matches(self.graph, selector).collect()])
        return found

    def trace(self, selector: str | None, direction: str = "Forward", max_depth: int = DEFAULT_DEPTH, include_utility: bool = False, edge_kinds: tuple[str, ...] | None = None) -> answers.TraceAnswer:
        if not MIN_DEPTH <= max_depth <= MAX_DEPTH:
            raise BadRequest(f"the depth must be from {MIN_DEPTH} to {MAX_DEPTH}")
        if direction not in ("Forward", "Backward"):
            raise BadRequest(f"unknown direction {direction!r}")
        starts = start(self.graph, self.node(selector))
        return answers.trace(self.graph, starts, direction, TraversalQuery(max_depth, include_utility, edge_kinds))

    def backward(self, selector: str | None, **how) -> answers.TraceAnswer:
        return self.trace(selector, "Backward", **how)

    def diagram(self, selector: str | None) -> contract.FlowDiagram:
        return contract.flow_diagram(self.graph, start(self.graph, self.node(selector)))

    def dependencies(self) -> DataFrame:
        return modules.dependencies(self.graph)

    def triage(self, text: str, trace_id: str = "trace") -> traces.Triage:
        spark = self.graph.nodes.sparkSession
        return traces.triage(self.graph, spark.createDataFrame([(trace_id, text)], "trace_id string, text string"))

    def evaluate(self, questions: DataFrame, verdicts: DataFrame | None = None) -> evals.EvalRun:
        return evals.run(self.graph, questions, verdicts)
