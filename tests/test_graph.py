import json

import pytest
from pyspark.sql import functions as F

from spanweave import cli
from spanweave.api import BadRequest, Engine, NotFound
from spanweave.model import InvalidGraph, TraversalQuery, validate
from spanweave.operators import answers, contract, modules, render, resolve, traverse
from spanweave.sources import store
from tests.graphs import chain, edge, graph, node

TABLE, ROOT = "table:shop.orders", "endpoint:POST /orders"


def ids(df):
    return {r["id"] for r in df.collect()}


def test_forward_backward_and_depth(spark):
    g = chain(spark)
    assert TABLE in ids(traverse.forward(g, ROOT))
    back = ids(traverse.backward(g, TABLE))
    assert ROOT in back and "Shop.Text.Trim(string)" not in back
    assert TABLE not in ids(traverse.forward(g, ROOT, 2))
    assert TABLE in ids(traverse.forward(g, ROOT, 4))
    assert ids(traverse.forward(g, "no such node")) == set()


def test_cycles_end_and_kinds_change_reach(spark):
    g = graph(spark, [node("A", "Method"), node("B", "Method")], [edge("A", "B"), edge("B", "A")])
    assert {(r["id"], r["depth"]) for r in traverse.forward(g, "A", 50).collect()} == {("A", 0), ("B", 1)}
    c = chain(spark)
    got = ids(traverse.reach(c, traverse.start(c, ROOT), kinds=("Calls",)))
    assert "Shop.Orders.Repo.Save(Order)" in got and "entity:Shop.Order" not in got


def test_induced_edges_leave_out_the_rim_and_keep_back_edges(spark):
    g = graph(spark, [node(x, "Method") for x in "ABC"], [edge("A", "B"), edge("B", "A"), edge("B", "C"), edge("C", "A")])
    sub = traverse.subgraph(g, traverse.start(g, "A"), query=TraversalQuery(max_depth=1))
    assert {(r["fromId"], r["toId"]) for r in sub.edges.collect()} == {("A", "B")}
    sub = traverse.subgraph(g, traverse.start(g, "A"), query=TraversalQuery(max_depth=2))
    assert {(r["fromId"], r["toId"]) for r in sub.edges.collect()} == {("A", "B"), ("B", "A"), ("B", "C")}


def test_thinning_never_changes_reach(spark):
    g = graph(spark, [node("A", "Handler"), node("U", "Method", utility=True), node("T", "Table")], [edge("A", "U"), edge("U", "T", "Writes")])
    sub = traverse.subgraph(g, traverse.start(g, "A"), query=TraversalQuery(include_utility=False))
    assert ids(sub.reach) == {"A", "T"}
    assert sub.edges.count() == 0
    assert answers.hidden_utility(g, sub, traverse.start(g, "A"), TraversalQuery(include_utility=False)).first()["hidden"] == 1


def test_answer_of_the_chain(spark):
    g = chain(spark, ["raw SQL reaches the database outside the model: r.cs:30", "raw SQL reaches the database outside the model: zz.cs:1"])
    a = answers.trace(g, traverse.start(g, ROOT))
    assert [(r["table"], r["access"], r["schema"]) for r in a.tables.collect()] == [("shop.orders", "W", "shop")]
    lim = {r["code"]: r["locations"] for r in a.limitations.collect()}
    assert lim == {"raw-sql": ["raw SQL reaches the database outside the model: r.cs:30"]}
    cut = answers.trace(g, traverse.start(g, ROOT), query=TraversalQuery(max_depth=2))
    assert cut.truncated.first()["truncated"] and "truncated" in {r["code"] for r in cut.limitations.collect()}
    back = answers.trace(g, traverse.start(g, TABLE), "Backward")
    assert back.tables is None and [(r["rootKind"], r["total"]) for r in back.entry_points.collect()] == [("Endpoint", 1)]


def test_column_confidence(spark):
    cols = ["direct", "row", "inferred", "weak", "none"]
    mechs = ["PropertyAssignment", "RowInsert", "SaveChangesInterceptor", "EntityConstruction"]
    g = graph(
        spark,
        [node("M", "Method"), *(node(f"column:s.t.{c}", "Column", c) for c in cols), node("table:s.t", "Table", "s.t")],
        [*(edge("M", f"column:s.t.{c}", "Writes", m) for c, m in zip(cols, mechs, strict=False)), edge("M", "column:s.t.none", "Calls"), *(edge(f"column:s.t.{c}", "table:s.t", "MapsTo") for c in cols)],
    )
    sub = traverse.subgraph(g, traverse.start(g, "M"))
    got = {r["column"]: r["confidence"] for r in answers.column_claims(sub.nodes, sub.edges).collect()}
    assert got == {"direct": "Direct", "row": "RowLevel", "inferred": "Inferred", "weak": "SecondClass", "none": "SecondClass"}
    assert answers.data_layer(sub.nodes, sub.edges).first()["access"] == "W"


def test_selectors_and_errors(spark):
    e = Engine(chain(spark))
    assert e.node("post /orders") == ROOT and e.node(ROOT) == ROOT and e.node("  handler.run ") == "Shop.Orders.Handler.Run(int)"
    with pytest.raises(NotFound) as x:
        e.node("repo")
    assert x.value.near == ["Repo.Save"]
    with pytest.raises(BadRequest):
        e.trace(ROOT, max_depth=51)
    with pytest.raises(BadRequest):
        e.trace(" ")
    assert e.endpoints("SHOP").first()["verb"] == "POST"
    assert resolve.resolve(e.graph, "nothing") is None


def test_json_round_trip_does_not_depend_on_order(spark, tmp_path):
    g = chain(spark, ["b", "a"])
    store.write_graph_json(g, str(tmp_path / "a.json"))
    mixed = graph(spark, [tuple(r) for r in g.nodes.orderBy(F.desc("id")).collect()], [tuple(r) for r in g.edges.orderBy(F.desc("toId")).collect()], ["a", "b"])
    store.write_graph_json(mixed, str(tmp_path / "b.json"))
    assert (tmp_path / "a.json").read_bytes() == (tmp_path / "b.json").read_bytes()
    again = store.read_graph_json(spark, str(tmp_path / "a.json"))
    assert again.nodes.count() == 6 and again.edges.count() == 5
    doc = json.loads((tmp_path / "a.json").read_text())
    assert doc["stats"]["rootCount"] == 1 and doc["nodes"][0]["utility"] is False and "evidence" not in doc["edges"][0]
    doc["version"] = 2
    (tmp_path / "c.json").write_text(json.dumps(doc))
    with pytest.raises(store.BadDocument):
        store.read_graph_json(spark, str(tmp_path / "c.json"))
    store.write_graph(g, str(tmp_path / "tables"))
    assert store.read_graph(spark, str(tmp_path / "tables")).edges.count() == 5


@pytest.mark.parametrize(
    "nodes,edges",
    [
        ([node("A", "Method", file=" ")], []),
        ([node("A", "Method", line=0)], []),
        ([node("A", "Method")], [edge("A", "B")]),
        ([node("A", "Method", utility=True, root="Consumer")], []),
        ([node("A", "Method"), node("A", "Method")], []),
    ],
)
def test_invalid_graphs_are_not_written(spark, tmp_path, nodes, edges):
    g = graph(spark, nodes, edges)
    with pytest.raises(InvalidGraph):
        validate(g)
    with pytest.raises(InvalidGraph):
        store.write_graph_json(g, str(tmp_path / "g.json"))
    assert not (tmp_path / "g.json").exists()


def test_source_keeps_the_last_good_graph(spark, tmp_path):
    at = tmp_path / "graph.json"
    store.write_graph_json(chain(spark), str(at))
    src = store.GraphSource(spark, str(at))
    first = src.refresh()
    assert first.n_nodes == 6 and src.refresh() is first
    at.write_text("{ broken")
    assert src.refresh() is first and src.error
    assert store.find_graph(None, cwd=tmp_path).path == at
    assert store.find_graph(str(tmp_path / "no.json")).path is None


def test_contraction_labels_kinds_and_sites(spark):
    g = chain(spark)
    d = contract.flow_diagram(g, traverse.start(g, ROOT, ROOT))
    got = {(r["fromId"], r["toId"]): (r["kind"], r["label"], len(r["callSites"])) for r in d.edges.collect()}
    assert got == {
        (ROOT, "Shop.Orders.Handler.Run(int)"): ("Call", "", 0),
        ("Shop.Orders.Handler.Run(int)", "Shop.Orders.Repo.Save(Order)"): ("Call", "", 1),
        ("Shop.Orders.Repo.Save(Order)", TABLE): ("Data", "Order", 0),
    }
    h = d.hidden.first()
    assert (h["total"], h["utility"], h["intermediate"], h["interfaces"], h["dataless"]) == (6, 1, 1, 0, 0)


def test_contraction_is_sound_complete_and_order_free(spark):
    import random

    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(24)]
    kinds = {n: rng.choice(["Handler", "Method", "Entity", "Table"]) for n in names}
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(60)}
    nodes = [node(n, kinds[n]) for n in names]
    edges = [edge(a, b, rng.choice(["Calls", "Writes", "Reads"]), sites=[("f.cs", i, 1)]) for i, (a, b) in enumerate(sorted(pairs))]

    def run(n, e):
        g = graph(spark, n, e)
        d = contract.flow_diagram(g, traverse.start(g, "n00"))
        return sorted((r["fromId"], r["toId"], r["kind"], r["label"], str(r["callSites"])) for r in d.edges.collect()), ids(d.nodes)

    got, kept = run(nodes, edges)
    assert got == run(nodes[::-1], edges[::-1])[0]
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)
    expect = set()
    for k in kept:
        stack, seen = list(below.get(k, ())), set()
        while stack:
            x = stack.pop()
            if x in kept:
                expect.add((k, x))
            elif x not in seen:
                seen.add(x)
                stack += below.get(x, ())
    assert {(a, b) for a, b, *_ in got} == {(a, b) for a, b in expect if a != b}


def test_modules_and_site(spark, tmp_path):
    g = chain(spark)
    assert modules.shared_dependents(g).collect()[0]["n"] == 1
    r = {x["module"]: x.asDict() for x in modules.rollup(g).collect()}
    assert r["Shop"]["with_data"] == 1 and r["Shop"]["tables"] == 1
    n = render.docs_site(g, str(tmp_path))
    assert n == 5 and "flowchart TD" in (tmp_path / "flows/post-orders.md").read_text() and "| shop.orders | W |" in (tmp_path / "flows/post-orders.md").read_text()
    assert (tmp_path / "README.md").exists()
    other = tmp_path / "one"
    render.docs_site(g, str(other), module="shop")
    assert not (other / "README.md").exists()


def test_command_line(spark, tmp_path, capsys):
    at = tmp_path / "graph.json"
    store.write_graph_json(chain(spark), str(at))
    ask = lambda *a: cli.run(spark, [*a, "--graph", str(at)])
    assert ask("endpoints") == cli.OK and "/orders" in capsys.readouterr().out
    assert ask("trace", "POST /orders") == cli.OK and "shop.orders" in capsys.readouterr().out
    assert ask("trace", "POST /orders", "--tree") == cli.OK
    assert ask("trace", "nothing like it") == cli.NOT_RESOLVED
    assert ask("trace", "POST /orders", "--max-depth", "99") == cli.BAD_INPUT
    assert cli.run(spark, ["endpoints", "--graph", str(tmp_path / "no.json")]) == cli.BAD_INPUT
    assert cli.run(spark, ["unknown"]) == cli.USAGE


def test_stream_of_edges(spark, tmp_path):
    from spanweave.streaming import refresh

    g = chain(spark)
    g.edges.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        refresh.follow(spark, str(tmp_path / "in"), str(tmp_path / "check"), refresh.append_to(str(tmp_path / "out"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_mentions(spark):
    """Texts that hold a file anywhere, whatever the case: short names, blanks, ends inside words."""
    texts = ["Warn A/b.CS:12", "x my file.cs: 3", "prefixa/b.csx", "nothing", "é.c", "long/path/to/some/very/deep/Handler.cs:1", "c"]
    files = ["a/b.cs", "my file.cs", "é.c", "c", "long/path/to/some/very/deep/handler.cs", "other/deep/handler.cs"]
    got = {(r["text"], r["file"]) for r in answers.mentions(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {(t, f) for t in texts for f in files if f in t.lower()}


def test_sets_of_many_ends(spark):
    """More ends than a word has bits; a circle; an end that reaches itself."""
    nodes = [node(f"T{i}", "Table") for i in range(70)] + [node(x, "Method") for x in "ABCD"]
    edges = [edge("A", f"T{i}") for i in range(70)] + [edge("B", "A"), edge("A", "B"), edge("C", "T3"), edge("T3", "T4")]
    g = graph(spark, nodes, edges)
    n = {r["id"]: r["n"] for r in traverse.reached_sets(g, g.nodes.where("kind = 'Table'")).collect()}
    assert (n["A"], n["B"], n["C"], n["T3"], n["T4"], n.get("D")) == (70, 70, 2, 2, 1, None)
