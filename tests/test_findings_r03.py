"""What the third round of findings asked for."""

from pathlib import Path

import duckdb

import __spark_entry__ as entry
from spanweave.operators import answers, link, modules, traverse
from spanweave.plans import fixtures
from spanweave.tables import shared_dir
from tests.graphs import edge, graph, node

SMALL = "/root/testdata/sf0.001"
SALES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def sales(tmp_path, **texts):
    """A folder of the small sales tables; ``texts`` are SELECTs that replace some."""
    con = duckdb.connect()
    for name in SALES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in SALES:
        con.sql(f"COPY ({texts.get(name, f'SELECT * FROM {name}')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def as_in_sql(spark, folder, name):
    """The rows of a query, held to those of its SQL over the same folder."""
    con = duckdb.connect()
    for table in SALES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(entry.oracle_sql()[name]).fetchall()))
    return got


def test_constructor_pairs_are_counted_not_listed(spark):
    f = {n: spark.createDataFrame([], s) for n, s in link.FACTS.items()}
    e = "Shop.Orders.Order"
    rows = {
        "methods": [(f"a{i}", "a", "T", "a.cs", 1, "Orders", None, "p", False) for i in range(3)],
        "ef_entities": [("Ctx", e, "shop", "orders", None, False)],
        "ef_properties": [("Ctx", e, "Note", "note", None, e, False, False, None, None, None)],
        "entity_accesses": [("m", e, "Writes", "EntityConstruction", f"l{i}", False) for i in range(5)] + [("m", e, "Writes", "DbSetProperty", "l9", False)],
        "column_writes": [(f"a{i}", e, e, "Note", None, None, "EntityConstructorAssignment", f"w{i}", "o.cs", 2) for i in range(3)],
    }
    f |= {n: spark.createDataFrame(r, link.FACTS[n]) for n, r in rows.items()}
    assert [tuple(r) for r in link.constructor_columns(f).collect()] == [("m", "shop.orders", "note", "EntityConstructorAssignment", "w0", 15)]


def test_layers_without_data_stay_in_the_diagram_queries(spark, tmp_path):
    """An order of the first customer that has no line reaches no data."""
    first = "(SELECT min(o_orderkey) FROM orders WHERE o_custkey = 0 AND o_orderstatus <> 'P')"
    at = sales(tmp_path, lineitem=f"SELECT * FROM lineitem WHERE l_orderkey <> {first}")
    assert as_in_sql(spark, at, "flow_diagram_edges")


def test_contracted_edges_keep_layers_without_data(spark, tmp_path):
    first = "(SELECT min(o_orderkey) FROM orders WHERE o_custkey = 0 AND o_orderstatus <> 'P')"
    at = sales(tmp_path, lineitem=f"SELECT * FROM lineitem WHERE l_orderkey <> {first}")
    assert as_in_sql(spark, at, "contracted_edges")


def test_a_graph_writes_only_the_table_that_is_asked_for(spark, tmp_path):
    at = sales(tmp_path)
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    assert as_in_sql(spark, at, "point_lookup") == [("event:n3", "Event", fixtures.stored_commerce(spark, at).nodes.where("id = 'event:n3'").first()["displayName"])]
    assert [p.name.split("-")[0] for p in set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) - before] == ["nodes"]


def test_sets_of_more_ends_than_a_word_holds(spark):
    """130 tables, each read by a method; a caller of all; an edge to a node that is not there."""
    n = 130
    nodes = [node("top", "Endpoint"), *(node(f"m{i}", "Method") for i in range(n)), *(node(f"t{i}", "Table") for i in range(n))]
    edges = [*(edge("top", f"m{i}") for i in range(n)), *(edge(f"m{i}", f"t{j}", "Reads") for i in range(n) for j in (i, (i + 1) % n)), edge("top", "gone"), edge("gone", "t0")]
    for many in (n, 64):
        g = graph(spark, nodes, edges)
        ends = g.nodes.where(f"kind = 'Table' and try_cast(substring(id, 2) as int) < {many}").repartition(8)
        got = {r["id"]: r["n"] for r in traverse.reached_sets(g, ends).collect()}
        assert got["top"] == many and got["m3"] == 2 and got["t0"] == 1 and "gone" not in got
        assert all(got.get(f"m{i}", 0) == (i < many) + ((i + 1) % n < many) for i in range(n))


def test_module_counts_need_no_evidence(spark):
    nodes = [node(f"a{i}", "Method", module="A") for i in range(3)] + [node("b", "Method", module="B"), node("s", "Method", module="Shared")]
    g = graph(spark, nodes, [edge(f"a{i}", "b") for i in range(3)] + [edge("b", "a0", "Publishes"), edge("b", "a0", "Reads"), edge("a0", "a1"), edge("a0", "s"), edge("a0", "gone")])
    assert {tuple(r) for r in modules.dependency_counts(g).collect()} == {("A", "B", 3), ("B", "A", 1)}
    assert {(r["module"], r["edges_out"], r["edges_in"]) for r in modules.rollup(g).collect()} == {("A", 3, 1), ("B", 1, 3), ("Shared", 0, 0)}


def test_entry_points_are_counted_without_their_list(spark):
    g = graph(spark, [node(f"e{i}", "Endpoint", root="Endpoint") for i in range(3)] + [node("m", "Method"), node("t", "Table")], [edge("e0", "t"), edge("e1", "m"), edge("e2", "m"), edge("m", "t")])
    sub = traverse.subgraph(g, traverse.start(g, "t"), "Backward")
    assert [tuple(r) for r in answers.entry_point_totals(sub.nodes, traverse.start(g, "t")).collect()] == [("q", "Endpoint", 3, 1)]


def test_every_route_prefix_is_kept(spark):
    """Twelve roots, a way on, and a circle that a way does not follow round again."""
    rows = [("host", "a", "Root", f"/p{i:02}", "h.cs", 1) for i in range(12)] + [("a", "a", "Parameter", "/again", "a.cs", 2), ("a", "b", "Parameter", "/b", "a.cs", 3), ("b", "a", "Parameter", "/back", "b.cs", 1)]
    f = {n: spark.createDataFrame(rows if n == "propagations" else [], s) for n, s in link.FACTS.items()}
    kept, over = link.route_prefixes(f["propagations"], f["implementations"], None)
    assert sorted(map(tuple, kept.collect())) == sorted([("a", f"/p{i:02}") for i in range(12)] + [("b", f"/p{i:02}/b") for i in range(12)]) and over.isEmpty()


def test_routes_of_a_build_are_whole(spark):
    got = as_in_sql(spark, SMALL, "link_route_prefixes")
    assert max(sum(m == x for m, _ in got) for x in {m for m, _ in got}) > 8
    assert len(as_in_sql(spark, SMALL, "link_endpoints")) > 57
    for name in ("build_nodes", "build_edges", "build_diagnostics"):
        as_in_sql(spark, SMALL, name)


def test_saved_and_audited_entities_do_not_repeat(spark):
    f = {n: spark.createDataFrame([], s) for n, s in link.FACTS.items()}
    rows = {
        "save_changes": [("m", "A"), ("m", "A"), ("m", "B"), ("k", "A")],
        "ef_entities": [("A", "E", "s", "e", None, False), ("B", "E", "s", "e", None, False), ("A", "F", "s", "f", None, False)],
        "interceptor_writes": [("i", "F", "audit")],
        "entity_accesses": [("m", "E", "Reads", "x", "l1", False), ("m", "E", "Reads", "y", "l2", False), ("k", "E", "Writes", "x", "l1", False), ("k", "E", "Reads", "x", "l1", False)],
    }
    f |= {n: spark.createDataFrame(r, link.FACTS[n]) for n, r in rows.items()}
    assert sorted((r["method_id"], r["entity"], r["evidence"]) for r in link.saved_entities(f).collect()) == [("m", "E", "save through A"), ("m", "E", "save through B")]
    assert sorted((r["method_id"], r["entity"]) for r in link.interceptor_accesses(f).collect()) == [("k", "F"), ("m", "F")]
    merged = link.merge_accesses(f["entity_accesses"], 2_000_000)
    assert merged.rdd.getNumPartitions() == 5 and merged.count() == 4


def test_headers_of_traces_build_no_graph(spark, tmp_path):
    at = sales(tmp_path)
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    as_in_sql(spark, at, "trace_headers")
    assert set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) == before
    for name in ("trace_links", "trace_frames"):
        as_in_sql(spark, at, name)
