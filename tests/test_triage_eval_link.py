import json

from spanweave.functions import frames, text
from spanweave.operators import evals, link, render, traces
from spanweave.sources import store
from tests.graphs import chain, edge, graph, node

STACK = """# captured by hand
info: Shop.Api[0] request failed: see below
Shop.Data.SaveFailed (0x80131500): could not save: 3
   at Vendor.Db.Execute(String sql) in /v/db.cs:line 9
   at Shop.Orders.Repo.Save(Order order) in /src/r.cs:line 22
   at Shop.Orders.Handler.<Run>d__2.MoveNext() in /src/h.cs:line 12
--- End of stack trace from previous location ---
   at Shop.Orders.Gone.Away()
   at )broken(
"""


def test_frames_one_for_each_rule():
    f = frames.frame
    assert f("at A.B.C(Int32 a, List<X,Y> b)")[:4] == ("A.B", "C", "A.B.C", ["Int32", "List<X,Y>"])
    assert f("at A.B.<Run>d__4.MoveNext() in /x y/z.cs:line 7")[2:] == ("A.B.Run", [], "/x y/z.cs", 7)
    assert f("at A.<>c.<Sum>b__0_1(I i)")[2] == "A.Sum"
    assert f("at A.<Main>g__Local|0_0(I i)")[2] == "A.Main"
    assert f("at A.Box`1.Put[T](T item)")[2] == "A.Box.Put"
    assert f("at nothing here") is None and f("at (x)") is None
    assert frames.normal_type("float[]") == frames.normal_type("System.Single[]") == "Single[]"
    assert frames.id_parameters("A.B(int, Map<K, V>, string[])") == ["int", "Map<K, V>", "string[]"]


def test_triage(spark):
    g = chain(spark, ["raw SQL reaches the database outside the model: r.cs:22"])
    commits = spark.createDataFrame([("r.cs", f"s{i}", "x", i) for i in range(9)], "file string, sha string, subject string, seq int")
    t = traces.triage(g, spark.createDataFrame([("t", STACK), ("none", "no frames"), ("null", None)], "trace_id string, text string"), commits)
    h = t.headers.collect()
    assert [(r["type"], r["message"]) for r in h] == [("Shop.Data.SaveFailed", "could not save: 3")]
    assert [(r["verdict"]) for r in t.frames.orderBy("idx").collect()] == ["Foreign", "Matched", "Matched", "NotInGraph"]
    assert [(r["callee"], r["verdict"]) for r in t.links.orderBy("callee").collect()] == [(0, "NotChecked"), (1, "Verified"), (2, "NotChecked")]
    p = t.points.collect()
    assert len(p) == 1 and p[0]["node"] == "Shop.Orders.Repo.Save(Order)" and p[0]["line"] == 22
    c = {r["trace_id"]: r for r in t.counts.collect()}
    assert (c["t"]["frame"], c["t"]["separator"], c["t"]["unparsed"], c["t"]["foreign"]) == (4, 1, 1, 1)
    assert t.diagnostics.first()["exact"] and t.history.count() == 5
    assert {r["trace_id"]: r["reason"] for r in t.reasons.collect()}["none"] == "no frame could be read"
    assert "Repo.Save" in render.triage_report(t, "t")
    rows = {(r["section"], r["trace_id"], r["n"]): json.loads(r["json"]) for r in render.triage_json(t).collect()}
    assert rows[("headers", "t", 1)]["message"] == "could not save: 3" and rows[("frames", "t", 2)]["verdict"] == "Matched" and rows[("reasons", "none", 1)]["reason"] == "no frame could be read"


def test_link_verdicts(spark):
    m = [node(f"P.{x}.Run()", "Method") for x in "ABCDEI"]
    i = lambda x: f"P.{x}.Run()"
    e = [edge(i("A"), i("B"), sites=[("a.cs", 5, 1)]), edge(i("A"), i("I"), sites=[("a.cs", 7, 1)]), edge(i("I"), i("C")), edge(i("B"), i("D"), sites=[("b.cs", 1, 1)])]
    g = graph(spark, m, e)
    cases = {"same": ("A", "A", 1), "direct": ("B", "A", 5), "wrong": ("B", "A", 6), "bridge": ("C", "A", 7), "skip": ("D", "A", 9), "lost": ("E", "A", 1)}
    stack = [(k, f"at P.{callee}.Run()\n  at P.{caller}.Run() in a.cs:line {n}") for k, (callee, caller, n) in cases.items()]
    matched = traces.match_frames(g, traces.frames(traces.trace_lines(spark.createDataFrame(stack, "trace_id string, text string"))))
    got = {r["trace_id"]: (r["verdict"], r["via"], r["known_lines"], r["route"]) for r in traces.links(g, matched).collect()}
    assert got["same"][0] == "SameMethod" and got["direct"][0] == "Verified" and got["lost"][0] == "MissingEdge"
    assert got["wrong"][:3] == ("LineMismatch", "", [5]) and got["bridge"][:2] == ("Verified", i("I"))
    assert got["skip"][0] == "SkippedFrames" and got["skip"][3] == [i("B"), i("D")]


def test_overloads_are_told_apart(spark):
    g = graph(spark, [node("P.A.Run(int)", "Method"), node("P.A.Run(string)", "Method")], [edge("P.A.Run(int)", "P.A.Run(string)")])
    rows = spark.createDataFrame([("x", "at P.A.Run(Int32 n)"), ("y", "at P.A.Run(Object n)")], "trace_id string, text string")
    got = {r["trace_id"]: (r["verdict"], r["candidates"]) for r in traces.match_frames(g, traces.frames(traces.trace_lines(rows))).collect()}
    assert got == {"x": ("Matched", ["P.A.Run(int)"]), "y": ("Ambiguous", ["P.A.Run(int)", "P.A.Run(string)"])}


def test_repo_root(spark):
    f = spark.createDataFrame([("t", "C:\\work\\app\\Src\\R.cs")], "trace_id string, file string")
    g = spark.createDataFrame([("src/r.cs",), ("other.cs",)], "filePath string")
    assert traces.repo_root(f, g).first()["root"] == "C:/work/app"


def test_evaluation(spark, tmp_path):
    g = chain(spark)
    qs = {
        "questions": [
            {"id": "q1", "selector": {"node": "post /orders", "direction": "Forward"}, "population": {"class": "a", "count": 2, "representative": True}, "expected": {"tables": [{"name": "shop.orders", "access": "w", "columns": ["id"]}], "externalStores": [], "limitations": []}, "expectedToFail": [{"id": "L16-4"}]},
            {"id": "q2", "selector": {"node": "table:shop.orders", "direction": "Backward"}, "population": {"class": "b", "count": 1, "representative": False}, "expected": {"roots": {"endpoint": ["POST /orders", "GET /gone"]}, "nodes": None}},
            {"id": "q3", "selector": {"node": "nobody", "direction": "Forward"}, "expected": {}},
        ]
    }
    (tmp_path / "q.json").write_text("// by hand\n" + json.dumps(qs))
    (tmp_path / "v.json").write_text(json.dumps({"verdicts": [{"question": "q2", "verdict": "old"}, {"question": "q2", "verdict": "question-wrong"}]}))
    q = store.read_questions(spark, str(tmp_path / "q.json"))
    r = evals.run(g, q, store.read_verdicts(spark, str(tmp_path / "v.json")))
    assert [x["id"] for x in r.unresolved.collect()] == ["q3"]
    diff = {(x["qid"], x["facet"], x["item"], x["kind"]) for x in r.differences.collect()}
    assert diff == {("q1", "ColumnWrite", "shop.orders.id", "missing"), ("q2", "Root", "GET /gone", "missing")}
    assert {x["qid"]: x["verdict"] for x in r.results.collect()} == {"q1": "pending", "q2": "question-wrong"}
    m = {(x["facet"], x["scope"]): x for x in evals.metric_rows(r.comparisons).collect()}
    assert m[("Table", "Inside")]["recall"] == 1.0 and m[("Root", "None")]["recall"] == 0.5 and m[("ExternalStore", "None")]["recall"] is None
    assert m[("Limitation", "None")]["precision"] is None
    assert evals.evidence_tally(r.evidence).first()["NotFound"] == 1
    meta = {x["limit"]: x["questions"] for x in evals.meta_coverage(q).collect()}
    assert len(meta) == 34 and meta["L16"] == ["q1"]
    boxes = {(x["row"], x["realised"]): x["n"] for x in evals.prediction_boxes(evals.predictions(q, r.results)).collect()}
    assert len(boxes) == 6 and boxes[("open", True)] == 1
    parts = (evals.metric_rows(r.comparisons), evals.evidence_tally(r.evidence), evals.category_rows(q, r.results), evals.prediction_boxes(evals.predictions(q, r.results)), evals.meta_coverage(q), r.results, r.unresolved, evals.verdict_tally(r.results))
    made = {(x["section"], x["n"]): json.loads(x["json"]) for x in render.eval_json(*parts).collect()}
    assert made[("questions", 1)]["qid"] == "q1" and made[("unresolved", 1)]["id"] == "q3" and made[("evidence", 1)]["NotFound"] == 1
    assert "## Metrics" in render.eval_report(evals.metric_rows(r.comparisons), evals.evidence_tally(r.evidence), evals.category_rows(q, r.results), evals.prediction_boxes(evals.predictions(q, r.results)), evals.meta_coverage(q), r.results, r.unresolved, evals.verdict_tally(r.results))


def test_greedy_suffix_match(spark):
    df = spark.createDataFrame([(["Db", "Db", "Cache"], ["A.Db", "B.Db", "C.Db"])], "w array<string>, a array<string>")
    r = df.select(evals.suffix_match(df["w"], df["a"]).alias("m")).first()["m"]
    assert r["missing"] == ["Cache"] and r["rest"] == ["C.Db"]


def facts(spark):
    rows = {
        "methods": [(f"Shop.{t}.{m}()", m, f"Shop.{mod}.{t}", f"{t}.cs", i + 1, mod, None, "p", False) for i, (t, m, mod) in enumerate([("Api", "Map", "Orders"), ("Handler", "Run", "Orders"), ("IRepo", "Save", "Orders"), ("Repo", "Save", "Orders"), ("Sink", "Consume", "Mail")])],
        "map_calls": [("Shop.Api.Map()", "Parameter", "/v1", "post", "orders", "Api.cs", 3, "Orders"), ("Shop.Lost.Map()", "Parameter", "", "get", "x", "Lost.cs", 1, "Orders")],
        "propagations": [("Shop.Host.Run()", "Shop.Api.Map()", "Root", "/api", "Host.cs", 1), ("Shop.Host.Run()", "Shop.Api.Map()", "Root", "/old//api", "Host.cs", 2)],
        "invocations": [("Shop.Api.Map()", "Shop.Handler.Run()", None, True, False, "Api.cs", 3, 9, False, "run"), ("Shop.Handler.Run()", "Shop.IRepo.Save()", None, True, True, "Handler.cs", 5, 3, True, "save"), ("Shop.Handler.Run()", "System.X()", None, False, False, "Handler.cs", 6, 3, False, "x")],
        "implementations": [("Shop.IRepo.Save()", "Shop.Repo.Save()", "Orders")],
        "raises": [("Shop.Handler.Run()", "Shop.Orders.Done", False, ("Handler.cs", 7, 1, False)), ("Shop.Handler.Run()", "Shop.Orders.Inner", False, ("Handler.cs", 8, 1, False))],
        "event_registry": [("Shop.Orders.Done", "Shop.Orders.DoneEvent", ("Reg.cs", 1, 1, False))],
        "consumers": [("Shop.Orders.DoneEvent", "Shop.Sink.Consume()", "Shop.Mail.Sink", "Sink.cs", 5)],
        "ef_entities": [("Ctx", "Shop.Orders.Order", "shop", "orders", None, False)],
        "ef_properties": [("Ctx", "Shop.Orders.Order", n, c, None, "Shop.Orders.Order", False, v, None, None, None) for n, c, v in [("Id", "id", False), ("Note", "note", False), ("Ver", "ver", True)]],
        "entity_accesses": [("Shop.Repo.Save()", "Shop.Orders.Order", "Writes", "DbSetProperty", "Repo.cs:4", True)],
        "column_writes": [("Shop.Repo.Save()", "Shop.Orders.Order", "Shop.Orders.Order", "Note", None, None, "PropertyAssignment", "Repo.cs:5", "Order.cs", 2), ("Shop.Repo.Save()", "Shop.Orders.Order", "Shop.Orders.Order", "Ghost", None, None, "PropertyAssignment", "Repo.cs:6", "Order.cs", 3)],
        "table_locations": [("Orders", "orders", "Map.cs", 11)],
        "external_calls": [("Shop.Sink.Consume()", "Shop.Mail.Sender", "post", "Sink.cs", 9)],
    }
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in link.FACTS.items()}


def test_build_from_facts(spark, tmp_path):
    f = facts(spark)
    assert {r["status"] for r in link.endpoints(f).collect()} == {"ok", "prefix-not-resolved"}
    assert {r["status"] for r in link.published(f).collect()} == {"Published", "InternalDomainEvent"}
    g = link.build(f)
    n = {r["id"]: r for r in g.nodes.collect()}
    assert "endpoint:POST /api/v1/orders" in n and "endpoint:POST /old/api/v1/orders" in n
    assert n["Shop.Sink.Consume()"]["rootKind"] == "Consumer" and n["external:Shop.Mail.Sender"]["kind"] == "ExternalCall"
    e = {(r["fromId"], r["toId"], r["mechanism"]) for r in g.edges.collect()}
    assert ("Shop.Repo.Save()", "column:shop.orders.note", "PropertyAssignment") in e
    assert ("Shop.Repo.Save()", "column:shop.orders.id", "RowInsert") in e
    assert not any("ver" in b for _, b, _ in e) and not any(a.startswith("table:") for a, _, _ in e)
    assert any("Repo.cs:6" in r["text"] for r in g.diagnostics.collect())
    assert n["table:shop.orders"]["filePath"] == "Map.cs" and n["table:shop.orders"]["line"] == 11
    for name, df in f.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert store.read_facts(spark, str(tmp_path))["methods"].count() == 5


def test_caps_are_reported(spark):
    """More prefixes than are kept, and a walk over its budget."""
    f = facts(spark)
    many = [("Shop.Host.Run()", "Shop.Api.Map()", "Root", f"/p{i:02}", "Host.cs", 1) for i in range(12)] + [("Shop.Api.Map()", "Shop.Api.Map()", "Parameter", "/again", "Api.cs", 2)]
    f["propagations"] = spark.createDataFrame(many, link.FACTS["propagations"])
    kept, over = link.route_prefixes(f["propagations"], f["implementations"])
    assert sorted(r["prefix"] for r in kept.collect()) == sorted((f"/p0{i}" + "/again" * k for i in range(8) for k in range(8)))[:8]
    assert [r["method"] for r in over.collect()] == ["Shop.Api.Map()"]
    texts = {r["text"] for r in link.build(f).diagnostics.collect()}
    assert "more than 8 route prefixes, the others are left out: Shop.Api.Map()" in texts and not any("budget" in t for t in texts)
    assert "the walk ended at its budget of 3 nodes" in {r["text"] for r in link.build(f, budget=3).diagnostics.collect()}
    hops = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(6)], "src string, dst string, cost int")
    found, spent = link.walk(hops, spark.createDataFrame([("n0",)], "id string"), budget=3)
    assert spent and {(r["id"], r["truncated"]) for r in found.collect()} == {("n0", False), ("n1", False), ("n2", True)}
    found, spent = link.walk(hops, spark.createDataFrame([("n0",)], "id string"), max_depth=2)
    assert not spent and {(r["id"], r["truncated"]) for r in found.collect()} == {("n0", False), ("n1", False), ("n2", True)}


def test_members_up_the_base_types(spark):
    bases = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "clr_name string, base_clr string")  # a circle ends
    assert {(r["clr_name"], r["ancestor"], r["distance"]) for r in link.base_chain(bases).where("clr_name = 'A'").collect()} == {("A", "A", 0), ("A", "B", 1), ("A", "C", 2)}


def test_text_functions(spark):
    df = spark.createDataFrame([("WR", "src/Modules/Orders/X.Orders.Domain/x.csproj", "X.Orders.Domain", "{\"libraries\"")], "a string, p string, n string, j string")
    p = text.project_facts(df["p"], df["n"])
    r = df.select(text.access_letters(df["a"]).alias("a"), p["module"].alias("m"), p["layer"].alias("l"), p["is_test"].alias("t"), text.package_version(df["a"]).alias("v")).first()
    assert (r["a"], r["m"], r["l"], r["t"]) == ("RW", "Orders", "Domain", False)
    import base64
    import zlib

    url = text.diagram_url("flowchart TD\n" + "x" * 70000)
    raw = url.split(":", 2)[2]
    assert json.loads(zlib.decompress(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))))["code"].startswith("flowchart")
