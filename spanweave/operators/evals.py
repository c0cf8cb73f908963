"""Answers against a hand-written truth set: facets, differences, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import access_letters
from spanweave.model import MAPPER_ISSUED, Graph, TraversalQuery, column_table, ordinal
from spanweave.operators.answers import trace
from spanweave.operators.resolve import resolve_all
from spanweave.tables import stored

KEYS = ("qid", "facet", "scope", "subject")


def multiset_diff(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, item, missing, unexpected: counts by which each side exceeds the
    other; items in balance are left out."""
    e = expected.groupBy(*keys, "item").agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys, "item").agg(F.count("*").alias("a"))
    both = e.join(a, [*keys, "item"], "full").na.fill(0, ["e", "a"])
    return both.where("e <> a").select(*keys, "item", F.greatest(F.col("e") - F.col("a"), F.lit(0).cast("long")).alias("missing"), F.greatest(F.col("a") - F.col("e"), F.lit(0).cast("long")).alias("unexpected"))


def replicate(diff: DataFrame, column: str) -> DataFrame:
    """Rows of a difference as often as their count says."""
    return diff.where(F.col(column) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(column).cast("int")))).drop("_i", "missing", "unexpected")


def suffix_match(wanted: Column, actual: Column) -> Column:
    """Greedy matching of sorted names: each wanted name takes the first left
    actual one that equals it or ends with it.

    struct(missing, rest), both sorted arrays.  Hits are removed by position,
    so equal names stay apart.
    """
    none = F.array().cast("array<string>")

    def take(acc: Column, name: Column) -> Column:
        fits = F.transform(acc["rest"], lambda a: a.endswith(name))
        at = F.array_position(fits, F.lit(True)).cast("int")
        rest = F.concat(F.slice(acc["rest"], F.lit(1), at - 1), F.slice(acc["rest"], at + 1, F.size(acc["rest"])))
        return F.struct(
            F.when(at > 0, acc["missing"]).otherwise(F.array_append(acc["missing"], name)).alias("missing"),
            F.when(at > 0, rest).otherwise(acc["rest"]).alias("rest"),
        )

    return F.aggregate(F.array_sort(wanted), F.struct(none.alias("missing"), F.array_sort(actual).alias("rest")), take)


def table_scopes(graph: Graph) -> DataFrame:
    """table (name), scope: Inside if the mapper itself reads or writes it."""
    e = graph.edges.where(F.col("kind").isin("Reads", "Writes") & F.col("mechanism").isin(*MAPPER_ISSUED)).select("toId").distinct()
    maps = graph.edges.where((F.col("kind") == "MapsTo") & F.col("fromId").startswith("entity:")).select(F.col("fromId").alias("toId"), F.col("toId").alias("id")).distinct()
    own = e.where(F.col("toId").startswith("table:")).select(F.col("toId").alias("id"))
    cols = e.where(F.col("toId").startswith("column:")).select(F.concat(F.lit("table:"), column_table(F.col("toId"))).alias("id"))
    far = e.where(~F.col("toId").rlike("^(table|column):")).join(maps, "toId").select("id")
    issued = own.unionByName(cols).unionByName(far).distinct().withColumn("in", F.lit(True))
    return graph.nodes.where("kind = 'Table'").join(issued, "id", "left").select(F.col("displayName").alias("table"), F.when(F.col("in"), "Inside").otherwise("Outside").alias("scope"))


@dataclass
class EvalRun:
    resolved: DataFrame
    unresolved: DataFrame
    comparisons: DataFrame
    differences: DataFrame
    evidence: DataFrame
    results: DataFrame


def run(graph: Graph, questions: DataFrame, verdicts: DataFrame | None = None, query: TraversalQuery | None = None) -> EvalRun:
    """Ask every question at once: one walk for each direction.

    questions: id, selector struct<node, direction>, expected struct<columnKind,
    tables array<struct<name, access, columns>>, roots struct<endpoint, consumer,
    backgroundJob>, events struct<consumedBy, publishedBy>, externalStores,
    limitations, nodes>.  A null facet is not asserted; an empty one is.
    """
    query = query or TraversalQuery()
    q = questions.withColumnRenamed("id", "qid")
    found = stored(resolve_all(graph, q.select("qid", F.col("selector.node").alias("text"))), "resolved")
    q = stored(q.join(found.select("qid", F.col("id").alias("node")), "qid"), "questions")
    unresolved = questions.join(found.select(F.col("qid").alias("id")), "id", "left_anti").select("id", F.col("selector.node").alias("selector"))
    expected, actual, subjects, presence = [], [], [], []

    def side(rows: DataFrame, facet, subject: str, scope=None) -> DataFrame:
        """rows: qid, item (and scope)."""
        facet = facet if isinstance(facet, Column) else F.lit(facet)
        scope_ = F.col("scope") if scope else F.lit("None")
        return rows.select("qid", facet.alias("facet"), scope_.alias("scope"), F.lit(subject).alias("subject"), "item")

    def compare(asserted: DataFrame, facet: str, subject: str, want: DataFrame, got: DataFrame, once: bool = False) -> None:
        """once: only what is missing counts."""
        subjects.append(asserted.select("qid", F.lit(facet).alias("facet"), F.lit("None").alias("scope"), F.lit(subject).alias("subject"), F.lit(once).alias("presence")))
        expected.append(side(want, facet, subject))
        got = got.join(asserted.select("qid"), "qid", "left_semi")
        (presence if once else actual).append(side(got, facet, subject))

    scopes = stored(table_scopes(graph), "scopes")
    ask = {d: q.where(F.col("selector.direction") == d).select("qid", F.col("node").alias("id")) for d in ("Forward", "Backward")}
    answers = {d: trace(graph, starts, d, query) for d, starts in ask.items()}
    both = lambda part: part("Forward").unionByName(part("Backward"))
    nodes = stored(both(lambda d: answers[d].nodes.select("qid", "id", "kind", "displayName")), "nodes")
    bridges = stored(both(lambda d: answers[d].event_bridges), "bridges")
    limits = stored(both(lambda d: answers[d].limitations.select("qid", "code")), "limits")
    layer = stored(answers["Forward"].tables.join(scopes, "table", "left").withColumn("scope", F.coalesce("scope", F.lit("Outside"))), "tables")
    roots = stored(answers["Backward"].entry_points.select("qid", "rootKind", F.explode("roots").alias("r")).select("qid", "rootKind", F.col("r.displayName").alias("item")), "roots")

    # tables and columns, by scope
    tables = q.where("expected.tables is not null")
    want = tables.select("qid", F.col("expected.columnKind").alias("columnKind"), F.explode("expected.tables").alias("t")).select("qid", "columnKind", "t.*")
    want = stored(want.join(scopes, want["name"] == scopes["table"], "left").withColumn("scope", F.coalesce("scope", F.lit("Outside"))).drop("table"), "wanted")
    got = layer.join(tables.select("qid", F.col("expected.columnKind").alias("columnKind")), "qid")
    column_facet = F.when(F.col("columnKind") == "Read", "ColumnRead").otherwise("ColumnWrite")
    for rows, into in ((want.withColumn("item", F.col("name")), expected), (got.withColumn("item", F.col("table")), actual)):
        into.append(side(rows, "Table", "table", "scope"))
    cols = want.select("qid", "columnKind", "scope", F.explode("columns").alias("c"), "name").withColumn("item", F.concat_ws(".", "name", "c"))
    got_cols = got.select("qid", "columnKind", "scope", "table", F.explode("columns").alias("c")).withColumn("item", F.concat_ws(".", "table", "c.column"))
    expected.append(side(cols, column_facet, "column", "scope"))
    actual.append(side(got_cols, column_facet, "column", "scope"))
    # access of the tables found
    pairs = want.join(layer.select("qid", F.col("table").alias("name"), F.col("access").alias("found")), ["qid", "name"])
    wrong = pairs.where(access_letters(F.col("access")) != access_letters(F.col("found")))
    subjects.append(pairs.select("qid", F.lit("Table").alias("facet"), F.lit("None").alias("scope"), F.lit("access").alias("subject"), F.lit(True).alias("presence")).distinct())
    expected.append(side(pairs.withColumn("item", F.col("name")), "Table", "access"))
    presence.append(side(pairs.join(wrong.select("qid", "name"), ["qid", "name"], "left_anti").withColumn("item", F.col("name")), "Table", "access"))
    # the other facets
    for name, kind in (("endpoint", "Endpoint"), ("consumer", "Consumer"), ("backgroundJob", "BackgroundService")):
        own = q.where(f"expected.roots.{name} is not null")
        compare(own, "Root", name, own.select("qid", F.explode(f"expected.roots.{name}").alias("item")), roots.where(F.col("rootKind") == kind))
    own = q.where("expected.events.consumedBy is not null")
    sinks = bridges.select("qid", F.explode("consumedBy").alias("id")).join(graph.nodes.select("id", "displayName"), "id", "left").select("qid", F.coalesce("displayName", "id").alias("item"))
    compare(own, "Event", "consumedBy", own.select("qid", F.explode("expected.events.consumedBy").alias("item")), sinks)
    own = q.where("expected.events.publishedBy is not null")
    sources = bridges.where(F.size("publishedBy") > 0).select("qid", F.substring_index("name", ".", -1).alias("item"))
    compare(own, "Event", "publishedBy", own.select("qid", F.explode("expected.events.publishedBy").alias("item")), sources)
    own = q.where("expected.limitations is not null")
    wanted = own.select("qid", F.explode("expected.limitations").alias("item"))
    have = limits.withColumnRenamed("code", "item").distinct()
    compare(own, "Limitation", "code", wanted, wanted.join(have, ["qid", "item"], "left_semi"), once=True)
    own = q.where("expected.nodes is not null")
    compare(own, "Node", "node", own.select("qid", F.explode("expected.nodes").alias("item")), nodes.withColumnRenamed("displayName", "item"))
    # external stores: greedy suffixes
    own = q.where("expected.externalStores is not null")
    calls = nodes.where("kind = 'ExternalCall'").groupBy("qid").agg(F.collect_list("displayName").alias("have"))
    none = F.array().cast("array<string>")
    stores = own.join(calls, "qid", "left").withColumn("have", F.coalesce("have", none)).withColumn("m", suffix_match(F.col("expected.externalStores"), F.col("have")))
    stores = stored(stores.select("qid", F.col("expected.externalStores").alias("want"), "have", "m"), "stores")
    store = lambda side_, kind: stores.select("qid", F.lit("ExternalStore").alias("facet"), F.lit("None").alias("scope"), F.lit("store").alias("subject"), F.explode(side_).alias("item"), F.lit(1).cast("long").alias("n"), F.lit(kind).alias("kind"))

    all_e, all_a, all_p = (_union(x) for x in (expected, actual, presence))
    all_s = _union(subjects).unionByName(stores.select("qid", F.lit("ExternalStore").alias("facet"), F.lit("None").alias("scope"), F.lit("store").alias("subject"), F.lit(False).alias("presence")))
    diff = multiset_diff(all_e, all_a.unionByName(all_p), KEYS)
    diff = diff.select(*KEYS, "item", F.col("missing").alias("n"), F.lit("missing").alias("kind")).unionByName(diff.select(*KEYS, "item", F.col("unexpected").alias("n"), F.lit("unexpected").alias("kind"))).where("n > 0")
    diff = stored(diff.unionByName(store("m.missing", "missing").unionByName(store("m.rest", "unexpected"))), "differences")
    counts = lambda rows, name: rows.groupBy(*KEYS).agg(F.count("*").alias(name))
    sizes = counts(all_e, "expected").join(counts(all_a.unionByName(all_p), "actual"), list(KEYS), "full")
    sizes = sizes.unionByName(stores.select("qid", F.lit("ExternalStore").alias("facet"), F.lit("None").alias("scope"), F.lit("store").alias("subject"), F.size("want").cast("long").alias("expected"), F.size("have").cast("long").alias("actual")))
    per = diff.groupBy(*KEYS).agg(F.sum(F.when(F.col("kind") == "missing", F.col("n")).otherwise(0)).alias("missing"), F.sum(F.when(F.col("kind") == "unexpected", F.col("n")).otherwise(0)).alias("unexpected"))
    comparisons = all_s.join(sizes, list(KEYS), "full").join(per, list(KEYS), "left").na.fill(0).na.fill(False, ["presence"])
    comparisons = stored(comparisons.withColumn("found", F.col("expected") - F.col("missing")), "comparisons")
    # evidence of each written column asked for
    claims = layer.select("qid", "table", F.explode("columns").alias("c")).select("qid", F.col("table").alias("name"), F.col("c.column").alias("c"), "c.confidence", F.array_join("c.mechanisms", "+").alias("mechanisms"))
    ev = cols.where("columnKind is null or columnKind <> 'Read'").select("qid", "name", "c").join(claims, ["qid", "name", "c"], "left")
    outcome = F.when(F.col("confidence").isNull(), "NotFound").when(F.col("confidence").isin("Direct", "RowLevel"), "ExpectedMechanism").otherwise("DifferentButValid")
    evidence = ev.select("qid", F.col("name").alias("table"), F.col("c").alias("column"), outcome.alias("outcome"), F.coalesce("mechanisms", F.lit("")).alias("mechanisms"))
    bad = diff.groupBy("qid").agg(F.sum(F.when(F.col("kind") == "missing", F.col("n")).otherwise(0)).alias("misses"), F.sum(F.when(F.col("kind") == "unexpected", F.col("n")).otherwise(0)).alias("false_positives"))
    results = q.select("qid", "node").join(bad, "qid", "left").na.fill(0)
    if verdicts is not None:
        results = results.join(verdicts.select(F.col("question").alias("qid"), "verdict"), "qid", "left")
    else:
        results = results.withColumn("verdict", F.lit(None).cast("string"))
    results = results.withColumn("verdict", F.when((F.col("misses") == 0) & (F.col("false_positives") == 0), "").otherwise(F.coalesce("verdict", F.lit("pending"))))
    return EvalRun(found, unresolved, comparisons, diff, evidence, results)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- scores -----------------------------------------------------------------------


def recall(found: Column, expected: Column) -> Column:
    """Null where nothing was expected."""
    return F.when(expected > 0, found / expected)


def precision(actual: Column, false_positives: Column, presence: Column) -> Column:
    """Null where only presence was judged, or nothing was claimed."""
    return F.when(~presence & (actual > 0), (actual - false_positives) / actual)


def metric_rows(comparisons: DataFrame) -> DataFrame:
    """facet, scope, expected, found, actual, false_positives, recall, precision."""
    m = comparisons.groupBy("facet", "scope").agg(
        F.sum("expected").alias("expected"), F.sum("found").alias("found"), F.sum("actual").alias("actual"), F.sum("unexpected").alias("false_positives"), F.bool_and("presence").alias("presence")
    )
    r, p = recall(F.col("found"), F.col("expected")), precision(F.col("actual"), F.col("false_positives"), F.col("presence"))
    return m.withColumn("recall", r).withColumn("precision", p).withColumn("ordinal", ordinal(F.col("facet"), "FacetKind"))


def evidence_tally(evidence: DataFrame) -> DataFrame:
    return evidence.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("ExpectedMechanism", "DifferentButValid", "NotFound")])


def category_rows(questions: DataFrame, results: DataFrame) -> DataFrame:
    """By population class: questions, declared counts, ids that represent
    nothing, sums of misses and false positives."""
    p = questions.select(F.col("id").alias("qid"), F.col("population.class").alias("class"), F.col("population.count").alias("count"), F.col("population.representative").alias("rep"))
    return (
        p.join(results, "qid", "left")
        .groupBy("class")
        .agg(
            F.count("*").alias("questions"), F.array_sort(F.collect_set("count")).alias("counts"), F.array_sort(F.collect_list(F.when(~F.col("rep"), F.col("qid")))).alias("not_representative"),
            F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"), F.coalesce(F.sum("false_positives"), F.lit(0)).alias("false_positives"),
        )
        .orderBy(F.length("class"), "class")
    )


def prediction_boxes(predictions: DataFrame) -> DataFrame:
    """The 3 x 2 table of (row, realised), empty cells kept; predictions: id,
    row, realised."""
    cells = predictions.sparkSession.createDataFrame([(r, b) for r in ("closed", "open", "none") for b in (True, False)], "row string, realised boolean")
    n = predictions.groupBy("row", "realised").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return cells.join(n, ["row", "realised"], "left").select("row", "realised", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def predictions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """id, row, realised: what a question said of itself (``expectedToFail``)
    and whether it came true."""
    q = questions.select("id", F.coalesce(F.size("expectedToFail"), F.lit(0)).alias("n"), F.exists(F.coalesce("expectedToFail", F.from_json(F.lit("[]"), questions.schema["expectedToFail"].dataType)), lambda x: x["closedIn"].isNull()).alias("open"))
    row = F.when(F.col("n") <= 0, "none").when(F.col("open"), "open").otherwise("closed")
    bad = results.select(F.col("qid").alias("id"), ((F.col("misses") > 0) | (F.col("false_positives") > 0)).alias("realised"))
    return q.withColumn("row", row).join(bad, "id", "left").select("id", "row", F.coalesce("realised", F.lit(False)).alias("realised"))


def meta_coverage(questions: DataFrame, families: dict[str, int] | None = None) -> DataFrame:
    """Every known limit, with the questions that touch it; ``L16-4`` also
    counts for ``L16``."""
    families = families or {"F": 10, "L": 24}
    spark = questions.sparkSession
    every = spark.createDataFrame([(f"{f}{i}", f, i) for f, n in families.items() for i in range(1, n + 1)], "limit string, family string, number int")
    named = questions.select(F.col("id").alias("qid"), F.explode("expectedToFail").alias("x")).select("qid", F.col("x.id").alias("limit"))
    named = named.unionByName(named.where(F.col("limit").contains("-")).select("qid", F.substring_index("limit", "-", 1).alias("limit"))).distinct()
    n = named.groupBy("limit").agg(F.array_sort(F.collect_set("qid")).alias("questions"))
    return every.join(n, "limit", "left").select("limit", "family", "number", F.coalesce("questions", F.array().cast("array<string>")).alias("questions"), F.when(F.col("questions").isNull(), "no question touches it").otherwise("").alias("reason"))


def verdict_tally(results: DataFrame) -> DataFrame:
    """verdict, n over the answers that differ."""
    return results.where("verdict <> ''").groupBy("verdict").agg(F.count("*").alias("n"))


def failure_axes(questions: DataFrame, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, limit, fits: whether an expected failure is on an axis that the
    question asserts at all."""
    e = F.col("expected")
    asserted = F.array_compact(F.array(*[F.when(e[k].isNotNull(), F.lit(k)) for k in ("tables", "roots", "events", "externalStores", "limitations", "nodes")]))
    table = F.create_map(*[x for k, v in axes.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    each = questions.select("id", asserted.alias("asserted"), F.explode("expectedToFail").alias("x"))
    own = F.coalesce(F.try_element_at(table, F.col("x.id")), F.array().cast("array<string>"))
    return each.select("id", F.col("x.id").alias("limit"), F.arrays_overlap(own, "asserted").alias("fits"))
