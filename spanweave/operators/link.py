"""Facts to graph: the joins and fix points between an extractor and a graph.

Facts are tables that a front end writes (see ``FACTS``); everything here is
relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.text import module_of_name, route_combine
from spanweave.model import EDGE, Graph, endpoint_id
from spanweave.tables import stored

SITE = "struct<filePath:string,line:int,column:int,conditional:boolean>"
FACTS: dict[str, str] = {
    "projects": "name string, path string, module string, layer string, is_test boolean",
    "methods": "id string, name string, containing_type string, file string, line int, module string, layer string, project string, is_test boolean",
    "invocations": "caller_id string, callee_id string, candidate_reason string, in_source boolean, callee_is_interface boolean, file string, line int, column int, conditional boolean, text string",
    "implementations": "interface_member_id string, impl_id string, module string",
    "map_calls": "enclosing_id string, origin_kind string, relative_prefix string, verb string, route_suffix string, file string, line int, module string",
    "propagations": "enclosing_id string, target_id string, origin_kind string, relative_prefix string, file string, line int",
    "raises": f"method_id string, domain_event string, argument_is_interface boolean, site {SITE}",
    "event_registry": f"domain_event string, integration_event string, site {SITE}",
    "consumers": "event_type string, consume_method_id string, consumer_type string, file string, line int",
    "hosted_services": "method_id string",
    "ef_entities": "context string, clr_name string, schema string, table string, owner_clr string, mapped_to_json boolean",
    "ef_properties": "context string, clr_name string, name string, column string, json_name string, declaring_clr string, shadow boolean, row_version boolean, store_type string, complex_name string, complex_owner string",
    "entity_accesses": "method_id string, entity string, kind string, mechanism string, evidence string, whole_row boolean",
    "save_changes": "method_id string, context string",
    "column_writes": "method_id string, entity string, declaring_clr string, property string, table string, column string, mechanism string, evidence string, decl_file string, decl_line int",
    "external_calls": "method_id string, caller_clr string, evidence string, file string, line int",
    "interceptor_writes": "interceptor string, entity string, evidence string",
    "table_locations": "module string, table string, file string, line int",
    "raw_sql_sites": "method_id string, text string, file string, line int",
    "base_types": "clr_name string, base_clr string",
    "members": "clr_name string, name string, file string, line int",
    "commits": "file string, sha string, subject string, seq int",
    "diagnostics": "text string",
}
MAX_PREFIXES = 8

# Names by which calls on the database or on HTTP clients are known.
WRITE_METHODS = (
    "Add", "AddAsync", "AddRange", "AddRangeAsync", "Update", "UpdateRange", "Remove", "RemoveRange", "Attach", "AttachRange",
    "ExecuteUpdate", "ExecuteUpdateAsync", "ExecuteDelete", "ExecuteDeleteAsync",
)
WHOLE_ROW_METHODS = ("Add", "AddAsync", "AddRange", "AddRangeAsync", "Update", "UpdateRange")
SAVE_METHODS = ("SaveChanges", "SaveChangesAsync")
RAW_SQL_METHODS = (
    "ExecuteSql", "ExecuteSqlAsync", "ExecuteSqlRaw", "ExecuteSqlRawAsync", "ExecuteSqlInterpolated", "ExecuteSqlInterpolatedAsync",
    "FromSqlRaw", "FromSqlInterpolated", "SqlQueryRaw", "SqlQuery", "CreateCommand",
)
CONTEXT_TYPE = "Microsoft.EntityFrameworkCore.DbContext"
HTTP_CLIENT_TYPES = ("System.Net.Http.HttpClient", "System.Net.Http.HttpMessageInvoker")


def production(facts: dict[str, DataFrame]) -> DataFrame:
    """Methods that linking may use: no test code, one row per id."""
    return facts["methods"].where("not coalesce(is_test, false)").dropDuplicates(["id"])


# --- routes -----------------------------------------------------------------------


def _targets(sites: DataFrame, implementations: DataFrame) -> DataFrame:
    """Calls of interface members also reach what implements them."""
    impl = implementations.select(F.col("interface_member_id").alias("target_id"), F.col("impl_id"))
    through = sites.join(impl, "target_id").drop("target_id").withColumnRenamed("impl_id", "target_id")
    return sites.unionByName(through.select(sites.columns)).distinct()


def _least_prefixes(level: DataFrame, push: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` least prefixes of each method, and the methods with more.  A
    cycle only lengthens a prefix, which makes it greater, so this ends."""
    place = F.row_number().over(Window.partitionBy("method").orderBy("prefix"))
    known = over = None
    while True:
        if known is not None:
            level = level.join(known, ["method", "prefix"], "left_anti")
        ranked = level.withColumn("_new", F.lit(True))
        if known is not None:
            ranked = ranked.unionByName(known.withColumn("_new", F.lit(False)))
        ranked = stored(ranked.withColumn("_n", place), "prefixes")
        left_out = ranked.where(F.col("_n") > most).select("method")
        over = left_out if over is None else over.unionByName(left_out)
        level = ranked.where(F.col("_new") & (F.col("_n") <= most)).select("method", "prefix")
        if level.isEmpty():
            break
        known = ranked.where(F.col("_n") <= most).select("method", "prefix")
        level = level.join(push, F.col("method") == F.col("enclosing_id")).select(F.col("target_id").alias("method"), route_combine(F.col("prefix"), F.col("relative")).alias("prefix")).distinct()
    return (level if known is None else known), over.distinct()


def _all_prefixes(level: DataFrame, push: DataFrame) -> DataFrame:
    """Every prefix of each method.  A way that comes to a method it has passed
    is not followed round again: what it would add has no end."""
    level = level.withColumn("passed", F.array("method"))
    found = None
    while True:
        level = stored(level, "prefixes")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        on = level.join(push, (F.col("method") == F.col("enclosing_id")) & ~F.array_contains("passed", F.col("target_id")))
        passed = F.array_sort(F.array_append("passed", F.col("target_id")))  # in any order, so that equal ways are one
        level = on.select(F.col("target_id").alias("method"), route_combine(F.col("prefix"), F.col("relative")).alias("prefix"), passed.alias("passed")).distinct()
    return (level if found is None else found).select("method", "prefix").distinct()


def route_prefixes(propagations: DataFrame, implementations: DataFrame, most: int | None = MAX_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """(method, prefix) of the prefixes under which each method is mounted, and
    the (method, ) of those that have more than ``most``.

    Starts at rooted propagations and pushes along those of parameters until
    nothing is new; a method keeps its ``most`` least prefixes, or all with None.
    """
    sites = stored(_targets(propagations.select("enclosing_id", "target_id", "origin_kind", "relative_prefix"), implementations), "propagations")
    level = sites.where("origin_kind = 'Root'").select(F.col("target_id").alias("method"), route_combine(F.coalesce("relative_prefix", F.lit(""))).alias("prefix")).distinct()
    push = sites.where("origin_kind = 'Parameter'").select("enclosing_id", "target_id", F.coalesce("relative_prefix", F.lit("")).alias("relative"))
    if most is not None:
        return _least_prefixes(level, push, most)
    every = _all_prefixes(level, push)
    return every, every.select("method").where("false")


def prefix_diagnostics(over: DataFrame, most: int = MAX_PREFIXES) -> DataFrame:
    """text: one line for each method that has more prefixes than are kept."""
    return over.select(F.concat(F.lit(f"more than {most} route prefixes, the others are left out: "), "method").alias("text"))


def endpoints(facts: dict[str, DataFrame], prefixes: DataFrame | None = None, most: int | None = MAX_PREFIXES) -> DataFrame:
    """id, displayName, method, module, file, line, status of each mapped route;
    one for each prefix.  A route that cannot be resolved stays, with its reason."""
    calls = facts["map_calls"]
    if prefixes is None:
        prefixes = route_prefixes(facts["propagations"], facts["implementations"], most)[0]
    prefixes = prefixes.select(F.col("method").alias("enclosing_id"), "prefix")
    known = calls.join(prefixes, "enclosing_id", "left")
    rooted = F.col("origin_kind") == "Root"
    base = F.when(rooted, F.lit("")).when(F.col("origin_kind") == "Parameter", F.col("prefix"))
    status = F.when(F.col("route_suffix").isNull(), "route-not-constant").when(base.isNull(), "prefix-not-resolved").otherwise("ok")
    route = route_combine(F.coalesce(base, F.lit("")), F.coalesce("relative_prefix", F.lit("")), F.coalesce("route_suffix", F.lit("")))
    out = known.where(~rooted | F.col("prefix").isNull()).unionByName(known.where(rooted & F.col("prefix").isNotNull()).withColumn("prefix", F.lit(None).cast("string")).distinct())
    return out.select(
        endpoint_id(F.col("verb"), route).alias("id"), F.concat(F.upper("verb"), F.lit(" "), route).alias("displayName"), F.col("enclosing_id").alias("method"),
        "module", "file", "line", status.alias("status"),
    ).distinct()


VERBS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}


def endpoint_candidates(candidates: DataFrame) -> DataFrame:
    """verb and reason of calls that look like endpoint maps; candidates: name,
    bound, is_extension, ... ; reason is null for those that are."""
    verb = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    got = candidates.withColumn("verb", F.try_element_at(verb, F.col("name")))
    reason = F.when(F.col("verb").isNull(), "unknown-verb").when(~F.col("bound"), "symbol-not-bound").when(~F.col("is_extension"), "not-a-framework-extension")
    return got.withColumn("reason", reason)


# --- events -------------------------------------------------------------------------


def published(facts: dict[str, DataFrame]) -> DataFrame:
    """method_id, domain_event, integration_event, status, site of each raise."""
    reg = facts["event_registry"].select("domain_event", "integration_event").distinct()
    r = facts["raises"].join(reg, "domain_event", "left")
    status = F.when(F.col("argument_is_interface") | F.col("domain_event").isNull(), "RaiseArgumentUnresolved").when(F.col("integration_event").isNull(), "InternalDomainEvent").otherwise("Published")
    return r.select("method_id", "domain_event", "integration_event", status.alias("status"), "site")


def event_edges(facts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Publish and consume edges, and diagnostics of events nobody consumes."""
    pub = published(facts).where("status = 'Published'")
    event = F.concat(F.lit("event:"), F.col("integration_event"))
    sites = F.when(F.col("site").isNotNull(), F.array("site")).otherwise(F.array().cast(f"array<{SITE}>"))
    up = pub.select(F.col("method_id").alias("fromId"), event.alias("toId"), F.lit("Publishes").alias("kind"), F.col("domain_event").alias("evidence"), F.lit(False).alias("ambiguous"), F.lit("DomainEventRegistry").alias("mechanism"), sites.alias("callSites"))
    con = facts["consumers"].dropDuplicates(["event_type", "consume_method_id"])
    down = con.join(pub.select(F.col("integration_event").alias("event_type")).distinct(), "event_type", "left_semi")
    site = F.struct(F.col("file").alias("filePath"), "line", F.lit(1).alias("column"), F.lit(False).alias("conditional"))
    down = down.select(F.concat(F.lit("event:"), "event_type").alias("fromId"), F.col("consume_method_id").alias("toId"), F.lit("Consumes").alias("kind"), F.col("consumer_type").alias("evidence"), F.lit(False).alias("ambiguous"), F.lit("ConsumerRegistration").alias("mechanism"), F.array(site).alias("callSites"))
    alone = pub.select(F.col("integration_event").alias("event_type")).distinct().join(con.select("event_type").distinct(), "event_type", "left_anti")
    return up.unionByName(down), alone.select(F.concat(F.lit("published event has no consumer: "), "event_type").alias("text"))


# --- calls --------------------------------------------------------------------------


def call_edges(facts: dict[str, DataFrame], policy: str = "AllImplementations") -> DataFrame:
    """Call edges with their sites put together, and an edge without a site
    from each interface member to what implements it; ambiguous if there is
    more than one."""
    inv = facts["invocations"].where("in_source and callee_id is not null")
    site = F.struct(F.col("file").alias("filePath"), "line", "column", "conditional")
    direct = inv.groupBy(F.col("caller_id").alias("fromId"), F.col("callee_id").alias("toId")).agg(F.array_sort(F.collect_set(site)).alias("callSites"), F.min_by("text", F.struct("file", "line", "column")).alias("evidence"))
    direct = direct.select("fromId", "toId", F.lit("Calls").alias("kind"), "evidence", F.lit(False).alias("ambiguous"), F.lit("None").alias("mechanism"), "callSites")
    impl = facts["implementations"]
    if policy == "DeclaringModuleOnly":
        own = facts["methods"].select(F.col("id").alias("interface_member_id"), F.col("module").alias("own"))
        impl = impl.join(own, "interface_member_id").where("module = own").drop("own")
    used = inv.where("callee_is_interface").select(F.col("callee_id").alias("interface_member_id")).distinct()
    many = F.count("*").over(Window.partitionBy("interface_member_id")) > 1
    spread = impl.select("interface_member_id", "impl_id").distinct().withColumn("ambiguous", many).join(used, "interface_member_id", "left_semi")
    spread = spread.select(F.col("interface_member_id").alias("fromId"), F.col("impl_id").alias("toId"), F.lit("Calls").alias("kind"), F.lit(None).cast("string").alias("evidence"), "ambiguous", F.lit("None").alias("mechanism"), F.array().cast(f"array<{SITE}>").alias("callSites"))
    return direct.unionByName(spread)


def merge_edges(edges: DataFrame, by_mechanism: bool = False) -> DataFrame:
    """One edge per (from, to, kind[, mechanism]): distinct call sites, the
    first evidence by its mechanism and text, ambiguous if any is."""
    keys = ["fromId", "toId", "kind", *(["mechanism"] if by_mechanism else [])]
    agg = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("callSites")))).alias("callSites"), F.min("evidence").alias("evidence"), F.bool_or("ambiguous").alias("ambiguous")]
    if not by_mechanism:
        agg.append(F.min("mechanism").alias("mechanism"))
    return edges.groupBy(*keys).agg(*agg).select(*EDGE.names)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id: ambiguous if any is, the least depth, the rest of the
    first by depth and file."""
    rest = [c for c in nodes.columns if c not in ("id", "ambiguous", "depth")]
    return nodes.groupBy("id").agg(F.bool_or("ambiguous").alias("ambiguous"), F.min("depth").alias("depth"), F.min_by(F.struct(*rest), F.struct("depth", "filePath", "line")).alias("r")).select("id", "ambiguous", "depth", "r.*").select(*nodes.columns)


def walk(hops: DataFrame, roots: DataFrame, max_depth: int = 20, budget: int = 5000) -> tuple[DataFrame, bool]:
    """(id, depth, truncated of what the roots reach over hops (src, dst,
    cost); whether the budget ended the walk).

    Interface members cost one hop more to their implementations, events one,
    consumers two, so depths are least sums.  Stops growing at ``budget`` nodes;
    a node is truncated if its next hop would pass the depth, or if the budget
    left a neighbour out.
    """
    frontier = stored(roots.select("id").distinct().withColumn("depth", F.lit(0)), "walk")
    levels, spent = [frontier], False

    def best() -> DataFrame:
        every = levels[0]
        for level in levels[1:]:
            every = every.unionByName(level)
        return every.groupBy("id").agg(F.min("depth").alias("depth"))

    while True:
        new = frontier.join(hops, frontier["id"] == hops["src"]).select(F.col("dst").alias("id"), (F.col("depth") + F.col("cost")).alias("depth")).where(F.col("depth") <= max_depth)
        new = new.groupBy("id").agg(F.min("depth").alias("depth"))
        old = best().select("id", F.col("depth").alias("_old"))
        new = stored(new.join(old, "id", "left").where("_old is null or depth < _old").select("id", "depth"), "walk")
        if new.isEmpty():
            break
        if best().count() >= budget:
            spent = not new.join(best().select("id"), "id", "left_anti").isEmpty()
            break
        frontier = new
        levels.append(frontier)
    found = stored(best(), "walk")
    onward = found.join(hops, found["id"] == hops["src"])
    cut = onward.where(F.col("depth") + F.col("cost") > max_depth).select("id")
    if spent:
        cut = cut.unionByName(onward.join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("id"))
    cut = cut.distinct().withColumn("truncated", F.lit(True))
    return found.join(cut, "id", "left").select("id", "depth", F.coalesce("truncated", F.lit(False)).alias("truncated")), spent


def walk_counters(invocations: DataFrame) -> DataFrame:
    return invocations.agg(
        F.count("*").alias("examined"), F.count_if(F.col("callee_id").isNotNull()).alias("resolved"), F.count_if(F.col("callee_id").isNull() & F.col("candidate_reason").isNotNull()).alias("candidate"),
        F.count_if(F.col("callee_id").isNull() & F.col("candidate_reason").isNull()).alias("unresolved"), F.count_if(F.col("callee_id").isNotNull() & ~F.col("in_source")).alias("framework"), F.count_if("callee_is_interface").alias("interface"),
    )


# --- what a call does ---------------------------------------------------------------------


def base_chain(base_types: DataFrame) -> DataFrame:
    """clr_name, ancestor, distance: each type with its base types, level by
    level, itself at 0; types that only occur as a base are included."""
    up = stored(base_types.select("clr_name", "base_clr").where("base_clr is not null").distinct(), "bases")
    level = up.select("clr_name").union(up.select("base_clr")).distinct()
    level = stored(level.select("clr_name", F.col("clr_name").alias("ancestor"), F.lit(0).alias("distance")), "chain")
    known, distance = level, 0
    while True:
        distance += 1
        new = level.select("clr_name", F.col("ancestor").alias("at")).join(up.select(F.col("clr_name").alias("at"), F.col("base_clr").alias("ancestor")), "at")
        level = stored(new.select("clr_name", "ancestor").distinct().join(known, ["clr_name", "ancestor"], "left_anti").withColumn("distance", F.lit(distance)), "chain")
        if level.isEmpty():  # also where base types run in a circle
            return known
        known = known.unionByName(level)


def http_calls(calls: DataFrame, base_types: DataFrame) -> DataFrame:
    """The calls (containing_type, ...) of methods that an HTTP client type, or
    a type below one, declares."""
    own = calls.sparkSession.createDataFrame([(t,) for t in HTTP_CLIENT_TYPES], "containing_type string")
    below = base_chain(base_types).where(F.col("ancestor").isin(*HTTP_CLIENT_TYPES)).select(F.col("clr_name").alias("containing_type"))
    return calls.join(own.unionByName(below).distinct(), "containing_type", "left_semi").select(calls.columns)


def discover_contexts(types: DataFrame, base_types: DataFrame) -> DataFrame:
    """clr_name, file, line of the classes below the mapper's context type that
    are not abstract and not test code; types: clr_name, is_abstract, is_test,
    file, line.  A class declared in parts has its first place."""
    below = base_chain(base_types).where((F.col("ancestor") == CONTEXT_TYPE) & (F.col("distance") > 0)).select("clr_name")
    own = types.where("not is_abstract and not is_test").join(below, "clr_name", "left_semi")
    return own.groupBy("clr_name").agg(F.min(F.struct("file", "line")).alias("at")).select("clr_name", "at.file", "at.line")


def output_project(projects: DataFrame) -> DataFrame:
    """name, problem: the application whose build output is read: the host if
    there is one, else the first; projects: name, module, is_application,
    is_test, output_path, built.  One row; a problem says why there is none."""
    apps = projects.where("is_application and not is_test")
    first = apps.agg(F.min_by(F.struct("name", "output_path", "built"), F.struct(F.col("module") != "Host", "name")).alias("p")).select("p.*")
    problem = (
        F.when(F.col("name").isNull(), "no application project")
        .when(F.coalesce("output_path", F.lit("")) == "", F.concat("name", F.lit(" reports no output path")))
        .when(~F.col("built"), F.concat("name", F.lit(" has not been built")))
    )
    return first.select("name", problem.alias("problem"))


def database_calls(calls: DataFrame) -> DataFrame:
    """calls (name, on_context, on_set, ...) with ``does``: RawSql, Save or
    Write, or null; and ``whole_row``.  Raw SQL is looked for first, then
    saving on a context, then writes on either."""
    name, any_ = F.col("name"), F.col("on_context") | F.col("on_set")
    does = F.when(name.isin(*RAW_SQL_METHODS) & any_, "RawSql").when(name.isin(*SAVE_METHODS) & F.col("on_context"), "Save").when(name.isin(*WRITE_METHODS) & any_, "Write")
    return calls.withColumn("does", does).withColumn("whole_row", F.coalesce((F.col("does") == "Write") & name.isin(*WHOLE_ROW_METHODS), F.lit(False)))


# --- the data layer --------------------------------------------------------------------


#: Rows that one task of ``merge_accesses`` sorts, about.
ACCESS_ROWS = 500_000


def merge_accesses(accesses: DataFrame, rows: int | None = None) -> DataFrame:
    """One per (method, entity, kind, mechanism); a whole-row access gives the
    evidence if there is one.  ``rows``: about how many there are, if known;
    the tasks, which sort texts, are then many enough to stay small."""
    keys = ["method_id", "entity", "kind", "mechanism"]
    if rows is not None:
        accesses = accesses.repartition(1 + rows // ACCESS_ROWS, *keys)
    return accesses.groupBy(*keys).agg(F.min_by("evidence", F.struct(~F.col("whole_row"), "evidence")).alias("evidence"), F.bool_or("whole_row").alias("whole_row"))


def saved_entities(facts: dict[str, DataFrame]) -> DataFrame:
    """Second-class writes: parameters' entities that a bare save's context
    maps and that the method does not already write."""
    mapped = facts["ef_entities"].select("context", F.col("clr_name").alias("entity")).distinct()
    seen = facts["entity_accesses"].groupBy("method_id", "entity").agg(F.bool_or(F.col("kind") == "Writes").alias("written"))
    saves = facts["save_changes"].select("method_id", "context").distinct()
    got = seen.where("not coalesce(written, false)").join(saves, "method_id").join(mapped, ["context", "entity"])
    return got.select("method_id", "entity", F.lit("Writes").alias("kind"), F.lit("SaveChangesWithEntityParameter").alias("mechanism"), F.concat(F.lit("save through "), "context").alias("evidence"), F.lit(False).alias("whole_row"))


def columns_of(facts: dict[str, DataFrame]) -> DataFrame:
    """declaring, property, clr_name, table, column: both ways in which a
    property is named, by its own type or by the owner of its complex type."""
    e = facts["ef_entities"].where("table is not null").select("context", "clr_name", F.concat_ws(".", "schema", "table").alias("table"))
    p = facts["ef_properties"].where("column is not null").join(e, ["context", "clr_name"])
    own = p.select(F.col("declaring_clr").alias("declaring"), F.col("name").alias("property"), "clr_name", "table", "column", "row_version")
    owner = p.where("complex_owner is not null").select(F.col("complex_owner").alias("declaring"), F.col("complex_name").alias("property"), "clr_name", "table", "column", "row_version")
    return own.unionByName(owner).distinct()


def resolved_columns(facts: dict[str, DataFrame]) -> DataFrame:
    """Property writes with their columns, in the module of the writer; what
    has none keeps a null column."""
    methods = production(facts).select(F.col("id").alias("method_id"), F.col("module").alias("own"))
    cols = columns_of(facts).select(F.col("declaring").alias("declaring_clr"), "property", "table", "column", module_of_name(F.col("clr_name")).alias("of"))
    writes = facts["column_writes"].drop("table", "column").join(methods, "method_id")
    hit = writes.join(cols, ["declaring_clr", "property"], "left").where("of is null or of = own")
    return hit.drop("own", "of")


def interceptor_accesses(facts: dict[str, DataFrame]) -> DataFrame:
    """Entities an interceptor writes, for each method that saves a context;
    only if the entity has exactly one mapping."""
    one = facts["ef_entities"].withColumn("_n", F.count("*").over(Window.partitionBy("clr_name"))).where("_n = 1").select("context", F.col("clr_name").alias("entity"))
    per = facts["interceptor_writes"].join(one, "entity").dropDuplicates(["context", "entity"])
    # distinct before the entities of a context come to each method: no two rows are equal after
    got = facts["save_changes"].select("method_id", "context").distinct().join(per, "context")
    return got.select("method_id", "entity", F.lit("Writes").alias("kind"), F.lit("SaveChangesInterceptor").alias("mechanism"), "evidence", F.lit(False).alias("whole_row"))


def row_columns(facts: dict[str, DataFrame], resolved: DataFrame | None = None) -> DataFrame:
    """Every mapped column, but row versions, of a row written whole that no
    assignment of the same method names; ``resolved``: ``resolved_columns``, if
    at hand."""
    resolved = resolved_columns(facts) if resolved is None else resolved
    whole = facts["entity_accesses"].where("kind = 'Writes' and whole_row").select("method_id", "entity", "evidence").distinct()
    cols = columns_of(facts).where("not coalesce(row_version, false)").select(F.col("clr_name").alias("entity"), "table", "column").distinct()
    named = resolved.where("column is not null").select("method_id", "table", "column").distinct()
    got = whole.join(cols, "entity").join(named, ["method_id", "table", "column"], "left_anti")
    return got.select("method_id", "table", "column", F.lit("RowInsert").alias("mechanism"), "evidence")


def constructor_columns(facts: dict[str, DataFrame], resolved: DataFrame | None = None) -> DataFrame:
    """Columns a constructor assigns belong to whoever constructs: one row per
    (method, table, column, mechanism) with its least evidence and ``n``, the
    pairs of a construction and an assignment behind it.

    Both sides are counted by entity before they meet, so pairs are never rows.
    """
    resolved = resolved_columns(facts) if resolved is None else resolved
    made = facts["entity_accesses"].where("mechanism = 'EntityConstruction'").groupBy(F.col("method_id").alias("by"), "entity").agg(F.count("*").alias("made"))
    own = resolved.where("mechanism = 'EntityConstructorAssignment' and column is not null")
    own = own.groupBy("entity", "table", "column", "mechanism").agg(F.min("evidence").alias("evidence"), F.count("*").alias("own"))
    pairs = own.join(made, "entity").groupBy(F.col("by").alias("method_id"), "table", "column", "mechanism")
    return pairs.agg(F.min("evidence").alias("evidence"), F.sum(F.col("own") * F.col("made")).alias("n"))


def locate_members(facts: dict[str, DataFrame]) -> DataFrame:
    """clr_name, column, file, line: where the member behind a column is
    declared, looked for up the base types: a complex member by the entity's
    name of it first, then by its own."""
    p = facts["ef_properties"].where("column is not null").select("clr_name", "column", "name", "complex_name").distinct()
    tries = p.select("clr_name", "column", F.lit(0).alias("tier"), F.col("complex_name").alias("member")).unionByName(p.select("clr_name", "column", F.lit(1).alias("tier"), F.col("name").alias("member"))).where("member is not null")
    chain = base_chain(facts["base_types"]).where("distance > 0")
    types = tries.select("clr_name", F.col("clr_name").alias("ancestor"), F.lit(0).alias("distance")).distinct().unionByName(chain.join(tries.select("clr_name").distinct(), "clr_name", "left_semi"))
    members = facts["members"].where("line > 0").select(F.col("clr_name").alias("ancestor"), F.col("name").alias("member"), "file", "line")
    hit = tries.join(types, "clr_name").join(members, ["ancestor", "member"])
    best = hit.groupBy("clr_name", "column").agg(F.min(F.struct("tier", "distance", "file", "line")).alias("b"))
    return best.select("clr_name", "column", "b.file", "b.line")


def locate_tables(facts: dict[str, DataFrame]) -> DataFrame:
    """table, module, file, line: where the table is named, else its entity's
    own place; the first of several."""
    e = facts["ef_entities"].where("table is not null").select(F.concat_ws(".", "schema", "table").alias("qualified"), "table", "clr_name", module_of_name(F.col("clr_name")).alias("module"))
    place = facts["table_locations"].groupBy("module", "table").agg(F.min(F.struct("file", "line")).alias("at"))
    types = facts["methods"].groupBy(F.col("containing_type").alias("clr_name")).agg(F.min(F.struct("file", "line")).alias("own"))
    got = e.join(place, ["module", "table"], "left").join(types, "clr_name", "left")
    at = F.coalesce("at", "own")
    return got.select(F.col("qualified").alias("table"), "module", at["file"].alias("file"), at["line"].alias("line")).groupBy("table").agg(F.min_by(F.struct("module", "file", "line"), F.struct("file", "line")).alias("b")).select("table", "b.*")


def model_tables(facts: dict[str, DataFrame]) -> DataFrame:
    """Distinct tables of the model with their first owner."""
    return facts["ef_entities"].where("table is not null").groupBy(F.concat_ws(".", "schema", "table").alias("table")).agg(F.min("clr_name").alias("entity"))


def attributable(facts: dict[str, DataFrame]) -> DataFrame:
    """Entities that have no owner, or one of their own module."""
    return facts["ef_entities"].where(F.col("owner_clr").isNull() | (module_of_name(F.col("owner_clr")) == module_of_name(F.col("clr_name"))))


def overlay(facts: dict[str, DataFrame], reached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, diagnostics) of the data layer of the reached methods."""
    reached = reached.select(F.col("id").alias("method_id")).distinct()
    none = F.array().cast(f"array<{SITE}>")

    def edge(rows: DataFrame, from_: Column, to: Column, kind: Column | str, mechanism: Column | str, evidence: Column, ambiguous: Column | None = None) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return rows.select(from_.alias("fromId"), to.alias("toId"), lit(kind).alias("kind"), evidence.alias("evidence"), (ambiguous if ambiguous is not None else F.lit(False)).alias("ambiguous"), lit(mechanism).alias("mechanism"), none.alias("callSites"))

    def node(rows: DataFrame, id_: Column, kind: str, name: Column, module: Column) -> DataFrame:
        return rows.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("displayName"), F.coalesce(module, F.lit("unknown")).alias("module"), F.col("file").alias("filePath"), "line", F.lit(False).alias("ambiguous"), F.lit(False).alias("truncated"), F.lit(False).alias("utility"), F.lit(0).alias("depth"), F.lit("None").alias("rootKind"))

    acc = facts["entity_accesses"].unionByName(saved_entities(facts)).unionByName(interceptor_accesses(facts))
    acc = merge_accesses(acc).join(reached, "method_id", "left_semi")
    places = locate_tables(facts)
    owners = attributable(facts).where("table is not null").select("clr_name", F.concat_ws(".", "schema", "table").alias("table")).distinct()
    owners = owners.withColumn("many", F.count("*").over(Window.partitionBy("clr_name")) > 1)
    owners = owners.join(places.where("file is not null"), "table")
    ent = F.concat(F.lit("entity:"), F.col("clr_name"))
    tab = F.concat(F.lit("table:"), F.col("table"))
    hit = acc.join(owners.select("clr_name", "many").distinct(), acc["entity"] == F.col("clr_name"))
    edges = edge(hit, F.col("method_id"), ent, F.col("kind"), F.col("mechanism"), F.col("evidence"), F.col("many"))
    edges = edges.unionByName(edge(owners, ent, tab, "MapsTo", "EfModelMapping", F.lit(None).cast("string"), F.col("many")))
    resolved = stored(resolved_columns(facts), "resolved")
    named = resolved.select("method_id", "table", "column", "mechanism", "evidence")
    diagnostics = named.where("column is null").join(reached, "method_id", "left_semi").select(F.concat(F.lit("property written but not mapped to a column: "), "evidence").alias("text"))
    cols = named.where("column is not null").unionByName(constructor_columns(facts, resolved).drop("n")).unionByName(row_columns(facts, resolved)).join(reached, "method_id", "left_semi")
    cols = cols.join(places.where("file is not null").select("table", "module", F.col("file").alias("t_file"), F.col("line").alias("t_line")), "table")
    members = locate_members(facts).join(facts["ef_entities"].where("table is not null").select("clr_name", F.concat_ws(".", "schema", "table").alias("table")).distinct(), "clr_name")
    members = members.groupBy("table", "column").agg(F.min(F.struct("file", "line")).alias("m"))
    at = F.coalesce("m", F.struct(F.col("t_file").alias("file"), F.col("t_line").alias("line")))
    # an edge keeps its least evidence
    cols = cols.groupBy("method_id", "table", "column", "mechanism", "module", "t_file", "t_line").agg(F.min("evidence").alias("evidence"))
    cols = cols.join(members, ["table", "column"], "left").withColumn("at", at)
    cols = stored(cols.select("method_id", "table", "column", "mechanism", "evidence", "module", "at.file", "at.line").where("column <> '*'"), "columns")
    each = cols.select("table", "column", "module", "file", "line").distinct()
    col = F.concat(F.lit("column:"), F.col("table"), F.lit("."), F.col("column"))
    edges = edges.unionByName(edge(cols, F.col("method_id"), col, "Writes", F.col("mechanism"), F.col("evidence")))
    edges = edges.unionByName(edge(each, col, tab, "MapsTo", "EfModelMapping", F.lit(None).cast("string")))
    ext = facts["external_calls"].join(reached, "method_id", "left_semi")
    out = F.concat(F.lit("external:"), F.col("caller_clr"))
    edges = edges.unionByName(edge(ext, F.col("method_id"), out, "Calls", "HttpClientInvocation", F.col("evidence")))
    nodes = node(owners, ent, "Entity", F.substring_index("clr_name", ".", -1), module_of_name(F.col("clr_name")))
    nodes = nodes.unionByName(node(owners, tab, "Table", F.col("table"), F.col("module")))
    nodes = nodes.unionByName(node(each, col, "Column", F.col("column"), F.col("module")))
    calls = ext.groupBy("caller_clr").agg(F.min(F.struct("file", "line")).alias("at")).select("caller_clr", "at.file", "at.line")
    nodes = nodes.unionByName(node(calls, out, "ExternalCall", F.substring_index("caller_clr", ".", -1), module_of_name(F.col("caller_clr"))))
    raw = facts["raw_sql_sites"].join(reached, "method_id", "left_semi")
    diagnostics = diagnostics.unionByName(raw.select(F.concat(F.lit("raw SQL reaches the database outside the model: "), "file", F.lit(":"), F.col("line").cast("string")).alias("text")))
    return merge_nodes(nodes), merge_edges(edges, by_mechanism=True), diagnostics.distinct()


def stamp_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Set rootKind of roots (kind, id): a background service over a consumer
    over an endpoint; a root is never a utility."""
    rank = F.when(F.col("kind") == "BackgroundService", 3).when(F.col("kind") == "Consumer", 2).otherwise(1)
    best = roots.groupBy("id").agg(F.max_by("kind", rank).alias("_root"))
    out = nodes.join(best, "id", "left")
    return out.withColumn("rootKind", F.coalesce("_root", "rootKind")).withColumn("utility", F.col("utility") & (F.col("rootKind") == "None")).select(nodes.columns)


def build(facts: dict[str, DataFrame], max_depth: int = 20, budget: int = 5000, most_prefixes: int | None = MAX_PREFIXES) -> Graph:
    """The whole graph of a set of facts."""
    methods = production(facts)
    prefixes, over = route_prefixes(facts["propagations"], facts["implementations"], most_prefixes)
    ends = stored(endpoints(facts, prefixes).where("status = 'ok'"), "endpoints")
    events, alone = event_edges(facts)
    none = F.array().cast(f"array<{SITE}>")
    mapped = ends.select(F.col("id").alias("fromId"), F.col("method").alias("toId"), F.lit("Calls").alias("kind"), F.lit(None).cast("string").alias("evidence"), F.lit(False).alias("ambiguous"), F.lit("None").alias("mechanism"), none.alias("callSites"))
    edges = stored(merge_edges(call_edges(facts).unionByName(events).unionByName(mapped)), "edges")
    cost = F.when(F.col("kind") == "Consumes", 2).otherwise(1)
    hop = edges.groupBy(F.col("fromId").alias("src"), F.col("toId").alias("dst")).agg(F.min(cost).alias("cost"))
    roots = ends.select(F.lit("Endpoint").alias("kind"), "id")
    roots = roots.unionByName(facts["consumers"].select(F.lit("Consumer").alias("kind"), F.col("consume_method_id").alias("id")).distinct())
    roots = roots.unionByName(facts["hosted_services"].select(F.lit("BackgroundService").alias("kind"), F.col("method_id").alias("id")).distinct())
    reached, spent = walk(stored(hop, "hops"), roots, max_depth, budget)
    reached = stored(reached, "reached")
    own = F.struct(F.col("containing_type").alias("t"))
    kind = F.when(F.col("containing_type").rlike("(Repository|Queries)$"), "Repository").when(F.col("containing_type").rlike("Handler$") & F.col("containing_type").contains(".Application"), "Handler").otherwise("Method")
    name = F.concat_ws(".", F.substring_index(own["t"], ".", -1), F.col("name"))
    flags = [F.lit(False).alias("ambiguous"), "truncated", (F.col("module") == "Shared").alias("utility"), "depth", F.lit("None").alias("rootKind")]
    nodes = methods.join(reached, "id").select("id", kind.alias("kind"), name.alias("displayName"), "module", F.col("file").alias("filePath"), "line", *flags)
    e = ends.join(reached, "id").groupBy("id").agg(F.min(F.struct("displayName", "module", "file", "line", "truncated", "depth")).alias("e")).select("id", "e.*")
    nodes = nodes.unionByName(e.select("id", F.lit("Endpoint").alias("kind"), "displayName", "module", F.col("file").alias("filePath"), "line", F.lit(False).alias("ambiguous"), "truncated", F.lit(False).alias("utility"), "depth", F.lit("None").alias("rootKind")))
    ev = events.where("kind = 'Publishes'").select(F.col("toId").alias("id"), F.try_element_at("callSites", F.lit(1)).alias("s")).groupBy("id").agg(F.min("s").alias("s")).join(reached, "id").where("s is not null")
    nodes = nodes.unionByName(ev.select("id", F.lit("Event").alias("kind"), F.substring_index("id", ":", -1).alias("displayName"), F.coalesce(module_of_name(F.col("id")), F.lit("unknown")).alias("module"), F.col("s.filePath").alias("filePath"), F.col("s.line").alias("line"), F.lit(False).alias("ambiguous"), "truncated", F.lit(False).alias("utility"), "depth", F.lit("None").alias("rootKind")))
    more, data, notes = overlay(facts, reached)
    nodes = stored(stamp_roots(merge_nodes(nodes.unionByName(more)), roots), "nodes")
    ids = nodes.select("id")
    live = edges.unionByName(data)
    live = live.join(ids.withColumnRenamed("id", "fromId"), "fromId", "left_semi").join(ids.withColumnRenamed("id", "toId"), "toId", "left_semi").select(*EDGE.names)
    notes = notes.unionByName(alone).unionByName(prefix_diagnostics(over, most_prefixes or 0)).unionByName(facts["diagnostics"])
    if spent:
        notes = notes.unionByName(methods.sparkSession.range(1).select(F.lit(f"the walk ended at its budget of {budget} nodes").alias("text")))
    return Graph(nodes, stored(live, "edges"), stored(notes.distinct(), "diagnostics"))


# --- gates ------------------------------------------------------------------------------


def preflight(counts: DataFrame) -> DataFrame:
    """context, problem of model facts that cannot be trusted; counts: context,
    declared, loaded, failed, tables."""
    problem = (
        F.when(F.col("failed"), "context could not be read")
        .when(F.col("loaded") < F.col("declared"), "fewer entities than declared")
        .when(F.col("loaded") > F.col("declared"), "more entities than declared")
        .when(F.col("tables") == 0, "context has no table")
    )
    return counts.withColumn("problem", problem).where("problem is not null").select("context", "problem")


def version_skew(target: DataFrame, loaded: DataFrame) -> DataFrame:
    """package, target, loaded of packages (package, version array<int>) whose
    first two numbers differ, or whose loaded version is older."""
    t, m = target.select(F.lower("package").alias("package"), F.col("version").alias("target")), loaded.select(F.lower("package").alias("package"), F.col("version").alias("loaded"))
    two = lambda c: F.slice(c, 1, 2)
    return t.join(m, "package").where((two("target") != two("loaded")) | (F.col("loaded") < F.col("target")))


def stale_output(sources: DataFrame, built: DataFrame) -> DataFrame:
    """project: those with a source newer than their output; both: project,
    modified."""
    s = sources.groupBy("project").agg(F.max("modified").alias("s"))
    b = built.groupBy("project").agg(F.max("modified").alias("b"))
    return s.join(b, "project", "left").where("b is null or s > b").select("project")


def compile_check(messages: DataFrame, samples: int = 3) -> DataFrame:
    """project, errors, warnings and the first messages; messages: project,
    severity, text."""
    w = F.row_number().over(Window.partitionBy("project").orderBy("severity", "text"))
    few = messages.withColumn("_n", w).where(F.col("_n") <= samples).groupBy("project").agg(F.array_sort(F.collect_list("text")).alias("samples"))
    n = messages.groupBy("project").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.join(few, "project", "left")


def load_diagnostics(raw: DataFrame) -> DataFrame:
    """kind, message, n: repeated load messages once, failures first."""
    return raw.groupBy("kind", "message").agg(F.count("*").alias("n")).orderBy(F.when(F.col("kind") == "failure", 0).otherwise(1), "message")
