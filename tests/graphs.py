"""Hand-built graphs."""

from spanweave.model import EDGE, NODE, Graph


def node(id_, kind, name=None, module="Shop", file="a.cs", line=1, ambiguous=False, utility=False, root="None"):
    return (id_, kind, name or id_, module, file, line, ambiguous, False, utility, 0, root)


def edge(a, b, kind="Calls", mechanism="None", sites=(), evidence=None, ambiguous=False):
    return (a, b, kind, evidence, ambiguous, mechanism, [(f, ln, c, False) for f, ln, c in sites])


def graph(spark, nodes, edges, notes=()):
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([(n,) for n in notes], "text string"), "test")


def chain(spark, notes=()):
    """Endpoint, handler, repository, helper, entity, table."""
    nodes = [
        node("endpoint:POST /orders", "Endpoint", "POST /orders", root="Endpoint"),
        node("Shop.Orders.Handler.Run(int)", "Handler", "Handler.Run", file="h.cs", line=10),
        node("Shop.Orders.Repo.Save(Order)", "Repository", "Repo.Save", file="r.cs", line=20),
        node("Shop.Text.Trim(string)", "Method", "Text.Trim", module="Shared", utility=True),
        node("entity:Shop.Order", "Entity", "Shop.Order"),
        node("table:shop.orders", "Table", "shop.orders"),
    ]
    edges = [
        edge("endpoint:POST /orders", "Shop.Orders.Handler.Run(int)"),
        edge("Shop.Orders.Handler.Run(int)", "Shop.Orders.Repo.Save(Order)", sites=[("h.cs", 12, 5)]),
        edge("Shop.Orders.Handler.Run(int)", "Shop.Text.Trim(string)", sites=[("h.cs", 11, 5)]),
        edge("Shop.Orders.Repo.Save(Order)", "entity:Shop.Order", "Writes", "DbSetProperty", evidence="r.cs:21"),
        edge("entity:Shop.Order", "table:shop.orders", "MapsTo", "EfModelMapping"),
    ]
    return graph(spark, nodes, edges, notes)
