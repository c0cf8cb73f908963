"""From what a user types to a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import selector
from spanweave.model import Graph


def resolve_all(graph: Graph, asked: DataFrame) -> DataFrame:
    """qid, id of selectors (qid, text); the first tier that fits wins: the
    exact id, then the id of an endpoint of that name, then a name whatever its
    case.  Ties go to the smaller id.  Selectors without a node are left out."""
    q = asked.select("qid", "text", selector(F.col("text")).alias("norm"), F.lower(F.col("text")).alias("low"))
    n = graph.nodes.select("id", F.lower("displayName").alias("low"), selector(F.col("displayName")).alias("norm"))
    exact = q.join(n.select("id"), q["text"] == n["id"]).select("qid", F.lit(1).alias("tier"), "id")
    named = q.select("qid", F.concat(F.lit("endpoint:"), "norm").alias("id")).join(n.select("id"), "id").select("qid", F.lit(2).alias("tier"), "id")
    by_name = q.join(n.select("id", "low"), "low").select("qid", F.lit(3).alias("tier"), "id")
    by_norm = q.join(n.select("id", "norm"), "norm").select("qid", F.lit(3).alias("tier"), "id")
    every = exact.unionByName(named).unionByName(by_name).unionByName(by_norm)
    return every.groupBy("qid").agg(F.min(F.struct("tier", "id")).alias("b")).select("qid", F.col("b.tier").alias("tier"), F.col("b.id").alias("id"))


def resolve(graph: Graph, text: str) -> str | None:
    asked = graph.nodes.sparkSession.createDataFrame([("q", text)], "qid string, text string")
    row = resolve_all(graph, asked).first()
    return row["id"] if row else None


def near_matches(graph: Graph, text: str, k: int = 10) -> DataFrame:
    """The first ``k`` nodes by id whose name or id contains the text."""
    low = text.strip().lower()
    hit = F.contains(F.lower("displayName"), F.lit(low)) | F.contains(F.lower("id"), F.lit(low))
    return graph.nodes.where(hit).select("id", "displayName").orderBy("id").limit(k)
