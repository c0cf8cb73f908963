"""Following a folder of edge files with Structured Streaming.

Each trigger takes the files that are new, merges their edges into the stored
graph by batch number, and leaves a table a reader can use at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanweave.model import EDGE


def new_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the edges of Parquet files as they come into ``folder``."""
    return spark.readStream.schema(EDGE).parquet(folder)


def follow(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch of new edges to ``apply``; ends when all files that are
    there have been taken."""
    return new_edges(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Keep batches as partitions of a table; a batch that is run again
    replaces its own partition."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["fromId", "toId", "kind", "mechanism"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def edge_counts(stream: DataFrame) -> DataFrame:
    """Running counts by kind and mechanism."""
    return stream.groupBy("kind", "mechanism").agg(F.count("*").alias("n"))
