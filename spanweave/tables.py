"""Tables that cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  One of our own is made only
    where it is unset and the executors are this machine; elsewhere they could
    not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_ranged(df: DataFrame, column: str, name: str = "table") -> tuple[DataFrame, int, str | None, str | None]:
    """``stored``, with the number of its rows and the least and the greatest
    value of ``column``, seen while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")), name)
    return out, seen.get["n"], seen.get["low"], seen.get["high"]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table of the shared folder."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
