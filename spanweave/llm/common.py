"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named and the executors are this machine (tests), a folder of
    our own is set for this context, once; on a cluster that is an error, since
    executors could not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with a table that outlives a lost executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, made longer where one of the columns has that name already."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column without copying its text.

    A null is an empty span.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none
    cut = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = cut[:-1], cut[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        ends[gone] = starts[gone]
    return raw, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes, one row at least."""
    n, i = len(starts), 0
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + most, side="right"))
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def release() -> None:
    """Give memory that a finished task no longer needs back to the system;
    Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; a null is empty."""
    raw, starts, ends = utf8_spans(column)
    view = memoryview(raw)
    return [bytes(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class TwoGenerations(dict):
    """Bounded memo: when ``most`` new keys came, the older ones go.

    ``compute`` gives a missing value.  A key of the older generation that is
    used again moves to the younger.
    """

    def __init__(self, compute, most: int) -> None:
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
