"""Token ids in training order, as fixed-stride binary shards.

Every sequence has a number, its place in a scan of the input.  A keyed
Feistel permutation of the next power of four, with cycle walking, maps the
numbers one to one onto the slots 0 .. n-1: no sort, no random column, and any
slot's sequence can be named from the key alone.  Slots are cut into equal
ranges; each range is one partition and is written as one shard file whose
records all have the same length, so record ``slot`` starts at byte
(slot mod per_shard) x stride of shard slot / per_shard, and a reader resumes
at any slot with one seek.

A record: doc_id (8 bytes, little endian), sequence number in the document (4),
number of ids (2), flags (1: doc_id is null), ids (width bytes each), padding
zeros, one newline (the writer's record end).  A manifest beside the shards
holds n, key, width, stride and per_shard, all that a reader needs.

Defined cases: a null or empty text has one sequence without ids; repeated rows
are sequences of their own; an empty table writes a manifest and no shard; a
long text is many sequences; columns other than doc_id and text are not looked
at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import bpe
from spanweave.llm.common import fresh_path, materialise, release, utf8_spans

HEAD = "<qIHB"
HEAD_SIZE = struct.calcsize(HEAD)
_HEAD = np.dtype([("doc", "<i8"), ("seq", "<u4"), ("n", "<u2"), ("null", "u1")])
#: Bytes of a record with its end, and of a shard at most; records parsed at once.
STRIDE, SHARD_BYTES, PARSED = 512, 4 << 20, 2048
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _keys(key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.uint64(key) + np.arange(1, ROUNDS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of sequence numbers, all of 0 .. n-1."""
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    walk = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while walk.any():
            x = out[walk]
            left, right = x >> half, x & mask
            for k in _keys(key):
                left, right = right, left ^ (_mix(right ^ k) & mask)
            out[walk] = left << half | right
            walk &= out >= np.uint64(n)
    return out.astype(np.int64)


def unpermute(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """Sequence numbers of slots."""
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = slots.astype(np.uint64)
    walk = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while walk.any():
            x = out[walk]
            left, right = x >> half, x & mask
            for k in _keys(key)[::-1]:
                left, right = right ^ (_mix(left ^ k) & mask), left
            out[walk] = left << half | right
            walk &= out >= np.uint64(n)
    return out.astype(np.int64)


def ids_per_record(width: int, stride: int = STRIDE) -> int:
    return (stride - HEAD_SIZE - 1) // width


def _records(bases, n: int, key: int, width: int, stride: int):
    """(slot, record) of each sequence; records packed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = bases.value.get(TaskContext.get().partitionId(), 0)
        press = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=1))
        most = ids_per_record(width, stride) * width
        for batch in batches:
            raw, starts, ends = utf8_spans(batch.column(1))
            docs = batch.column(0)
            null = docs.is_null().to_numpy(zero_copy_only=False)
            doc = docs.fill_null(0).to_numpy(zero_copy_only=False)
            size = ends - starts
            count = np.maximum(1, -(-size // most))
            rows = np.repeat(np.arange(len(size)), count)
            seq = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            a = starts[rows] + seq * most
            b = np.minimum(a + most, ends[rows])
            slots = permute(number + np.arange(len(rows)), n, key)
            number += len(rows)
            view = memoryview(raw)
            packed = [
                press.compress(struct.pack(HEAD, d, s, (y - x) // width, z) + bytes(view[x:y]))
                for d, s, x, y, z in zip(doc[rows].tolist(), seq.tolist(), a.tolist(), b.tolist(), null[rows].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(packed, pa.binary())], names=["slot", "packed"])

    return run


def _lines(stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        for batch in batches:
            full = [unpack.decompress(x.as_buffer()).ljust(stride - 1, b"\0") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary())], names=["record"])

    return run


KIND = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def pack_ids(sequences: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, ids as little-endian bytes, from rows with ``ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array(x or [], KIND[width]).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return sequences.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary")


def write_shards(ids: DataFrame, path: str, width: int = 2, key: int = 1, stride: int = STRIDE, shard_bytes: int = SHARD_BYTES) -> dict[str, int]:
    """Write ``ids`` (doc_id, ids binary or string of whole ids) as shards below
    ``path``/shards and their manifest below ``path``/manifest; returns it.

    ``ids`` must be a scan that gives the same rows in the same partitions each
    time, as a scan of files does; write anything else to a table first.
    """
    spark = ids.sparkSession
    if stride > 60_000 or ids_per_record(width, stride) < 1:
        raise ValueError("stride")
    most = ids_per_record(width, stride) * width
    rows = ids.toDF("doc_id", "ids")
    size = F.coalesce(F.octet_length("ids"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(size / most)).cast("long")
    # one number a partition of the scan
    per = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(count).alias("n")).collect()}
    bases, n = {}, 0
    for p in sorted(per):
        bases[p], n = n, n + per[p]
    per_shard = max(1, shard_bytes // stride)
    made = {"n": n, "width": width, "stride": stride, "per_shard": per_shard, "key": key}
    spark.range(1).select(F.lit(json.dumps(made)).alias("value")).coalesce(1).write.text(f"{path}/manifest")
    if not n:
        return made
    shards = -(-n // per_shard)
    records = rows.mapInArrow(_records(spark.sparkContext.broadcast(bases), n, key, width, stride), "slot long, packed binary")
    placed = records.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot").select("packed").mapInArrow(_lines(stride), "record binary")
    placed.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(f"{path}/shards")
    return made


def read_manifest(spark: SparkSession, path: str) -> dict[str, int]:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def _parse(stride: int, width: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column(0)[r].as_py()
                records = np.frombuffer(batch.column(1)[r].as_buffer(), np.uint8).reshape(-1, stride)
                for first in range(0, len(records), PARSED):
                    part = records[first : first + PARSED]
                    head = np.ascontiguousarray(part[:, :HEAD_SIZE]).view(_HEAD).ravel()
                    at = np.arange(first, first + len(part))
                    ends = HEAD_SIZE + head["n"].astype(np.int64) * width
                    sha = [hashlib.sha256(row[HEAD_SIZE:b]).hexdigest() for row, b in zip(part, ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(head["doc"].copy(), mask=head["null"] != 0),
                            pa.array(head["seq"].astype(np.int64)),
                            pa.array(shard * per_shard + at),
                            pa.array(np.full(len(part), shard, np.int32)),
                            pa.array(at * stride),
                            pa.array(head["n"].astype(np.int32)),
                            pa.array(sha, pa.string()),
                        ],
                        names=["doc_id", "seq_no", "slot", "shard", "byte_offset", "n_ids", "ids_sha256"],
                    )
        release()

    return run


SLOTS = "doc_id long, seq_no long, slot long, shard int, byte_offset long, n_ids int, ids_sha256 string"


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """What the stored shards hold, one row per record, as read back."""
    made = read_manifest(spark, path)
    if not made["n"]:
        return spark.createDataFrame([], SLOTS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    number = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int")
    return files.select(number.alias("shard"), "content").mapInArrow(_parse(made["stride"], made["width"], made["per_shard"]), SLOTS)


def read_from(path_of_shard, slot: int, made: dict[str, int]) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """Resume at ``slot``: (slot, doc_id, seq_no, ids) to the end, one seek and
    then sequential reads.  ``path_of_shard`` opens the file of a shard, and
    ``made`` is the manifest."""
    while slot < made["n"]:
        shard, first = divmod(slot, made["per_shard"])
        with path_of_shard(shard) as f:
            f.seek(first * made["stride"])
            while record := f.read(made["stride"]):
                doc, seq, n, null = struct.unpack_from(HEAD, record)
                yield slot, None if null else doc, seq, np.frombuffer(record, KIND[made["width"]], n, HEAD_SIZE)
                slot += 1


def training_order(docs: DataFrame, tokenizer: str | None = None, key: int = 1) -> DataFrame:
    """Materialise the ids of each text in training order below the shared
    folder, and return what the shards hold.

    Ids are those of a byte-level tokenizer file, or without one the UTF-8
    bytes, whose shards can be written without a table of ids before them.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "training")
    if tokenizer is None:
        write_shards(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path, width=1, key=key)
    else:
        write_shards(materialise(bpe.encode_packed(docs, tokenizer), "ids"), path, key=key)
    return read_slots(spark, path)
