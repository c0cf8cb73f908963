"""Duplicate word spans by relative Lempel-Ziv factors.

The reference of a document is every document with a smaller id.  It is
indexed in blocks: the windows of ``window`` words that share an anchor, the
least hash among the short word runs of a window, are one block, so equal
windows always meet in one.  The index of a block holds for each of its windows
the least document that has it, and where.  A document is parsed from left to
right: where a window of it is in the index, a factor (reference document, place, length)
begins, and it is extended greedily, word by word, as long as the reference
goes on with the same words; at its end, where the next word leaves the
reference, the next window is looked up anew, so factors may overlap and each
boundary is tested.  A factor has ``window`` words or more; the words of all
factors are the duplicate spans.

Index and lookups use 128-bit hashes that are not linear in the words.  Every
factor is then checked against its reference's own words; should one differ, the
windows are hashed and parsed again with other seeds, so no word goes because of
a collision.

What moves is small: first one hash for each anchor (about one for 20 words),
then, only where an anchor occurs in two different texts, the hashes of
its windows, reduced to the least place of each before the shuffle, and at
last the factors.  Exact copies of a whole text are settled by a digest of the
text, so a group of copies costs one of its members.

Defined cases: a null or empty text has no words and no windows; a null doc_id
counts as larger than every id (its windows never cover another document, and
are covered by any equal window of a document with an id); rows that share a
doc_id do not cover each other, since none has a smaller id; repeated rows each
get a row; an empty table gives an empty table; a long text is split into words
block by block; columns of any other name are kept and do not clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanweave.llm.common import materialise, release, unused, utf8_spans

#: Words of a window and of an anchor; bytes of text split into words at once.
WINDOW, ANCHOR, BLOCK = 50, 12, 1 << 20
LAST_ID = (1 << 63) - 1
#: Pairs of hash seeds that are tried before giving up.
SEEDS = 8

_BLANK = re.compile(rb"[ \t-\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_blocks(text: memoryview | bytes) -> Iterator[list[bytes]]:
    """The words of a text, the runs without ASCII white space, some at a time."""
    at, n = 0, len(text)
    while at < n:
        end = n
        if n - at > BLOCK and (m := _BLANK.search(text, at + BLOCK)) is not None:
            end = m.start()
        yield bytes(text[at:end]).split()
        at = end


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))


def text_hashes(text: memoryview | bytes, seed: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(word_hashes(w, seed) for w in word_blocks(text))])


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs."""
    return _mix(_mix(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes: runs of 1, 2, 4, ...
    words are hashed from two halves, and the window from such runs."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, span, run = None, width, 1, words
    while True:
        if width & span:  # the last words of the window come from the short runs
            done -= span
            part = run[done : done + n]
            out = part if out is None else _after(part, out)
        if span * 2 > width:
            return _mix(out + np.uint64(width))
        run = _after(run[:-span], run[span:])
        span *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window: the least hash of its word runs."""
    return _sliding_min(window_hashes(words, anchor), window - anchor + 1)


def _text_key(text: memoryview) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _index(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = utf8_spans(batch.column(1))
            view = memoryview(raw)
            n_words, sha, t1, t2, found = [], [], [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                x, y = _text_key(view[a:b])
                t1.append(x)
                t2.append(y)
                digest, hashes, n = hashlib.sha256(), [np.zeros(0, np.uint64)], 0
                for words in word_blocks(view[a:b]):
                    if n and words:
                        digest.update(b" ")
                    digest.update(b" ".join(words))
                    hashes.append(word_hashes(words, 0))
                    n += len(words)
                n_words.append(n)
                sha.append(digest.hexdigest())
                found.append((np.unique(_anchors(np.concatenate(hashes), window, anchor)) if n >= window else hashes[0]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "t1", "t2", "n_words", "sha", "anchors"],
            )
        release()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in a small form for a shuffle, with their keys."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw, starts, ends = utf8_spans(batch.column(1))
        view = memoryview(raw)
        t1, t2, packed = [], [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            x, y = _text_key(view[a:b])
            t1.append(x)
            t2.append(y)
            packed.append(press.compress(view[a:b]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "t1", "t2", "packed"])


def _windows(window: int, anchor: int, seed: int):
    """The hashes of the windows whose anchor is one of the row's shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                text = unpack.decompress(batch.column(2)[r].as_buffer())
                words = text_hashes(text, 0)
                shared = batch.column(3)[r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(np.isin(_anchors(words, window, anchor), shared))
                if seed:
                    words = text_hashes(text, 2 * seed)
                h1 = window_hashes(words, window)[at]
                h2 = window_hashes(text_hashes(text, 2 * seed + 1), window)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[r], len(at)), pa.repeat(batch.column(1)[r], len(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(at, pa.int32())],
                    names=["row", "id", "h1", "h2", "at"],
                )
        release()

    return run


def factors(at: np.ndarray, ref: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, reference, place there) of the factors of one document.

    at: its windows that the index has, ascending, with the reference row and
    place of each.  A factor goes on while the next window is that of the next
    place of the same reference: one more word is the same.
    """
    if not len(at):
        return at, at, ref, place
    new = np.append(True, (np.diff(at) != 1) | (np.diff(ref) != 0) | (np.diff(place) != 1))
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))) + window - 1, ref[first], place[first]


def covered(start: np.ndarray, words: np.ndarray, n_words: int) -> np.ndarray:
    """True for each word that a factor covers."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + words, -1)
    return np.cumsum(step)[:-1] > 0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_FACTOR = pa.struct([("ref", pa.int64()), ("place", pa.int64()), ("words", pa.int64()), ("digest", pa.binary())])


def _parse(window: int):
    """Factors of each document, and what is left of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n_removed, kept, made = [], [], []
            for r in range(batch.num_rows):
                text = unpack.decompress(batch.column(3)[r].as_buffer())
                words = [w for some in word_blocks(text) for w in some]
                hits = batch.column(4)[r].values
                at, ref, place = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in hits.flatten())
                order = np.argsort(at)
                start, n, ref, place = factors(at[order], ref[order], place[order], window)
                gone = covered(start, n, len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                made.append([{"ref": x, "place": p, "words": k, "digest": _digest(words[a : a + k])} for a, k, x, p in zip(start.tolist(), n.tolist(), ref.tolist(), place.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(made, pa.list_(_FACTOR))],
                names=["doc_id", "t1", "t2", "n_removed", "kept", "factors"],
            )
        release()

    return run


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has not the words of a factor that cites it."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        wrong = []
        for r in range(batch.num_rows):
            words = [w for some in word_blocks(unpack.decompress(batch.column(1)[r].as_buffer())) for w in some]
            cited = batch.column(2)[r].as_py()
            wrong.append(any(_digest(words[c["place"] : c["place"] + c["words"]]) != c["digest"] for c in cited))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(wrong, pa.bool_()))], names=["row"])


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])


def _parsed(texts: DataFrame, window: int, anchor: int, seed: int) -> DataFrame:
    """doc_id, t1, t2, n_removed, kept, factors of the candidates that have factors."""
    windows = materialise(texts.select("row", "id", "packed", "shared").mapInArrow(_windows(window, anchor, seed), "row long, id long, h1 long, h2 long, at int"), "windows")
    # the first place of each window; both picks are made by the same comparisons
    least = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("row", "id").alias("ref"), F.min_by("at", "id").alias("place"))
    least = materialise(least.where("low < high").drop("high"), "references")
    hits = windows.join(least, ["h1", "h2"]).where("low < id").groupBy("row").agg(F.collect_list(F.struct("at", "ref", "place")).alias("hits"))
    found = texts.join(hits, "row").select("doc_id", "t1", "t2", "packed", "hits")
    schema = "doc_id long, t1 long, t2 long, n_removed long, kept string, factors array<struct<ref:long,place:long,words:long,digest:binary>>"
    return materialise(found.mapInArrow(_parse(window), schema), "changed")


def factors_differ(texts: DataFrame, parsed: DataFrame) -> bool:
    """Whether a factor's words are not those of its reference."""
    cited = parsed.select(F.explode("factors").alias("f")).select("f.*").distinct()
    cited = cited.groupBy(F.col("ref").alias("row")).agg(F.collect_list(F.struct("place", "words", "digest")).alias("cited"))
    wrong = texts.select("row", "packed").join(cited, "row").mapInArrow(_differ, "row long")
    return not wrong.isEmpty()


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(all, changed).

    all: doc_id, t1, t2, n_words, sha, copy for every input row; t1 and t2 are
    a 128-bit key of the text, sha the digest of its words, copy whether a
    smaller doc_id has the same whole text.
    changed: doc_id, t1, t2, n_removed, kept, factors for each (doc_id, text),
    once, that loses words but is not such a copy; a factor's ref is a number of
    a reference text within this run.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = materialise(docs.mapInArrow(_index(window, anchor), "doc_id long, t1 long, t2 long, n_words long, sha string, anchors array<long>"), "anchors")
    # of texts that come twice or more, the least id; a table, not an
    # aggregate, so that the copies of a common text can be split over tasks
    first = index.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    every = index.drop("anchors").join(materialise(first, "repeated"), ["t1", "t2"], "left")
    every = every.withColumn("copy", F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    heads = index.where(F.size("anchors") > 0).groupBy("t1", "t2").agg(F.min(order).alias("id"), F.first("anchors").alias("anchors"))
    # anchors of two documents or more; ids differ, or the texts do
    each = heads.select("id", "t1", "t2", F.explode("anchors").alias("anchor"))
    each = materialise(each, "occurrences")
    shared = materialise(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")
    wanted = each.join(shared, "anchor", "left_semi").groupBy("id", "t1", "t2").agg(F.collect_list("anchor").alias("shared"))
    wanted = wanted.select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "id", "t1", "t2", "shared")
    packed = docs.mapInArrow(_pack, "doc_id long, t1 long, t2 long, packed binary")
    texts = packed.join(wanted, _same(packed, wanted)).select(packed["doc_id"], "id", packed["t1"], packed["t2"], "packed", "shared")
    texts = materialise(texts.dropDuplicates(["doc_id", "t1", "t2"]).withColumn("row", F.monotonically_increasing_id()), "candidates")
    for seed in range(SEEDS):
        changed = _parsed(texts, window, anchor, seed)
        if not factors_differ(texts, changed):
            return every, changed
    raise RuntimeError("window hashes collide with every seed")


def dedup_digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    every, changed = duplicate_spans(docs, window, anchor)
    small = changed.select("doc_id", "t1", "t2", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"))
    out = every.join(small, _same(every, small), "left")
    whole = F.col("copy") & (F.col("n_words") >= window)
    return out.select(
        every["doc_id"],
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def _keyed(at: int, t1: str, t2: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = utf8_spans(batch.column(at))
            view = memoryview(raw)
            keys = [_text_key(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=[*batch.schema.names, t1, t2]
            )

    return run


def remove_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs``; a text that loses words becomes its kept words,
    joined by one space.  A text of which nothing is kept goes.

    n_chars, where there is such a column, follows the new text.
    """
    every, changed = duplicate_spans(docs, window, anchor)
    whole = every.where(F.col("copy") & (F.col("n_words") >= window)).select("doc_id", "t1", "t2", F.lit("").alias("kept")).distinct()
    new = changed.join(whole, _same(changed, whole), "left_anti").select("doc_id", "t1", "t2", "kept").unionByName(whole)
    t1, t2, n_doc, n_1, n_2, n_kept = unused(docs.columns, "_t1", "_t2", "_n_doc", "_n_1", "_n_2", "_n_kept")
    new = materialise(new, "kept").toDF(n_doc, n_1, n_2, n_kept)
    keyed = docs.mapInArrow(_keyed(docs.columns.index("text"), t1, t2), StructType([*docs.schema.fields, StructField(t1, LongType()), StructField(t2, LongType())]))
    on = F.col("doc_id").eqNullSafe(F.col(n_doc)) & (F.col(t1) == F.col(n_1)) & (F.col(t2) == F.col(n_2))
    out = keyed.join(new, on, "left").where(F.col(n_kept).isNull() | (F.col(n_kept) != ""))
    text = F.coalesce(n_kept, "text")
    cols = {"text": text}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col(n_kept).isNull(), F.col("n_chars")).otherwise(F.length(n_kept)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns])
