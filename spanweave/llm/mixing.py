"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document of it should be taken
target / source size times.  The whole part is taken for all.  The fractional
part is rounded by pairing: two documents with probabilities p and q exchange
word mass, one way or the other at random, so that the mass and both
expectations stay and one of the two becomes 0 or 1.  Documents are paired
inside small chunks of a source; the one residual of each chunk goes up a
reduction tree, so a source ends within one document of its target.

DataFrame functions only.  A source that holds most rows is many chunks.

Rows that nothing tells apart are handled as one entry, but each has its own
copies: of m such rows the whole part of m times the fraction take one copy
more for sure, and one row enters the pairing with the fraction that is left.

Defined cases: a null or blank text has size 0 and takes 0 words; a null source
is a source of its own, the last in order; null ids are ids like any other; all
randomness is a hash of ids, so reruns agree; an empty table gives an empty
table; columns of any other name are kept and do not clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from spanweave.llm.common import materialise, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a chunk, on average; children of a node of the reduction tree.
CHUNK = 64
#: Rows of the table of sources up to which it is sent to every executor.
BROADCAST_SOURCES = 20_000
SALT = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _by_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Rows with the columns of their source.  The table of sources is
    broadcast if it is known to be small; else a hot source is salted."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALT)).cast("int"))
    right = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    on = left["source"].eqNullSafe(right["source"]) & (left["_salt"] == right["_salt"])
    return left.join(right, on).drop(right["source"], right["_salt"], left["_salt"])


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, null last, from 0; no task sees
    more than a range of the sources."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "sources")
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return ranged.withColumn("rank", F.lit(0)).drop("_part")
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("rank", own - 1 + F.element_at(base, F.col("_part"))).drop("_part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """(source, source_size, n_units, target), and the number of sources.

    Targets are in proportion to weight, none above ``cap`` times its size;
    what is cut off is shared again by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    per = materialise(_ranked(per).withColumn("weight", weight), "weights")
    n, words = per.agg(F.count("*"), F.sum("source_size")).first()
    total = share * float(words or 0)
    most = F.lit(float(cap)) * F.col("source_size")
    level = None
    while True:
        above = F.lit(False) if level is None else most < F.col("weight") * F.lit(level)
        full, free = per.agg(F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        now = (total - full) / free if free else math.inf
        if not n or now == level or not free:
            break
        level = now
    target = most if not n or not free else F.least(most, F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "n_units", target.cast("double").alias("target")), n


def _draw(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the ids only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) / F.lit(float(1 << 53))


def _pair(seed: int):
    """One exchange: the residual ``a`` of the pairs so far meets ``b``."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        have_a, have_b = a["w"] * a["p"], b["w"] * b["p"]
        room_a, room_b = a["w"] * (1 - a["p"]), b["w"] * (1 - b["p"])
        give, get = F.least(have_a, room_b), F.least(room_a, have_b)
        gives = _draw(seed, a["key"], b["key"]) * (give + get) < get
        clip = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        done = lambda x, up: F.struct(x["key"].alias("key"), F.lit(up).alias("up"))
        rest = lambda x, p: F.struct(x["key"].alias("key"), x["w"].alias("w"), clip(p).alias("p"))
        out = (
            F.when(gives & (have_a <= room_b), F.struct(done(a, 0).alias("done"), rest(b, b["p"] + have_a / b["w"]).alias("rest")))
            .when(gives, F.struct(done(b, 1).alias("done"), rest(a, a["p"] - room_b / a["w"]).alias("rest")))
            .when(have_b <= room_a, F.struct(done(b, 0).alias("done"), rest(a, a["p"] + have_b / a["w"]).alias("rest")))
            .otherwise(F.struct(done(a, 1).alias("done"), rest(b, b["p"] - room_a / b["w"]).alias("rest")))
        )
        return F.element_at(F.transform(F.array(out), lambda o: F.struct(F.array_append(acc["done"], o["done"]).alias("done"), o["rest"].alias("rest"))), 1)

    return step


def decisions(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 8) -> DataFrame:
    """Decide how often each document is taken.

    rows: doc_id, source, size and more columns that tell rows apart.  Result:
    these columns, times (how many input rows are equal), source_size, target,
    whole, more; one row per distinct input row.  ``more`` of the equal rows
    are taken whole + 1 times, the others whole times.
    """
    own = rows.columns
    rows = materialise(rows, "sizes")
    sources, n_sources = source_targets(rows, weights, share, cap)
    units = _by_source(rows.groupBy(*own).agg(F.count("*").alias("times")), sources, n_sources)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("_ratio", ratio).withColumn("whole", F.floor("_ratio"))
    units = units.withColumn("_mass", F.col("times") * (F.col("_ratio") - F.col("whole")))
    units = units.withColumn("_sure", F.floor("_mass")).withColumn("_p", F.col("_mass") - F.col("_sure"))
    chunks = F.greatest(F.ceil(F.col("n_units") / CHUNK), F.lit(1)).cast("long")
    units = units.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed), *own), chunks))
    units = materialise(units.drop("n_units", "_ratio", "_mass"), "units")
    open_ = (F.col("_p") > 0) & (F.col("size") > 0)
    key = F.struct(*own, "times", "source_size", "target", "whole", "_sure")
    level = units.where(open_).select("source", F.col("_chunk").alias("chunk"), F.struct(key.alias("key"), F.col("size").cast("double").alias("w"), F.col("_p").alias("p")).alias("unit"))
    parts = [units.where(~open_).select(key.alias("key"), F.lit(0).alias("up"))]
    last = (units.agg(F.max("_chunk")).first()[0] or 0) + 1
    n = seed
    while True:
        n += 1
        start = lambda c: F.struct(F.slice(F.array(F.struct(F.element_at(c, 1)["key"].alias("key"), F.lit(0).alias("up"))), 1, 0).alias("done"), F.element_at(c, 1).alias("rest"))
        folded = level.groupBy("source", "chunk").agg(F.array_sort(F.collect_list("unit")).alias("c"))
        folded = folded.select("source", "chunk", F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), start(F.col("c")), _pair(n)).alias("f"))
        folded = materialise(folded, "pivots")
        parts.append(folded.select(F.explode("f.done").alias("d")).select("d.key", "d.up"))
        level = folded.select("source", (F.col("chunk") / CHUNK).cast("long").alias("chunk"), F.col("f.rest").alias("unit"))
        if last <= 1:
            break
        last = -(-last // CHUNK)
    rest = level.select(F.col("unit.key").alias("key"), (_draw(n + 1, F.col("unit.key")) < F.col("unit.p")).cast("int").alias("up"))
    out = rest
    for p in parts:
        out = out.unionByName(p)
    own += ["times", "source_size", "target", "whole"]
    return out.select(*[F.col(f"key.{c}").alias(c) for c in own], (F.col("key._sure") + F.col("up")).cast("long").alias("more"))


def _numbered(rows: DataFrame, times: Column, block: str, number: str) -> DataFrame:
    """Each row ``times`` times with a number from 1: blocks of up to 1024
    numbers, those of a row with many blocks dealt out over tasks."""
    rows = rows.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((times - 1) / 1024))))
    rows = rows.where(times <= 1024).unionByName(rows.where(times > 1024).repartition(F.col(block)))
    return rows.withColumn(number, F.explode(F.sequence(F.col(block) * 1024 + 1, F.least(times, F.col(block) * 1024 + 1024))))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row."""
    made = decisions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), **how)
    made = _numbered(materialise(made, "mix"), F.col("times"), "_block", "_i")
    copies = F.col("whole") + (F.col("_i") <= F.col("more")).cast("long")
    return made.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; a document of size
    0 carries no words and stays once."""
    size = word_count(F.col("text"))
    k1, k2, m_n, m_one, m_block, m_i, m_row = unused(docs.columns, "_m_k1", "_m_k2", "_m_n", "_m_one", "_m_block", "_m_i", "_m_row")
    # a 128-bit key of all columns: rows of one key are equal
    cols = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in docs.schema.fields]
    keyed = docs.withColumn(k1, F.xxhash64(F.lit(1), *cols)).withColumn(k2, F.xxhash64(F.lit(2), *reversed(cols)))
    made = decisions(keyed.select("doc_id", "source", size.alias("size"), F.col(k1).alias("k1"), F.col(k2).alias("k2")), **how)
    total = F.when(F.col("size") == 0, F.col("times")).otherwise(F.col("times") * F.col("whole") + F.col("more"))
    made = materialise(made.select(F.col("k1").alias(k1), F.col("k2").alias(k2), total.alias(m_n), (F.col("times") == 1).alias(m_one)).where(F.col(m_n) > 0), "copies")
    joined = keyed.join(made, [k1, k2])
    alone = joined.where(F.col(m_one)).withColumn(m_i, F.explode(F.sequence(F.lit(1), F.col(m_n)))).select(*docs.columns)
    equal = joined.where(~F.col(m_one)).groupBy(k1, k2).agg(F.first(m_n).alias(m_n), F.first(F.struct(*docs.columns)).alias(m_row))
    return alone.unionByName(_numbered(materialise(equal, "equal"), F.col(m_n), m_block, m_i).select(f"{m_row}.*"))
