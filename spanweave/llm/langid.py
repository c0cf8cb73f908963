"""Language identification by a linear-chain conditional random field.

Every word of a text gets one label.  A word's scores come from its affixes
and inner letter n-grams (2 to 4 letters between word borders, hashed) and,
for frequent words, from a lexicon; learned transitions tie neighbours, so a
text that switches language is labelled run by run.  Posteriors are exact
(scaled forward-backward).  A document's language is the label with the largest
mean posterior over its words with letters; that mean is the score.

The model is fitted on a bounded sample: about PER_LANGUAGE labelled texts of
each language and TRAIN_WORDS words of all, in the order of a hash of the id,
always as whole texts, of the MOST_LABELS most frequent languages.  Training
sequences mix runs of different languages, which is what the transitions learn
from.

Defined cases: a null text or one without letters is ``und`` with score 0; so
is every text if there is nothing to learn from; rows with a null id or a null
lang are predicted, but not learned from; ties go to the smaller label;
repeated rows each get a row; an empty table gives an empty table; a long text
is one sequence, labelled whole, and needs memory in proportion; columns of any
other name are kept by ``keep_identified`` and do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spanweave.llm.common import release, slices, unused, utf8_spans

#: Bound of the training sample, texts of one language; and words of all.
PER_LANGUAGE, TRAIN_WORDS = 150, 600_000
#: Labels that are learned at most, the most frequent ones.
MOST_LABELS = 256
#: Buckets of the n-gram features; bytes of text labelled at once.
BUCKETS, BLOCK = 1 << 15, 1 << 20
ROUNDS, RUN = 30, 40

BASE = np.uint64(0x5851F42D4C957F2D)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_LETTER = regex.compile(r"\p{L}")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """The words of some texts: a hash and a doc for each, and the distinct
    words with the features they have."""

    doc: np.ndarray
    word: np.ndarray  # index into the distinct words
    hashes: np.ndarray  # of the distinct words
    lettered: np.ndarray
    grams: np.ndarray  # buckets, word after word
    starts: np.ndarray  # of each distinct word's grams


def read_words(texts: list[bytes]) -> Words:
    """Words of lower-cased UTF-8 texts."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turn = np.diff(inside)
    ws, we = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    doc = np.searchsorted(ends, ws, side="right")
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        up, down = np.full(len(raw) + 1, BASE), np.full(len(raw) + 1, UNBASE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = _mix((total[we] - total[ws]) * down[ws] + (we - ws).astype(np.uint64))
        del total, up, down
        hashes, first, word = np.unique(h, return_index=True, return_inverse=True)
        a, n = ws[first], we[first] - ws[first]
        # each distinct word between two borders
        size = n + 2
        at = np.cumsum(size) - size
        code = np.ones(int(size.sum()) + 3, np.uint64)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        code[np.repeat(at + 1, n) + k] = raw[np.repeat(a, n) + k].astype(np.uint64) + np.uint64(2)
        own = np.repeat(np.arange(len(n)), size)
        place = np.arange(len(own)) - np.repeat(at, size)
        left = np.repeat(size, size) - place  # letters from here to the border
        two = code[:-3] * np.uint64(1 << 10) + code[1:-2]
        three = two * np.uint64(1 << 10) + code[2:-1]
        four = three * np.uint64(1 << 10) + code[3:]
        grams = np.stack([_mix(two + np.uint64(2 << 60)), _mix(three + np.uint64(3 << 60)), _mix(four + np.uint64(4 << 60))], axis=1) >> np.uint64(49)
    fits = np.stack([left >= 2, left >= 3, left >= 4], axis=1)
    count = fits.sum(axis=1)
    lettered = np.zeros(len(n), bool)
    np.logical_or.at(lettered, np.repeat(np.arange(len(n)), n), _ALPHA[raw[np.repeat(a, n) + k]])
    per = np.bincount(own, weights=count, minlength=len(n)).astype(np.int64)
    return Words(doc, word, hashes, lettered, grams[fits].astype(np.int64), np.cumsum(per) - per)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Crf:
    labels: list[str]
    grams: np.ndarray  # buckets x labels
    lexicon: np.ndarray  # sorted word hashes
    entries: np.ndarray  # words of the lexicon x labels
    steps: np.ndarray  # transitions, label to label
    first: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of each distinct word; words without letters have none."""
        n = len(w.hashes)
        if not n:
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.stack([np.add.reduceat(self.grams[:, k][w.grams], w.starts) for k in range(len(self.labels))], axis=1)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, w.hashes), len(self.lexicon) - 1)
            hit = self.lexicon[at] == w.hashes
            out[hit] += self.entries[at[hit]]
        out[~w.lettered] = 0
        return out

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Posteriors of each word of sequences of these lengths (all > 0); to
        learn, also the expected transitions and first labels.

        Sequences go side by side, the longest first; step t handles every
        sequence that has a word t.
        """
        order = np.argsort(-lengths, kind="stable")
        long = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        most = int(long[0])
        active = np.searchsorted(-long, -np.arange(most), side="left")  # sequences longer than t
        rank = np.concatenate([np.arange(a) for a in active])
        step = np.repeat(np.arange(most), active)
        where = starts[rank] + step
        off = np.concatenate([[0], np.cumsum(active)])
        e = np.exp(scores[where] - scores[where].max(axis=1, keepdims=True))
        go = np.exp(self.steps)
        alpha = np.empty_like(e)
        now = e[: active[0]] * np.exp(self.first)
        alpha[: active[0]] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, most):
            a, b = off[t], off[t + 1]
            now = (alpha[off[t - 1] : off[t - 1] + (b - a)] @ go) * e[a:b]
            now /= now.sum(axis=1, keepdims=True)
            alpha[a:b] = now
        beta = np.ones_like(e)
        for t in range(most - 2, -1, -1):
            a, b = off[t + 1], off[t + 2]
            now = (e[a:b] * beta[a:b]) @ go.T
            now /= now.sum(axis=1, keepdims=True)
            beta[off[t] : off[t] + (b - a)] = now
        out = np.empty_like(e)
        if not learn:
            alpha *= beta
            alpha /= alpha.sum(axis=1, keepdims=True)
            out[where] = alpha
            return out, None, None
        post = alpha * beta
        post /= post.sum(axis=1, keepdims=True)
        later = np.arange(off[1], off[-1])
        before = off[step[later] - 1] + rank[later]
        right = e[later] * beta[later]
        norm = np.einsum("ni,ij,nj->n", alpha[before], go, right, optimize=True)
        pairs = (alpha[before] / norm[:, None]).T @ right * go
        out[where] = post
        return out, pairs, post[: active[0]].sum(axis=0)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(best label or -1, score) of each text; -1: no letters."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        named = np.array([_LETTER.search(t) is not None for t in texts], bool)
        if not named.any():
            return best, score
        w = read_words([t.lower().encode() for t in texts])
        lengths = np.bincount(w.doc, minlength=len(texts))
        has = lengths > 0
        post, _, _ = self.posteriors(self.emissions(w)[w.word], lengths[has])
        use = w.lettered[w.word]
        total = np.stack([np.bincount(w.doc[use], weights=post[use, k], minlength=len(texts)) for k in range(len(self.labels))], axis=1)
        count = np.bincount(w.doc[use], minlength=len(texts))
        ok = named & (count > 0)
        mean = np.round(total[ok] / count[ok, None], 9)
        best[ok], score[ok] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
        return best, score


def _runs(texts: list[bytes], tags: list[int], rng: np.random.Generator) -> tuple[list[bytes], list[int]]:
    """Whole texts cut into runs of words and dealt out in a random order."""
    runs, of = [], []
    for t, tag in zip(texts, tags, strict=True):
        words, at = t.split(), 0
        while at < len(words):
            n = int(rng.geometric(1 / RUN))
            runs.append(b" ".join(words[at : at + n]))
            of.append(tag)
            at += n
    deal = rng.permutation(len(runs))
    return [runs[i] for i in deal], [of[i] for i in deal]


def fit(samples: list[tuple[str, str]]) -> Crf | None:
    """Fit on (text, language) pairs; deterministic.  None without any word."""
    labels = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(4)
    texts, tags = _runs([t.lower().encode() for t, _ in samples], [labels.index(lang) for _, lang in samples], rng)
    w = read_words(texts)
    if not len(w.word) or not labels:
        return None
    k = len(labels)
    tag = np.array(tags)[w.doc]
    n = np.bincount(w.word, minlength=len(w.hashes))
    lexicon = np.flatnonzero((n >= 3) & w.lettered)
    model = Crf(labels, np.zeros((BUCKETS, k), np.float32), w.hashes[lexicon], np.zeros((len(lexicon), k), np.float32), np.zeros((k, k)), np.zeros(k))
    # sequences of some hundred words, runs of several languages in each
    cuts = np.append(np.arange(0, len(w.word), 400), len(w.word))
    lengths = np.diff(cuts)
    heads = cuts[:-1]
    inner = np.ones(len(tag), bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (tag[at - 1], tag[at]), 1)
    seen_first = np.bincount(tag[heads], minlength=k)
    truth = np.zeros((len(tag), k))
    truth[np.arange(len(tag)), tag] = 1
    sizes = np.diff(np.append(w.starts, len(w.grams)))
    own = np.repeat(np.arange(len(w.hashes)), sizes)
    weights = [model.grams, model.entries, model.steps, model.first]
    sums = [np.full(x.shape, 1e-8) for x in weights]
    for _ in range(ROUNDS):
        post, pairs, first = model.posteriors(model.emissions(w)[w.word], lengths, learn=True)
        diff = truth - post
        by_word = np.stack([np.bincount(w.word, weights=diff[:, j], minlength=len(w.hashes)) for j in range(k)], axis=1)
        by_word[~w.lettered] = 0
        by_gram = np.stack([np.bincount(w.grams, weights=by_word[own, j], minlength=BUCKETS) for j in range(k)], axis=1)
        grads = [by_gram, by_word[lexicon], seen_pairs - pairs, seen_first - first]
        for x, g, s in zip(weights, grads, sums, strict=True):
            g = g - 0.5 * x  # a Gaussian prior
            s += g * g
            x += (0.15 * g / np.sqrt(s)).astype(x.dtype)
    return model


def _unit(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(4), c), 11) / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; no for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most about ``per_language`` whole texts of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    taken = known.withColumn("_u", _unit(F.col("doc_id"))).where(F.col("_u") < F.try_element_at(share, F.col("lang")))
    taken = taken.orderBy("_u", "doc_id", "lang", "text").limit(2 * per_language * len(counts)).collect()
    out, left = [], {lang: TRAIN_WORDS // len(counts) for lang in counts}
    for r in sorted(taken, key=lambda r: r["lang"]):  # keeps the order within a language
        if left[r["lang"]] > 0:
            out.append((r["text"], r["lang"]))
            left[r["lang"]] -= len(r["text"].split())
    return out


def _predict(model, pred: str, sure: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raw, starts, ends = utf8_spans(batch.column(at))
            view = memoryview(raw)
            names, scores = [], []
            for i, j in slices(starts, ends, BLOCK):
                texts = [str(view[a:b], "utf-8") for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]
                best, score = crf.label(texts) if crf is not None else (np.full(j - i, -1), np.zeros(j - i))
                names += [crf.labels[b] if b >= 0 else "und" for b in best.tolist()]
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, pred, sure])
        release()

    return run


def predict(docs: DataFrame, columns: list[str], model: Crf | None, pred: str, sure: str) -> DataFrame:
    """``columns`` (text among them) with the language and the score under these names."""
    spark = docs.sparkSession
    some = docs.select(*columns)
    schema = StructType([*some.schema.fields, StructField(pred, StringType()), StructField(sure, DoubleType())])
    return some.mapInArrow(_predict(spark.sparkContext.broadcast(model), pred, sure), schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    samples = training_sample(docs, per_language)
    model = fit(samples) if samples else None
    out = predict(docs, ["doc_id", "text"], model, "lang_pred", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least this
    score; the others are rejected."""
    samples = training_sample(docs)
    model = fit(samples) if samples else None
    pred, sure = unused(docs.columns, "_lang_pred", "_score")
    out = predict(docs, docs.columns, model, pred, sure)
    return out.where((F.col(pred) != "und") & (F.col(sure) >= least)).select(*docs.columns)
