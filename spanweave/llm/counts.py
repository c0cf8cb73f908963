"""Token counts through a compiled finite-state tokenizer.

The merge tokenizer of a sentencepiece BPE model is compiled, transition by
transition as texts ask for them, into a deterministic transducer over
characters.  A state is the last-token window of a prefix; a transition carries
the number of tokens by which the count of the prefix changes, so a walk needs
no merge queue.  The last token of a longer prefix is the one vocabulary suffix
whose pair with the token before it survives merging.  Where two neighbouring
characters stand together in no piece no merge crosses, and the machine is in
its start state again; so it is before every word mark that follows another
character.  The words of a block of texts walk the machine side by side, as
numpy arrays over one table of transitions.

A text longer than LONG is cut into chunks, rows of a table that is dealt out
over tasks.  The state map of a chunk gives exit state and count for each state
it can be entered in: those that the characters before it lead to from a fresh
start at each of the last places (as many as a piece is long).  Maps compose
associatively, in a tree: blocks of FAN chunks, then the text.  Should a text
enter a chunk in a state that its map lacks, the text is walked whole instead,
which is exact as well.

Defined cases: a null text counts as empty (0 bytes, 0 tokens, not over the
limit); repeated rows each get a row; an empty table gives an empty table;
columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import materialise, release, slices, utf8_spans

MARK = "▁"
#: Bytes of text walked at once; states (about) and pairs that a worker keeps.
BLOCK, STATES, PAIRS = 1 << 20, 200_000, 400_000
#: Bytes of a text above which its chunks are rows of their own; characters of
#: a chunk and of what a chunk sees of the text before it; chunks of a block.
LONG, CHUNK, BEFORE, FAN = 4 << 20, 1 << 18, 256, 64
#: Words that walk side by side at least, and their characters at most.
FEW, WIDE = 16, 4096


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        i += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind == 5:
            value, i = b[i : i + 4], i + 4
        else:
            value, i = b[i : i + 8], i + 8
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a model file."""
    import struct

    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for field, value in _fields(raw):
        if field == 1:
            text, score, kind = "", 0.0, 1
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out.append((text, score, kind))
    return out


class Transducer:
    """Counts of one model with byte fallback and a dummy word mark in front."""

    def __init__(self, path: str) -> None:
        pieces = read_pieces(path)
        self.score = {p: s for p, s, kind in pieces if kind == 1}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a word mark")
        self.known = {c for p in self.score for c in p}
        self.together = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.starts = {p[:n] for p in self.score for n in range(1, len(p))}  # of the automaton
        self.made: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tails: dict[str, tuple] = {}
        self.reach = max(map(len, self.score))
        self._reset()

    # merging itself: how tokens are made

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merge queue, best score first, then the left one; and the two
        parts of the last merge."""
        n = len(text)
        sym: list[str] = list(text)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        score, last = self.score, None
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i]
            if not sym[i] or j < 0 or len(sym[i]) + len(sym[j]) != len(p) or sym[i] + sym[j] != p:
                continue
            last = (sym[i], sym[j])
            sym[i], sym[j] = p, ""
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (q := p + sym[k]) in score:
                    heapq.heappush(heap, (-score[q], i, q))
            h = prv[i]
            if h >= 0 and (q := sym[h] + p) in score:
                heapq.heappush(heap, (-score[q], h, q))
        return [s for s in sym if s], last

    def parts(self, token: str) -> tuple[str, str] | None:
        """The two tokens that a token is merged from; None if merging its own
        characters does not give it, so that it never comes up."""
        if token not in self.made:
            out, last = self.merge(token)
            self.made[token] = last if len(out) == 1 else None
        return self.made[token]

    def _stands(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._pair_stands(left, right)
        return known

    def _pair_stands(self, left: str, right: str) -> bool:
        """Would merging the characters of both tokens leave just these two?

        A merge across the border that comes before a merge that built either
        side breaks the pair.
        """
        limit, score = float("inf"), self.score
        while True:
            across = score.get(left + right)
            if across is not None and -across < limit:
                return False
            rl = -score[left] if len(left) > 1 else -1
            rr = -score[right] if len(right) > 1 else -1
            if rl > rr:
                limit, left = rl, self.parts(left)[1]
            elif rr >= 0:  # of equal merges the left one comes first
                limit, right = rr + 1, self.parts(right)[0]
            else:
                return True

    # the machine

    def _reset(self) -> None:
        """State 0 is the empty prefix.  A state: the longest end of the prefix
        that starts some piece, and (last token, count) of the prefixes that
        reach back as far, counts relative to the newest."""
        start = ("", (("", 0),))
        self.ids: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.steps: dict[int, int] = {}  # state and character: next state and tokens added
        self.tails.clear()
        self.keys = np.full(1 << 18, -1, np.int64)  # the same, for many at once
        self.values = np.zeros(1 << 18, np.int64)
        self.held = 0

    def _tail(self, tail: str) -> tuple[str, int, tuple[bool, ...], tuple[tuple[int, str, int], ...]]:
        """What a step needs of the end of a prefix: its longest end that
        starts a piece, what that leaves out, which of its places start one,
        and the pieces that may be its last token (length, piece, tokens)."""
        score = self.score
        ends = []
        for n in range(1, len(tail) + 1):
            t = tail[-n:]
            if n == 1 or t in score and self.parts(t) is not None:
                ends.append((n, t, 1 if t in score else len(t.encode())))
        rest = tail
        while rest and rest not in self.starts:
            rest = rest[1:]
        return rest, len(tail) - len(rest), tuple(rest[i:] in self.starts for i in range(len(rest))), tuple(ends)

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """(next state, tokens added) of a transition met for the first time."""
        if c not in self.known:  # byte fallback: one token a byte, and a fresh start
            return 0, len(c.encode())
        tail, window = self.states[state]
        if tail and tail[-1] + c not in self.together:  # no merge crosses
            tail, window = self.states[0]
        tail += c
        made = self.tails.get(tail)
        if made is None:
            made = self.tails[tail] = self._tail(tail)
        rest, gone, place, ends = made
        for n, token, add in ends:
            before, count = window[-n]
            if before and not self._stands(before, token):
                continue
            count += add
            break
        else:
            raise AssertionError(f"no token ends {tail!r}")
        if not rest:
            return 0, count
        # a later piece can only begin where the end of the prefix starts one
        window = (*[(w[0], w[1] - count) if ok and w else None for ok, w in zip(place, window[gone:])], (token, 0))  # noqa: B905
        to = self.ids.setdefault((rest, window), len(self.states))
        if to == len(self.states):
            self.states.append((rest, window))
        return to, count

    def step(self, key: int) -> int:
        """A transition by its key, state << 21 | character: next state << 8 |
        tokens added + 128."""
        value = self.steps.get(key)
        if value is None:
            to, count = self._compile(key >> 21, chr(key & 0x1FFFFF))
            value = self.steps[key] = to << 8 | count + 128
        return value

    def _places(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _keep(self, key: np.ndarray, value: np.ndarray) -> None:
        """Put distinct new keys into the table, each at the next free place;
        the table stays half empty."""
        self.held += len(key)
        if 2 * self.held > len(self.keys):
            old = self.keys != -1
            key, value = np.concatenate([self.keys[old], key]), np.concatenate([self.values[old], value])
            size = 1 << (4 * self.held).bit_length()
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        at, most = self._places(key), len(self.keys) - 1
        while len(key):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, value, at = key[left], value[left], at[left] + 1 & most

    def look(self, key: np.ndarray) -> np.ndarray:
        """Many transitions at once."""
        at, most = self._places(key), len(self.keys) - 1
        out, there = self.values[at], self.keys[at]
        miss = np.flatnonzero(there != key)
        new = []
        while len(miss):
            none = there[miss] == -1
            new.append(miss[none])
            miss = miss[~none]
            at[miss] = at[miss] + 1 & most
            there[miss] = self.keys[at[miss]]
            hit = there[miss] == key[miss]
            out[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit]
        if new and len(rows := np.concatenate(new)):
            asked, back = np.unique(key[rows], return_inverse=True)
            found = np.array([self.step(k) for k in asked.tolist()], np.int64)
            out[rows] = found[back]
            self._keep(asked, found)
        return out

    def walk(self, text: str, state: int = 0) -> tuple[int, int]:
        """(exit state, tokens added) of a text entered in a state."""
        total, steps = 0, self.steps
        for c in map(ord, text):
            value = steps.get(state << 21 | c)
            if value is None:
                value = self.step(state << 21 | c)
            state = value >> 8
            total += (value & 255) - 128
        return state, total

    def words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of words that each begin in the start state."""
        total = np.zeros(len(starts), np.int64)
        size = np.minimum(ends - starts, WIDE + 1).astype(np.uint16)
        order = np.argsort(np.uint16(WIDE + 1) - size, kind="stable")  # the longest first
        n_wide = int((size > WIDE).sum())
        for w in order[:n_wide].tolist():
            total[w] = self.walk(points[starts[w] : ends[w]].astype("<u4").tobytes().decode("utf-32-le"))[1]
        order = order[n_wide:]
        active = len(order) - np.cumsum(np.bincount(size[order], minlength=1))  # words longer than t
        at, state, count = starts[order], np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for t, n in enumerate(active.tolist()):
            if n < FEW:
                for w in range(n):
                    text = points[at[w] + t : ends[order[w]]].astype("<u4").tobytes().decode("utf-32-le")
                    count[w] += self.walk(text, int(state[w]))[1]
                break
            value = self.look(state[:n] << 21 | points[at[:n] + t])
            state[:n] = value >> 8
            count[:n] += (value & 255) - 128
        total[order] = count
        return total

    def count_block(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self._reset()
        out = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        marked = [MARK + texts[i].replace(" ", MARK) for i in full]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.cumsum([0, *map(len, marked[:-1])])
        mark = points == ord(MARK)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[first] = True
        starts = np.flatnonzero(begins)
        counts = self.words(points, starts, np.append(starts[1:], len(points)))
        out[full] = np.add.reduceat(counts, np.searchsorted(starts, first))
        return out

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        return int(self.count_block([text or ""])[0])

    # chunk maps

    def name(self, state: int) -> str:
        """A state's name, the same in every worker."""
        return json.dumps(self.states[state], ensure_ascii=False, separators=(",", ":"))

    def chunk_map(self, before: str, text: str) -> dict[str, tuple[str, int]]:
        """The state map of a chunk: exit state and tokens of each state that
        it may be entered in.  ``before`` is the end of what comes before it;
        where that is empty the text starts here."""
        if len(self.states) > STATES:
            self._reset()
        entries = {self.walk(before[k:])[0] for k in range(min(self.reach, len(before) or 1))}
        # walks that meet go on as one: (state, tokens, entries with their own tokens)
        walks = [(e, 0, {e: 0}) for e in sorted(entries)]
        for i in range(0, len(text), 64):
            met: dict[int, tuple[int, int, dict[int, int]]] = {}
            for state, n, of in walks:
                state, more = self.walk(text[i : i + 64], state)
                n += more
                if state in met:
                    _, m, all_ = met[state]
                    all_.update({e: x + n - m for e, x in of.items()})
                else:
                    met[state] = (state, n, of)
            walks = list(met.values())
            if len(walks) == 1:
                state, n, of = walks[0]
                state, more = self.walk(text[i + 64 :], state)
                walks = [(state, n + more, of)]
                break
        return {self.name(e): (self.name(state), n + x) for state, n, of in walks for e, x in of.items()}


def compose(a: dict[str, tuple[str, int]], b: dict[str, tuple[str, int]]) -> dict[str, tuple[str, int]]:
    """The map of two neighbouring stretches; without the states that lead to
    one that the second map lacks."""
    return {e: (b[x][0], n + b[x][1]) for e, (x, n) in a.items() if x in b}


def composed(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """The map of neighbouring stretches, joined pair by pair."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            raw, starts, ends = utf8_spans(batch.column(1))
            view = memoryview(raw)
            n = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(starts, ends, BLOCK):
                n[i:j] = machine.count_block([str(view[a:b], "utf-8") for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    return run


def _chunks(size: int, before: int):
    """row, chunk, before, text of each chunk of long texts, word marks set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = MARK + batch.column(1)[r].as_py().replace(" ", MARK)
                for k, at in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(r, 1), pa.array([k], pa.int64()), pa.array([text[max(0, at - before) : at]]), pa.array([text[at : at + size]])], names=["row", "chunk", "before", "text"]
                    )

    return run


_MAP = "map<string,struct<exit:string,n:bigint>>"


def _maps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        kind = pa.map_(pa.string(), pa.struct([("exit", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            made = [machine.chunk_map(b.as_py(), t.as_py()) for b, t in zip(batch.column(2), batch.column(3), strict=True)]
            made = [[(e, {"exit": x, "n": n}) for e, (x, n) in m.items()] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], names=["row", "chunk", "states"])
        release()

    return run


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for some neighbouring chunks of a text: their composed map."""
    pdf = pdf.sort_values("chunk")
    maps = [{e: (v["exit"], v["n"]) for e, v in (m.items() if isinstance(m, dict) else m)} for m in pdf["states"]]
    out = {e: {"exit": x, "n": n} for e, (x, n) in composed(maps).items()}
    return pd.DataFrame({"row": pdf["row"].iloc[:1].to_numpy(), "chunk": pdf["chunk"].iloc[:1].to_numpy(), "states": [out]})


def count_long(docs: DataFrame, path: str, limit: int, chunk: int = CHUNK, before: int = BEFORE) -> DataFrame:
    """The counts of long texts, their chunks dealt out over tasks."""
    size = F.octet_length("text").cast("long")
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "long")
    chunks = rows.select("row", "text").mapInArrow(_chunks(chunk, before), "row long, chunk long, before string, text string")
    maps = chunks.repartition("row", "chunk").mapInArrow(_maps(path), f"row long, chunk long, states {_MAP}")
    for fan in (FAN, 1 << 40):
        maps = maps.groupBy("row", F.floor(F.col("chunk") / fan)).applyInPandas(_joined, f"row long, chunk long, states {_MAP}")
    start = transducer(path).name(0)
    total = materialise(maps.select("row", F.try_element_at("states", F.lit(start))["n"].alias("n_tokens")), "totals")
    n = F.col("n_tokens")
    done = rows.join(total.where(n.isNotNull()), "row").select("doc_id", size.alias("n_bytes"), n, (n > limit).alias("over_limit"))
    whole = rows.join(total.where(n.isNull()), "row").select("doc_id", "text")
    return done.unionByName(whole.mapInArrow(_counts(path, limit), COUNTS))


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, long: int = LONG, **cut) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    One row per input row; a null text has 0 bytes and 0 tokens.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    short = docs.where(~is_long).mapInArrow(_counts(path, limit), COUNTS)
    return short.unionByName(count_long(docs.where(is_long), path, limit, **cut))
