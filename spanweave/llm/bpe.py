"""Byte-level BPE encoding and decoding.

Encoding backtracks over the longest token matches of a trie automaton: at each
byte the longest vocabulary match is tried first; a token may follow another
only if the pair table says that byte-pair merging would keep both as they
are; a dead end gives the last token back for its next shorter match.  Each
position is given up at most once, so the time is linear and the result is
exactly the merge result.  The words of a block of texts walk the automaton
side by side, as numpy arrays: one step tries, keeps or gives back one token of
every word.  Decoding gathers bytes through a table of (offset, length) per id.

Words are cut by the file's pattern.  Which characters are letters, numbers and
spaces is asked of the tokenizers library itself, whose Unicode tables are not
those of Python's packages.

Defined cases: a null or empty text has no ids; the special string of the
tokenizer file inside a text becomes its special id, as the library does by
default; repeated rows each get a row; an empty table gives an empty table;
columns other than doc_id and text are not looked at, whatever their names; a
text longer than BLOCK is handled in pieces, cut before a blank that follows an
ASCII letter or digit, where no token crosses (memory grows with the longest
stretch without such a place).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import release, utf8_spans

#: Bytes of text encoded at once, about.
BLOCK = 1 << 20
#: Bytes of a word that walks with others; longer ones go one by one.
WIDE = 63
#: Places of the pair table (a power of two).
PAIRS = 1 << 20
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    rest = [b for b in range(256) if b not in keep]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def classes() -> tuple[tuple[int, int], ...]:
    """(first code point, class) of each run of characters of one class, as the
    library's pattern engine has it."""
    from tokenizers import Regex, pre_tokenizers

    def cut(pattern: str, text: str) -> list[tuple[int, int]]:
        return [at for _, at in pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str(text)]

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    runs = [a for a, _ in cut(r"\p{L}+|\p{N}+|\s+", "".join(map(chr, points)))]
    # the class of a run is that of its first character
    few = "".join("|" + chr(points[a]) for a in runs)
    kind = dict.fromkeys(range(len(runs)), OTHER)
    for name, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for a, b in cut(pattern, few):
            if b - a == 1 and a % 2 == 1 and re.fullmatch(r"[^|]", few[a]):
                kind[a // 2] = name
    return tuple((points[a], kind[i]) for i, a in enumerate(runs))


class Trie:
    """Longest vocabulary match from a byte, for many places at once.

    Nodes are prefixes of tokens; a node's children lie at base[node] + byte
    of one shared array, which also names the owner.
    """

    def __init__(self, vocab: dict[bytes, int]) -> None:
        kids: list[dict[int, int]] = [{}]
        best = [-1]
        for token, i in sorted(vocab.items()):  # a prefix comes before what it starts
            node = 0
            for b in token:
                to = kids[node].get(b)
                if to is None:
                    to = kids[node][b] = len(kids)
                    kids.append({})
                    best.append(best[node])
                node = to
            best[node] = i
        self.best = np.array(best, np.int32)
        base = np.zeros(len(kids), np.int32)
        taken, low = bytearray(4 * len(kids) + 1024), 256
        places: list[tuple[int, int, int]] = []
        for node in sorted((n for n in range(len(kids)) if kids[n]), key=lambda n: -len(kids[n])):
            own = sorted(kids[node])
            at, tries = low, 0
            while True:
                at = taken.find(0, at)
                start = at - own[0]
                if not any(taken[start + b] for b in own):
                    break
                at, tries = at + 1, tries + 1
            base[node] = start
            for b in own:
                taken[start + b] = 1
                places.append((start + b, node, kids[node][b]))
            if len(own) == 1 or tries > 20:  # the places before are as good as full
                low = at
        # one gather for owner and child; 255 empty places more for any byte
        self.table = np.full(max(p for p, _, _ in places) + 257, -1, np.int64)
        for at, node, to in places:
            self.table[at] = node << 32 | to
        self.base = base
        self.first = np.zeros(256, np.int32)
        for b, to in kids[0].items():
            self.first[b] = to

    def longest(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that starts at each place and ends by ``end``."""
        node = self.first[raw[at]]
        rows = np.flatnonzero(at + 1 < end)
        here, place, stop = node[rows], at[rows] + 1, end[rows]
        while len(rows):
            found = self.table[self.base[here] + raw[place]]
            good = found >> 32 == here
            rows, here, place, stop = rows[good], (found[good] & 0xFFFFFFFF).astype(np.int32), place[good] + 1, stop[good]
            node[rows] = here
            more = place < stop
            if not more.all():
                rows, here, place, stop = rows[more], here[more], place[more], stop[more]
        return self.best[node]


class Encoder:
    """Exact byte-level BPE of one tokenizer file."""

    def __init__(self, path: str, kinds: tuple[tuple[int, int], ...]) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand = _byte_of_char()
        unfold = lambda s: bytes(stand[c] for c in s)
        vocab = {unfold(t): i for t, i in spec["model"]["vocab"].items() if all(c in stand for c in t)}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * self.size
        for b, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = b
        self.vocab = {b: i for b, i in vocab.items() if i not in set(self.special.values())}
        # merges: (left id, right id) -> (rank, merged id), and how each token was made
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = unfold(a), unfold(b)
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.merge:
                self.merge[pair] = (rank, made)
                self.parts.setdefault(made, pair)
        self.rank = {made: self.merge[p][0] for made, p in self.parts.items()}
        self.trie = Trie(self.vocab)
        # the next shorter vocabulary token that starts a token, or -1
        self.shorter = np.full(self.size, -1, np.int32)
        for b, i in self.vocab.items():
            self.shorter[i] = next((self.vocab[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.vocab), -1)
        self.pair_key = np.full(PAIRS, -1, np.int64)
        self.pair_ok = np.zeros(PAIRS, bool)
        self.special_find = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for (a, k), b in zip(kinds, [*(a for a, _ in kinds[1:]), 0x110000], strict=True):
            self.kind[a:b] = k
        # decoding: one byte store, a place and a length for each id
        self.length = np.array([len(b) for b in self.token], np.int64)
        self.store = np.frombuffer(b"".join(self.token), np.uint8)
        self.place = np.cumsum(self.length) - self.length
        self.decimal = np.array([b"%d," % i for i in range(self.size)], "S8").view(np.uint8).reshape(self.size, 8)
        self.written = self.decimal != 0

    # the pair table

    def pair_stands(self, left: int, right: int) -> bool:
        """Would merging the bytes of both tokens leave just these two?

        Walks the two derivation trees along the border: a merge across the
        border that would have come before a merge that built either side
        breaks the pair.
        """
        limit = 1 << 60
        merge, parts, rank = self.merge, self.parts, self.rank
        while True:
            m = merge.get((left, right))
            if m is not None and m[0] < limit:
                return False
            lr, rr = rank.get(left, -1), rank.get(right, -1)
            if lr > rr:
                limit = lr
                left = parts[left][1]
            elif rr >= 0:  # of equal merges the left one comes first
                limit = rr + 1
                right = parts[right][0]
            else:
                return True

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows of the pair table, worked out when first asked for."""
        key = left.astype(np.int64) * self.size + right
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) % PAIRS
        out = self.pair_ok[at]
        new = np.flatnonzero(self.pair_key[at] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            found = np.array([self.pair_stands(*divmod(k, self.size)) for k in asked.tolist()], bool)
            out[new] = found[back]
            place = (asked * 0x9E3779B1 & 0xFFFFFFFF) % PAIRS
            _, last = np.unique(place[::-1], return_index=True)  # one key a place
            last = len(place) - 1 - last
            self.pair_key[place[last]], self.pair_ok[place[last]] = asked[last], found[last]
        return out

    # words to ids

    def _backtrack(self, word: bytes) -> list[int]:
        """One word of any length."""
        n = len(word)
        raw, vocab, reach = word, self.vocab, max(len(t) for t in self.vocab) if n > 256 else n

        def longest(at: int) -> int:
            for m in range(min(reach, n - at), 0, -1):
                i = vocab.get(raw[at : at + m])
                if i is not None:
                    return i
            raise AssertionError("a byte without a token")

        ids: list[int] = []
        dead = bytearray(n + 1)
        shorter, length, known = self.shorter, self.length, {}
        at, last, cand = 0, -1, longest(0)
        while at < n:
            end = at + int(length[cand])
            ok = not dead[end]
            if ok and last >= 0:
                pair = (last, cand)
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.pair_stands(last, cand)
            if ok:
                ids.append(cand)
                at, last = end, cand
                if at < n:
                    cand = longest(at)
                continue
            nxt = int(shorter[cand])
            while nxt < 0:  # nothing fits here: give the last token back
                dead[at] = 1
                cand = ids.pop()
                at -= int(length[cand])
                nxt = int(shorter[cand])
            cand = nxt
            last = ids[-1] if ids else -1
        return ids

    def _side_by_side(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of words of at most WIDE bytes, given the first
        candidate of each: a step of backtracking for all at a time."""
        n, size = len(starts), (ends - starts).astype(np.int32)
        kept = np.zeros((n, int(size.max(initial=1))), np.int32)
        count, at = np.zeros(n, np.int32), np.zeros(n, np.int32)
        dead = np.zeros(n, np.uint64)
        cand, one = cand.copy(), np.uint64(1)
        rows = np.arange(n)
        while len(rows):
            c, k = cand[rows], count[rows]
            end = at[rows] + self.length[c].astype(np.int32)
            ok = dead[rows] >> end.astype(np.uint64) & one == 0
            pair = np.flatnonzero(ok & (k > 0))
            ok[pair] = self.stand(kept[rows[pair], k[pair] - 1], c[pair])
            on, back = rows[ok], rows[~ok]
            kept[on, k[ok]] = c[ok]
            count[on] += 1
            at[on] = end[ok]
            on = on[end[ok] < size[on]]
            cand[on] = self.trie.longest(raw, starts[on] + at[on], ends[on])
            nxt = self.shorter[cand[back]]
            while (none := nxt < 0).any():  # nothing fits there: give the last token back
                lost = back[none]
                dead[lost] |= one << at[lost].astype(np.uint64)
                count[lost] -= 1
                cand[lost] = kept[lost, count[lost]]
                at[lost] -= self.length[cand[lost]].astype(np.int32)
                nxt[none] = self.shorter[cand[lost]]
            cand[back] = nxt
            rows = np.concatenate([on, back])
        return kept[np.arange(kept.shape[1])[None] < count[:, None]], count

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each)."""
        size = ends - starts
        cand = self.trie.longest(raw, starts, ends) if len(starts) else np.zeros(0, np.int32)
        count = np.ones(len(starts), np.int64)
        more = np.flatnonzero(self.length[cand] < size)
        wide = more[size[more] > WIDE]
        some = more[size[more] <= WIDE]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their ids)
        for a in range(0, len(some), 1 << 15):
            w = some[a : a + (1 << 15)]
            ids, n = self._side_by_side(raw, starts[w], ends[w], cand[w])
            count[w] = n
            found.append((w, ids))
        for w in wide.tolist():
            ids = np.array(self._backtrack(raw[starts[w] : ends[w]].tobytes()), np.int32)
            count[w] = len(ids)
            found.append((np.array([w]), ids))
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[at] = cand  # right for words of one token; the others are written over
        for w, ids in found:
            n = count[w]
            out[np.repeat(at[w] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    # texts to words

    def cut(self, raw: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Byte offsets at which the words of some UTF-8 texts start; the texts
        start at ``breaks`` and nothing crosses from one to the next."""
        if not len(raw):
            return np.zeros(0, np.int64)
        lead = np.flatnonzero(raw & 0xC0 != 0x80)
        if len(lead) == len(raw):
            point, kind = raw, self.kind[raw]
        else:
            point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            kind = self.kind[point]
        forced = np.zeros(len(point) + 1, bool)
        forced[np.searchsorted(lead, breaks)] = True
        forced[-1] = True
        turn = forced.copy()
        turn[1:-1] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(turn)
        first, last = runs[:-1], runs[1:]
        of, goes_on = kind[first], ~forced[last]
        word = np.zeros(len(point) + 1, bool)
        word[first] = True
        # of blanks before something else, a last plain one is the next word's, another its own word
        blank = np.flatnonzero((of == SPACE) & goes_on)
        end = last[blank]
        word[end - 1] = True
        plain = point[end - 1] == 32
        word[end[plain]] = False
        # an apostrophe alone, followed by certain letters
        quote = np.flatnonzero((of == OTHER) & goes_on & (last - first == 1) & (point[first] == 39) & word[first])
        quote = quote[of[np.minimum(quote + 1, len(of) - 1)] == LETTER]
        at = last[quote]
        one = point[at]
        two = np.where(at + 1 < last[quote + 1], point[np.minimum(at + 1, len(point) - 1)], 0)
        is_ = lambda c: one == ord(c)
        short = is_("s") | is_("t") | is_("m") | is_("d")
        long = is_("r") & (two == ord("e")) | is_("v") & (two == ord("e")) | is_("l") & (two == ord("l"))
        word[at[short | long]] = False
        word[at[short] + 1] = True
        word[at[long] + 2] = True
        return lead[word[:-1]] if len(lead) != len(raw) else np.flatnonzero(word[:-1])

    def encode_block(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in ``raw`` and start at
        ``texts``; and where the ids of each start."""
        special = list(self.special_find.finditer(raw.tobytes())) if self.special_find is not None else []
        inside = np.concatenate([np.arange(m.start() + 1, m.end()) for m in special]) if special else np.zeros(0, np.int64)
        if len(inside):  # not where two texts only make the string together
            across = set(np.intersect1d(inside, texts).tolist())
            special = [m for m in special if across.isdisjoint(range(m.start() + 1, m.end()))]
        breaks = texts[texts < len(raw)]
        if special:
            breaks = np.union1d(breaks, [x for m in special for x in m.span() if x < len(raw)])
        starts = self.cut(raw, breaks)
        if special:  # one word each
            own = np.array([m.start() for m in special])
            ends_ = np.array([m.end() for m in special])
            k = np.searchsorted(own, starts, side="right") - 1
            starts = starts[(k < 0) | (starts >= ends_[k]) | (starts == own[k])]
        ends = np.append(starts[1:], len(raw))
        ids, count = self.words(raw, starts, ends)
        after = np.concatenate([[0], np.cumsum(count)])
        if special:
            at = np.searchsorted(starts, own)
            keep = np.ones(len(ids), bool)
            for w, m in zip(at.tolist(), special, strict=True):
                keep[after[w] + 1 : after[w + 1]] = False
                ids[after[w]] = self.special[m[0]]
            count[at] = 1
            ids = ids[keep]
            after = np.concatenate([[0], np.cumsum(count)])
        return ids, after[np.searchsorted(starts, texts)]

    def encode_batch(self, column: pa.Array) -> Iterator[tuple[int, bool, memoryview, np.ndarray]]:
        """(row, whether it is the row's last piece, piece, its ids), in order."""
        raw, starts, ends = utf8_spans(column)
        view = memoryview(raw)
        pieces: list[tuple[int, int, int]] = []
        held = 0
        for r, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            while b - a > BLOCK and (m := _CUT.search(view, a + BLOCK, b)) is not None:
                pieces.append((r, a, m.end()))
                held += m.end() - a
                a = m.end()
                if held >= BLOCK:
                    yield from self._pieces(view, pieces, ends)
                    pieces, held = [], 0
            pieces.append((r, a, b))
            held += b - a
            if held >= BLOCK:
                yield from self._pieces(view, pieces, ends)
                pieces, held = [], 0
        yield from self._pieces(view, pieces, ends)

    def _pieces(self, view: memoryview, pieces: list[tuple[int, int, int]], ends: np.ndarray) -> Iterator[tuple[int, bool, memoryview, np.ndarray]]:
        if not pieces:
            return
        block = np.frombuffer(b"".join([view[a:b] for _, a, b in pieces]), np.uint8)
        size = np.array([b - a for _, a, b in pieces])
        at = np.cumsum(size) - size
        ids, first = self.encode_block(block, at)
        for (r, a, b), low, high in zip(pieces, first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
            yield r, b == ends[r], view[a:b], ids[low:high]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        got = [ids for _, _, _, ids in self.encode_batch(pa.array([text], pa.string()))]
        return np.concatenate(got)

    def written_ids(self, ids: np.ndarray) -> bytes:
        """Decimal ids, a comma after each."""
        return self.decimal[ids][self.written[ids]].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather through the offset table."""
        if not len(ids):
            return b""
        n = self.length[ids]
        ends = np.cumsum(n)
        index = np.repeat(self.place[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.store[index].tobytes()


_CUT = re.compile(rb"[0-9A-Za-z](?=[ \n])")


@lru_cache(maxsize=2)
def encoder(path: str, kinds: tuple[tuple[int, int], ...] | None = None) -> Encoder:
    return Encoder(path, kinds or classes())


def _digests(path: str, kinds: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kinds)
        for batch in batches:
            n_tokens, ids_sha, dec_sha = [], [], []
            n, of_ids, of_text, begun = 0, hashlib.sha256(), hashlib.sha256(), False
            for _, last, piece, ids in enc.encode_batch(batch.column(1)):
                if len(ids):
                    if begun:
                        of_ids.update(b",")
                    of_ids.update(memoryview(enc.written_ids(ids))[:-1])
                    out = enc.decode(ids)
                    of_text.update(out if out == piece else out.decode("utf-8", "replace").encode())
                    n, begun = n + len(ids), True
                if last:
                    n_tokens.append(n)
                    ids_sha.append(of_ids.hexdigest())
                    dec_sha.append(of_text.hexdigest())
                    n, of_ids, of_text, begun = 0, hashlib.sha256(), hashlib.sha256(), False
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release()

    return run


def _texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    One row per input row, repeated rows included; a null or empty text has
    no ids and the digests of nothing.
    """
    return _texts_of(docs).mapInArrow(_digests(path, classes()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str, kinds: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kinds)
        for batch in batches:
            flat, n = [np.zeros(0, np.int32)], [0] * batch.num_rows
            for r, _, _, ids in enc.encode_batch(batch.column(1)):
                flat.append(ids)
                n[r] += len(ids)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text; a null text has no ids."""
    return _texts_of(docs).mapInArrow(_ids(path, classes()), "doc_id long, ids array<int>")


def _packed(path: str, kinds: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kinds)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for batch in batches:
            rows: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for r, _, _, ids in enc.encode_batch(batch.column(1)):
                rows[r].append(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(x) for x in rows], pa.binary())], names=["doc_id", "ids"])
        release()

    return run


def encode_packed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text as little-endian numbers, of 2 bytes
    where the vocabulary allows it and else of 4."""
    return _texts_of(docs).mapInArrow(_packed(path, classes()), "doc_id long, ids binary")


def _texts(path: str, kinds: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kinds)
        for batch in batches:
            out = [enc.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ``ids``; null ids give an empty text."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_texts(path, classes()), "doc_id long, text string")
