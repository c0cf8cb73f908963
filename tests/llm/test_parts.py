"""Parts of the operators, without or with little Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.llm import counts, media, shards, simhash, substrings
from spanweave.llm.bpe import decode, encode, encoder
from spanweave.llm.components import components
from tests.llm import brute


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _same_ids(texts: list[str]) -> None:
    from tokenizers import Tokenizer

    got: list[list[int]] = [[] for _ in texts]
    for r, _, _, ids in encoder(BYTE_BPE).encode_batch(pa.array(texts, pa.string())):
        got[r] += ids.tolist()
    want = [x.ids for x in _library(Tokenizer).encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


@given(st.lists(st.text(max_size=80) | st.text(alphabet="'strevlmd \n\t\u3000é1!", max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_bpe_any_text(texts):
    _same_ids(texts)
    for text in texts:
        assert encoder(BYTE_BPE).decode(encoder(BYTE_BPE).encode(text)) == text.encode()


def test_bpe_every_code_point():
    """Letters, numbers and blanks are those of the library."""
    for low in range(0, 0x110000, 1 << 16):
        some = [chr(c) for c in range(low, low + (1 << 16)) if not 0xD800 <= c < 0xE000]
        _same_ids([f"a{c}'s{c}b 1{c}2 {c}" for c in some])


def test_bpe_pieces(monkeypatch):
    """Long texts are cut where no token crosses."""
    from spanweave.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK", 40)
    words = ["the", "x" * 90, "don't", "\u3000", "", "\n", "<|endoftext|>", "12\u00a0", "é's", "end"]
    _same_ids([" ".join(words) * 5, "", "<|endoftext|>" * 9, "ab" * 200, "a " * 100, *words])


_cache = {}


def _library(kind):
    if kind not in _cache:
        _cache[kind] = kind.from_file(BYTE_BPE)
    return _cache[kind]


@given(st.text(max_size=80) | st.text(alphabet="ab ▁eth\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_any_text(text):
    import sentencepiece

    key = "sp"
    if key not in _cache:
        _cache[key] = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    machine = counts.transducer(public_tokenizers.path("piece_bpe_32k.model"))
    assert machine.count(text) == len(_cache[key].encode(text))


LONG_TEXTS = ["the quick  brown fox▁▁jumps over " * 40 + "x" * 300 + " end  ", " " * 1000, "-" * 700 + "=" * 500, "x" * 2000, "é中x" * 300]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_chunk_maps_compose(size):
    machine = counts.transducer(public_tokenizers.path("piece_bpe_32k.model"))
    for text in LONG_TEXTS:
        marked = counts.MARK + text.replace(" ", counts.MARK)
        maps = [machine.chunk_map(marked[max(0, i - counts.BEFORE) : i], marked[i : i + size]) for i in range(0, len(marked), size)]
        assert counts.composed(maps)[machine.name(0)][1] == machine.count(text) == machine.walk(marked)[1]


def test_compose_lacks_a_state():
    a, b = {"s": ("t", 2), "u": ("v", 3)}, {"t": ("w", 5)}
    assert counts.compose(a, b) == {"s": ("w", 7)}
    assert counts.compose(b, a) == {}


def test_long_texts_as_chunk_rows(spark):
    """Texts above the length are counted by several tasks, with the same result."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, t) for i, t in enumerate([*LONG_TEXTS, "short", "", None])] + [(None, LONG_TEXTS[0]), (0, LONG_TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = Counter(map(tuple, counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), 400, long=50, chunk=100).collect()))
    want = Counter((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 400) for d, t in rows)
    assert got == want
    # maps that lack the state a text enters a chunk in: the text is walked whole
    assert Counter(map(tuple, counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), 400, long=50, chunk=100, before=0).collect())) == want


@given(st.binary(min_size=64, max_size=640), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(data, kind):
    image = np.frombuffer(data[: len(data) // 64 * 64], np.uint8).reshape(-1, 64)
    assert (media.decode_png(media.encode_png(image, kind)) == image).all()


def test_png_checksums():
    good = bytearray(media.encode_png(np.arange(256, dtype=np.uint8).reshape(4, 64)))
    for at in range(0, len(good), 5):
        bad = good.copy()
        bad[at] ^= 1
        with pytest.raises(media.BadMedia):
            media.decode_png(bytes(bad))


@given(st.integers(1, 5000), st.integers(0, 1 << 40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    slots = shards.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert (shards.unpermute(slots, n, key) == np.arange(n)).all()


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=2, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 63), st.integers(0, 63)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_trie_links(base, near):
    keys = set(base)
    for i, b, c in near:
        keys.add(base[i % len(base)] ^ (1 << b) ^ (1 << c))
    a = np.array(sorted(keys), np.uint64)
    u, v = simhash.trie_links(a, None, 0, 0, 2)
    want = {(x, y) for x in keys for y in keys if x < y and (x ^ y).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist(), strict=True)} == want


def test_links_over_subtrees(spark, monkeypatch):
    """Links across subtrees: many small units give what brute force gives."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    keys = set(base.tolist())
    for x in base.tolist():
        for _ in range(3):
            x ^= 1 << int(rng.integers(64))
            keys.add(x)
    monkeypatch.setattr(simhash, "SUBTREE", 20)
    rows = [(int(np.uint64(k).astype(np.int64)),) for k in keys]
    got = components(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()
    root = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in got}
    u, v = simhash.trie_links(np.array(sorted(keys), np.uint64), None, 0, 0, 2)
    node, least = simhash.spanning(u, v)
    want: dict[int, set] = {}
    for n, r in zip(node.tolist(), least.tolist(), strict=True):
        want.setdefault(r, {r}).add(n)
    have: dict[int, set] = {}
    for n, r in root.items():
        have.setdefault(r, {r}).add(n)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_components_star_and_path(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 for i in range(201)) and got[2001] == 2000


def test_factors():
    start, words, ref, place = substrings.factors(np.array([2, 3, 4, 9, 10]), np.array([7, 7, 5, 5, 5]), np.array([0, 1, 2, 20, 21]), 3)
    assert (start.tolist(), words.tolist(), ref.tolist(), place.tolist()) == ([2, 4, 9], [4, 3, 4], [7, 5, 5], [0, 2, 20])
    assert np.flatnonzero(substrings.covered(start, words, 14)).tolist() == [2, 3, 4, 5, 6, 9, 10, 11, 12]


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_window_hashes(values, width):
    """Equal windows and only those have equal hashes."""
    words = np.array(values, np.uint64)
    got = substrings.window_hashes(words, width).tolist()
    want = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(got) == len(want)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def _thue_morse(k: int) -> str:
    s = "a"
    for _ in range(k):
        s += s.translate({97: 98, 98: 97})
    return s


def _spans_of(spark, rows):
    got = substrings.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string"), window=50)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())


def test_substrings_of_words_made_to_collide(spark):
    """Polynomial hashes modulo a power of two are equal for such words."""
    word = _thue_morse(10)
    other = word.translate({97: 98, 98: 97})
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")]
    assert _spans_of(spark, rows) == Counter(brute.spans(rows))


def test_factors_are_checked_against_words(spark, monkeypatch):
    """Hashes that collide for the first seeds: the result is still right."""
    honest = substrings._parsed

    def weak(texts, window, anchor, seed):
        if seed == 0:  # as if every shared window were the first of row 0
            made = honest(texts, window, anchor, seed)
            return made.withColumn("factors", F.transform("factors", lambda f: f.withField("place", f["place"] + 1)))
        return honest(texts, window, anchor, seed)

    monkeypatch.setattr(substrings, "_parsed", weak)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, "a " + passage), (2, passage + " b"), (3, "c d " + passage), (4, None), (5, "e " * 120), (6, "e " * 90)]
    assert _spans_of(spark, rows) == Counter(brute.spans(rows))


def test_encode_decode_frames(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "hello  world 😀"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decode(encode(docs, path), path).collect()}
    assert got == {1: "hello  world 😀", 2: "", 3: ""}


def test_shards_resume(spark, tmp_path):
    rows = [(i, bytes([i % 256]) * (i * 7 % 900)) for i in range(60)]
    path = str(tmp_path / "source")
    spark.createDataFrame(rows, "doc_id long, ids binary").write.parquet(path)
    out = str(tmp_path / "shards")
    made = shards.write_shards(spark.read.parquet(path), out, width=1, key=3, stride=128, shard_bytes=128 * 16)
    assert shards.read_manifest(spark, out) == made == {"n": made["n"], "width": 1, "stride": 128, "per_shard": 16, "key": 3}
    made = shards.read_manifest(spark, out)  # what a reader has
    files = sorted(p for p in (tmp_path / "shards" / "shards").iterdir() if p.name.startswith("part-"))
    assert [p.stat().st_size for p in files[:-1]] == [made["per_shard"] * 128] * (len(files) - 1)
    all_ = list(shards.read_from(lambda s: files[s].open("rb"), 0, made))
    assert [x[0] for x in all_] == list(range(made["n"]))
    tail = list(shards.read_from(lambda s: files[s].open("rb"), 33, made))
    assert [(x[0], x[1], x[2], x[3].tolist()) for x in tail] == [(x[0], x[1], x[2], x[3].tolist()) for x in all_[33:]]
    back: dict[int, dict[int, bytes]] = {}
    for _, doc, seq, ids in all_:
        back.setdefault(doc, {})[seq] = ids.tobytes()
    assert {d: b"".join(p[i] for i in sorted(p)) for d, p in back.items()} == dict(rows)


def test_posteriors_by_enumeration():
    """Forward-backward against the sum over all label sequences."""
    from itertools import product

    from spanweave.llm.langid import Crf

    rng = np.random.default_rng(5)
    k, lengths = 3, np.array([4, 1, 6, 4])
    model = Crf(["a", "b", "c"], np.zeros((1, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), rng.normal(size=(k, k)), rng.normal(size=k))
    scores = rng.normal(size=(int(lengths.sum()), k))
    post, pairs, first = model.posteriors(scores, lengths, learn=True)
    want, want_pairs, want_first, at = np.zeros_like(scores), np.zeros((k, k)), np.zeros(k), 0
    for n in lengths.tolist():
        own, total, p, f = np.zeros((n, k)), 0.0, np.zeros((k, k)), np.zeros(k)
        for path in product(range(k), repeat=n):
            w = np.exp(model.first[path[0]] + sum(scores[at + i, x] for i, x in enumerate(path)) + sum(model.steps[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            f[path[0]] += w
            for i, x in enumerate(path):
                own[i, x] += w
            for x, y in zip(path, path[1:], strict=False):
                p[x, y] += w
        want[at : at + n] = own / total
        want_pairs += p / total
        want_first += f / total
        at += n
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs) and np.allclose(first, want_first)
    assert np.allclose(model.posteriors(scores, lengths)[0], want)


def test_even_bits():
    """Bits that say the same are not both chosen."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    one = fps & np.uint64(1)
    for b in range(1, 40):  # bits 0 .. 39 are one bit
        fps = fps & ~(np.uint64(1) << np.uint64(b)) | one << np.uint64(b)
    order = simhash._even_bits(fps, 5)
    assert sorted(order) == list(range(64)) and sum(b < 40 for b in order[:5]) <= 1
