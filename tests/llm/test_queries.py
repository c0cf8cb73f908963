"""The queries against brute force, over sf0.001 with edge rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from spanweave.llm import queries as q
from tests.llm import brute


def table(rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in brute.COLUMNS.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


@pytest.fixture(scope="module")
def rows():
    return brute.rows()


@pytest.fixture(scope="module")
def at(rows, tmp_path_factory):
    return brute.temporary(tmp_path_factory.mktemp("edge"), "documents", table(rows))


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    brute.temporary(folder, "documents", table([]))
    return brute.temporary(folder, "embeddings", pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_table(spark, nothing, name):
    assert q.queries()[name](spark, nothing).collect() == []


def test_media(spark, at, rows):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in q.op2_media_png(spark, at).collect())
    assert got == Counter((r[0], *brute.media(r[1])) for r in rows)


def test_equal_texts_have_equal_media(spark, at, rows):
    by = defaultdict(set)
    for r in q.op2_media_png(spark, at).collect():
        by[r.payload_sha256].add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in by.values())


def test_simhash(spark, tmp_path, rows):
    seen, some = set(), []
    for r in rows:  # distinct ids here; repeated and null ids have a test of their own
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            some.append(r)
    at = brute.temporary(tmp_path, "documents", table(some))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op5_simhash_groups(spark, at).collect()}
    assert got == brute.simhash([r[:2] for r in some])


def test_simhash_repeated_and_null_ids(spark, tmp_path):
    some = [(7, "same text here now"), (7, "same text here now"), (None, "same text here now"), (None, "lonely words without company"), (3, None), (9, "")]
    at = brute.temporary(tmp_path, "documents", table([(*r, "en", "s", 0, 0.0, "", "", "", 0) for r in some]))
    got = Counter((r.doc_id, r.component_id) for r in q.op5_simhash_groups(spark, at).collect())
    assert got == Counter({(7, 7): 2, (None, 7): 1, (None, None): 1, (3, 3): 1, (9, 3): 1})


def test_bpe(spark, at, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op7_bpe_codec(spark, at).collect())
    assert got == want


def test_counts(spark, at, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in rows:
        n = len(sp.encode(r[1] or ""))
        want[(r[0], len((r[1] or "").encode()), n, n > 4096)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in q.op9_token_counts(spark, at).collect())
    assert got == want


def test_substrings(spark, at, rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in q.op10_substring_spans(spark, at).collect())
    assert got == Counter(brute.spans([r[:2] for r in rows]))


def test_mix(spark, at, rows):
    got = q.op8_pivotal_mix(spark, at).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    sizes, source_of = defaultdict(int), {}
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
        source_of[r[0]] = r[3]
    want = brute.targets(sizes)
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    again = q.op8_pivotal_mix(spark, at).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_equal_rows_and_null_ids(spark, tmp_path):
    """Rows that nothing tells apart are units of their own."""
    some = [(None if i % 6 else i, "w " * 100, "en", "s1") for i in range(3000)] + [(i, "w " * (i % 90), "en", "s2") for i in range(500)] + [(7, "w " * 40, "en", None)] * 2000
    at = brute.temporary(tmp_path, "documents", table([(*r, 0, 0.0, "", "", "", 0) for r in some]))
    got = q.op8_pivotal_mix(spark, at).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(r[1].split())) for r in some)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in some:
        sizes[r[3]] += len(r[1].split())
    want = brute.targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[by_size[r.source_size]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 100 for s in sizes)


def test_language(spark, at, rows):
    import zlib

    got = q.op4_crf_language(spark, at).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    text = {r[0]: r[1] for r in rows}
    right = total = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        none = not any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == none
        if r.held_out and r.doc_id < 900000 and not none:
            total += 1
            right += r.lang_pred == lang[r.doc_id]
    assert right >= 0.85 * total


def test_language_ignores_lang_and_source(spark, rows, tmp_path):
    """A held-out document's prediction does not depend on its lang, source or id."""
    import zlib

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    other = [(r[0], r[1], "xx", None, *r[4:]) if held(r[0]) else r for r in rows]
    a = brute.temporary(tmp_path / "a", "documents", table(rows))
    b = brute.temporary(tmp_path / "b", "documents", table(other))
    pred = lambda d: Counter((r.doc_id, r.lang_pred, r.score) for r in q.op4_crf_language(spark, d).collect())
    assert pred(a) == pred(b)


def vectors() -> list[tuple[int | None, list | None]]:
    import pyarrow.parquet as pq

    out = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    dims = len(out[0][1])
    out += [(100_000, None), (100_050, []), (100_100, [0.0] * dims), (100_150, [float("nan")] * dims), (100_200, [float("inf")] + [1.0] * (dims - 1)), (100_250, [None] * dims), (None, out[0][1]), (100_300, [1.0, 2.0])]
    return out + [(100_350 + i, out[1][1]) for i in range(9)]  # ties


def test_neighbours(spark, tmp_path):
    some = vectors()
    at = brute.temporary(tmp_path, "embeddings", pa.table({"vec_id": pa.array([v[0] for v in some], pa.int64()), "embedding": pa.array([v[1] for v in some], pa.list_(pa.float32())), "label": pa.array([1] * len(some), pa.int32())}))
    dims = len(some[0][1])
    kept = {i: list(map(float, np.array(v, np.float32))) for i, v in some if i is not None and v and None not in v and len(v) == dims}
    want = brute.neighbours(kept)
    got = defaultdict(list)
    for r in q.op6_projection_forest(spark, at).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for query, near in got.items():
        near.sort()
        assert [n for n, _, _ in near] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        exact = dict(want[query])
        hit += sum(i in exact or s >= min(exact.values()) - 1e-12 for _, i, s in near)
    assert hit >= 0.9 * 5 * len(want)


def test_few_vectors(spark, tmp_path):
    at = brute.temporary(tmp_path, "embeddings", pa.table({"vec_id": pa.array([0, 1, 2], pa.int64()), "embedding": pa.array([[1.0, 0.0], [1.0, 1.0], [0.0, 2.0]], pa.list_(pa.float32()))}))
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in q.op6_projection_forest(spark, at).collect())
    assert got == [(0, 1, 1, 0.707107), (0, 2, 2, 0.0)]


@pytest.mark.parametrize("width", [1, 2])
def test_training_order(spark, at, rows, width):
    """Slots, shards and contents against a plain version: the records of each
    text, numbered in the order of the scan, placed by the permutation."""
    from tokenizers import Tokenizer

    from spanweave.llm import shards

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = lambda: (q.op1_training_order(spark, at) if width == 1 else shards.training_order(q.documents(spark, at), q.BYTE_BPE)).collect()
    got = run()
    most = shards.ids_per_record(width)
    want = Counter()
    for r in rows:
        ids = list((r[1] or "").encode()) if width == 1 else t.encode(r[1] or "", add_special_tokens=False).ids
        for k in range(max(1, -(-len(ids) // most))):
            part = ids[k * most : (k + 1) * most]
            want[(r[0], k, len(part), brute.sha(b"".join(i.to_bytes(width, "little") for i in part)))] += 1
    assert Counter((r.doc_id, r.seq_no, r.n_ids, r.ids_sha256) for r in got) == want
    n, per_shard = len(got), shards.SHARD_BYTES // shards.STRIDE
    assert sorted(r.slot for r in got) == list(range(n))
    assert all((r.shard, r.byte_offset) == (r.slot // per_shard, r.slot % per_shard * shards.STRIDE) for r in got)
    # the numbers behind the slots: the records of a text are neighbours
    number = dict(zip(range(n), shards.unpermute(np.arange(n), n, 1).tolist(), strict=True))
    by_number = sorted((number[r.slot], r.doc_id, r.seq_no) for r in got)
    assert [x[0] for x in by_number] == list(range(n))
    assert all(b[1:] == (a[1], a[2] + 1) or b[2] == 0 for a, b in zip(by_number, by_number[1:], strict=False))
    assert [r.slot for r in sorted(got, key=lambda r: number[r.slot])] != list(range(n))  # another order than the input's
    assert Counter(map(tuple, got)) == Counter(map(tuple, run()))


def test_licenses(spark, at, rows):
    from spanweave.llm import licenses

    got = {}
    for r in q.op3_license_scan(spark, at).collect():
        got.setdefault(r.doc_id, r)
    # brute force: each unit of each text against each template
    import math

    vocabulary = set(licenses._vocabulary(licenses.TEMPLATES))
    df = Counter()
    for r in rows:
        df.update(vocabulary.intersection(licenses.tokens((r[1] or "").encode())))
    n = len(rows)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + n) + 1
    for r in rows:
        best = (0.0, 0, "")
        folded = (r[1] or "").encode().translate(licenses._FOLD)
        words = folded.split()
        units = [u.split() for u in folded.split(b"\n")] + [words]
        for texts in licenses.TEMPLATES.values():  # where a copy around the rarest word would lie
            for text in texts:
                own = licenses.tokens(text.encode())
                rare = max(own, key=lambda t: (idf(t), t))
                units += [words[max(0, p - own.index(rare)) : p - own.index(rare) + len(own)] for p, t in enumerate(words) if t == rare]
        for unit in units:
            a = {t: c * idf(t) for t, c in Counter(unit).items()}
            for name, texts in sorted(licenses.TEMPLATES.items()):
                for text in texts:
                    b = {t: c * idf(t) for t, c in Counter(licenses.tokens(text.encode())).items()}
                    dot = sum(x * b[t] for t, x in a.items() if t in b)
                    cos = round(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9) if dot else 0.0
                    if dot:
                        best = min(best, (cos, len(licenses.tokens(text.encode())), name), key=lambda x: (-x[0], -x[1], x[2]))
        own = best[2] if best[0] >= licenses.THRESHOLD else None
        assert got[r[0]].own_license == own, r
    assert any(r.own_license for r in got.values())


def test_license_units(spark):
    """Wrapped headers, licences inside paragraphs, whole bodies; shared parts."""
    from spanweave.llm import licenses

    t = licenses.TEMPLATES
    filler = " ".join(f"word{i}" for i in range(60))
    bsd3, mit0, gpl = t["BSD-3-Clause"][0], t["MIT-0"][0], t["GPL-3.0-or-later"][0]
    words = lambda x: "\n".join(" ".join(x.split()[i : i + 6]) for i in range(0, len(x.split()), 6))
    files = [(1, "a/1", f"{filler} {t['LGPL-3.0'][0]} {filler}"), (2, "a/2", words(bsd3) + "\n" + filler), (3, "a/3", t["MIT"][2]), (4, "a/4", mit0), (5, "a/5", gpl), (6, "a/6", t["BSD-2-Clause"][1]), (7, "a/7", filler)]
    got = {r.doc_id: r.own_license for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: "LGPL-3.0", 2: "BSD-3-Clause", 3: "MIT", 4: "MIT-0", 5: "GPL-3.0-or-later", 6: "BSD-2-Clause", 7: None}


def test_license_inheritance(spark):
    from spanweave.llm import licenses

    mit = licenses.TEMPLATES["MIT"][1]
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    files = [(1, "a/LICENSE", mit), (2, "a/b/c.py", "plain words only"), (3, "a/d/COPYING", gpl), (4, "a/d/e/f.py", "other plain words"), (5, "z/g.py", "nothing at all"), (6, None, "no path"), (7, "a/b/h.py", gpl)]
    got = {r.doc_id: (r.license, r.declared_in) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "a/LICENSE"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", "a/d/COPYING"), 5: (None, None), 6: (None, None), 7: ("GPL-3.0", None)}
