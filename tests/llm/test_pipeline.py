"""The corpus pipeline: each stage against brute force on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from spanweave.llm.common import materialise
from tests.llm import brute
from tests.llm.test_shingles import kept


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage, as lists of rows."""
    docs = materialise(spark.createDataFrame(brute.rows(), brute.COLUMNS), "docs")
    out = {}
    for name, f in cp.STAGES:
        made = materialise(f(spark, docs, "unused"), name)
        if name != "bpe_tokens":
            assert made.columns == docs.columns
        out[name] = (docs.collect(), made.collect())
        docs = made
    return out


def test_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mix_sources", "bpe_tokens"]


def test_language(stages):
    before, after = stages["language_id"]
    kept = {r.doc_id for r in after}
    assert not kept & {900001, 900002, 900003, 900004}  # no letters
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))
    assert sum(r.doc_id in kept for r in before if r.doc_id is not None and r.doc_id < 900000) >= 195


def test_near_duplicates(stages):
    """One of each group by the five-word Jaccard of all pairs: the stage has no
    contract of op5's, so it takes five words and a similarity of 0.8."""
    before, after = stages["near_duplicates"]
    want = kept([(r.doc_id, r.text) for r in before])
    assert Counter(((r.doc_id is None, r.doc_id or 0), r.text) for r in after) == want


def test_substrings(stages):
    before, after = stages["substring_dedup"]
    want = Counter()
    for d, _, _, kept in brute.spans([(r.doc_id, r.text) for r in before]):
        if kept != brute.sha(""):
            want[(d, kept)] += 1
    assert Counter((r.doc_id, brute.sha(" ".join(brute.words(r.text)))) for r in after) == want
    assert any(r.text != dict((b.doc_id, b.text) for b in before)[r.doc_id] for r in after)


def test_mix(stages):
    before, after = stages["mix_sources"]
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len(brute.words(r.text))
        sizes[r.source] += n
        biggest[r.source] = max(biggest[r.source], n)
    for r in after:
        taken[r.source] += len(brute.words(r.text))
    for s, t in brute.targets(sizes).items():
        assert abs(taken[s] - t) <= biggest[s]
    assert set(map(tuple, after)) <= set(map(tuple, before))
    assert max(Counter(map(tuple, after)).values()) <= 2


def test_mix_copies_of_equal_rows(spark):
    rows = [(None, "w " * 50, "en", "s1", 1, {"a": i % 2}) for i in range(2600)] + [(i, "w " * 50, "en", "s1", 1, None) for i in range(100)] + [(1, "", "en", "s1", 0, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more map<string,int>")
    from spanweave.llm import mixing

    got = Counter((r.doc_id, r.text, None if r.more is None else r.more["a"]) for r in mixing.mixed_documents(docs).collect())
    assert abs(sum(n * len(k[1].split()) for k, n in got.items()) - 1.5 * 2700 * 50) <= 50
    assert got[(1, "", None)] == 3 and {k[2] for k in got} == {0, 1, None}
    assert max(n for k, n in got.items() if k[0] is not None and k[1]) <= 2


def test_tokens(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["bpe_tokens"]
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids)) for r in before)


def test_empty(spark):
    docs = spark.createDataFrame([], brute.COLUMNS)
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, "unused")
    assert docs.count() == 0


def test_clashing_columns(spark):
    extra = ["_lang_pred", "_score", "_text_key", "_t1", "_n_kept", "_m_copies", "_k_doc", "key", "least"]
    rows = [(i, "these are some plain words of text number %d in a row here" % (i * 7919), "en", "s", 1, *["x"] * len(extra)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, "unused")
        assert docs.columns[5:] == extra
    assert all(tuple(r)[5:] == ("x",) * len(extra) for r in docs.collect())
