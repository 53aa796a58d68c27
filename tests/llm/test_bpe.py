from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import AWKWARD, awkward, empty, rows

from tesserae.llm import bpe, token_counts

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH)


def ids(own, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in own.encode_all([t.encode() for t in texts])]


def test_strings_of_all_kinds(own, library):
    rng = random.Random(5)
    parts = ["a", "b", "the", "ing", "é", "é", "İ", "Σ", "ς", " ", "\n", "\xa0", " ", "\x1c", "\x85", "'s", "'LL", "1", "½", "<|endoftext|>", "<|startoftext|>", "<|", "👍", "ß", "ǅ", "中", "힣", "!!!", "</w>", "K", "ﬁ", "\x00", "​", "º", "Ʋ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 24))) for _ in range(6000)]
    texts += ["a" * 3000, "ab" * 2500, "", " ", "x" * 193, "héé" * 100]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = ids(own, texts)
    assert got == expected
    assert [own.decode(np.array(g, "<u4").tobytes()).decode() for g in got] == [library.decode(g, skip_special_tokens=False) for g in got]


def test_scalar_program_agrees(own, library):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 30))) for _ in range(800)]
    assert [own.word(w) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_any_text(texts):
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(bpe.encoder(PATH), texts) == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_memo_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    assert ids(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_suffix_automaton_knows_all_substrings():
    auto = bpe.SuffixAutomaton()
    strings = ["abcbc", "bcab", "cab", "aaa"]
    for s in strings:
        auto.add(s)

    def has(s):
        state = 0
        for c in s:
            state = auto.go[state].get(c, -1)
            if state < 0:
                return False
        return True

    every = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert all(map(has, every))
    assert not any(has(a + b + c) for a in "abc" for b in "abc" for c in "abc" if a + b + c not in every)


def test_round_trip_of_documents(spark, library):
    got = sorted(rows(bpe.round_trip(awkward(spark))), key=repr)
    want = []
    for d, t, *_ in AWKWARD:
        i = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert rows(bpe.round_trip(empty(spark))) == []


def test_real_outputs(spark, library):
    made = {r.doc_id: r.ids for r in bpe.encode(awkward(spark)).collect()}
    assert made[6] == library.encode("one two", add_special_tokens=False).ids and made[3] == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(awkward(spark))).collect()}
    assert back[6] == library.decode(made[6], skip_special_tokens=False) and back[4] == ""


def test_token_counts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    size = sorted(len(e.ids) for e in library.encode_batch([r.text or "" for r in docs.collect()], add_special_tokens=False))
    counts = token_counts.histogram(docs)
    got = {r.n_tokens: r for r in token_counts.suffix_sums(counts).collect()}
    assert set(got) == set(size)
    for n, r in got.items():
        at_least = [s for s in size if s >= n]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_over) == (size.count(n), len(at_least), sum(at_least), sum(s > n for s in size))
        assert r.truncated_total == sum(min(s, n) for s in size) and r.share_up_to == pytest.approx(sum(s <= n for s in size) / len(size))
    assert token_counts.truncated_total(counts, 100) == sum(min(s, 100) for s in size)
    assert token_counts.quantile(counts, 0.5) == size[(len(size) + 1) // 2 - 1]


def test_token_counts_of_awkward_and_no_rows(spark):
    got = token_counts.suffix_sums(token_counts.histogram(awkward(spark)))
    assert sum(r.n_docs for r in got.collect()) == len(AWKWARD)
    none = token_counts.histogram(empty(spark))
    assert rows(token_counts.suffix_sums(none)) == [] and token_counts.truncated_total(none, 5) == 0 and token_counts.quantile(none, 0.5) is None
