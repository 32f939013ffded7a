"""Token counts against the tokenizer library."""

import random

import pytest
from tokenizers import Tokenizer

from plumbline.llm.token_counts import VOCABULARY, PrefixCounter, _kept, token_counts, vocabulary_file

PIECES = ["a", "b", "the", " ", "  ", "\n", "'", "re", "ll", "s", "é", "日", "😀", "<|endoftext|>", "<|", "1", "23", "!", "...", "\t", "ing", "Ġ", " ", "͸", "ß", "\x1c", "\x85", "'s", "'VE", "ﷺ", " "]


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(vocabulary_file())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_counts(counter, library):
    for s in [*texts(1500, 1), "", "x" * 3000, " " * 300, "ab" * 700, "=" * 500]:
        assert counter.count(s) == library(s), repr(s)


def test_prefixes(counter, library):
    for s in texts(200, 2):
        counts = counter.prefixes(s).tolist()
        assert counts == [library(s[:k]) for k in range(1, len(s) + 1)], repr(s)
        for budget in (1, 4, 9):
            most = max((k for k in range(1, len(s) + 1) if counts[k - 1] <= budget), default=0)
            assert counter.longest_within(s, budget) == most
            if counter.count(s) > budget:
                assert _kept(counter, s, budget) == most, repr(s)


def test_classes_below_the_bound(counter, library):
    for c in range(0x250):
        s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}b"
        assert counter.count(s) == library(s), hex(c)


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "é" * 2000), (1, "Hello world")], "doc_id long, text string")
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, with_prefixes=True).collect()}
    assert {(1, 11, 2, False), (2, 0, 0, False)} <= rows and len(rows) == 3
    assert token_counts(df.limit(0)).count() == 0


def test_operator_against_the_library(spark, library):
    rows = [(n, t, "clash", 5) for n, t in enumerate([*texts(60, 7), None, "", " " * 900, "word " * 700, "<|endoftext|> " * 90, "日本語" * 400])] + [(3, "again", "x", 1), (None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = {(r.doc_id, r.n_bytes): r for r in token_counts(df, limit=20).collect()}
    for i, t, *_ in rows:
        t = t or ""
        r = got[i, len(t.encode())]
        n = library(t)
        assert (r.n_tokens, r.over_limit) == (n, n > 20)
        if n <= 20:
            assert r.kept_chars == len(t)
        elif len(t) < 300:
            assert r.kept_chars == max((k for k in range(1, len(t) + 1) if library(t[:k]) <= 20), default=0), repr(t)
