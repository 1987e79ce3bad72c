import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.functions.heuristic import heuristic_tokens
from loomspark.llm import bpe, encode, lexicon, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
SIGNS = "aAbe 1.\n\t\x1c\x85\xa0　é漢😀\x00́'st"
ODD = ["", None, " ", "a", "<|endoftext|>", "don't  stop\n\n x", "漢字かな", "😀" * 40, "a" * 5000, "x y " * 3000, "x y " * 3000, "(){}[];:", "\x1c!\x1d!"]


@pytest.fixture(scope="module")
def public():
    import tiktoken

    v = bpe.vocabulary("byte_bpe_50k")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(alphabet=SIGNS, max_size=150), st.text(max_size=80)))
def test_counts_and_merges_equal_the_public_tokenizer(public, text):
    v = bpe.vocabulary("byte_bpe_50k")
    text = text.encode("utf-8", "ignore").decode()
    want = public.encode_ordinary(text)
    assert [i for c in bpe.coarse(text) for w in bpe.fine(c) for i in v.merge(w.encode())] == want
    assert bpe.local("test", v, lambda x: bpe.ChunkCounts(bpe.CountingAutomaton(x))).of(text) == len(want)


def test_coarse_cuts_are_pattern_cuts():
    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(SIGNS) for _ in range(60))
        assert [w for c in bpe.coarse(t) for w in bpe.fine(c)] == bpe.fine(t)


def test_corpus_ids_round_trip(spark, public):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    for words in (3, 50_000):
        got = {r.doc_id: r.ids for r in encode.encode_corpus(df, words=words).collect()}
        assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(ODD)}
        assert all(public.decode(got[i]) == t for i, t in enumerate(ODD) if t)
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_lexicon(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(0, 6))): [rng.randint(0, 9) for _ in range(rng.randint(1, 4))] for _ in range(400)}
    (tmp_path / "x").write_bytes(lexicon.compile_lexicon(words.items()))
    lex = lexicon.Lexicon(str(tmp_path / "x"))
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert all(lex.get(w + b"q") is None and (w[:-1] in words or lex.get(w[:-1]) is None) for w in words)
    (tmp_path / "e").write_bytes(lexicon.compile_lexicon([]))
    assert lexicon.Lexicon(str(tmp_path / "e")).get(b"a") is None


def test_models_in_one_pass(spark, public):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, tokens int")
    rows = tokens.token_counts(df, ["heuristic", "byte_bpe_50k", "byte_bpe_multi_50k"]).withColumn("native", heuristic_tokens(df.text)).collect()
    assert all(r.tokens.heuristic == r.native for r in rows)
    assert all(r.tokens.byte_bpe_50k == (len(public.encode_ordinary(r.text)) if r.text else 0) for r in rows)


def test_cube_and_budgets(spark):
    docs = spark.createDataFrame(
        [(" Docs", "EN_us", None, "abcd" * 4), ("docs", "en-GB", " ", "abcd"), ("docs", None, "x", None), (None, "", "x", "漢字漢"), ("docs", "_x", "x", "a")],
        "source string, lang string, domain string, text string",
    )
    cube = tokens.token_cube(docs, ["heuristic"])
    got = {(r.source, r.lang, r.domain): (r.documents, r.tokens) for r in cube.filter("level = 0").collect()}
    assert got == {("docs", "en", "none"): (2, 5), ("docs", "none", "x"): (2, 1), ("none", "none", "x"): (1, 2)}
    assert cube.filter("level = 7").select("documents", "tokens").collect() == [(5, 8)]
    budgets = spark.createDataFrame([(1, "docs", "en", "none", "heuristic", 4), (2, "docs", "en", "none", "heuristic", 5), (3, "none", "none", "x", "HEURISTIC", 1), (4, "gone", "en", "x", "heuristic", 0), (5, "docs", "none", "x", None, None)], "budget_id long, source string, lang string, domain string, token_model string, max_tokens long")
    assert sorted(r.budget_id for r in tokens.over_budget(cube, budgets).collect()) == [1, 3]
    assert tokens.token_cube(docs.limit(0), ["heuristic"]).count() == 0
