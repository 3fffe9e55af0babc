"""Token counts and BPE encoding against the tokenizers library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchframe.llm import bpe_codec, token_counts
from matchframe.llm.base import materialize, prepare

TEXTS = ["", " ", "a", "Hello  World's\n\n end ", "don't  <|endoftext|>x<|startoftext|> y", "é́ àÀß ÿ ¼ ²", "a b  c　　d", "x\x1cy \x85z", "日本語 テキスト 🙂🙂",
         "ΑΣ ς İI", "AKIA123456 1234567 12 a1b2", "!!??\n\n\n  ...", "w" * 5000, " " * 300 + "x", "\t\ta\r\nb", "‘quotes’ – dash", "ź̧ q"]


def rows(spark, df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def byte_tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_tok():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_and_cache(spark, byte_tok, tmp_path):
    prepare(spark)
    table = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (101, TEXTS[3]), (101, TEXTS[3]), (None, "x y")]
    docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "7 AS n_tokens", "'a' AS digest")
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(docs, cache).select("doc_id", "n_bytes", "n_tokens").collect()
    want = [(k, len((t or "").encode()), len(byte_tok.encode(t or "", add_special_tokens=False).ids)) for k, t in table]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in table})  # every distinct text once
    more = spark.createDataFrame([(1, TEXTS[3]), (2, "new text")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, cache).collect()} == {1: len(byte_tok.encode(TEXTS[3]).ids), 2: 2}
    assert spark.read.parquet(cache).count() == stored + 1  # only the miss was encoded
    assert token_counts.count_tokens(docs.limit(0), str(tmp_path / "none")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n  　\x85\x1c'sStT<|>aé1²!.,İſ́"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(byte_tok, word_tok, text):
    assert token_counts.count_text(byte_tok, {}, text) == len(byte_tok.encode(text, add_special_tokens=False).ids)
    codec = bpe_codec.load(bpe_codec.default_tokenizer())
    found = word_tok.encode(text, add_special_tokens=False).ids
    ids, decoded = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == found
    assert decoded.decode() == word_tok.decode(found, skip_special_tokens=False) == codec.decode(ids)


def test_forced_boundaries_cut_words():
    codec = bpe_codec.load(bpe_codec.default_tokenizer())
    assert not codec.pairs[ord(" ")].any()
    cut = [w for w in ("zqxj", "qzqz", "wvkq", "xqjz") if len(codec.cuts(w)) > 1]
    assert cut  # some pairs occur in no token


def test_codec_query_forms(spark, word_tok):
    prepare(spark)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(50, None), (50, None)], "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = sorted(map(tuple, bpe_codec.encode_digests(docs).collect()))
    want = []
    for k, t in [*enumerate(TEXTS), (50, ""), (50, "")]:
        ids = word_tok.encode(t, add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(word_tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    full = {r.doc_id: r for r in bpe_codec.encode_documents(docs).collect()}
    assert full[3].ids == word_tok.encode(TEXTS[3]).ids and full[50].ids == [] and full[50].decoded == ""
    assert bpe_codec.encode_digests(docs.limit(0)).count() == 0
    assert materialize(bpe_codec.encode_documents(docs)).count() == len(TEXTS) + 2


def test_worker_keeps_the_tables_of_one_operator():
    from matchframe.llm.base import held
    first = held("a", dict)
    assert held("a", dict) is first
    held("b", list)
    assert held("a", dict) is not first
