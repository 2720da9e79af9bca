"""Token counts and byte-level BPE against the tokenizer libraries."""

import hashlib
import sys

import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from movecheck.llm import byte_bpe, common, token_counts
from movecheck.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

ODD = [
    None, "", " ", "\n\n", "Hello  World's 123 ñandú!!! <|endoftext|>a<|startoftext|>b", "a\xa0b​c İstanbul ΑΣ Σ",
    "<|ENDOFTEXT|> '''s 'S it'll", "x\x00y\x85z w　v﻿q \x1c \x1f", "é é \U0001d54f 12½", "the " * 900, "a" * 3000,
]


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE_BPE), special_tokens={}
    )


@pytest.fixture(scope="module")
def mine():
    return byte_bpe.encoder(BYTE_BPE, public_tokenizers.PATTERN)


def test_counts_match_library(spark, sf_dir, word_bpe):
    found = QUERIES["op3_token_counts"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    for doc, text in zip(docs.doc_id, docs.text):
        n = len(word_bpe.encode(text or "", add_special_tokens=False).ids)
        assert found.loc[doc].tolist() == [len((text or "").encode()), n, n > 2048]


@pytest.mark.parametrize("block", [3, 60_000])
def test_counts_of_odd_rows(spark, word_bpe, monkeypatch, block):
    rows = [(i % 4 or None, t, "x") for i, t in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    monkeypatch.setattr(token_counts, "BLOCK_ROWS", block)
    found = token_counts.token_counts(df.repartition(3, "text"), WORD_BPE).collect()
    wanted = [(i, len((t or "").encode()), len(word_bpe.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)
    assert token_counts.token_counts(df.limit(0), WORD_BPE).count() == 0


def test_blocks_deal_every_posting_once():
    block = token_counts.Block()
    assert list(block.dealt(7, 0, 4)) == []
    wanted = {}
    for row in range(300):
        words = [f"w{row % 7}", "everywhere"] + ["often"] * (row == 5)
        counts = [row + 1, 1, 1000][: len(words)]
        block.add(row, [block.codes[w] for w in words], counts)
        for word, n in zip(words, counts):
            wanted[word, row] = n
    found, seen = {}, set()
    for bucket, keys, lengths, packed in block.dealt(7, 300, 4):
        assert bucket not in seen and lengths.sum() == len(packed)
        seen.add(bucket)
        lists = iter(packed.tolist())
        for key, length in zip(keys, lengths.tolist()):
            for _ in range(length):
                row, n = next(lists)
                found[key, row] = found.get((key, row), 0) + n
    assert found == wanted
    # What stands in many texts goes elsewhere for another block, the rest to the same place.
    place = lambda name: {k: b for b, keys, *_ in block.dealt(name, 300, 4) for k in keys}
    assert place(7)["everywhere"] != place(8)["everywhere"] and place(7)["often"] == place(8)["often"]


def test_encoding_matches_library(spark, sf_dir, reference):
    found = QUERIES["op8_byte_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    for doc, text in zip(docs.doc_id, docs.text):
        ids = reference.encode_ordinary(text or "")
        wanted = [len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()]
        assert found.loc[doc].tolist() == wanted


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_encodes_as_the_library(reference, mine, text):
    ids = mine.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert mine.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(" aeinorst'\n", max_size=80))
def test_common_letters_encode_as_the_library(reference, mine, text):
    assert mine.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text("abéй09½²Ⅷ_'.,!`~#\xa0 \n", max_size=60))
def test_signs_after_words_encode_as_the_library(reference, mine, text):
    assert mine.encode(text) == reference.encode_ordinary(text)


def test_words_and_signs_are_what_the_pattern_means():
    every = "".join(map(chr, range(0x500)))
    assert regex.sub(r"[\p{L}\p{N}]", "", "".join(regex.findall(f"[{byte_bpe.WORD}]", every))) == ""
    assert regex.findall(r"[\s\p{L}\p{N}']", "".join(regex.findall(f"[{byte_bpe.SIGNS}]", every))) == []


def test_known_words_cost_no_call_each(reference):
    bpe = byte_bpe.Encoder(byte_bpe.load_ranks(BYTE_BPE), public_tokenizers.PATTERN)
    bpe.encode("unheardword otherword, thirdwordly.")
    text = " otherword unheardword, thirdwordly." * 100
    bpe.encode(text)
    calls = []
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        ids = bpe.encode(text)
    finally:
        sys.setprofile(None)
    assert ids == reference.encode_ordinary(text) and len(calls) < 10
    # A word is known whichever sign follows it.
    for n, sign in enumerate("!?;:"):
        known = len(bpe.chunks)
        bpe.encode(f" otherword{sign} unheardword{sign} thirdwordly{sign}")
        assert len(bpe.chunks) == known + 1, n


def test_encoded_keeps_columns(spark, reference):
    rows = [(i, t, "z") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "id bigint, text string, ids string")
    out = byte_bpe.encoded(df, BYTE_BPE, public_tokenizers.PATTERN)
    assert out.columns == ["id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.id: r.ids for r in out.collect()} == {i: reference.encode_ordinary(t or "") for i, t, _ in rows}
    assert byte_bpe.encoded(df.limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_copies_that_lie_together(spark, reference):
    texts = ["one two", "one two", None, "", None, "a b", "one two", "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for row in byte_bpe.encoded(df, BYTE_BPE, public_tokenizers.PATTERN).collect():
        assert row.ids == reference.encode_ordinary(texts[row.doc_id] or "") and row.n_tokens == len(row.ids)
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


def test_a_text_without_tokens_is_an_error():
    ranks = {bytes([b]): b for b in range(256) if b != ord("z")}
    lacking = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, 10)
    assert lacking.encode("ab") == [97, 98]
    with pytest.raises(ValueError, match="no tokens cover"):
        lacking.encode("az")


def test_memo_stays_bounded():
    memo = byte_bpe.Memo(10)
    for i in range(1000):
        memo.keep(i, i)
        assert len(memo) + len(memo.old) <= 20
    assert memo.recall(999) == 999 and memo.recall(0) is None


def test_a_worker_keeps_the_latest_table_alone():
    made = []
    build = lambda name: lambda: made.append(name) or [name]
    first = common.resident("a", build("a"))
    assert common.resident("a", build("a")) is first and made == ["a"]
    common.resident("b", build("b"))
    assert common.resident("a", build("a")) == ["a"] and made == ["a", "b", "a"]
    common.vacate()
    assert common.resident("a", build("a")) == ["a"] and made == ["a", "b", "a", "a"]
    common.vacate()
