"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from playtrail.llm import bpe, pieces

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "  a  b\t\n\n c ", "a" * 3000, "naïve café 𝒳  x\r\n", "x\n y", "'s it's DON'T", " lead", "trail ", "\n", "ab\0c",
       "日本語テキスト" * 50, "12345 67", "one, two.. three.,", "end. Next,\nline! ?", "., .", "q" * 70 + " " + "abcabc" * 40]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def duck():
    return bpe.DuckBpe(bpe.read_ranks(open(FILE, "rb").read()), public_tokenizers.PATTERN)


def same(duck, library, texts):
    coded = duck.encode(texts)
    for text, ids in zip(texts, coded):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
    assert duck.decode(coded) == [t.encode() for t in texts]


def test_odd_texts(duck, library):
    same(duck, library, ODD)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_any_text(duck, library, texts):
    same(duck, library, texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", " ", "\n", ".", ",", "!", "'", "s", "7", "_", "\t"]), max_size=20).map("".join))
def test_white_space_and_marks(duck, library, text):
    same(duck, library, [text])


def test_long_words_of_few_letters(duck, library):
    rng = random.Random(2)
    same(duck, library, ["".join(rng.choices("ab", k=n)) for n in (63, 64, 65, 500, 2000)] + ["the" * 700])


def test_memory_of_pieces_is_bounded_and_changes_nothing(duck, library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHARS", 20)
    monkeypatch.setattr(bpe, "STRETCH", 3)
    monkeypatch.setattr(bpe, "BLOCK_ROWS", 10)
    for _ in range(2):
        same(duck, library, ["some words of a text", *ODD[:6], "more of other words"])


def test_no_such_token(duck):
    with pytest.raises(ValueError):
        duck.decode([np.array([60000], "<u4").tobytes()])


def test_rows_of_a_table(spark, library):
    rows = [(i, t, "old", 1.5) for i, t in enumerate([*ODD, None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, Decoded double").repartition(4)
    out = bpe.encode_decode(df, FILE, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode_decode(df.where("false"), FILE, public_tokenizers.PATTERN).count() == 0
