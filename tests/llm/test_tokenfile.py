"""Token files: exact round trip, order and starts, lookups, refusal of a wrong dictionary."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playtrail.llm import tokenfile
from playtrail.session import scratch_path

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(3, "a b, c."), (1, None), (None, "x"), (3, "a b, c."), (2, ""), (3, "zz  \t\n"), (9, "wort " * 30_000), (-4, "É é <|endoftext|> 日本"),
         *[(100 + i, f"document number {i} of many, and so on.\nA line") for i in range(300)]]


def library(text):
    tok = Tokenizer.from_file(FILE)
    tok.encode_special_tokens = True
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def written(spark, rows, monkeypatch=None, block=None):
    if block:
        monkeypatch.setattr(tokenfile, "BLOCK_BYTES", block)
    path = scratch_path(spark, "tokens")
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, id string, n_tokens int")
    tokenfile.write_tokens(df.repartition(5), path, FILE, end_id=2)
    return path


@pytest.mark.parametrize("block", [200, 2_000_000])
def test_round_trip_in_order(spark, monkeypatch, block):
    path = written(spark, TEXTS, monkeypatch, block)
    rows = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    place, want = 0, {}
    for i, t in TEXTS:
        want.setdefault(i, []).append(library(t))
    for r in rows:
        got = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == place and r["n_tokens"] == len(got)
        want[r["doc_id"]].remove(got)
        place += len(got)
    assert not any(want.values())


def test_lookup_reads_only_what_is_asked(spark, monkeypatch):
    path = written(spark, TEXTS, monkeypatch, 200)
    rows = tokenfile.read_documents(spark, path, [3, 250, 5000]).collect()
    assert sorted(r["doc_id"] for r in rows) == [3, 3, 3, 250]
    assert np.frombuffer(bytes(rows[-1]["ids"]), "<u4").tolist() in [library(t) for _, t in TEXTS]
    plan = tokenfile.read_documents(spark, path, [250])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "first_id" in plan


def test_wrong_dictionary_is_refused(spark):
    path, other = written(spark, TEXTS[:4]), written(spark, TEXTS[8:])
    mixed = scratch_path(spark, "mixed")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{mixed}/blocks")
    spark.read.parquet(f"{other}/dictionary").write.parquet(f"{mixed}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        tokenfile.read_tokens(spark, mixed).collect()


def test_empty_table(spark):
    path = written(spark, [])
    assert tokenfile.read_tokens(spark, path).count() == 0
    assert tokenfile.read_documents(spark, path, [1]).count() == 0


def test_dictionary_of_few_samples():
    assert tokenfile.train_dictionary([]) == b""
    assert tokenfile.train_dictionary([b"ab", b""]) == b"ab"


def test_remembered_pieces_change_nothing(monkeypatch):
    """Texts that begin with a mark, a space or a line feed, and generations of a few pieces."""
    monkeypatch.setattr(tokenfile, "KEPT_PIECES", 5)
    monkeypatch.setattr(tokenfile, "PIECES_TOGETHER", 3)
    encoder = tokenfile.Encoder(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    texts = ["\nab cd", ".x, y", " a b", "the cat, the dog.", None, "", "\n", "é ü, ß'll it's 12 345", "a\tb  c", "q" * 300 + " r", "the cat again"] * 3
    for start in range(0, len(texts), 4):
        some = texts[start:start + 4]
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.code(some)] == want
