"""Alignment of two tokenizers against a slow version that works on whole texts."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from playtrail.llm import alignment
from playtrail.llm.queries import QUERIES
from playtrail.llm.shared import table

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(Path(A_FILE).read_text(encoding="utf-8"), Path(B_FILE).read_bytes())


def slow_groups(pair, text):
    """The groups of one whole text, by sets of ends."""
    if not text:
        return []
    content = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    if any(b"".join(names[i] for i in ids) != content for names, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
        return []

    def ends(ids, names):
        return np.cumsum([len(names[i]) for i in ids]).tolist()

    a_ends, b_ends = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    both = sorted(set(a_ends) & set(b_ends))
    return [([t for t, e in zip(a, a_ends) if low < e <= high], [t for t, e in zip(b, b_ends) if low < e <= high])
            for low, high in zip([0, *both], both)]


def slow(pair, texts):
    """What ``align`` returns for each text."""
    groups = [slow_groups(pair, t) for t in texts]
    links = [Counter((x, y) for a, b in found for x in a for y in b) for found in groups]
    counts = Counter(p for found in links for p in found)
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [(sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), sum(linked.values()),
             sum(n for p, n in linked.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in linked.items()),
             ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found))
            for found, linked in zip(groups, links)]


ODD = [None, "", " ", "\n", "  ", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a \n b", "a\tb  c d", "x y z", "one,two. three's won't",
       "▁ a▁b", "\u0000 a\u0000b c", "naïve ﬁ Å ﷺ ǆ", "日本語 の テキスト", "🙂🙃 👩‍👩‍👧 flag 🇩🇪", "<|endoftext|> <s> </s> <unk> <0x0A>", "12 345 6789",
       "a  b c\nd e \n\n f", "\r\nx\ry", "same text twice", "same text twice", "ab " * 300, "z" * 3000, "​‍ x", "é e ́x"]


def check(spark, pair, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, A_FILE, B_FILE, **options).collect()}
    wanted = slow(pair, texts)
    assert len(found) == len(texts)
    for i, want in enumerate(wanted):
        assert found[i] == want, texts[i]


def test_odd_texts_equal_the_slow_version(spark, pair):
    assert pair.local
    check(spark, pair, ODD)


def test_blocks_of_any_size_give_the_same(spark, pair, monkeypatch):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(120).collect()
    texts = [r["text"] for r in rows] + ODD
    monkeypatch.setattr(alignment, "GROUP_DOCS", 7)
    monkeypatch.setattr(alignment, "COUNTED_TOGETHER", 50)
    check(spark, pair, texts, block_chars=2000)


def test_pieces_join_and_whole_tokens(pair):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice([" ", " ", "\n", "a", "the", ",", ".", "'s", "é", "日", "9", "\t", "▁", "<s>", "🙂", "  "])
                       for _ in range(rng.randrange(1, 40)))
        pieces = pair.pieces(text)
        assert "".join(pieces) == " " + text and all(pieces)
        whole = pair.a.encode(" " + text, add_special_tokens=False).ids
        assert [t for p in pieces for t in pair.a.encode(p, add_special_tokens=False).ids] == whole
        # B reads this mark as a space, so its bytes differ from the text's whatever the cuts.
        if "▁" not in text:
            assert [t for ids in pair._b_ids(pieces) for t in ids] == pair.b.encode(text)


def test_galloping():
    rng = np.random.default_rng(3)
    for _ in range(200):
        target = np.unique(rng.integers(0, 200, rng.integers(0, 60)))
        low = rng.integers(0, len(target) + 1, 30)
        high = np.array([rng.integers(x, len(target) + 1) for x in low])
        values = rng.integers(-5, 210, 30)
        want = [x + np.searchsorted(target[x:y], v) for x, y, v in zip(low, high, values)]
        assert alignment.gallop(values, low, high, target).tolist() == want


def test_common_ends_of_many_lists():
    rng = np.random.default_rng(4)
    lists = [[np.unique(rng.integers(1, 30, rng.integers(0, 25))) for _ in range(2)] for _ in range(300)]
    a, b = ([x[k] for x in lists] for k in range(2))
    base = np.arange(len(lists)) * 100

    def joined(of):
        return np.concatenate([x + o for x, o in zip(of, base)]), np.concatenate([[0], np.cumsum([len(x) for x in of])])

    (all_a, a_starts), (all_b, b_starts) = joined(a), joined(b)
    in_a, in_b = alignment.common_ends(all_a, all_b, a_starts, b_starts)
    assert in_a.tolist() == np.isin(all_a, all_b).tolist() and in_b.tolist() == np.isin(all_b, all_a).tolist()


def test_long_texts(pair):
    began = time.time()
    arranged, found = pair.align(["q" * 200_000, " a\t" * 100_000])
    assert len(arranged) == 2 and found.n_links.min() > 0 and found.good.all() and time.time() - began < 30


def test_empty_table_and_other_columns(spark, pair):
    docs = spark.createDataFrame([(None, "x y", 1, "s"), (3, None, 2, "s"), (3, "x", 2, "s")],
                                 "doc_id bigint, text string, block int, pieces string")
    assert sorted((r["doc_id"] or -1, r["n_a"]) for r in alignment.align(docs, A_FILE, B_FILE).collect()) == [(-1, 2), (3, 0), (3, 1)]
    assert alignment.align(docs.where("false"), A_FILE, B_FILE).count() == 0


def test_query_equals_the_slow_version(spark, pair):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in QUERIES["op11_tokenizer_alignment"](spark, folder).collect()}
    wanted = slow(pair, [d["text"] for d in docs])
    assert len(found) == len(docs)
    for doc, want in zip(docs, wanted):
        row = found[doc["doc_id"]]
        assert tuple(row)[1:7] == want[:6]
        assert row["groups_sha256"] == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
