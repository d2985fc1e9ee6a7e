"""Language identification: subwords against brute force, held-out accuracy, rejection, edge rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from playtrail.llm import langid

FOLDER = "/root/testdata/sf0.01"


def slow_subwords(text):
    found = Counter()
    padded = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    for size in langid.SIZES:
        for i in range(len(padded) - size + 1):
            piece = padded[i:i + size]
            if "\0" in piece[1:-1] or piece.strip("\0") == "":
                continue
            h = ord(piece[0])
            for c in piece[1:]:
                h = (h * 0x01000193 + ord(c)) % 2 ** 32
            found[((h + size) * 0x9E3779B1) % 2 ** 32 >> 32 - langid.BUCKET_BITS] += 1
    return found


def test_subwords_equal_brute_force(monkeypatch):
    texts = ["", "a", "ab", "The cat, le chat!", "é\n\nß 12 日本語", "x" * 50, "one two three four five " * 9]
    for block in (1 << 16, 7, 16, 33):
        monkeypatch.setattr(langid, "BLOCK", block)
        for text in texts:
            got = Counter(b for part in langid.subwords(text) for b in part.tolist())
            assert got == slow_subwords(text), (block, text)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = langid.identify(docs, langid.fit(docs)).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.02
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_fit_learns_nothing_of_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.fit(wrong)["languages"] == ["de", "en", "es", "fr"]


def test_foreign_text_scores_lower(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    assert langid.predict_text(model, "Жили были дед и баба")[1] < langid.predict_text(model, "the and of that")[1]


def test_edge_rows(spark):
    schema = "doc_id bigint, text string, lang string, score string, rejected string"
    given = [(i, "the cat and the dog", "en", "s", "r") for i in range(12)]
    given += [(i + 20, "le chat et le chien", "fr", "s", "r") for i in range(12)]
    odd = [(50, None, "en", "s", "r"), (51, "", "en", "s", "r"), (52, "12 !!", "fr", "s", "r"), (None, "le chat", None, "s", "r"),
           (53, "the " * 100_000, None, "s", "r"), (53, "the " * 100_000, None, "s", "r")]
    df = spark.createDataFrame([*given, *odd], schema)
    model = langid.fit(df)
    rows = langid.identify(df, model).collect()
    assert len(rows) == 30
    by_text = {r["text"]: (r["lang_pred"], r["rejected"]) for r in rows}
    assert by_text[None] == by_text[""] == by_text["12 !!"] == ("und", True)
    assert by_text["the cat and the dog"] == ("en", False) and by_text["le chat"][0] == "fr"
    assert by_text["the " * 100_000][0] == "en"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 27
    dotted = langid.keep_identified(df.withColumnRenamed("score", "a.score"))
    assert dotted.columns == ["doc_id", "text", "lang", "a.score", "rejected"] and dotted.count() == 27


def test_without_labels_all_is_unknown(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert langid.fit(df) is None
    assert langid.identify(df, None).first()["lang_pred"] == "und"
    assert langid.keep_identified(df.where("false")).count() == 0
