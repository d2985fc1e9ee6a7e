"""Secrets: patterns against plain regular expressions, links against brute force."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from playtrail.llm import credentials

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ID, KEY, LINK = "AKIAABCDEFGH12", "aB3dE5gH7jK9mN1pQ3", "https://x.example/y"


def slow_spans(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return credentials.in_order(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "SECRET", "tokenſ", "api_key", "apiKey", "=", ":", " ", '"', "abc", "AKIA", "A" * 15, "0a" * 6, "é", "K", "_"]), max_size=20).map("".join))
def test_patterns_equal_plain_regular_expressions(text):
    assert credentials.base_spans(text) == slow_spans(text)


def test_long_runs_take_linear_time():
    assert len(credentials.base_spans("0" * 200_000 + " token" + " " * 200_000 + "AKIA" + "B" * 200_000)) == 2


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id bigint, text string, base string, added int")
    out = credentials.find(df)
    assert out.columns == ["doc_id", "base", "added"]
    return sorted(((r["doc_id"] or -1), [s["kind"] for s in r["base"]], [(s["kind"], s["start"], s["stop"]) for s in r["added"]]) for r in out.collect())


def test_weak_candidates_need_a_complementary_part(spark):
    both = f"id {ID} and key {KEY}"
    rows = [(1, both), (2, ID), (3, KEY), (4, f"{ID}\n \n{KEY}"), (5, ID + " " + "x " * 120 + KEY), (6, f"{KEY} {LINK}"),
            (7, f"{ID} password=hunter22"), (8, None), (9, ""), (None, both), (1, both), (1, "clean"),
            (10, "word " * 100_000 + both), (11, f"{KEY} AKIA{'B' * 16}")]
    got = found(spark, rows)
    id_, key = ("weak_access", 3, 17), ("weak_secret", 26, 44)
    far = 5 * 100_000
    assert got == [
        (-1, [], [id_, key]), (1, [], []), (1, [], [id_, key]), (1, [], [id_, key]), (2, [], []), (3, [], []), (4, [], []),
        (5, [], [("weak_access", 0, 14), ("weak_secret", 255, 273)]),
        (6, [], [("weak_secret", 0, 18)]), (7, ["assign"], [("weak_access", 0, 14)]), (8, [], []), (9, [], []),
        (10, [], [("weak_access", far + 3, far + 17), ("weak_secret", far + 26, far + 44)]), (11, ["access"], [("weak_secret", 0, 18)])]


def test_long_secret_beside_an_identifier(spark):
    for n in (128, 129, 1000):
        token = (KEY * 60)[:n]
        assert found(spark, [(1, f"{ID} {token}")]) == [(1, [], [("weak_access", 0, 14), ("weak_secret", 15, 15 + n)])]
    assert found(spark, [(1, (KEY * 60)[:1000])]) == [(1, [], [])]
    assert len(credentials.parts_of(KEY * 100_000, [])) == 1


def test_links_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(30):
        words = rng.choices([ID, KEY, LINK, "filler " * 9, "\n\n", "password=hunter22", "x"], k=40)
        rows.append((i + 1, " ".join(words)))
    got = {i: {a[1:] for a in added} for i, _, added in found(spark, rows)}
    for i, text in rows:
        parts = credentials.parts_of(text, credentials.base_spans(text))
        want = {(a, b) for r, w, a, b, s in parts if w and any(
            r != r2 and s == s2 for r2, _, a2, b2, s2 in parts)}
        assert got[i] == want


def test_many_parts_of_one_scope_take_linear_work(spark):
    text = f"{ID} " * 20_000 + f"{KEY} " * 20_000
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    searched = credentials._searched(df, "doc_id", "text")
    met = credentials.links(searched)
    assert met.count() == 40_000 and met.where("size(with_roles) <> 1").count() == 0


def test_empty_table(spark):
    assert found(spark, []) == []
