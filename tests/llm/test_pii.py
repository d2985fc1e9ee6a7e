"""Personal data: patterns against plain regular expressions, gradients against differences, windows, reconciliation."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playtrail.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.findall("[0-9]", m.group())
        if 14 <= len(digits) <= 19 and pii._luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return pii.in_order(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a1@.+-( )%_é", "25", "255", "4242424242424242", "+1 (456) 555-2186", "x@y.z", "1.2.3.4"]), max_size=25).map("".join))
def test_patterns_equal_plain_regular_expressions(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 100_000 + "+1" + " " * 200_000
    assert pii.base_spans(text) is not None


def test_gradients_equal_differences():
    net, rng = pii.Network(), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, pii.SYMBOLS, (3, 7))
    y = np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 0, 7, 8, 8]])
    _, grad = net.gradients(x, y)
    for name, value in net.p.items():
        for place in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(4)] + ([(x[0, 2], 3)] if name == "embed" else []):
            old = value[place]
            value[place] = old + 1e-4
            up = net.gradients(x, y)[0]
            value[place] = old - 1e-4
            down = net.gradients(x, y)[0]
            value[place] = old
            assert abs((up - down) / 2e-4 - grad[name][place]) < 1e-3, (name, place)


def test_decode_finds_the_best_path():
    import itertools

    net = pii.Network()
    x = np.array([[5, 60, 33]])
    scores, moves = net.emissions(x)[0][:, 0], net.p["moves"]

    def total(path):
        return sum(scores[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(pii.TAGS), repeat=3), key=total)
    assert net.decode(x)[0].tolist() == list(best)


def test_windows_cover_every_trigger():
    rng = np.random.default_rng(4)
    for size in (0, 1, 95, 96, 97, 144, 145, 1000):
        text = "".join(rng.choice(["x", "x", "x", "x", "7"], size))
        starts = list(pii.windows_of(text))
        assert starts == sorted(set(starts)) and all(s % pii.STRIDE == 0 for s in starts)
        for m in re.finditer("7", text):
            assert any(s <= m.start() < s + pii.WINDOW for s in starts)
        for s in starts:
            assert re.search("[0-9@]", text[s:s + pii.WINDOW])


def test_reconcile():
    join = pii.reconcile([("ip", 3, 8), ("ip", 6, 12), ("card", 10, 14), ("phone", 20, 30), ("card", 25, 29), ("card", 30, 33)])
    assert join == [("ip", 3, 12), ("phone", 20, 30), ("card", 30, 33)]
    assert pii.reconcile([]) == []


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(7)
    windows = []
    for _ in range(300):
        a, b = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 38)), "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 38))
        kind = rng.integers(0, 3)
        digits = rng.integers(100, 999, 3)
        middle = ["", f"+1 ({digits[0]}) {digits[1]}-{digits[2]}0", f"{a[:5].strip() or 'q'}.{digits[0]}@mail.example.com"][kind]
        text = f"{a} {middle} {b}"
        spans = [(("", "phone", "email")[kind], len(a) + 1, len(a) + 1 + len(middle))] if middle else []
        windows.append((text[:pii.WINDOW], spans))
    return pii.train(windows, steps=120)


def test_network_adds_a_number_without_its_plus(trained):
    text = "word " * 40 + "call 1 (456) 555-2180 now " + "word " * 40
    base = pii.base_spans(text)
    assert base == []
    (span,) = pii.added_spans(trained, [text], [base])[0]
    assert span[0] == "phone" and "(456) 555-2180" in text[span[1]:span[2]]
    assert pii.added_spans(trained, ["no digits at all " * 30], [[]]) == [[]]
    assert pii.added_spans(None, [text], [base]) == [[]]


def test_rows_of_a_table(spark, trained):
    rows = [(1, "mail a.b@c.de now", "b", 1), (1, "mail a.b@c.de now", "b", 1), (2, None, "b", 1), (None, "", "b", 1),
            (3, "x" * 200_000 + " 1.2.3.4", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, base string, added int")
    out = pii.find(df, trained)
    assert sorted(out.columns) == ["added", "base", "doc_id", "text"] and out.count() == 5
    by_id = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in out.collect()}
    assert by_id == {1: [("email", 5, 13)], 2: [], None: [], 3: [("ip", 200_001, 200_008)]}
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(df, trained).collect()}
    assert hidden[1] == "mail [EMAIL] now" and hidden[2] is None and hidden[None] == "" and hidden[3].endswith("x [IP]")
    assert pii.find(df.where("false"), None).count() == 0
    assert pii.fit(df.where("doc_id = 2")) is None


def test_trained_on_sampled_labels_it_finds_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = pii.fit(docs, steps=100)
    texts = [r["text"] for r in docs.select("text").collect()]
    base = [pii.base_spans(t) for t in texts]
    again = pii.added_spans(net, texts, [[] for _ in texts])
    hit = sum(len(set(a) & set(b)) for a, b in zip(again, base))
    assert hit > 0.8 * sum(map(len, base)) and hit > 0.8 * sum(map(len, again))


def test_every_window_with_a_trigger_is_decoded():
    rng = random.Random(9)
    texts = ["x" * 10 + "1" + "x" * 49 + "@" + "x" * 200]
    texts += ["".join(rng.choices("x@1", (weight, 1, 1), k=rng.randint(0, 700))) for weight in (5, 50, 200, 1000) for _ in range(60)]
    for text in texts:
        last = max([0, *[s + pii.STRIDE for s in range(0, len(text), pii.STRIDE) if s + pii.WINDOW < len(text)]])
        want = [s for s in range(0, last + 1, pii.STRIDE) if any(c in "@1" for c in text[s:s + pii.WINDOW])]
        assert list(pii.windows_of(text)) == want
