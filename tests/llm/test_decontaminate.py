"""Greedy string tiling against brute force; what counts as contaminated."""

import random
import time

from playtrail.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def slow_tiles(doc, item, size):
    """Longest unmarked common run first, ties to the earliest in the document, then in the item."""
    used_doc, used_item, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while (p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]
                       and p + n not in used_doc and q + n not in used_item):
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < size:
            return sorted(tiles)
        tiles.append((p, q, n))
        used_doc.update(range(p, p + n))
        used_item.update(range(q, q + n))


def fast_tiles(doc, item, size=5):
    seeds = decontaminate._signed(decontaminate.seeds_of(" ".join(item), size)).tolist()
    at = decontaminate._signed(decontaminate.seeds_of(" ".join(doc), size)).tolist()
    return decontaminate.tiles_of({p: s for p, s in enumerate(at) if s in set(seeds)}, seeds, size)


def test_tiling_covers_what_brute_force_covers():
    rng = random.Random(3)
    for _ in range(60):
        item = [f"w{i}" for i in range(rng.randint(6, 70))]
        doc = [f"x{i}" for i in range(10)]
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(item))
            doc += [*item[a:a + rng.randint(3, 40)], f"y{rng.randrange(99)}"]
        fast, slow = fast_tiles(doc, item), slow_tiles(doc, item, 5)
        assert sum(t[2] for t in fast) == sum(t[2] for t in slow), (fast, slow)
        for p, q, n in fast:
            assert doc[p:p + n] == item[q:q + n]


def test_repeated_words_do_not_overlap():
    tiles = fast_tiles(["a"] * 30, ["a"] * 12)
    assert sum(t[2] for t in tiles) == 12 and len({t[1] for t in tiles}) == len(tiles)


def test_tiling_of_few_words_covers_almost_what_brute_force_covers():
    """Runs cut by a longer tile are found in a later pass, so repeated words may leave a little less covered."""
    rng = random.Random(8)
    fast = slow = 0
    for _ in range(150):
        words = "ab" if rng.random() < 0.5 else "abcdefgh"
        item = rng.choices(words, k=rng.randint(6, 40))
        doc = [w for _ in range(rng.randint(1, 6)) for w in [*rng.choices(words, k=rng.randint(0, 30)), "stop"]]
        tiles = fast_tiles(doc, item)
        for p, q, n in tiles:
            assert n >= 5 and doc[p:p + n] == item[q:q + n]
        for place in (0, 1):
            taken = [t[place] + i for t in tiles for i in range(t[2])]
            assert len(taken) == len(set(taken))
        fast += sum(t[2] for t in tiles)
        slow += sum(t[2] for t in slow_tiles(doc, item, 5))
    assert 0.97 * slow <= fast <= 1.03 * slow


def test_copies_of_stretches_that_no_tile_can_need_change_nothing(monkeypatch):
    rng = random.Random(9)
    for _ in range(100):
        item = rng.choices("abc", k=rng.randint(6, 30))
        stretch = rng.choices("abc", k=rng.randint(5, 12))
        doc = [*stretch, "stop"] * 40
        got = fast_tiles(doc, item)
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "_places", lambda doc, copies: sorted(doc))
            assert fast_tiles(doc, item) == got


def test_long_texts_of_equal_words_end_soon():
    start = time.process_time()
    assert fast_tiles(["a"] * 100_000, ["a"] * 1000) == [(0, 0, 1000)]
    assert sum(t[2] for t in fast_tiles((["a"] * 10 + ["b"]) * 10_000, ["a"] * 1000)) == 1000
    assert time.process_time() - start < 20


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, coverage string, key string")
    b = spark.createDataFrame(items, "item_id bigint, text string, seed string")
    rows = decontaminate.contaminated(d, b, **options).collect()
    kept = decontaminate.drop_contaminated(d, b, **options)
    assert kept.columns == d.columns
    return {(r["doc_id"], r["item_id"]): r for r in rows}, sorted((r["doc_id"] or -1) for r in kept.collect())


def doc(i, text):
    return (i, text, "a", "b", "c")


def test_exact_reordered_partial_and_clean(spark):
    text = " ".join(ITEM)
    moved = " ".join([*ITEM[10:], "between", *ITEM[:10]])
    docs = [
        doc(1, f"before {text} after"), doc(2, f"Some {moved.upper()}!"), doc(3, " ".join(ITEM[:9]) + " tail"),
        doc(4, " ".join(w for pair in zip(ITEM, ITEM[::-1]) for w in pair)), doc(5, None), doc(6, ""),
        doc(None, text), doc(1, f"before {text} after"), doc(7, "filler " * 50_000 + text), doc(8, "clean text of its own")]
    hits, kept = found(spark, docs, [(10, text, "s"), (10, text, "s"), (11, None, "s"), (12, "too short", "s")])
    assert set(hits) == {(1, 10), (2, 10), (None, 10), (7, 10)}
    assert len(hits[2, 10]["tiles"]) == 2 and hits[2, 10]["coverage"] == 1.0
    assert kept == [3, 4, 5, 6, 8]


def test_threshold_is_a_share_of_the_item(spark):
    docs = [doc(1, " ".join(ITEM[:10])), doc(2, " ".join(ITEM[:9]))]
    assert set(found(spark, docs, [(1, " ".join(ITEM), "s")])[0]) == {(1, 1)}
    assert set(found(spark, docs, [(1, " ".join(ITEM), "s")], threshold=0.4)[0]) == {(1, 1), (2, 1)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, " ".join(ITEM), "s")]) == ({}, [])
    assert found(spark, [doc(1, " ".join(ITEM))], []) == ({}, [1])


def test_rows_of_one_id_are_told_apart(spark):
    hits, kept = found(spark, [doc(1, " ".join(ITEM)), doc(1, "clean text")], [(1, " ".join(ITEM), "s")])
    assert set(hits) == {(1, 1)} and kept == [1]


def test_bitmap_holds_every_seed(spark):
    b = spark.createDataFrame([(i, f"{i} " + " ".join(random.Random(i).choices(ITEM, k=30))) for i in range(50)], "item_id bigint, text string")
    seeds = decontaminate._seed_rows(decontaminate._keyed(b, "item_id", "text"), 5)
    bits = decontaminate._bitmap(seeds)
    slots = [(r["seed"] % (1 << 64)) >> (64 - decontaminate.BITMAP_BITS) for r in seeds.collect()]
    assert slots and all(bits[s >> 3] >> (s & 7) & 1 for s in slots)
