"""Hard negatives against all pairs, and the streaming pass against its own definition."""

import random

import pytest
from pyspark.sql import functions as F

from playtrail.llm import hardnegatives


def slow(rows, every, positives=5, wanted=3):
    out = []
    for anchor, label, vec in rows:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, other) for i, other, v in rows
                        if i != anchor and len(v) == len(vec))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:wanted]
            out += [(anchor, positive, r + 1, s[1], -score, -s[0]) for r, s in enumerate(fits)]
    return sorted(out)


def made(seed, n, spread, dimensions=3, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randrange(-spread // 3, spread) for _ in range(dimensions)]) for i in range(n)]


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vec array<bigint>")
    return sorted(map(tuple, hardnegatives.mine(df, F.col("vec_id") % every == 0, **options).collect()))


@pytest.mark.parametrize("seed, spread", [(1, 4), (2, 30), (3, 1000), (4, 1_000_000_000)])
def test_equals_all_pairs(spark, seed, spread):
    rows = made(seed, 160, spread)
    got = mined(spark, rows, 7, anchor_block=5, row_block=23)
    assert got == slow(rows, 7) and got


def test_third_of_all_rows_alike_and_lengths_mixed(spark):
    rows = made(6, 90, 9) + [(100 + i, i % 2, [3, 2, 1]) for i in range(60)] + [(200 + i, i % 3, [5, 5]) for i in range(20)]
    assert mined(spark, rows, 10, anchor_block=4, row_block=16) == slow(rows, 10)


def test_rows_that_take_no_part(spark):
    rows = made(7, 60, 20)
    extra = [(None, 1, [9, 9, 9]), (70, None, [9, 9, 9]), (72, 1, None), (73, 1, [9, None, 9]), (3, rows[3][1], rows[3][2])]
    assert mined(spark, rows + extra, 5) == slow(rows, 5)
    assert mined(spark, [], 5) == [] and mined(spark, [(1, 1, [1])], 5) == [] and mined(spark, [(5, 1, [1]), (6, 1, [])], 5) == []


def test_zero_and_negative_positives(spark):
    rows = [(0, 1, [1, 0]), (1, 1, [0, 5]), (2, 1, [-4, 0]), (3, 2, [0, 7]), (4, 2, [-3, 1]), (5, 2, [0, 0])]
    assert mined(spark, rows, 50) == slow(rows, 50) == [(0, 1, 1, 3, 0, 0), (0, 1, 2, 5, 0, 0)]


def test_other_columns_and_too_large_values(spark):
    rows = spark.createDataFrame([(0, 1, [10], "x"), (1, 1, [10], "y"), (2, 2, [9], "z")],
                                 "vec_id bigint, label int, vec array<bigint>, id string")
    assert [tuple(r) for r in hardnegatives.mine(rows, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 100, 90)]
    with pytest.raises(ArithmeticError):
        hardnegatives.mine(spark.createDataFrame([(0, 1, [1 << 62])], "vec_id bigint, label int, vec array<bigint>"), F.lit(True))


def test_keys_sort_as_meant_and_the_stream_holds_windows_only():
    rng = random.Random(8)
    items = [(rng.randrange(-5, 5), rng.randrange(-9, 9), rng.random() < 0.5, rng.randrange(-5, 50)) for _ in range(500)]
    keys = sorted(hardnegatives.pack(*i) for i in items)
    assert [hardnegatives.unpack(k) for k in keys] == sorted(items, key=lambda i: (i[0], -i[1], not i[2], i[3]))

    def endless():
        yield hardnegatives.pack(1, 1000, True, 5)
        for i in range(200_000):
            yield hardnegatives.pack(1, 900, False, i)

    assert [f[3] for f in hardnegatives.negatives(endless(), 5, 3)] == [0, 1, 2]
