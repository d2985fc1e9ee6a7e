"""Nearest neighbours against brute force: recall, order, ties, unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from playtrail.llm import ann


def brute(ids, rows, query, own, k):
    scores = ann.inner(rows, query)
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), float(scores[i])) for i in order if ids[i] != own][:k]


def recall(ids, rows, k=20, **blocks):
    largest = float(np.sqrt((rows ** 2).sum(axis=1)).max())
    hits, asked = 0, ids[ids % 20 == 0]
    block = ann.Block(ids, rows, largest)
    for own, found, scores in block.nearest(asked, rows[ids % 20 == 0], k, largest):
        want = brute(ids, rows, rows[ids == own][0], own, k)
        hits += len({i for i, _ in want} & set(found.tolist()))
        assert list(zip(-scores, found)) == sorted(zip(-scores, found)) and own not in found
    return hits / (len(asked) * min(k, len(ids) - 1))


def test_recall_on_random_clustered_and_unscaled_vectors():
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((2000, 64))
    flat /= np.linalg.norm(flat, axis=1)[:, None]
    ids = np.arange(2000)
    assert recall(ids, flat) > 0.95
    centres = rng.standard_normal((12, 32)) * 3
    assert recall(ids, centres[rng.integers(0, 12, 2000)] + rng.standard_normal((2000, 32))) > 0.95
    assert recall(ids, rng.standard_normal((2000, 100)) * rng.uniform(0.1, 5, (2000, 1))) > 0.95
    assert recall(ids, rng.standard_normal((2000, 3))) > 0.95
    assert recall(np.arange(12), rng.standard_normal((12, 8))) == 1.0


def test_equal_vectors_come_in_order_of_ids():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((600, 16))
    rows[100:400] = rows[100]
    largest = float(np.sqrt((rows ** 2).sum(axis=1)).max())
    ((_, found, scores),) = ann.Block(np.arange(600), rows, largest).nearest(np.array([120]), rows[120:121], 20, largest)
    assert found.tolist() == list(range(100, 120)) and len(set(scores.tolist())) == 1


def test_table_over_several_blocks(spark):
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((400, 8)).astype(np.float32)
    given = [(i, rows[i].tolist(), "r", 0.5) for i in range(400)]
    odd = [(400, None, "r", 0.0), (420, [], "r", 0.0), (440, [0.0] * 8, "r", 0.0), (460, [float("nan")] * 8, "r", 0.0),
           (480, [float("inf")] + [1.0] * 7, "r", 0.0), (500, [None] + [1.0] * 7, "r", 0.0), (None, [1.0] * 8, "r", 0.0),
           (520, [1.0, 2.0], "r", 0.0), (0, rows[0].tolist(), "r", 0.0)]
    df = spark.createDataFrame(given + odd, "vec_id bigint, embedding array<float>, rank string, score double")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, query_block=7, row_block=64)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))  # the only vector of length two has no other to find
    exact = rows.astype(np.float64)
    hits = 0
    for q, found in got.items():
        want = brute(np.arange(400), exact, exact[q], q, 5)
        hits += len({i for i, _ in found} & {i for i, _ in want})
        assert all(abs(s - exact[q] @ exact[i]) < 1e-12 for i, s in found) and len(found) == 5
    assert hits >= 0.95 * 100
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_few_rows_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0])], "vec_id bigint, embedding array<double>")
    rows = ann.nearest(df, F.col("vec_id") == 0, k=20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, 0.0)]
