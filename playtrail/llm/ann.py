"""Approximate nearest neighbours by collision counting over single projections.

Rows lie in blocks by the hash of their id, and every block of queries meets every block of rows; both have a bounded
size, so a task never holds more than one block of each. A block keeps one sorted array per projection. Around a query,
a window of half-width ``WIDTH * R / sqrt(dimensions)`` opens in each array, and a row collides where it lies inside.
Rows with at least the threshold of collisions are verified by their exact inner product. While fewer than k verified rows
lie within distance R, R grows by ``GROWTH`` and the windows widen (virtual rehashing); only what is new is counted.

The largest inner product becomes the least distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm.
Projections are rows of random rotations. A row at distance R collides in each with probability p, so it passes the threshold
of m p - ``SLACK`` deviations with a fixed probability whatever the data; rows nearer pass more often.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.llm.shared import written

QUERY_BLOCK = 4096
ROW_BLOCK = 8192
PROJECTIONS = 16
WIDTH = 1.0
SLACK = 1.8
GROWTH = 1.2
# Queries whose products with a block are made at once.
TOGETHER = 64


def rotations(dimensions: int, count: int = PROJECTIONS, seed: int = 29) -> np.ndarray:
    """``count`` directions, from as many random rotations as needed."""
    rng = np.random.default_rng(seed)
    found = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-count // dimensions))]
    return np.concatenate(found)[:count]


def threshold(dimensions: int, count: int = PROJECTIONS) -> int:
    """Collisions that a row at distance R reaches but for ``SLACK`` binomial deviations.

    A coordinate of a random direction has the density (1 - u^2)^((dimensions - 3) / 2), here summed over a fine grid of
    angles. Projections of one rotation spread less than independent ones, so the deviation is an upper bound.
    """
    angle = (np.arange(20_000) + 0.5) * (math.pi / 40_000)
    density = np.cos(angle) ** max(dimensions - 2, 0)
    p = float(density[np.sin(angle) <= WIDTH / math.sqrt(dimensions)].sum() / density.sum())
    return max(1, math.floor(count * p - SLACK * math.sqrt(count * p * (1 - p))))


class Block:
    """The sorted arrays of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: float):
        self.ids, self.rows = ids, rows
        rest = np.sqrt(np.maximum(largest ** 2 - (rows ** 2).sum(axis=1), 0))
        self.points = np.concatenate([rows, rest[:, None]], axis=1)
        self.directions = rotations(self.points.shape[1])
        placed = self.points @ self.directions.T
        # All sorted arrays in one, each shifted clear of the one before, so that one search opens all windows.
        self.shift = np.arange(placed.shape[1]) * (8 * (largest + 1.0))
        self.order = np.argsort(placed, axis=0, kind="stable").T.reshape(-1)
        self.sorted = np.sort(placed, axis=0).T.reshape(-1) + np.repeat(self.shift, len(rows))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, largest: float):
        """(query, row, score) of up to k rows for each query, best first, ties to the smaller id."""
        n, dimensions = self.points.shape
        need, reach = threshold(dimensions), WIDTH / math.sqrt(dimensions)
        centred = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) @ self.directions.T
        # Every query starts at four fifths of its least distance to a few rows.
        some = self.rows[:: max(1, n // 64)]
        norms = (queries ** 2).sum(axis=1)
        start = 0.8 * np.sqrt(np.maximum((norms + largest ** 2)[:, None] - 2 * queries @ some.T, 0)).min(axis=1)
        spread = np.maximum(np.sqrt(norms), largest)
        edges = np.arange(len(self.shift)) * n
        for i, query in enumerate(queries):
            if i % TOGETHER == 0:
                # A large share of a block is verified, and a product of matrices costs less than gathering that share.
                products = queries[i:i + TOGETHER] @ self.rows.T
            product = products[i % TOGETHER]
            counts = np.zeros(n, np.int64)
            low = high = None
            # Beyond this half-width a window holds its whole array.
            whole = spread[i] + largest
            others = self.ids != query_ids[i]
            radius = max(float(start[i]), 1e-6 * largest, 1e-300)
            while True:
                half = reach * radius
                at = np.clip(centred[i], -4 * (largest + 1), 4 * (largest + 1)) + self.shift
                opened = half if half < whole else 0
                new_low = np.searchsorted(self.sorted, at - half, "left") if opened else edges
                new_high = np.searchsorted(self.sorted, at + half, "right") if opened else edges + n
                new_low, new_high = np.maximum(new_low, edges), np.minimum(new_high, edges + n)
                if high is None:
                    low, high = new_low, new_low
                spans = [*zip(new_low.tolist(), low.tolist()), *zip(high.tolist(), new_high.tolist())]
                low, high = new_low, new_high
                seen = [self.order[a:b] for a, b in spans if a < b]
                if seen:
                    counts += np.bincount(np.concatenate(seen), minlength=n)
                verified = counts >= need
                found = np.flatnonzero(verified & others)
                scores = product[found]
                if len(found) >= k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    if norms[i] + largest ** 2 - 2 * kth <= radius ** 2:
                        break
                if not opened or verified.all():
                    break
                radius *= GROWTH
            if len(found) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= kth - 1e-9 * (1 + abs(kth))
                found = found[near]
            exact = inner(self.rows[found], query)
            best = np.lexsort((self.ids[found], -exact))[:k]
            yield query_ids[i], self.ids[found[best]], exact[best]


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal vectors have equal scores."""
    total = np.zeros(len(rows))
    for j, q in enumerate(query.tolist()):
        total += rows[:, j] * q
    return total


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col="vec_id", vec_col="embedding",
            query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``is_query`` its ``k`` found rows of largest inner product.

    Unusable vectors and rows without id take no part; vectors of different length never meet. Rows that repeat an id
    count once, with the smallest of their vectors. A query never finds its own id. Scores are in double precision.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = written(rows.groupBy("id").agg(F.min("vec").alias("vec"), F.bool_or("asks").alias("asks")), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x))
    n, asked, largest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(norm)).first()
    row_blocks, query_blocks = -(-max(1, n) // row_block), -(-max(1, asked) // query_block)
    largest = float(largest or 0.0)
    cells = min(row_blocks * query_blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df, own, count, other, others):
        place = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(count)).cast("int")
        spread = df.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.size("vec").alias("d"), place.alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
        # A fixed number of parts: adaptive merging goes by bytes, and a few bytes are much work here.
        return spread.repartition(cells, "d", "q", "r")

    asking = dealt(rows.where("asks"), "q", query_blocks, "r", row_blocks).groupBy("d", "q", "r")
    given = dealt(rows, "r", row_blocks, "q", query_blocks).groupBy("d", "q", "r")

    def matrix(table):
        values = table.column("vec").combine_chunks()
        ids = table.column("id").to_numpy()
        return ids, values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            ids, points = matrix(right)
            query_ids, queries = matrix(left)
            order = np.argsort(ids)
            parts = list(Block(ids[order], points[order], largest).nearest(query_ids, queries, k, largest))
        sizes = [len(p[1]) for p in parts]
        return pa.table({
            "query_id": pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes), pa.int64()),
            "vec_id": pa.array(np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)]), pa.int64()),
            "score": pa.array(np.concatenate([p[2] for p in parts] or [np.zeros(0)]), pa.float64())})

    found = asking.cogroup(given).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
