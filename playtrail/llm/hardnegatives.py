"""Hard negatives of anchors, streamed from one secondary sort.

Every anchor meets every other row, in blocks of bounded size, by a matrix product. Two passes keep only what can matter: the
first the best rows of the anchor's label in each block, of which the best of all blocks are its positives; the second, in each
block, the best rows of other labels inside each positive's score window. What is left is packed into keys of anchor,
descending score and id, dealt out by anchor and sorted inside the partitions by Spark's shuffle. An iterator then
reads each partition once: a positive opens its window, and a negative is emitted for every open window that it falls into. It
remembers the open windows of one anchor only.

Scores are exact integers. Blocks are multiplied in double precision where all sums stay below 2^53, else in 64-bit integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.llm.shared import written

ANCHOR_BLOCK = 4096
ROW_BLOCK = 8192
ANCHORS_AT_ONCE = 256
# Bounds of a window in hundredths of the positive's score.
LOW, HIGH = 50, 95

_KEY = ">QQBQ"
_SIGN, _ALL = 1 << 63, (1 << 64) - 1


def pack(anchor: int, score: int, positive: bool, row: int) -> bytes:
    """A key whose bytes sort by anchor, falling score, positives before negatives, id."""
    return struct.pack(_KEY, anchor + _SIGN, _ALL - (score + _SIGN), 0 if positive else 1, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, kind, row = struct.unpack(_KEY, key)
    return anchor - _SIGN, _ALL - score - _SIGN, kind == 0, row - _SIGN


def negatives(keys, positives: int, wanted: int):
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys, one pass, nothing gathered."""
    current, opened, windows = None, 0, []
    for key in keys:
        anchor, score, positive, row = unpack(key)
        if anchor != current:
            current, opened, windows = anchor, 0, []
        if positive:
            if opened < positives:
                opened += 1
                windows.append([row, score, 0])
            continue
        for window in windows:
            if LOW * window[1] <= 100 * score <= HIGH * window[1] and window[2] < wanted:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score
        windows = [w for w in windows if w[2] < wanted and LOW * w[1] <= 100 * score]


def _best_first(scores: np.ndarray, taken: np.ndarray, bound: int) -> np.ndarray:
    """For each line, the columns in falling score, ties by column; columns not ``taken`` come last."""
    bits = max(1, scores.shape[1] - 1).bit_length()
    if bound.bit_length() + bits < 61:
        # Score and column in one number: sorting numbers is much faster than sorting their places.
        columns = np.arange(scores.shape[1], dtype=np.int64)
        keys = np.where(taken, (-scores).astype(np.int64) << bits | columns, np.iinfo(np.int64).max)
        keys.sort(axis=1)
        return np.where(keys == np.iinfo(np.int64).max, 0, keys & ((1 << bits) - 1))
    return np.lexsort((-scores, ~taken), axis=1)


def _matrix(table: pa.Table, exact_doubles: bool) -> np.ndarray:
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, len(flat) // table.num_rows).astype(np.float64 if exact_doubles else np.int64)


def _meet(anchors: pa.Table, rows: pa.Table, bound: int, found_of):
    """Packed keys that ``found_of(scores, taken, order, i)`` keeps for each anchor of the block."""
    keys = []
    if anchors.num_rows and rows.num_rows:
        rows = rows.sort_by("id")
        exact_doubles = bound < 1 << 53
        points, asked = _matrix(rows, exact_doubles), _matrix(anchors, exact_doubles)
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        anchor_ids, anchor_labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        windows = anchors.column("windows").to_pylist() if "windows" in anchors.column_names else [None] * len(anchor_ids)
        for at in range(0, len(anchor_ids), ANCHORS_AT_ONCE):
            part = slice(at, at + ANCHORS_AT_ONCE)
            scores = asked[part] @ points.T
            same = labels[None, :] == anchor_labels[part, None]
            taken = same & (ids[None, :] != anchor_ids[part, None]) if windows[0] is None else ~same
            order, many = _best_first(scores, taken, bound), taken.sum(axis=1)
            for i, anchor in enumerate(anchor_ids[part].tolist()):
                line = order[i, :many[i]]
                kept = found_of(scores[i, line], windows[at + i])
                keys += [pack(anchor, int(scores[i, line[j]]), windows[0] is None, int(ids[line[j]])) for j in kept]
    return pa.table({"key": pa.array(keys, pa.binary())})


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, wanted: int = 3, id_col="vec_id", vec_col="vec",
         label_col="label", anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from vectors of whole numbers.

    The positives of an anchor are the ``positives`` best other rows of its label; for each, the ``wanted`` best rows of other
    labels come whose score is 50 to 95 hundredths of the positive's. Ties go to the smaller id. A positive of negative score
    has an empty window; one of score zero takes negatives of score zero. Rows without id, label or vector, or with a null
    component, take no part; rows that repeat an id count once, with the smallest label and vector; vectors of different length
    never meet; a table without anchors gives no rows. Raises where a score could leave 64 bits.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<bigint>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                          vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"), F.bool_or("asks").alias("asks"))
    rows = written(rows.select("id", "row.label", "row.vec", "asks"), "mined-rows")
    largest = F.aggregate("vec", F.lit(0).cast("bigint"), lambda m, x: F.greatest(m, F.abs(x)))
    n, asked, high, wide = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(largest), F.max(F.size("vec"))).first()
    bound = max(1, wide or 0) * (high or 0) ** 2
    if bound >= 1 << 63:
        raise ArithmeticError("inner products of these vectors do not fit 64 bits")
    row_blocks, anchor_blocks = -(-max(1, n) // row_block), -(-max(1, asked) // anchor_block)
    cells = min(row_blocks * anchor_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df, own, count, other, others):
        place = F.pmod(F.xxhash64("id", F.lit(37)), F.lit(count)).cast("int")
        spread = df.select(*[F.col(c).alias(c) for c in df.columns], F.size("vec").alias("d"), place.alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
        # A fixed number of parts: adaptive merging goes by bytes, and a few bytes are much work here.
        return spread.repartition(cells, "d", "a", "r").groupBy("d", "a", "r")

    def met(anchors, found_of):
        given = dealt(rows.select("id", "label", "vec"), "r", row_blocks, "a", anchor_blocks)
        asking = dealt(anchors, "a", anchor_blocks, "r", row_blocks)
        return asking.cogroup(given).applyInArrow(lambda left, right: _meet(left, right, bound, found_of), "key binary")

    def first_ones(scores, windows):
        return range(min(positives, len(scores)))

    def in_windows(scores, windows):
        kept, rising = set(), -scores
        for score in windows:
            # A window is a run of the falling scores, from HIGH * score / 100 rounded down to LOW * score / 100 rounded up.
            start = np.searchsorted(rising, -(HIGH * score // 100), "left")
            stop = np.searchsorted(rising, -LOW * score // 100, "right")
            kept.update(range(start, min(stop, start + wanted)))
        return sorted(kept)

    anchors = rows.where("asks").select("id", "label", "vec")
    near = written(met(anchors, first_ones), "mined-positives")
    best = Window.partitionBy(F.substring("key", 1, 8)).orderBy("key")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)

    def scores_of(batches):
        for batch in batches:
            found = [unpack(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["id", "score"])

    scored = near.select("key").mapInArrow(scores_of, "id bigint, score bigint")
    windows = scored.groupBy("id").agg(F.collect_set("score").alias("windows"))
    far = met(anchors.join(windows, "id"), in_windows)

    keys = near.select("key").union(far).rdd.map(lambda r: (bytes(r[0]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    found = ordered.mapPartitions(lambda part: negatives((k for k, _ in part), positives, wanted))
    return spark.createDataFrame(
        found, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
