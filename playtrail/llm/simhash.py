"""SimHash fingerprints of documents, and near-duplicate groups by covering locality-sensitive hashing.

Near-duplicates are documents whose fingerprints differ in at most ``RADIUS`` bits, and whatever such
links connect. A covering family finds them without false negatives: give every bit position i a
non-zero vector m(i) of RADIUS + 1 bits; table v (each non-zero vector) keeps the positions with
m(i) . v = 1 (mod 2). Any RADIUS positions leave a v orthogonal to all their vectors, and in that table the
two fingerprints have the same key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import connected_components, free_name, written

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
# Buckets with at most so many different fingerprints are compared pair by pair, others by centres; both are exact.
PAIRWISE = 24


def fingerprints_of(texts: list[str | None]) -> list[int]:
    """64-bit fingerprints, signed as Spark's BIGINT.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are three words, repeats count.
    Fewer words make one shingle; none, an empty or a null text make fingerprint zero. Long texts are hashed
    in blocks of shingles, so memory stays bounded.
    """
    import re

    import numpy as np
    import xxhash

    words_of = re.compile(rb"[^\x20\x09-\x0D]+").findall
    hashed = xxhash.xxh64_intdigest
    out = []
    for text in texts:
        words = words_of((text or "").encode("utf-8", "surrogatepass").lower())
        if not words:
            out.append(0)
            continue
        if len(words) < SHINGLE:
            out.append(_signed(hashed(b" ".join(words), SEED)))
            continue
        total = len(words) - SHINGLE + 1
        counts = np.zeros(BITS, np.int64)
        for start in range(0, total, 8192):
            part = words[start:start + 8192 + SHINGLE - 1]
            values = np.array(
                [hashed(b"%b %b %b" % three, SEED) for three in zip(part, part[1:], part[2:])], "<u8")
            counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
        bits = np.packbits(2 * counts > total, bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, in Arrow batches."""
    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints_of([t if isinstance(t, str) else None for t in texts]), dtype="int64")

    return hashed(text)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, fp)`` for every row, repeated and null ids included."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"))


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The kept positions of each table, as unsigned masks; position i has the vector 1 + i mod (2^(radius+1) - 1)."""
    tables = (1 << (radius + 1)) - 1
    vectors = [1 + i % tables for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, tables + 1)]


def near_links(fps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints ``fp`` at most ``radius`` (2) bits apart.

    Every such pair is connected through the links returned, and every link is such a pair. In a small bucket
    all pairs are compared. In a large one, two fingerprints differ only in the positions its table drops, so
    they share a centre reached by flipping at most one dropped bit in each; all members at one centre are
    within two bits of each other, and each is linked to the smallest. No bucket is gathered beyond
    ``pairwise`` members, and a bucket of n members makes a number of rows in proportion to n.
    """
    if radius != 2:
        raise ValueError("centres reach exactly two bits")
    masks = covering_masks(BITS, radius)
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
        for t, m in enumerate(masks)])
    keyed = fps.select("fp").distinct().select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    keyed = written(keyed, "simhash-keys")
    sizes = written(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    shared = keyed.join(sizes, ["t", "k"])

    small = shared.where(F.col("n") <= pairwise).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    pairs = (
        small.select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode(F.filter("fps", lambda b: (b < F.col("a"))
                                        & (F.bit_count(F.col("a").bitwiseXOR(b)) <= radius))).alias("b")))

    flips = F.array(*[
        F.filter(F.array(*[F.lit(_signed(1 << i)) if not m >> i & 1 else F.lit(0) for i in range(BITS)]), lambda x: x != 0)
        for m in masks])
    centred = shared.where(F.col("n") > pairwise).select("fp", F.explode(F.concat(
        F.array("fp"), F.transform(F.element_at(flips, F.col("t") + 1), lambda x: F.col("fp").bitwiseXOR(x)),
    )).alias("centre")).distinct()
    least = centred.groupBy("centre").agg(F.min("fp").alias("b"))
    stars = centred.join(least, "centre").select(F.col("fp").alias("a"), "b").where("a <> b")
    return pairs.union(stars).distinct()


def group_names(fps: DataFrame, links_of=near_links) -> DataFrame:
    """``(fp, component, component_id)`` for every fingerprint of ``fps (doc_id, fp)``; ``links_of`` its nodes links them."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    components = connected_components(links_of(nodes))
    grouped = written(
        nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "simhash-grouped")
    names = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return written(grouped.join(names, "component").select("fp", "component", "component_id"), "simhash-names")


def near_duplicate_groups(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the smallest id it is connected to.

    Null and empty texts share fingerprint zero and are linked like any other. Null ids keep their rows; a
    group without any id has a null component. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash-fps")
    return fps.join(group_names(fps), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_per_group(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash-fps")
    return keep_first(docs, fps, group_names(fps), fingerprint, id_col, text_col)


def keep_first(docs: DataFrame, fps: DataFrame, names: DataFrame, name_of, id_col="doc_id", text_col="text") -> DataFrame:
    """The document with the smallest id of each group in ``names``, with all its columns.

    ``fps (doc_id, fp)`` holds what ``name_of`` makes of each text. Texts move once, in a sort-merge join by id whatever the
    sizes. Where several rows carry a kept id, those rows are written and hashed again to tell which belong to the group, and
    one of them stays. A group without any id keeps one of its rows.
    """
    first = fps.join(names, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    rows = fps.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    kept = written(first.join(rows, first["doc_id"].eqNullSafe(rows["id"])).select("doc_id", "n"), "simhash-kept")
    single, many = kept.where("n = 1 AND doc_id IS NOT NULL"), kept.where("n > 1 OR doc_id IS NULL")
    once = docs.join(single.hint("merge"), docs[id_col].cast("bigint") == single["doc_id"], "left_semi")
    if many.isEmpty():
        return once
    again = docs.join(many.hint("merge"), docs[id_col].cast("bigint").eqNullSafe(many["doc_id"]), "left_semi")
    again = written(again, "simhash-repeated")
    fp, component, least = (free_name(docs, n) for n in ("fp", "component", "least"))
    renamed = names.select(F.col("fp").alias(fp), F.col("component").alias(component),
                           F.col("component_id").alias(least))
    chosen = (
        again.withColumn(fp, name_of(F.col(text_col))).join(renamed, fp)
        .where(F.col(id_col).cast("bigint").eqNullSafe(F.col(least)))
        .dropDuplicates([component]))
    return once.unionByName(chosen.select(*docs.columns))
