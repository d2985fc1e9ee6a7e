"""Helpers that several text operators use: tables, written intermediate results, components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that lost executors cost no lineage.

    Used where a result is needed several times, or where a later shuffle should start from files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache(name: str, make):
    """``make()``, kept while the Python worker lives and asks for it, since tasks unpickle functions anew.

    A worker serves one stage after another; what an earlier stage kept goes when a later one asks for something else.
    """
    import sys
    import types

    kept = sys.modules.setdefault("playtrail_process_cache", types.ModuleType("playtrail_process_cache"))
    if getattr(kept, "held", ("", None))[0] != name:
        kept.held = ("", None)
        kept.held = (name, make())
    return kept.held[1]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; a component is named by its smallest node.

    Large-star and small-star rounds: every node links its larger neighbours to the smallest
    neighbour, then its smaller ones. Each round is two grouped minima and two joins over links, so a hub
    is pre-aggregated before its shuffle and its join is left to Spark's skew handling; no group is
    gathered. Every round is written to the shared folder. The driver sees one count and one checksum a
    round. Null ends and loops are ignored; no links give no rows.
    """

    def star(edges, larger):
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            around = around.where("b < a")
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = around.join(least, "a")
        if larger:
            found = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            found = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b")))
        return found.where("a <> b").distinct()

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(max_rounds):
        edges = written(star(star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
