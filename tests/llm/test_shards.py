"""Shards: every row once, equal counts, one order for the same rows, no Python in the plan."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from playtrail.llm import shards
from playtrail.llm.queries import QUERIES
from playtrail.llm.shared import table
from playtrail.session import scratch_path

FOLDER = "/root/testdata/sf0.01"


def placed(df):
    """Places by shard; raises where slots have gaps or counts of shards differ by more than one."""
    by = defaultdict(list)
    for r in df.collect():
        by[r["shard"]].append(r)
    return by


def check_law(df, rows, count):
    by = placed(df)
    sizes = [len(by.get(s, [])) for s in range(count)]
    assert sum(sizes) == rows and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(count))
    for found in by.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    return by


@pytest.mark.parametrize("bucket_bytes", [10_000, 300_000, 64_000_000])
def test_law_and_content(spark, bucket_bytes):
    docs = table(spark, FOLDER, "documents")
    rows = docs.count()
    by = check_law(shards.shuffled(docs, 24, bucket_bytes=bucket_bytes), rows, 24)
    got = Counter((r["record"]["doc_id"], r["record"]["text"], r["bytes"]) for found in by.values() for r in found)
    assert got == Counter((d["doc_id"], d["text"], len(d["text"].encode()) + 8) for d in docs.collect())


def test_same_order_whatever_the_files_and_partitions(spark):
    docs = table(spark, FOLDER, "documents").limit(400)
    orders = []
    for parts, shuffles in ((1, "3"), (13, "8")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            found = shards.shuffled(docs.repartition(parts), 5, bucket_bytes=50_000).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        orders.append(sorted((r["shard"], r["slot"], r["record"]["doc_id"]) for r in found))
    assert orders[0] == orders[1]
    other = shards.shuffled(docs, 5, bucket_bytes=50_000, seed=9).collect()
    assert orders[0] != sorted((r["shard"], r["slot"], r["record"]["doc_id"]) for r in other)


def test_order_looks_uniform(spark):
    """Neighbours, equal texts and ids are spread: ranks of ids by place have next to no correlation."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    found = shards.shuffled(docs, 10, bucket_bytes=12_000).collect()
    place = {r["record"]["doc_id"]: r["shard"] * 2000 + r["slot"] for r in found}
    mean = (len(place) - 1) / 2
    top = sum((i - mean) * (p - mean) for i, p in place.items())
    assert abs(top / sum((i - mean) ** 2 for i in place)) < 0.03
    near = sum(abs(place[i] - place[i + 1]) < 100 for i in range(len(place) - 1))
    assert near < 3 * 2 * 100
    assert all(200 < sum(i < 2500 for i, p in place.items() if p // 2000 == s) < 300 for s in range(10))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, 1, "a"), (None, None, 1, "a"), (1, "", 2, None), (1, "ü", None, "b"), (2, "x" * 200_000, 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, bucket string")
    by = check_law(shards.shuffled(docs, 3, bucket_bytes=1000), 5, 3)
    assert Counter(tuple(r["record"]) for f in by.values() for r in f) == Counter(rows)
    assert {r["bytes"] for f in by.values() for r in f} == {8, 10, 200_008}
    assert shards.shuffled(docs.where("false"), 3).count() == 0
    assert len(check_law(shards.shuffled(docs, 24), 5, 24)) == 5


def test_a_third_of_all_rows_alike_is_spread(spark):
    """One id and text on 4,000 of 12,000 rows would fill one bucket; their numbers spread them."""
    docs = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"),
        (F.col("id") % 2).alias("copy"))
    by = check_law(shards.shuffled(docs, 8, bucket_bytes=6_000), 12_000, 8)
    hot = [sum(r["record"]["doc_id"] == 7 for r in by[s]) for s in range(8)]
    assert sum(hot) == 4_001 and min(hot) > 350


def test_written_shards_and_their_plan(spark):
    docs = table(spark, FOLDER, "documents")
    path = scratch_path(spark, "shards")
    shards.write_shards(docs, path, 6, bucket_bytes=200_000)
    assert len(check_law(shards.read_shards(spark, path, docs.schema), docs.count(), 6)) == 6
    plan = shards.shuffled(docs, 6)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD|CartesianProduct|BroadcastNestedLoop", plan)


def test_query(spark):
    found = QUERIES["op13_shuffled_shards"](spark, FOLDER)
    assert dict(found.dtypes).items() >= {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                                          "slot": "bigint", "grown_shard": "int"}.items()
    check_law(found, table(spark, FOLDER, "documents").count(), 24)
