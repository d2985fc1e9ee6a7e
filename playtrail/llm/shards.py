"""Shuffled shards by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters records into buckets by a seeded hash of their id and text; a bucket is about ``bucket_bytes``,
so one task can hold it, and Spark's shuffle files are its external form. The second pass gives every bucket one
Fisher-Yates permutation (Spark's ``shuffle``), lays the buckets end to end, and writes the records at their new places.
A shard is an equal share of the places, so the counts of shards differ by one at most.

Permutations are drawn from a range of bucket numbers, whose partitions are fixed, and records enter a bucket in the order of
their hashes. The same rows, seed and sizes thus give the same shards, whatever the files, the cores and the retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.llm.shared import free_name

BUCKET_BYTES = 64_000_000
RECORD_BYTES = 8
SEED = 41
# Bucket numbers per partition where permutations are drawn and where offsets are summed up; part of the result.
DRAWN_TOGETHER = 16
SUMMED_TOGETHER = 1024


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the number of each row among the rows equal to it, counted without gathering them."""
    counted = docs.groupBy(*[F.col(f"`{c}`") for c in docs.columns]).agg(F.count(F.lit(1)).alias(f"{name}_n"))
    each = counted.withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{name}_n"))))
    return each.drop(f"{name}_n")


def shuffled(docs: DataFrame, shards: int, id_col="doc_id", text_col="text", bucket_bytes: int = BUCKET_BYTES,
             seed: int = SEED) -> DataFrame:
    """``(record, bytes, shard, slot)``: every row once, as a struct of its own columns, at its place.

    ``bytes`` is the size of the text in UTF-8 and 8 more; ``slot`` runs from 0 in each shard without gaps. Null ids and
    texts are values like any other (a null text has no bytes), a very long text is a record like any other, no rows give no
    rows, and shards beyond the number of rows stay empty. Rows equal in id and text share a bucket; where so many do that a
    bucket holds more than twice its share, rows equal in all columns are numbered and scattered by their number as well (those
    columns must then be of types that can be grouped). ``docs`` is read three times and must hold the same rows each time.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint") + F.lit(RECORD_BYTES)
    rows, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))

    def scattered(*more):
        key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), *more)
        return F.pmod(key, F.lit(buckets)).alias("bucket"), F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col), *more)

    def counted(given, *more):
        return given.groupBy(scattered(*more)[0]).agg(F.count(F.lit(1)).alias("n"))

    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given, more, counts = docs, [], counted(docs)
    largest = counts.agg(F.max("n")).first()[0] or 0
    if buckets > 1 and largest > 2 * rows / buckets + 1000:
        name = free_name(docs, "copy")
        given, more = _numbered(docs, name), [F.col(name)]
        counts = counted(given, *more)
        largest = counts.agg(F.max("n")).first()[0]

    # Sums of neighbouring buckets first, so that the one ordered sum has a thousandth of the buckets.
    together = F.floor(F.col("bucket") / SUMMED_TOGETHER)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy(together.alias("group")).agg(F.sum("n").alias("n")).select(
        "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("group_start"))
    within = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("group", together).join(groups, "group").select(
        "bucket", "n", (F.col("group_start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"))

    # A uniform order of the largest bucket's places is a uniform order of the fewer places of another.
    drawn = spark.range(0, buckets, 1, -(-buckets // DRAWN_TOGETHER)).select(
        F.col("id").alias("bucket"), F.shuffle(F.sequence(F.lit(1), F.lit(max(1, largest))), seed).alias("places"))
    orders = drawn.join(starts, "bucket").select(
        "bucket", "start", F.filter("places", lambda p: p <= F.col("n")).alias("places"))

    bucket, ordered = scattered(*more)
    placed = given.select(record.alias("record"), size.alias("bytes"), bucket, ordered.alias("ordered"))
    entered = Window.partitionBy("bucket").orderBy("ordered", F.xxhash64("record"))
    placed = placed.withColumn("entered", F.row_number().over(entered)).join(orders, "bucket")
    place = F.col("start") + F.element_at("places", F.col("entered")) - 1
    # In whole numbers: a shard begins at the first place p with p * shards >= shard * rows.
    placed = placed.select("record", "bytes", place.cast("bigint").alias("place")).withColumn(
        "shard", F.expr(f"place * {shards} div {max(1, rows)}"))
    return placed.select("record", "bytes", F.col("shard").cast("int").alias("shard"),
                         F.expr(f"place - (shard * {rows} + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """``shuffled`` as Parquet, a folder ``shard=...`` for each shard, rows of a file in the order of their slots."""
    found = shuffled(docs, shards, **options)
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, records) -> DataFrame:
    """What ``write_shards`` wrote, ``records`` being the schema of the documents."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([StructField("record", records), StructField("bytes", LongType()), StructField("slot", LongType()),
                         StructField("shard", IntegerType())])
    return spark.read.schema(schema).parquet(path)
