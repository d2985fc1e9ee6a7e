"""History files of any size: one JSON array read by many tasks.

The text reader can be told to end its records at closing braces, and then it splits a file like any text. What a brace means
depends on all that stands before it: whether it lies inside a string, and how deep. Each byte range is therefore summed up
for both cases, inside and outside a string at its beginning; one pass over the ranges of a file, few rows, tells which case
holds and at what depth; and then every record knows its place. A brace that closes an object of the array ends a segment: the
object, and whatever stood between it and the one before. Segments are parsed singly, and a file is valid where all its
segments are, so the same cut points follow as from reading the file whole (see ``history.with_items``).

No step gathers more than one segment. One that is larger than ``cell_bytes`` counts as unreadable, and so does a file without
any closing brace for 2 GB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtrail.session import scratch_path
from playtrail.sources.history import ITEMS, TRIMMED, read_text, whole_array

CELL_BYTES = 256 << 20
# Segments whose plays are numbered together.
NUMBERED_TOGETHER = 4096


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_pieces(spark: SparkSession, paths, above: int | None = None) -> DataFrame:
    """(source_file, size, block, place, text): the files cut behind each closing brace, which the text leaves out.

    ``block`` is the first byte of the range that was read, ``place`` the order inside the range. With ``above``, only files of more
    bytes are opened. Many small ranges are read by one task, else what is written has a file for each.
    """
    files = read_text(spark, paths, lineSep="}")
    if above is not None:
        files = files.where(F.col("_metadata.file_size") > above)
    pieces = files.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"))
    return pieces.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def _read_in_ranges(spark: SparkSession, paths, above: int | None, range_bytes: int | None) -> DataFrame:
    """``read_pieces``, written, with ranges of ``range_bytes`` in place of the session's; other tables keep the latter."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if range_bytes is not None:
        spark.conf.set(key, str(range_bytes))
    try:
        return _kept(read_pieces(spark, paths, above), "read-pieces")
    finally:
        spark.conf.set(key, before)


def _count(text, marks: str):
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _located(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``last`` (nothing follows in the file), ``closed`` (a brace follows the text), ``inside`` and ``depth`` at
    their beginning, ``ends`` (the brace closes an object of the array) and ``segment``."""
    before = Window.partitionBy("source_file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column, window):
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    # A reader that finds a brace at the end of the file does not return an empty text behind it; the sizes tell.
    whole = pieces.groupBy("source_file").agg(
        F.max(F.struct("block", "place")).alias("at"), (F.max("size") - F.sum(F.octet_length("text") + 1)).alias("lack"))
    whole = whole.select("source_file", "at", (F.col("lack").isin(-1, 2)).alias("open_end"))
    rows = pieces.join(whole, "source_file").withColumn("last", F.struct("block", "place") == F.col("at"))
    rows = rows.withColumn("closed", ~(F.col("last") & F.col("open_end"))).drop("at", "open_end", "size")
    # Without escapes every quote opens or closes a string, and every second part lies outside.
    bare = F.regexp_replace(F.concat("text", F.when(F.col("closed"), "}").otherwise("")), r"(?s)\\.", "")
    rows = rows.withColumn("parts", F.split(bare, '"', -1))

    def deeper(inside):
        outside = F.array_join(F.filter("parts", lambda x, i: (i + inside) % 2 == 0), "")
        return (_count(outside, "{[") - _count(outside, "}]")).cast("bigint")

    rows = rows.withColumns({"quotes": (F.size("parts") - 1).cast("bigint"), "out": deeper(0), "in": deeper(1)}).drop("parts")
    rows = rows.withColumn("local", so_far("quotes", before))
    even = F.col("local") % 2 == 0
    blocks = rows.groupBy("source_file", "block").agg(
        F.sum("quotes").alias("quotes"), F.sum(F.when(even, F.col("out")).otherwise(F.col("in"))).alias("out"),
        F.sum(F.when(even, F.col("in")).otherwise(F.col("out"))).alias("in"))
    blocks = blocks.withColumn("parity", so_far("quotes", earlier) % 2)
    blocks = blocks.withColumn("change", F.when(F.col("parity") == 0, F.col("out")).otherwise(F.col("in")))
    blocks = blocks.select("source_file", "block", "parity", so_far("change", earlier).alias("start"))
    rows = rows.join(blocks, ["source_file", "block"])
    rows = rows.withColumn("inside", (F.col("parity") + F.col("local")) % 2 == 1)
    rows = rows.withColumn("change", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
    rows = rows.withColumn("depth", F.col("start") + so_far("change", before))
    structural = F.col("closed") & ((F.col("quotes") + F.col("inside").cast("bigint")) % 2 == 0)
    rows = rows.withColumn("ends", structural & (F.col("depth") + F.col("change") == 1))
    rows = _kept(rows.select("source_file", "block", "place", "text", "last", "closed", "inside", "depth", "ends"), "pieces")
    ended = F.col("ends").cast("bigint")
    counts = rows.groupBy("source_file", "block").agg(F.sum(ended).alias("n"))
    counts = counts.select("source_file", "block", so_far("n", earlier).alias("earlier"))
    return rows.join(counts, ["source_file", "block"]).withColumn("segment", F.col("earlier") + so_far(ended, before)).drop("earlier")


def _segments(rows: DataFrame, cell_bytes: int) -> DataFrame:
    """(source_file, segment, closed, text): the text of each segment, NULL where it is too large for a cell."""
    sizes = rows.groupBy("source_file", "segment").agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    large = sizes.where(F.col("bytes") > cell_bytes).select("source_file", "segment", F.lit(True).alias("large"))
    part = F.concat("text", F.when(F.col("closed"), "}").otherwise(""))
    rows = rows.join(large, ["source_file", "segment"], "left").withColumn("part", F.when(F.col("large").isNull(), part))
    found = rows.groupBy("source_file", "segment").agg(
        F.bool_or("ends").alias("closed"), F.bool_or(F.col("large").isNotNull()).alias("large"),
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("block", "place", "part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return found.select("source_file", "segment", "closed", F.when(~F.col("large"), text).alias("text"))


def split_items(spark: SparkSession, paths, cell_bytes: int = CELL_BYTES, above: int | None = None,
                range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The items of the files as (source_file, segment, items), and (source_file, broken) for every file that is not empty.

    ``paths`` are files, or a folder or glob of which the files of more than ``above`` bytes are taken.
    """
    rows = _kept(_located(_read_in_ranges(spark, paths, above, range_bytes)), "located")
    text, first = F.col("text"), F.col("segment") == 0
    head = F.when(first, F.ltrim(text, F.lit(TRIMMED))).otherwise(text)
    # Behind another segment the text goes on with a comma; in place of what is before it an empty item stands.
    array = F.when(first, head).otherwise(F.concat(F.lit("[null"), text))
    array = F.when(F.col("closed"), F.concat(array, F.lit("]"))).otherwise(F.rtrim(array, F.lit(TRIMMED)))
    parsed = _segments(rows, cell_bytes).select(
        "source_file", "segment", "closed",
        F.when(first & ~F.col("closed") & (F.btrim(text, F.lit(TRIMMED)) == "null"), F.array().cast(ITEMS))
        .otherwise(whole_array(array)).alias("all"))
    items = F.when(first, F.col("all")).otherwise(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))))
    parsed = _kept(parsed.select("source_file", "segment", "closed", items.alias("items")), "parsed")

    unread = F.col("items").isNull()
    segments = parsed.groupBy("source_file").agg(
        F.count_if("closed").alias("n"), F.min(F.when(F.col("closed") & unread, F.col("segment"))).alias("bad"),
        F.bool_or(~F.col("closed") & F.col("items").isNotNull()).alias("tail"))
    # Where the last brace and the last brace with a comma stand, and what follows the former.
    comma = F.startswith(text, F.lit(",")) & ((F.col("block") > 0) | (F.col("place") != F.col("top")))
    top = rows.where("block = 0").groupBy("source_file").agg(F.min("place").alias("top"))
    place = F.struct("block", "place")
    marks = rows.join(top, "source_file").groupBy("source_file").agg(
        F.max_by(F.struct("inside", "depth", "segment"), F.when(comma, place)).alias("comma"),
        F.max_by("ends", F.when(F.col("closed"), place)).alias("object_end"),
        F.max_by(F.when(~F.col("closed"), text), F.when(F.col("last"), place)).alias("behind"),
        F.bool_or("closed").alias("braces"))
    behind = F.coalesce(F.col("behind"), F.lit(""))
    ended = F.endswith(F.rtrim(behind, F.lit(TRIMMED)), F.lit("]"))
    files = segments.join(marks, "source_file")
    no_bad = F.col("bad").isNull()
    plain = F.btrim(behind, F.lit(TRIMMED)) == "null"
    whole = (ended | (plain & ~F.col("braces"))) & no_bad & F.coalesce(F.col("tail"), F.lit(False))
    cut = ~ended & F.col("braces") & ~F.contains(behind, F.lit("]")) & no_bad & F.col("object_end")
    shorter = ~F.col("comma.inside") & (F.col("comma.depth") == 1) & (no_bad | (F.col("bad") >= F.col("comma.segment")))
    # How many segments stay; the one behind the last object counts where the array is closed.
    stay = F.when(whole, F.col("n") + 1).when(cut, F.col("n")).when(F.coalesce(shorter, F.lit(False)), F.col("comma.segment"))
    files = _kept(files.select("source_file", stay.alias("stay")), "files")
    found = parsed.join(files, "source_file").where(F.col("segment") < F.col("stay")).select("source_file", "segment", "items")
    return found, files.select("source_file", F.col("stay").isNull().alias("broken"))


def numbered_in_file(items: DataFrame, keep) -> DataFrame:
    """(source_file, position, item): the items that ``keep`` accepts, with their place among those of their file."""
    kept = items.select("source_file", "segment", F.filter("items", keep).alias("items")).withColumn("n", F.size("items").cast("bigint"))
    together = F.floor(F.col("segment") / NUMBERED_TOGETHER)
    before = Window.partitionBy("source_file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = kept.groupBy("source_file", together.alias("group")).agg(F.sum("n").alias("n")).select(
        "source_file", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_file", "group").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.where("n > 0").withColumn("group", together).withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(groups, ["source_file", "group"]).select(
        "source_file", (F.col("start") + F.col("inner")).alias("base"), F.posexplode("items").alias("i", "item"))
    return placed.select("source_file", (F.col("base") + F.col("i")).alias("position"), "item")
