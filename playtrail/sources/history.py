"""Play history from JSON exports: one file holds one array of plays.

Exports come in files of some megabytes, which are read whole, a file a row; ``staged_history`` reads larger ones by
``splithistory``, with the same result. The functions on documents are plain column expressions and serve batch and
streaming DataFrames alike.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.functions.calendar import country_clock
from playtrail.schemas import PLAYS

# Names in the export format.
HISTORY_GLOB = "Streaming_History_Audio_*.json"
MUSIC_URI = "spotify:track:"
WIRE_NAMES = {
    "track": "master_metadata_track_name",
    "artist": "master_metadata_album_artist_name",
    "album": "master_metadata_album_album_name",
    "track_uri": "spotify_track_uri",
    "country": "conn_country",
}
TS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SKIP_REASONS = ("forward", "back")

# What the upload path puts in place of missing fields.
UPLOAD_DEFAULTS = {
    "platform": "spotify",
    "ms_played": 0,
    "track": "",
    "artist": "",
    "album": "",
    "track_uri": "",
    "reason_start": "unknown",
    "reason_end": "unknown",
    "skipped": False,
    "country": "unknown",
}

NO_ARRAY = "no JSON array of plays"
ITEMS = "array<map<string,string>>"
# White space that a document may begin and end with.
TRIMMED = " \t\r\n\f\x0b"
# Files above this size are read by many tasks.
WHOLE_BYTES = 64 << 20


def read_text(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """The text files at ``path`` (folder or glob), found by listing one folder where that finds the same.

    Given a glob, Spark lists each file that it matches once more by itself, in a job of up to 10,000 tasks. So where only the last
    part is a glob, its folder is listed, and the files are chosen by their names. A folder that holds folders, or no file of such a
    name, is left to Spark.
    """
    folder, _, name = path.rpartition("/") if isinstance(path, str) else ("", "", "")
    parts = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder)
    plain = parts.startswith("/") and not re.search(r"[*?\[\]{}\\]|/\.{0,2}(/|$)", parts)
    if plain and re.search(r"[*?\[{]", name):
        listed = spark.read.option("recursiveFileLookup", True)
        above = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        try:
            deeper = listed.text(folder, **options).where(F.size(F.split(above, "/")) > parts.count("/") + 2)
            files = listed.option("pathGlobFilter", name).text(folder, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            if deeper.rdd.getNumPartitions() == 0 and files.rdd.getNumPartitions() > 0:
                return files
    return spark.read.text(path, **options)


def read_documents(spark: SparkSession, path: str, largest: int | None = None) -> DataFrame:
    """Files below ``path`` (folder or glob) as (source_file, body); those above ``largest`` bytes are not opened."""
    files = read_text(spark, path, wholetext=True)
    return _documents(files if largest is None else files.where(F.col("_metadata.file_size") <= largest))


def _documents(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("body"))


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of an export folder."""
    return read_documents(spark, f"{folder}/{HISTORY_GLOB}")


def _cut_after(body: Column, mark: str, keep: int) -> Column:
    """Text up to the last ``mark``, of which ``keep`` characters stay; NULL without the mark."""
    tail = F.length(F.substring_index(body, mark, -1))
    size = F.length(body) - tail - len(mark) + keep
    return F.when(F.contains(body, F.lit(mark)), F.left(body, size))


def whole_array(text: Column) -> Column:
    """The items of a text that is one JSON array and nothing else, NULL otherwise.

    The JSON parser stops after the first value and would not notice what follows. So the text is also parsed inside an
    array and inside an object with a field behind it. Whatever follows the value would have to continue both, and nothing
    but white space does.
    """
    inside = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{ITEMS}>")
    before = F.from_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":1}')), f"value {ITEMS}, end int")
    return F.when((F.size(inside) == 1) & (before["end"] == 1), before["value"])


def with_items(documents: DataFrame, recover=True) -> DataFrame:
    """(source_file, items): the plays of each document as string maps.

    Items are NULL for a document that cannot be parsed. With ``recover``, a document that does not end
    its array is cut after its last object and closed, and whatever still fails to parse is cut at its
    last ``},`` instead. The steps are separate selects so that each is evaluated once per document.
    """
    trimmed = documents.select(
        "source_file", "body", F.btrim("body", F.lit(TRIMMED)).alias("text")
    )
    text, body = F.col("text"), F.col("body")
    nothing = F.when(text == "null", F.array().cast(ITEMS))
    if not recover:
        return trimmed.select("source_file", F.coalesce(nothing, whole_array(text)).alias("items"))
    object_last = F.length(F.substring_index(text, "}", -1)) < F.length(
        F.substring_index(text, "]", -1)
    )
    closed = F.when(F.endswith(text, F.lit("]")), text).when(
        F.contains(text, F.lit("}")) & object_last,
        F.concat(_cut_after(text, "}", 1), F.lit("]")),
    )
    shorter = F.concat(_cut_after(body, "},", 1), F.lit("]"))
    items = F.coalesce(nothing, whole_array(closed), whole_array(shorter))
    return trimmed.select("source_file", items.alias("items"))


def _each_item(parsed: DataFrame, keep) -> DataFrame:
    """One row per item that ``keep`` accepts, with its place among those of its file, from 0 without gaps.

    The outer explode matters: for a plain one Spark adds a check that the array is filled, and that
    check would parse every document again.
    """
    kept = parsed.select("source_file", F.filter("items", keep).alias("items"))
    return kept.select("source_file", F.posexplode_outer("items").alias("position", "item")).where("item IS NOT NULL")


def _field(item: Column, name: str) -> Column:
    return F.try_element_at(item, F.lit(WIRE_NAMES.get(name, name)))


def is_music(item: Column) -> Column:
    return F.coalesce(F.contains(_field(item, "track_uri"), F.lit(MUSIC_URI)), F.lit(False))


def _whole_number(text: Column) -> Column:
    return F.coalesce(
        text.try_cast("bigint"), F.rint(text.try_cast("double")).try_cast("bigint")
    )


def _unreadable(item: Column) -> Column:
    ts, ms = _field(item, "ts"), _field(item, "ms_played")
    return (ts.isNotNull() & ts.try_cast("timestamp_ntz").isNull()) | (
        ms.isNotNull() & _whole_number(ms).isNull()
    )


def _skipped_by_reason(item: Column) -> Column:
    """NULL when the item has no end reason at all, false when the reason is null."""
    by_reason = F.coalesce(_field(item, "reason_end").isin(*SKIP_REASONS), F.lit(False))
    return F.when(F.map_contains_key(item, F.lit("reason_end")), by_reason)


def bulk_plays(documents: DataFrame) -> DataFrame:
    """Music plays of the documents as they are, missing fields as NULL.

    Items whose time or duration cannot be read are left out; ``load_report`` counts them.
    """
    readable = with_items(documents)
    return _each_item(readable, _loadable).select(*_bulk_fields(F.col("item")), "source_file", "position")


def _loadable(item: Column) -> Column:
    return is_music(item) & ~_unreadable(item)


def _bulk_fields(item: Column) -> list[Column]:
    typed = {
        "ts": _field(item, "ts").try_cast("timestamp_ntz"),
        "ms_played": _whole_number(_field(item, "ms_played")),
        "skipped": _skipped_by_reason(item),
    }
    return [typed.get(n, _field(item, n)).alias(n) for n in PLAYS.fieldNames()]


def _counted(parsed: DataFrame, *kept) -> DataFrame:
    """For each row of ``parsed`` the numbers of its items: plays, plays that cannot be read, other content."""
    items = F.col("items")

    def number(condition):
        return F.coalesce(F.size(F.filter(items, condition)), F.lit(0)).cast("bigint")

    return parsed.select(
        "source_file", *kept, number(_loadable).alias("inserted"), number(lambda i: is_music(i) & _unreadable(i)).alias("failed"),
        number(lambda i: (F.size(i) > 0) & ~is_music(i)).alias("skipped_content"))


def _with_status(counts: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("broken"), "failed")
        .when(F.col("inserted") + F.col("failed") > 0, "loaded")
        .when(F.col("skipped_content") > 0, "skipped")
        .otherwise("empty")
    )
    return counts.withColumn("status", status).drop("broken")


def staged_plays(documents: DataFrame) -> DataFrame:
    """The rows of ``bulk_plays``, and with each row the counts of its document, whose items are parsed once.

    A document without plays has one row, without position. ``plays_of`` and ``report_of`` take what is staged apart.
    """
    counts = _counted(with_items(documents), F.filter("items", _loadable).alias("kept"), F.col("items").isNull().alias("broken"))
    totals = ["failed", "skipped_content", "broken"]
    rows = counts.select("source_file", *totals, F.posexplode_outer("kept").alias("position", "item"))
    return rows.select(*_bulk_fields(F.col("item")), "source_file", F.col("position").cast("bigint").alias("position"), *totals)


def plays_of(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("position").isNotNull()).select(*PLAYS.fieldNames(), "source_file", "position")


def report_of(staged: DataFrame) -> DataFrame:
    """``load_report`` from what is staged."""
    counts = staged.groupBy("source_file").agg(
        F.bool_or("broken").alias("broken"), F.count("position").alias("inserted"), F.max("failed").alias("failed"),
        F.max("skipped_content").alias("skipped_content"))
    return _with_status(counts)


def staged_history(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, range_bytes: int | None = None) -> DataFrame:
    """``staged_plays`` of all files below ``path``; those above ``whole_bytes`` are read by many tasks, in ranges of
    ``range_bytes`` (those of the session, if None).

    Sizes come from the listing of the folder, so no file is opened for them and the driver sees no names.
    """
    from playtrail.sources import splithistory

    files, size = read_text(spark, path, wholetext=True), F.col("_metadata.file_size")
    staged = staged_plays(_documents(files.where(size <= whole_bytes)))
    if files.where(size > whole_bytes).rdd.getNumPartitions() == 0:
        return staged
    items, files = splithistory.split_items(spark, path, above=whole_bytes, range_bytes=range_bytes)
    counts = _counted(items).groupBy("source_file").agg(F.sum("failed").alias("failed"), F.sum("skipped_content").alias("skipped_content"))
    zero = F.lit(0).cast("bigint")
    files = files.join(counts, "source_file", "left").select(
        "source_file", F.coalesce("failed", zero).alias("failed"), F.coalesce("skipped_content", zero).alias("skipped_content"), "broken")
    rows = files.join(splithistory.numbered_in_file(items, _loadable), "source_file", "left")
    return staged.unionByName(rows.select(*_bulk_fields(F.col("item")), "source_file", "position", "failed", "skipped_content", "broken"))


def load_report(documents: DataFrame) -> DataFrame:
    """Per file: plays loaded, plays that cannot be read, other content skipped, and a status.

    Counted inside each document, so nothing is exploded or shuffled.
    """
    return _with_status(_counted(with_items(documents), F.col("items").isNull().alias("broken")))


def upload_plays(documents: DataFrame, shift_clock=True, recover=False) -> DataFrame:
    """Plays of uploaded documents with every gap filled and the clock moved by country.

    Every item that is no null is kept, music or not, with fields or without. A document that is no JSON array, or a time that cannot be read,
    fails the job. With ``recover`` truncated documents are cut as in the bulk load, and only hopeless
    ones fail.
    """
    items = F.col("items")
    refused = F.raise_error(F.concat(F.lit(f"{NO_ARRAY}: "), F.col("source_file")))
    readable = with_items(documents, recover).select(
        "source_file", F.when(items.isNull(), refused.cast(ITEMS)).otherwise(items).alias("items")
    )
    plays = _each_item(readable, lambda i: i.isNotNull()).select(*_upload_fields(F.col("item")), "source_file", "position")
    return shift_by_country(plays) if shift_clock else plays


def _upload_fields(item: Column) -> list[Column]:
    raw = {n: _field(item, n) for n in PLAYS.fieldNames()}
    typed = {
        **raw,
        "ts": F.to_timestamp_ntz(raw["ts"], F.lit(TS_PATTERN)),
        "ms_played": raw["ms_played"].cast("bigint"),
        "skipped": raw["skipped"].cast("boolean"),
        "platform": F.lit(None).cast("string"),
    }
    return [
        (F.coalesce(typed[n], F.lit(UPLOAD_DEFAULTS[n])) if n in UPLOAD_DEFAULTS else typed[n]).alias(n)
        for n in PLAYS.fieldNames()
    ]


def _refusal(items: Column) -> Column:
    """Why the upload refuses a document with these items; NULL where it does not."""

    def some(name, read):
        return F.exists(items, lambda i: _field(i, name).isNotNull() & read(_field(i, name)).isNull())

    return (
        F.when(items.isNull(), NO_ARRAY)
        .when(some("ts", lambda v: F.try_to_timestamp(v, F.lit(TS_PATTERN))), "a time cannot be read")
        .when(some("ms_played", lambda v: v.try_cast("bigint")), "a duration cannot be read")
        .when(some("skipped", lambda v: v.try_cast("boolean")), "a skip flag cannot be read")
    )


def upload_or_refuse(documents: DataFrame, shift_clock=True, recover=False) -> DataFrame:
    """``upload_plays`` with one more column, ``refused``: a document that would fail the job has one row, without play, that
    says why."""
    judged = with_items(documents, recover).select("source_file", "items", _refusal(F.col("items")).alias("refused"))
    given = F.when(F.col("refused").isNull(), F.filter("items", lambda i: i.isNotNull()))
    rows = judged.select("source_file", "refused", given.alias("items")).select(
        "source_file", "refused", F.posexplode_outer("items").alias("position", "item"))
    rows = rows.where(F.col("item").isNotNull() | F.col("refused").isNotNull())
    accepted = F.col("refused").isNull()
    fields = [F.when(accepted, c).alias(n) for n, c in zip(PLAYS.fieldNames(), _upload_fields(F.col("item")))]
    plays = rows.select(*fields, "source_file", "position", "refused")
    return shift_by_country(plays) if shift_clock else plays


def bulk_or_refuse(documents: DataFrame) -> DataFrame:
    """``bulk_plays`` with one more column, ``refused``: a document that cannot be read has one row, without play, that says why."""
    staged = staged_plays(documents)
    staged = staged.where(F.col("position").isNotNull() | F.col("broken"))
    return staged.select(*PLAYS.fieldNames(), "source_file", F.col("position").cast("int").alias("position"),
                         F.when(F.col("broken"), NO_ARRAY).alias("refused"))


def shift_by_country(plays: DataFrame) -> DataFrame:
    return plays.withColumn("ts", country_clock(F.col("ts"), F.col("country")))
