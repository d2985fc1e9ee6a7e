"""Track metadata: CSV and Parquet sources, defaults, and the upsert on the track URI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.schemas import TRACKS

# What stands for a missing field.
TRACK_DEFAULTS = {
    "track": "",
    "artist": "",
    "track_popularity": 0,
    "album": "",
    "duration_ms": 0,
    "explicit": False,
    "album_type": "unknown",
    "total_tracks": 0,
    "genres": "",
    "artist_popularity": 0,
    "artist_uri": "",
    "artist_followers": 0,
}

# Marks the place of a row in its input; the later row of a key wins.
LOAD_ORDER = "_load_order"


def _in_input_order(rows: DataFrame) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    return rows.withColumn(LOAD_ORDER, place)


def read_metadata_csv(spark: SparkSession, path: str, multi_line=False) -> DataFrame:
    """CSV with a header in any column order; ``track_uri`` is required, every value is text.

    Files are split among tasks. Quoted values with line breaks must be declared by ``multi_line``, which keeps each file in
    one task. Undeclared ones leave lines with an open quote; those are looked for first and refused.
    """
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
            raise ValueError("a quoted value holds a line break: read with multi_line=True")
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line,
               "enforceSchema": False, "mode": "FAILFAST"}
    rows = spark.read.options(**options).csv(path)
    if "track_uri" not in rows.columns:
        raise ValueError("missing required columns: track_uri")
    return _in_input_order(rows)


def read_metadata_parquet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    if "track_uri" not in rows.columns:
        raise ValueError("missing required columns: track_uri")
    return _in_input_order(rows)


def release_day(text: Column, strict=True) -> Column:
    """Date of a possibly empty text. A bare year or month fails when strict, else its first day."""
    filled = F.nullif(F.trim(text), F.lit(""))
    if not strict:
        return filled.try_cast("date")
    full = filled.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    refused = F.raise_error(F.concat(F.lit("not a release date: "), filled)).cast("date")
    return F.when(filled.isNull(), F.lit(None).cast("date")).when(full, filled.cast("date")).otherwise(
        refused
    )


def clean_metadata(rows: DataFrame, strict=True) -> DataFrame:
    """Rows with a URI in the table's types and with defaults for missing fields.

    Values that do not fit their type fail the job when strict and count as missing otherwise.
    """

    def typed(field):
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType)
        value = F.col(field.name)
        if field.name == "album_release_date":
            return release_day(value.cast("string"), strict)
        return value.cast(field.dataType) if strict else value.try_cast(field.dataType)

    keep = [LOAD_ORDER] if LOAD_ORDER in rows.columns else []
    known = rows.where(F.col("track_uri").isNotNull())
    return known.select(*[typed(f).alias(f.name) for f in TRACKS.fields], *keep).fillna(TRACK_DEFAULTS)


def last_per_track(rows: DataFrame, order=LOAD_ORDER) -> DataFrame:
    """The last row of each track. A combining aggregate, so a repeated URI is no hot group."""
    fields = [c for c in rows.columns if c not in ("track_uri", order)]
    return (
        rows.groupBy("track_uri")
        .agg(F.max_by(F.struct(*fields), F.col(order)).alias("row"))
        .select("track_uri", "row.*")
    )


def upsert_tracks(current: DataFrame, incoming: DataFrame, order=LOAD_ORDER) -> DataFrame:
    """``current`` with its tracks replaced by, and extended with, the last incoming rows.

    Both sides of the join hold a track once, so no key is hot, and the incoming side is already
    partitioned by track from its aggregate. Write the result to a new location; it reads ``current``.
    """
    fields = [c for c in current.columns if c != "track_uri"]
    fresh = last_per_track(incoming, order).select("track_uri", F.struct(*fields).alias("fresh"))
    row = F.coalesce("fresh", F.struct(*fields)).alias("row")
    both = current.join(fresh, "track_uri", "full_outer").select("track_uri", row)
    return both.select("track_uri", "row.*").select(*current.columns)
