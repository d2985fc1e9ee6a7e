"""Table schemas. ``tracks.track_uri`` is the primary key: every writer keeps it unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PLAYS = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("platform", T.StringType()),
    T.StructField("ms_played", T.LongType()),
    T.StructField("track", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("album", T.StringType()),
    T.StructField("track_uri", T.StringType()),
    T.StructField("reason_start", T.StringType()),
    T.StructField("reason_end", T.StringType()),
    T.StructField("skipped", T.BooleanType()),
    T.StructField("country", T.StringType()),
])

# Uploaded history carries a generated id in front.
PLAYS_WITH_ID = T.StructType([T.StructField("id", T.LongType()), *PLAYS.fields])

# As stored: bulk loads have no id, and the last two columns are the partition columns.
PLAYS_STORED = T.StructType([
    *PLAYS_WITH_ID.fields,
    T.StructField("load_id", T.StringType()),
    T.StructField("play_date", T.DateType()),
])

TRACKS = T.StructType([
    T.StructField("track_uri", T.StringType()),
    T.StructField("track", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("track_popularity", T.IntegerType()),
    T.StructField("album_release_date", T.DateType()),
    T.StructField("album", T.StringType()),
    T.StructField("duration_ms", T.IntegerType()),
    T.StructField("explicit", T.BooleanType()),
    T.StructField("album_type", T.StringType()),
    T.StructField("total_tracks", T.IntegerType()),
    T.StructField("genres", T.StringType()),
    T.StructField("artist_popularity", T.IntegerType()),
    T.StructField("artist_uri", T.StringType()),
    T.StructField("artist_followers", T.LongType()),
])

GENRES = T.StructType([
    T.StructField("genre_id", T.LongType()),
    T.StructField("name", T.StringType()),
])

TRACK_GENRES = T.StructType([
    T.StructField("track_uri", T.StringType()),
    T.StructField("genre_id", T.LongType()),
])

TABLES = {
    "plays": PLAYS,
    "tracks": TRACKS,
    "genres": GENRES,
    "track_genres": TRACK_GENRES,
}


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cut to the schema's columns; raises when one is absent or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    absent = [f.name for f in schema.fields if f.name not in have]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    wrong = [f.name for f in schema.fields if have[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"columns of another type: {', '.join(wrong)}")
    return df.select(*schema.fieldNames())
