"""Row-level joins of plays with their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions import calendar
from playtrail.functions.text import strip_list_marks
from playtrail.plans.filters import scoped

# The facts of a track that enriched plays carry, in their order.
_TRACK_FACTS = (
    "album_release_date",
    "track_popularity",
    "explicit",
    "album_type",
    "total_tracks",
    "genres",
    "artist_popularity",
    "artist_followers",
)


def enriched_plays(plays: DataFrame, tracks: DataFrame, filt=None) -> DataFrame:
    """Every play with calendar fields and what is known of its track.

    Rows are not collapsed, so a track may be hot: a small dimension is broadcast by its measured size,
    and beyond that adaptive execution splits the hot partition of the left side.
    """
    facts = [c for c in _TRACK_FACTS if c in tracks.columns]
    rows = scoped(plays, filt).withColumns({
        "month": calendar.period_start("month", "ts"),
        "year": calendar.year("ts"),
        "weekday": calendar.weekday("ts"),
        "hour": calendar.hour("ts"),
    })
    return rows.join(tracks.select("track_uri", *facts), "track_uri", "left")


def enriched_plays_clean(plays, tracks, filt=None) -> DataFrame:
    return enriched_plays(plays, tracks, filt).withColumn(
        "genres", strip_list_marks(F.col("genres"))
    )


def plays_with_tracks(plays: DataFrame, tracks: DataFrame, *facts, filt=None) -> DataFrame:
    """Plays whose track is known, with the chosen facts."""
    return scoped(plays, filt).join(tracks.select("track_uri", *facts), "track_uri")


def plays_with_genres(plays, genres, track_genres, filt=None) -> DataFrame:
    """One row per play and genre of its track."""
    named = track_genres.join(genres.select("genre_id", F.col("name").alias("genre")), "genre_id")
    return scoped(plays, filt).join(named, "track_uri")


def preview(df: DataFrame, rows=100) -> DataFrame:
    return df.limit(rows)
