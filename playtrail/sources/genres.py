"""Genre dimension and track-genre bridge, derived from the genre text of the tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.text import genre_names


def genre_id(name: Column) -> Column:
    """A genre keeps its id whatever else is loaded, and no task has to see all names."""
    return F.xxhash64(name)


def _exploded(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_uri", F.explode(genre_names(F.col("genres"))).alias("name"))


def track_genre_bridge(tracks: DataFrame) -> DataFrame:
    """(track_uri, genre_id), distinct because URIs are unique and names are within a track."""
    return _exploded(tracks).select("track_uri", genre_id(F.col("name")).alias("genre_id"))


def genre_dimension(tracks: DataFrame) -> DataFrame:
    names = _exploded(tracks).select("name").distinct()
    return names.select(genre_id(F.col("name")).alias("genre_id"), "name")
