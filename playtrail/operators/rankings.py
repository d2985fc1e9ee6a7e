"""Top tracks, artists and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.numeric import ratio
from playtrail.functions.text import duration_text, item_label, pair_label
from playtrail.plans.collapse import collapse, top
from playtrail.plans.filters import known, played, scoped


def _totals(plays: DataFrame, *keys) -> DataFrame:
    return collapse(plays, *keys).withColumnRenamed("plays", "play_count")


def _with_tracks(plays: DataFrame, *keys) -> DataFrame:
    """Totals and distinct tracks per key; the distinct count runs over collapsed rows."""
    return collapse(plays, *keys, "track").groupBy(*keys).agg(
        F.sum("total_ms").alias("total_ms"),
        F.sum("plays").alias("play_count"),
        F.count("track").alias("unique_tracks"),
    )


def top_tracks(plays, filt=None, limit=100) -> DataFrame:
    totals = _totals(scoped(plays, filt), "track", "artist")
    return top(totals, limit, "total_ms", "track", "artist")


def top_tracks_detail(plays, filt=None, limit=25) -> DataFrame:
    totals = _totals(scoped(plays, played(), filt), "track", "artist", "album")
    best = top(totals, limit, "total_ms", "track", "artist", "album")
    return best.select(
        "*",
        duration_text(F.col("total_ms")).alias("duration_display"),
        pair_label("artist", "track").alias("track_label"),
    )


def top_artists(plays, filt=None, limit=100) -> DataFrame:
    return top(_with_tracks(scoped(plays, filt), "artist"), limit, "total_ms", "artist")


def top_artists_known(plays, filt=None, limit=50) -> DataFrame:
    totals = _totals(scoped(plays, known("artist"), filt), "artist")
    return top(totals, limit, "total_ms", "artist").withColumn(
        "item_tooltip", item_label(F.col("artist"), F.col("total_ms"), F.col("play_count"))
    )


def top_albums(plays, filt=None, limit=100) -> DataFrame:
    totals = _with_tracks(scoped(plays, filt), "album", "artist")
    return top(totals, limit, "total_ms", "album", "artist")


def top_albums_known(plays, filt=None, limit=50) -> DataFrame:
    totals = _with_tracks(scoped(plays, known("album", allow_empty=False), filt), "album", "artist")
    label = F.col("album_label")
    return (
        top(totals, limit, "total_ms", "album", "artist")
        .withColumn("album_label", pair_label("album", "artist"))
        .withColumn("item_tooltip", item_label(label, F.col("total_ms"), F.col("play_count")))
    )


def album_completion(plays, filt=None, albums=50, limit=20) -> DataFrame:
    """Among the top albums, those with the fewest distinct tracks per play."""
    completion = ratio(F.col("unique_tracks"), F.col("play_count"))
    order = [F.col(c).asc_nulls_last() for c in ("completion_ratio", "album", "artist")]
    return (
        top_albums_known(plays, filt, albums)
        .withColumn("completion_ratio", completion)
        .orderBy(*order)
        .limit(limit)
        .select("album_label", "unique_tracks", "play_count", "completion_ratio")
    )


def most_listened(plays, limit=10) -> DataFrame:
    totals = collapse(plays, "track", "artist").select("track", "artist", "total_ms")
    return top(totals, limit, "total_ms", "track", "artist")
