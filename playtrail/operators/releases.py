"""Release years of the music played."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions import calendar
from playtrail.functions.numeric import ratio
from playtrail.plans.collapse import collapse, collapse_by_track
from playtrail.plans.filters import known, sane_release, scoped


def _years(tracks: DataFrame, rule) -> DataFrame:
    """Release years of the tracks that pass ``rule``."""
    year = calendar.year("album_release_date").alias("release_year")
    return tracks.where(rule).select("track_uri", year)


def release_years(plays, tracks, filt=None, as_of=None) -> DataFrame:
    return (
        collapse(scoped(plays, filt), "track_uri")
        .join(_years(tracks, sane_release(as_of=as_of)), "track_uri")
        .groupBy("release_year")
        .agg(
            F.count("track_uri").alias("unique_tracks"),
            F.sum("total_ms").alias("total_ms"),
            F.sum("plays").alias("play_count"),
        )
    )


def release_decades(plays, tracks, filt=None, as_of=None) -> DataFrame:
    """A track has one release year, so its years' distinct counts add up."""
    return (
        release_years(plays, tracks, filt, as_of)
        .groupBy(calendar.decade(F.col("release_year")).alias("decade"))
        .agg(
            F.sum("total_ms").alias("total_ms"),
            F.sum("play_count").alias("play_count"),
            F.sum("unique_tracks").alias("unique_tracks"),
        )
    )


def release_by_month(plays, tracks, filt=None, as_of=None) -> DataFrame:
    month = {"period": calendar.period_start("month", "ts")}
    years = _years(tracks, sane_release(as_of=as_of))
    return collapse_by_track(scoped(plays, filt), years, month, ["release_year"]).withColumnRenamed(
        "plays", "count"
    )


def avg_release_year(plays, tracks, filt=None, as_of=None) -> DataFrame:
    weighted = F.sum(F.col("release_year") * F.col("count"))
    return release_by_month(plays, tracks, filt, as_of).groupBy("period").agg(
        ratio(weighted, F.sum("count")).alias("avg_release_year"),
        F.min("release_year").alias("min_release_year"),
        F.max("release_year").alias("max_release_year"),
    )


def same_year_share(plays, tracks, filt=None) -> DataFrame:
    """Per listening year, the share of music released that year; any known date counts."""
    years = _years(tracks, known("album_release_date"))
    same = F.when(F.col("year") == F.col("release_year"), F.col("plays")).otherwise(0)
    return (
        collapse_by_track(scoped(plays, filt), years, {"year": calendar.year("ts")}, ["release_year"])
        .groupBy("year")
        .agg(F.sum("plays").alias("total_plays"), F.sum(same).alias("same_year_plays"))
        .withColumn(
            "percentage", ratio(F.col("same_year_plays"), F.col("total_plays")) * 100
        )
    )
