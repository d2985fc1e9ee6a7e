"""Plays over time: hours, weekdays, days and months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions import calendar
from playtrail.functions.numeric import hour_angle, ratio, to_minutes
from playtrail.plans.collapse import collapse, within_top
from playtrail.plans.filters import known, scoped


def artist_monthly(plays, filt=None) -> DataFrame:
    return collapse(
        scoped(plays, known("artist"), filt),
        calendar.period_start("month", "ts").alias("month"),
        "artist",
    )


def artist_trends_top(plays, filt=None, limit=10) -> DataFrame:
    """Monthly plays of the artists with most time, both taken from one aggregate."""
    return within_top(artist_monthly(plays, filt), limit, "artist", "total_ms", "plays")


def daily_patterns(plays, filt=None) -> DataFrame:
    return (
        scoped(plays, filt)
        .groupBy(calendar.weekday("ts").alias("weekday"), calendar.hour("ts").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            to_minutes(F.avg("ms_played")).alias("avg_duration_min"),
        )
    )


def daily_patterns_named(plays, filt=None) -> DataFrame:
    return daily_patterns(plays, filt).withColumn(
        "weekday", calendar.weekday_name(F.col("weekday"))
    )


def hour_counts(plays, filt=None) -> DataFrame:
    return (
        scoped(plays, filt)
        .groupBy(calendar.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def hour_profile(plays, filt=None) -> DataFrame:
    """Hours over all weekdays. The average is the plain mean of the weekday averages."""
    return daily_patterns(plays, filt).groupBy("hour").agg(
        F.sum("count").alias("count"), F.avg("avg_duration_min").alias("avg_duration_min")
    )


def hour_polar(plays, filt=None) -> DataFrame:
    return hour_profile(plays, filt).select(
        "hour", "count", "avg_duration_min",
        hour_angle(F.col("hour")).alias("angle"), F.col("count").alias("radius"),
    )


def listening_trends(plays, filt=None) -> DataFrame:
    return (
        scoped(plays, filt)
        .groupBy(calendar.period_start("day", "ts").alias("ts"), calendar.hour("ts").alias("hour"))
        .agg(
            to_minutes(F.sum("ms_played")).alias("ms_played"),
            ratio(F.count_if("skipped"), F.count(F.lit(1))).alias("skip_rate"),
        )
    )


def trend_overview(plays, filt=None) -> DataFrame:
    """Mean hourly minutes of each day."""
    return listening_trends(plays, filt).groupBy("ts").agg(F.avg("ms_played").alias("avg_minutes"))


def artist_repetitiveness(plays, filt=None) -> DataFrame:
    """Per day, the percentage of plays beyond the first of each artist."""
    repeated = (1 - ratio(F.col("unique_artists"), F.col("total_plays"))) * 100
    return (
        collapse(
            scoped(plays, known("artist"), filt),
            calendar.period_start("day", "ts").alias("ts"),
            "artist",
        )
        .groupBy("ts")
        .agg(F.sum("plays").alias("total_plays"), F.count("artist").alias("unique_artists"))
        .withColumn("repetitiveness", repeated)
    )


def plays_by_day(plays, filt=None) -> DataFrame:
    return (
        scoped(plays, filt)
        .groupBy(calendar.period_start("day", "ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("play_count"),
            F.sum("ms_played").alias("total_ms"),
            F.avg("ms_played").alias("avg_ms"),
        )
        .withColumn("total_minutes", to_minutes(F.col("total_ms")))
        .withColumn("avg_minutes", to_minutes(F.col("avg_ms")))
    )
