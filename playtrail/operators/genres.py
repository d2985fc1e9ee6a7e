"""Genre analyses, at two grains: the whole genre text of a track, or its single genres.

With single genres a play counts once for each genre of its track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions import calendar
from playtrail.functions.numeric import ratio
from playtrail.functions.text import item_label
from playtrail.operators.overview import auto_granularity
from playtrail.plans.collapse import collapse, collapse_by_track, top, within_top
from playtrail.plans.filters import played, scoped


def _texts(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_uri", F.col("genres").alias("genre"))


def _period(unit: str) -> dict:
    return {"period": calendar.period_start(unit, "ts")}


def _named(per_id: DataFrame, genres: DataFrame) -> DataFrame:
    return per_id.join(genres.select("genre_id", F.col("name").alias("genre")), "genre_id")


def top_genre_text(plays, tracks, filt=None, limit=100) -> DataFrame:
    totals = (
        collapse_by_track(scoped(plays, filt), _texts(tracks), {"track": F.col("track")}, ["genre"])
        .groupBy("genre")
        .agg(
            F.sum("total_ms").alias("total_ms"),
            F.sum("plays").alias("play_count"),
            F.count("track").alias("unique_tracks"),
        )
    )
    return top(totals, limit, "total_ms", "genre")


def artist_popularity(plays, tracks, filt=None, limit=50) -> DataFrame:
    """Mean popularity over the plays of each artist, for the artists played most."""
    rated = F.when(F.col("artist_popularity").isNotNull(), F.col("plays"))
    popularity = ratio(F.sum(F.col("artist_popularity") * F.col("plays")), F.sum(rated))
    known = tracks.select("track_uri", "artist_popularity")
    totals = (
        collapse_by_track(scoped(plays, filt), known, {"artist": F.col("artist")}, ["artist_popularity"])
        .groupBy("artist")
        .agg(popularity.alias("artist_popularity"), F.sum("plays").alias("play_count"))
    )
    return top(totals, limit, "play_count", "artist")


def top_genres(plays, genres, track_genres, filt=None, limit=50) -> DataFrame:
    per_id = (
        collapse(scoped(plays, played(), filt), "track_uri")
        .join(track_genres, "track_uri")
        .groupBy("genre_id")
        .agg(
            F.sum("total_ms").alias("total_ms"),
            F.sum("plays").alias("play_count"),
            F.count("track_uri").alias("unique_tracks"),
        )
    )
    named = _named(per_id, genres).select("genre", "total_ms", "play_count", "unique_tracks")
    return top(named, limit, "total_ms", "genre")


def top_genres_labelled(plays, genres, track_genres, filt=None, limit=50) -> DataFrame:
    return top_genres(plays, genres, track_genres, filt, limit).withColumn(
        "item_tooltip", item_label(F.col("genre"), F.col("total_ms"), F.col("play_count"))
    )


def genre_totals(plays, genres, track_genres, filt=None, limit=50) -> DataFrame:
    """Totals over the top genres. A track counts once per genre it has."""
    return top_genres(plays, genres, track_genres, filt, limit).agg(
        F.count(F.lit(1)).alias("total_genres"),
        F.sum("total_ms").alias("total_ms"),
        F.sum("unique_tracks").alias("unique_tracks"),
    )


def _fold_others(periods: DataFrame, rank_by: str, limit: int) -> DataFrame:
    """Genres outside the ``limit`` largest become 'Other'; share of the period's plays."""
    others = [m for m in ("plays", "total_ms") if m in periods.columns and m != rank_by]
    in_period = F.sum("plays").over(Window.partitionBy("period"))
    return (
        within_top(periods, limit, "genre", rank_by, *others, how="left")
        .groupBy("period", F.coalesce("kept", F.lit("Other")).alias("genre"))
        .agg(*[F.sum(m).alias(m) for m in (rank_by, *others)])
        .withColumn("proportion", ratio(F.col("plays"), in_period))
    )


def genre_text_evolution(plays, tracks, unit="month", filt=None, limit=10) -> DataFrame:
    count = [F.count(F.lit(1)).alias("plays")]
    periods = collapse_by_track(scoped(plays, filt), _texts(tracks), _period(unit), ["genre"], count)
    return _fold_others(periods, "plays", limit)


def genre_evolution(plays, genres, track_genres, unit="month", filt=None, limit=10) -> DataFrame:
    """Plays per period of the genres with most time. ``unit='auto'`` fits the unit to the span."""
    lasted = scoped(plays, played(), filt)
    if unit == "auto":
        fitted = auto_granularity(plays, filt).select("unit").scalar()
        lasted = lasted.withColumn("unit", fitted)
        period = {
            "period": F.when(F.col("unit") == "day", calendar.period_start("day", "ts"))
            .when(F.col("unit") == "week", calendar.period_start("week", "ts"))
            .otherwise(calendar.period_start("month", "ts"))
        }
    else:
        period = _period(unit)
    per_id = collapse_by_track(lasted, track_genres, period, ["genre_id"])
    periods = _named(per_id, genres).select("period", "genre", "plays", "total_ms")
    return _fold_others(periods, "total_ms", limit)


def genre_text_diversity(plays, tracks, unit="month") -> DataFrame:
    """Distinct genre texts per period."""
    count = [F.count(F.lit(1)).alias("plays")]
    return (
        collapse_by_track(plays, _texts(tracks), _period(unit), ["genre"], count)
        .groupBy("period")
        .agg(F.count("genre").alias("genre_count"))
    )


def genre_diversity(plays, genres, track_genres, unit="month", filt=None) -> DataFrame:
    """Distinct genres per period."""
    count = [F.count(F.lit(1)).alias("plays")]
    return (
        collapse_by_track(scoped(plays, played(), filt), track_genres, _period(unit), ["genre_id"], count)
        .join(genres.select("genre_id"), "genre_id", "left_semi")
        .groupBy("period")
        .agg(F.count("genre_id").alias("genre_count"))
    )


def genre_by_hour(plays, genres, track_genres, filt=None, limit=8) -> DataFrame:
    """Plays per hour of the genres with most time.

    The choice of genres looks at all plays, whatever the filter and however short. Both measures come
    from one pass over the plays.
    """
    counted = played() if filt is None else played() & filt
    measures = [F.count_if(counted).alias("count"), F.sum("ms_played").alias("all_ms")]
    per_id = collapse_by_track(
        plays, track_genres, {"hour": calendar.hour("ts")}, ["genre_id"], measures
    )
    hours = within_top(_named(per_id, genres), limit, "genre", "all_ms", "count")
    # Counted plays took time, so the second condition holds whenever the first does.
    return hours.where((F.col("count") > 0) & F.col("all_ms").isNotNull()).select(
        "hour", "genre", "count"
    )


def genre_order(evolution: DataFrame) -> DataFrame:
    """Genres of an evolution by their mean share."""
    return (
        evolution.groupBy("genre")
        .agg(F.avg("proportion").alias("mean_proportion"))
        .orderBy(F.col("mean_proportion").desc(), "genre")
    )
