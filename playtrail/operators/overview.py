"""Headline numbers: overviews, table counts, ranges, column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions import calendar
from playtrail.functions.numeric import ratio, to_hours
from playtrail.plans.filters import played, scoped

# Fixed value: first day offered when there is no history yet.
EMPTY_HISTORY_START = "2015-01-01"


def _combinations(plays: DataFrame, *keys) -> DataFrame:
    # Several exact distinct counts in one aggregate multiply every input row by their number.
    # Here they run over the distinct key combinations instead.
    return plays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("total_ms"),
        F.count_if(F.col("skipped")).alias("skips"),
    )


def overview_stats(plays: DataFrame, filt=None) -> DataFrame:
    return _combinations(scoped(plays, filt), "track", "artist").agg(
        F.count_distinct("track").alias("unique_tracks"),
        F.count_distinct("artist").alias("unique_artists"),
        to_hours(F.sum("total_ms")).alias("total_hours"),
        ratio(F.sum("skips"), F.sum("plays")).alias("skip_rate"),
    )


def overview_full(plays, tracks, genres, track_genres, filt=None) -> DataFrame:
    """Overview of plays that lasted, with genres met through the (track, artist) pair."""
    combos = _combinations(scoped(plays, played(), filt), "track", "artist", "album")
    base = combos.agg(
        F.sum("total_ms").alias("total_ms"),
        F.count_distinct("artist").alias("unique_artists"),
        F.count_distinct("track").alias("unique_tracks"),
        F.count_distinct("album").alias("unique_albums"),
        ratio(F.sum("skips"), F.sum("plays")).alias("skip_rate"),
        to_hours(F.sum("total_ms")).alias("total_hours"),
    )
    # The conditions hold for every row. They make this branch read the columns the other one reads, so
    # that Spark runs the aggregate over the plays once and reuses its exchange. The null-safe join
    # serves the same end: a plain one would push its null checks below that aggregate.
    pairs = combos.where((F.col("plays") > 0) & (F.col("total_ms") > 0) & (F.col("skips") >= 0))
    pairs = pairs.select("track", "artist").distinct().alias("p")
    named = genres_by_pair(tracks, track_genres).dropna(subset=["track", "artist"]).alias("n")
    same = F.col("n.track").eqNullSafe(F.col("p.track")) & F.col("n.artist").eqNullSafe(F.col("p.artist"))
    met = (
        named.join(pairs, same, "left_semi")
        .select("genre_id").distinct()
        .join(genres, "genre_id")
        .agg(F.count_distinct("name"))
    )
    return base.withColumn("unique_genres", met.scalar())


def genres_by_pair(tracks: DataFrame, track_genres: DataFrame) -> DataFrame:
    """Distinct (track, artist, genre_id): the genre bridge keyed by names instead of the URI."""
    names = tracks.select("track_uri", "track", "artist")
    return (
        track_genres.join(names, "track_uri").select("track", "artist", "genre_id").distinct()
    )


def table_counts(plays: DataFrame, tracks: DataFrame, with_genres=False) -> DataFrame:
    rows = F.count(F.lit(1))
    counts = plays.agg(rows.alias("history_count")).withColumn(
        "metadata_count", tracks.agg(rows).scalar()
    )
    if not with_genres:
        return counts
    # NULL and '' both fail the comparison.
    return counts.withColumn(
        "genre_track_count", tracks.agg(F.count_if(F.col("genres") != "")).scalar()
    )


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and whether it is empty."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).withColumn("is_empty", F.col("row_count") == 0)


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """Exact minimum, maximum, mean, count and distinct count of the known values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
    return counts.agg(
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
        (F.sum(F.col("v").cast("double") * F.col("count")) / F.sum("count")).alias("avg_value"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
        F.count(F.lit(1)).alias("unique_count"),
    )


def date_range(plays: DataFrame, as_of=None) -> DataFrame:
    first, last = F.min("ts").cast("date"), F.max("ts").cast("date")
    return plays.agg(first.alias("a"), last.alias("b")).select(
        F.coalesce("a", F.lit(EMPTY_HISTORY_START).cast("date")).alias("min_date"),
        F.coalesce("b", calendar.moment(as_of).cast("date")).alias("max_date"),
    )


def auto_granularity(plays: DataFrame, filt=None) -> DataFrame:
    """Span of the history in whole elapsed days and the period unit that suits it."""
    span = F.extract(F.lit("DAY"), F.col("max_ts") - F.col("min_ts")).cast("bigint")
    unit = F.when(F.col("span_days") < 60, "day").when(F.col("span_days") < 365, "week")
    return (
        scoped(plays, filt)
        .agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
        .withColumn("span_days", span)
        .withColumn("unit", unit.otherwise("month"))
    )
