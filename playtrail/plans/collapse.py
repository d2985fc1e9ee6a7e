"""Aggregates of plays, alone and by what a dimension says about their track.

Analyses that join plays to tracks or genres aggregate afterwards, and their measures are counts and sums. So plays are
first summed up per (key, track), whatever the dimension's size: that starts in the scan stage, a track holding a third of all
plays leaves each task as one row per key, and the join moves tracks rather than plays. No broadcast is forced; with
``playtrail.session.SETTINGS`` only sizes measured at run time lead to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(plays: DataFrame, *keys) -> DataFrame:
    """One row per key with ``plays`` and ``total_ms``."""
    return plays.groupBy(*keys).agg(*_counts())


def _counts():
    return [F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("total_ms")]


def collapse_by_track(plays: DataFrame, tracks: DataFrame, keys: dict, track_keys, measures=None) -> DataFrame:
    """Plays summed up by ``keys`` of the play (name to Column) and ``track_keys`` of its track.

    ``tracks`` has ``track_uri`` and the track keys, and may hold a track several times: a play then
    counts for each. ``measures`` are aggregate Columns that add up.
    """
    measures = measures or _counts()
    small = plays.groupBy(*[c.alias(n) for n, c in keys.items()], "track_uri").agg(*measures)
    sums = [F.sum(m).alias(m) for m in small.columns[len(keys) + 1:]]
    return small.join(tracks, "track_uri").groupBy(*keys, *track_keys).agg(*sums)


def top(df: DataFrame, limit: int, measure: str, *ties) -> DataFrame:
    """First ``limit`` rows by falling measure; the keys settle equal measures."""
    order = [F.col(measure).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return df.orderBy(*order).limit(limit)


def within_top(grouped: DataFrame, limit: int, key: str, measure: str, *others, how="inner") -> DataFrame:
    """An aggregate joined to its ``limit`` keys with the largest sum of ``measure``.

    With ``how="left"`` all rows stay and the column ``kept`` tells the chosen keys from the rest.

    The aggregate is used twice, and Spark reuses its exchange only while both uses read the same
    columns. So the ``others`` are summed for the ranking too and close its order, behind the key, which
    already decides it. The chosen keys are unique, so an inner join serves as the semi join, which
    Catalyst would push below the aggregate of one side only.
    """
    sums = grouped.groupBy(key).agg(*[F.sum(m).alias(m) for m in (measure, *others)])
    chosen = top(sums, limit, measure, key, *others)
    if how == "left":
        return grouped.join(chosen.select(key, F.col(key).alias("kept")), key, "left")
    return grouped.join(chosen.select(key), key)
