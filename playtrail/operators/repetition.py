"""Repetition in playing order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.numeric import ratio
from playtrail.plans.ordered import neighbour_repeats_by_day


def consecutive_repeats(plays: DataFrame) -> DataFrame:
    """Per day, how often the artist is that of the play before, over pairs with both known.

    Plays are ordered by (ts, id) over the whole history, across midnight too.
    """
    return neighbour_repeats_by_day(plays, "artist").select(
        F.col("day").alias("ts"), ratio(F.col("repeats"), F.col("pairs")).alias("repetitiveness")
    )
