"""Two-way splits: skipped or completed, remix or original; by plays or by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions.numeric import ratio
from playtrail.plans.collapse import collapse
from playtrail.plans.filters import known, mentions, scoped


def _share(plays: DataFrame, kind, name: str, measure: str) -> DataFrame:
    # The window spans the grouped rows, of which there are two.
    whole = F.sum(measure).over(Window.partitionBy())
    return collapse(plays, kind.alias(name)).select(
        name,
        F.col("plays").alias("count"),
        "total_ms",
        ratio(F.col(measure), whole).alias("percentage"),
    )


def _skip_kind():
    return F.when(F.col("skipped"), "Skipped").otherwise("Completed")


def _remix_kind(word: str):
    return F.when(mentions("track", word), "Remix").otherwise("Original")


def skip_share(plays, filt=None) -> DataFrame:
    """By count; an unknown flag counts as completed."""
    return _share(scoped(plays, filt), _skip_kind(), "skipped", "plays").drop("total_ms")


def skip_share_time(plays, filt=None) -> DataFrame:
    """By time; plays with an unknown flag are left out."""
    return _share(scoped(plays, known("skipped"), filt), _skip_kind(), "skipped", "total_ms")


def remix_share(plays, filt=None, word="remix") -> DataFrame:
    return _share(scoped(plays, filt), _remix_kind(word), "is_remix", "plays").drop("total_ms")


def remix_share_time(plays, filt=None, word="remix") -> DataFrame:
    return _share(scoped(plays, filt), _remix_kind(word), "is_remix", "total_ms")
