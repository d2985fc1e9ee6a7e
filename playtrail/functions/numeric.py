"""Numeric expressions: units, ratios, chart coordinates, type widening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the circle constant the polar hour view uses.
CIRCLE = 3.14159


def to_minutes(ms: Column) -> Column:
    return ms / F.lit(60000.0)


def to_hours(ms: Column) -> Column:
    return ms / F.lit(3600000.0)


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient; NULL when the whole is zero or NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def hour_angle(hour: Column) -> Column:
    return hour * F.lit(2 * CIRCLE / 24)


def jittered_hour(hour: Column, seed: int | None = None) -> Column:
    """Hour moved at random by less than a quarter either way."""
    noise = F.rand() if seed is None else F.rand(seed)
    return hour + (noise - 0.5) * 0.5


def widen_small_integers(df: DataFrame) -> DataFrame:
    """Every byte, short and int column as double."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
        for f in df.schema.fields
    ])
