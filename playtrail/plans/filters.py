"""Filters as Columns.

Two families share names and differ in meaning. ``build_filter`` takes trailing windows and day parts
whose upper hour is included; ``build_period_filter`` takes windows from the start of the unit and
half-open day parts. Time bounds stay plain comparisons on the raw timestamp, so they reach the
Parquet scan. For a table partitioned by period, ``partition=("play_date", "day")`` names the partition
column and its unit, and the bounds prune partitions too.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions import calendar

ALL_TIME = "All Time"

# Day parts as (first hour, last hour).
DAY_PARTS = {
    "12AM-6AM": (0, 6),
    "6AM-12PM": (6, 12),
    "12PM-6PM": (12, 18),
    "6PM-12AM": (18, 24),
}

_WEEKDAYS = {name: number for number, name in calendar.WEEKDAY_NAMES.items()}
_WEEKDAYS.update({name[:3]: number for number, name in calendar.WEEKDAY_NAMES.items()})


def all_of(*conditions) -> Column | None:
    active = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, active) if active else None


def any_of(*conditions) -> Column | None:
    active = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, active) if active else None


def scoped(df: DataFrame, *conditions) -> DataFrame:
    """``df`` under all the given conditions; None stands for no condition."""
    condition = all_of(*conditions)
    return df if condition is None else df.where(condition)


def between_days(start, end, ts="ts", partition=None) -> Column:
    """Days from ``start`` to ``end``, both included."""
    first, last = _as_day(start), _as_day(end)
    column = F.col(ts)
    bounds = (column >= calendar.moment(first)) & (
        column < calendar.moment(last + dt.timedelta(days=1))
    )
    if partition:
        bounds = bounds & _from_period(calendar.moment(first), partition) & (
            F.col(partition[0]) <= F.lit(last)
        )
    return bounds


def _from_period(point: Column, partition) -> Column:
    column, unit = partition
    return F.col(column) >= calendar.period_start(unit, point).cast("date")


def _since(point: Column, ts, partition) -> Column:
    bound = F.col(ts) >= point
    return bound & _from_period(point, partition) if partition else bound


def trailing(unit: str, as_of=None, ts="ts", partition=None) -> Column:
    """From one year, month, week or day before ``as_of`` on."""
    return _since(calendar.before(calendar.moment(as_of), 1, unit), ts, partition)


def since_last_year_of(unit: str, as_of=None, ts="ts", partition=None) -> Column:
    """From one year before the start of the unit holding ``as_of`` on."""
    start = calendar.period_start(unit, calendar.moment(as_of))
    return _since(calendar.before(start, 1, "year"), ts, partition)


def on_weekdays(days, ts="ts") -> Column | None:
    """Full or short English weekday names."""
    numbers = [_WEEKDAYS[d] for d in days]
    return calendar.weekday(ts).isin(numbers) if numbers else None


def in_day_parts(parts, ts="ts") -> Column | None:
    """Day parts with the last hour included; unknown names are ignored."""
    known = [DAY_PARTS[p] for p in parts if p in DAY_PARTS]
    return any_of(*[F.hour(F.col(ts)).between(a, b) for a, b in known])


def in_half_open_day_parts(parts, ts="ts") -> Column | None:
    return any_of(*[
        (F.hour(F.col(ts)) >= a) & (F.hour(F.col(ts)) < b)
        for a, b in (DAY_PARTS[p] for p in parts)
    ])


def build_filter(timeframe=ALL_TIME, date_range=None, days=(), day_parts=(), as_of=None, ts="ts",
                 partition=None) -> Column | None:
    """Conjunction of the active filters. A date range counts only for 'All Time'."""
    window = None
    if timeframe == ALL_TIME:
        if date_range and all(date_range):
            window = between_days(*date_range, ts=ts, partition=partition)
    elif timeframe and timeframe.lower() in calendar.PERIOD_UNITS:
        window = trailing(timeframe.lower(), as_of, ts, partition)
    return all_of(window, on_weekdays(days or (), ts), in_day_parts(day_parts or (), ts))


def build_period_filter(timeframe=None, days=(), day_parts=(), as_of=None, ts="ts",
                        partition=None) -> Column | None:
    window = None
    if timeframe and timeframe != ALL_TIME:
        window = since_last_year_of(timeframe.lower(), as_of, ts, partition)
    return all_of(
        window, in_half_open_day_parts(day_parts or (), ts), on_weekdays(days or (), ts)
    )


def played() -> Column:
    return F.col("ms_played") > 0


def known(column: str, allow_empty=True) -> Column:
    condition = F.col(column).isNotNull()
    return condition if allow_empty else condition & (F.col(column) != "")


def sane_release(release_date="album_release_date", as_of=None) -> Column:
    """Release years after 1900 and not after the year of ``as_of``."""
    released = F.year(F.col(release_date))
    return (released > 1900) & (released <= F.year(calendar.moment(as_of)))


def mentions(column: str, word: str) -> Column:
    """Whether the text holds ``word`` in any letter case; false for NULL."""
    return F.coalesce(F.lower(F.col(column)).contains(word.lower()), F.lit(False))


def among(df: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``chosen``."""
    return df.join(chosen.select(column), column, "left_semi")


def _as_day(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
