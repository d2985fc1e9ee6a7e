"""Calendar expressions on TIMESTAMP_NTZ values.

Everything goes through DATE, which has no zone, so results do not depend on the session zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday numbers count from Sunday.
WEEKDAY_NAMES = {
    0: "Sunday",
    1: "Monday",
    2: "Tuesday",
    3: "Wednesday",
    4: "Thursday",
    5: "Friday",
    6: "Saturday",
}

# Hours from UTC by connection country, as the upload path applies them.
COUNTRY_HOURS = {"US": -7, "NO": -1, "ES": -1, "DE": -1, "FR": -1, "IT": -1}

PERIOD_UNITS = ("day", "week", "month", "year")


def moment(value) -> Column:
    """Zone-free timestamp literal from text, date, datetime or Column; None means now."""
    if value is None:
        return F.localtimestamp()
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.isoformat()
    return F.lit(value).cast("timestamp_ntz")


def before(point: Column, count: int, unit: str) -> Column:
    return point - F.expr(f"INTERVAL {int(count)} {unit.upper()}")


def period_start(unit: str, ts) -> Column:
    """First instant of the day, week (from Monday), month or year holding ``ts``."""
    if unit not in PERIOD_UNITS:
        raise ValueError(f"unknown period unit: {unit}")
    day = _col(ts).cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def weekday(ts) -> Column:
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")


def hour(ts) -> Column:
    return F.hour(_col(ts)).cast("bigint")


def year(value) -> Column:
    return F.year(_col(value)).cast("bigint")


def decade(year_number: Column) -> Column:
    return (F.floor(year_number / F.lit(10.0)) * 10).cast("bigint")


def weekday_name(number: Column) -> Column:
    """Name of a Sunday-based weekday number; any other number is shown as it is."""
    names = F.create_map(*[F.lit(v) for pair in WEEKDAY_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, number.cast("int")), number.cast("string"))


def timeframe_unit(name: str | None) -> str:
    """Grouping unit of a timeframe name; 'All Time' and unknown names group by month."""
    unit = (name or "").lower()
    return unit if unit in PERIOD_UNITS else "month"


def country_clock(ts: Column, country: Column) -> Column:
    """``ts`` moved by the fixed offset of the connection country."""
    hours = F.create_map(*[F.lit(v) for pair in COUNTRY_HOURS.items() for v in pair])
    offset = F.coalesce(F.try_element_at(hours, country), F.lit(0))
    return F.timestamp_add("HOUR", offset, ts)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
