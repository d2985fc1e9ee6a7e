"""Text expressions: durations, labels, counts and genre clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_MINUTE = 60_000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000

# Fixed value: days in an average month, as the long duration text counts them.
DAYS_PER_MONTH = 30.44


def _whole(amount: Column) -> Column:
    return F.floor(amount).cast("bigint").cast("string")


def duration_text(ms: Column) -> Column:
    """``1d 2h 3m``; seconds are dropped."""
    days = _whole(ms / F.lit(float(MS_PER_DAY)))
    hours = _whole(F.pmod(ms, F.lit(MS_PER_DAY)) / F.lit(float(MS_PER_HOUR)))
    minutes = _whole(F.pmod(ms, F.lit(MS_PER_HOUR)) / F.lit(float(MS_PER_MINUTE)))
    return F.concat(days, F.lit("d "), hours, F.lit("h "), minutes, F.lit("m"))


def long_duration_text(ms: Column) -> Column:
    """``2mo 3d 4h 5m`` without the units that are zero; ``0m`` for NULL.

    A unit is reduced by the next larger one only when that larger unit is shown.
    """
    minutes = ms.cast("double") / 1000 / 60
    hours = minutes / 60
    days = hours / 24
    months = days / DAYS_PER_MONTH
    has_months = months >= 1
    days = F.when(has_months, days % DAYS_PER_MONTH).otherwise(days)
    has_days = days >= 1
    hours = F.when(has_days, hours % 24).otherwise(hours)
    has_hours = hours >= 1
    minutes = F.when(has_hours, minutes % 60).otherwise(minutes)
    nothing_larger = ~(has_months | has_days | has_hours)
    parts = F.concat_ws(
        " ",
        F.when(has_months, F.concat(_whole(months), F.lit("mo"))),
        F.when(has_days, F.concat(_whole(days), F.lit("d"))),
        F.when(has_hours, F.concat(_whole(hours), F.lit("h"))),
        F.when((minutes >= 1) | nothing_larger, F.concat(_whole(minutes), F.lit("m"))),
    )
    return F.when(ms.isNull(), F.lit("0m")).otherwise(parts)


def listened_text(ms: Column) -> Column:
    hours = ms / F.lit(float(MS_PER_HOUR))
    minutes = _whole((hours - F.floor(hours)) * 60)
    tail = F.concat(minutes, F.lit(" minutes"))
    return F.when(
        hours >= 1, F.concat(F.lit("Listened to "), _whole(hours), F.lit(" hours, "), tail)
    ).otherwise(F.concat(F.lit("Listened to "), tail))


def item_label(name: Column, ms: Column, plays: Column) -> Column:
    """Three lines: name, time listened, times played. A missing name reads ``None``."""
    return F.concat(
        F.coalesce(name, F.lit("None")),
        F.lit("\n"),
        listened_text(ms),
        F.lit("\nPlayed "),
        F.format_number(plays, 0),
        F.lit(" times"),
    )


def count_text(value: Column) -> Column:
    """Whole number with thousands separators; ``0`` for NULL and NaN."""
    number = value.cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(number.isNull() | F.isnan(number), F.lit("0")).otherwise(
        F.format_number(whole.cast("bigint"), 0)
    )


def hours_text(value: Column) -> Column:
    """One decimal, ties to even; ``N/A`` for NULL and NaN."""
    number = value.cast("double")
    shown = F.concat(F.call_function("format_number", number, F.lit("0.0")), F.lit(" hours"))
    return F.when(number.isNull() | F.isnan(number), F.lit("N/A")).otherwise(shown)


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def pair_label(first, second) -> Column:
    """``first - second``; NULL when either is NULL."""
    return F.concat(F.col(first), F.lit(" - "), F.col(second))


def strip_list_marks(genres: Column) -> Column:
    """Genre list text without brackets and double quotes."""
    return F.regexp_replace(genres, r'[\[\]"]', "")


def clean_genre(name: Column) -> Column:
    """Letters, digits, white space and hyphens of a genre name, trimmed; '' for NULL."""
    bare = F.btrim(name, F.lit("[]\"'"))
    kept = F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}\s-]", "")
    return F.coalesce(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), F.lit(""))


def genre_names(genres: Column) -> Column:
    """Distinct clean names in a genre list held as text, e.g. ``['a', "b c"]``.

    Text that is no list literal (such as an unescaped quote inside a name) is cut at its commas.
    """
    listed = F.from_json(genres, "array<string>")
    cut = F.split(strip_list_marks(genres), ",")
    names = F.transform(F.coalesce(listed, cut), clean_genre)
    return F.array_distinct(F.filter(names, lambda n: n != ""))
