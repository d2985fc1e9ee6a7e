"""Filters, each measured by what it lets through."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.tables import sql
from playtrail.operators import rankings
from playtrail.plans import filters as f

_PASSED = """SELECT COUNT(*) AS plays, CAST(SUM(ms_played) AS BIGINT) AS total_ms,
  MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM plays"""


def _passed(plays, *conditions):
    return f.scoped(plays, *conditions).agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("total_ms"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def _filter(name, condition, where, plays="ev"):
    check(
        f"filter_{name}",
        lambda t: _passed(getattr(t, plays), condition()),
        sql(f"{_PASSED} WHERE {where}", plays),
    )


_DAY = "TIMESTAMP '2024-01-20 12:00:00'"
_YEARS = "TIMESTAMP '1999-06-15 12:00:00'"
DOW, HOUR = "EXTRACT(DOW FROM ts)", "EXTRACT(HOUR FROM ts)"

_filter("date_range", lambda: f.build_filter(date_range=("2024-01-05", "2024-01-12")),
        "CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
_filter("date_range_years", lambda: f.build_filter(date_range=("1997-02-01", "1999-12-31")),
        "CAST(ts AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1999-12-31'", "li")
for _unit in ("Month", "Week", "Day"):
    _filter(f"trailing_{_unit.lower()}",
            lambda u=_unit: f.build_filter(u, as_of="2024-01-20 12:00:00"),
            f"ts >= {_DAY} - INTERVAL 1 {_unit.upper()}")
_filter("trailing_year", lambda: f.build_filter("Year", as_of="1999-06-15 12:00:00"),
        f"ts >= {_YEARS} - INTERVAL 1 YEAR", "li")
_filter("weekdays", lambda: f.build_filter(days=("Saturday", "Sun", "Wed")), f"{DOW} IN (6, 0, 3)")
_filter("day_parts", lambda: f.build_filter(day_parts=("12AM-6AM", "12PM-6PM", "no such part")),
        f"({HOUR} BETWEEN 0 AND 6 OR {HOUR} BETWEEN 12 AND 18)")
_filter("day_parts_evening", lambda: f.build_filter(day_parts=("6AM-12PM", "6PM-12AM")),
        f"({HOUR} BETWEEN 6 AND 12 OR {HOUR} BETWEEN 18 AND 24)")
_filter("combined",
        lambda: f.build_filter(date_range=("2024-01-03", "2024-01-25"), days=("Mon", "Friday"),
                               day_parts=("6AM-12PM",)),
        f"CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND {DOW} IN (1, 5) "
        f"AND {HOUR} BETWEEN 6 AND 12")
for _unit in ("Year", "Month", "Week", "Day"):
    _filter(f"since_last_year_of_{_unit.lower()}",
            lambda u=_unit: f.build_period_filter(u, as_of="1999-06-15 12:00:00"),
            f"ts >= DATE_TRUNC('{_unit.lower()}', {_YEARS}) - INTERVAL 1 YEAR", "li")
_filter("half_open_day_parts",
        lambda: f.build_period_filter(day_parts=("12AM-6AM", "12PM-6PM")),
        f"({HOUR} BETWEEN 0 AND 5 OR {HOUR} BETWEEN 12 AND 17)")
_filter("short_weekdays", lambda: f.build_period_filter(days=("Sun", "Tue")), f"{DOW} IN (0, 2)")
_filter("period_combined",
        lambda: f.build_period_filter("Month", ("Mon", "Sat"), ("6PM-12AM",), "2024-12-20 00:00:00"),
        f"ts >= DATE_TRUNC('month', TIMESTAMP '2024-12-20') - INTERVAL 1 YEAR "
        f"AND {DOW} IN (1, 6) AND {HOUR} BETWEEN 18 AND 23")
_filter("played", f.played, "ms_played > 0")
_filter("known_artist", lambda: f.known("artist"), "artist IS NOT NULL")
_filter("known_album", lambda: f.known("album", allow_empty=False),
        "album IS NOT NULL AND album <> ''")
_filter("known_skip_flag", lambda: f.known("skipped"), "skipped IS NOT NULL")
_filter("mentions_word", lambda: f.mentions("track", "RING"), "LOWER(track) LIKE '%ring%'")

check(
    "filter_sane_release",
    lambda t: t.tracks.where(f.sane_release(as_of="1999-06-15")).agg(
        F.count(F.lit(1)).alias("tracks"), F.min("album_release_date").alias("first_release"),
        F.max("album_release_date").alias("last_release")),
    sql("""SELECT COUNT(*) AS tracks, CAST(MIN(album_release_date) AS VARCHAR) AS first_release,
      CAST(MAX(album_release_date) AS VARCHAR) AS last_release FROM tracks
      WHERE EXTRACT(YEAR FROM album_release_date) > 1900
        AND EXTRACT(YEAR FROM album_release_date) <= 1999"""),
)
check(
    "filter_among_top",
    lambda t: _passed(f.among(t.li, rankings.top_artists_known(t.li, limit=10), "artist")),
    sql(f"""best AS (SELECT artist FROM plays WHERE artist IS NOT NULL GROUP BY 1
        ORDER BY SUM(ms_played) DESC, artist LIMIT 10)
      {_PASSED} WHERE artist IN (SELECT artist FROM best)""", "li"),
)
