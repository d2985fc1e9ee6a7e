"""Queries that join plays to tracks or genres."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.filters import HOUR
from checks.registry import check
from checks.single_table import MS, SKIPS, WEEKEND, item_label_sql, weekend
from checks.tables import number as r
from checks.tables import sql
from playtrail.operators import density, enrich, genres, overview, releases
from playtrail.plans import filters as f

AS_OF = "1999-06-15"
TIMES = "COUNT(*) AS play_count"

# Overview with genres, popularity --------------------------------------------------------------


def _full_sql(where="ms_played > 0"):
    return f"""base AS (SELECT {MS}, COUNT(DISTINCT artist) AS unique_artists,
        COUNT(DISTINCT track) AS unique_tracks, COUNT(DISTINCT album) AS unique_albums,
        {r(f"CAST({SKIPS} AS DOUBLE) / NULLIF(COUNT(*), 0)")} AS skip_rate FROM plays WHERE {where}),
      pairs AS (SELECT DISTINCT track, artist, name FROM track_genres JOIN tracks USING (track_uri)),
      met AS (SELECT COUNT(DISTINCT p.name) AS unique_genres FROM plays h
        JOIN pairs p ON h.track = p.track AND h.artist = p.artist WHERE {where})
      SELECT base.*, {r("total_ms / 3600000.0")} AS total_hours, unique_genres FROM base CROSS JOIN met"""


check("overview_full", lambda t: overview.overview_full(t.ev, t.tracks, t.genres, t.track_genres),
      sql(_full_sql()))
check("overview_full_filtered",
      lambda t: overview.overview_full(t.ev, t.tracks, t.genres, t.track_genres, weekend()),
      sql(_full_sql(f"ms_played > 0 AND {WEEKEND}")))
check("overview_full_years",
      lambda t: overview.overview_full(t.li, t.tracks, t.genres, t.track_genres), sql(_full_sql(), "li"))

for _suffix, _plays in (("", "ev"), ("_years", "li")):
    check(f"artist_popularity{_suffix}",
          lambda t, p=_plays: genres.artist_popularity(getattr(t, p), t.tracks),
          sql(f"""SELECT h.artist, {r("AVG(m.artist_popularity)")} AS artist_popularity, {TIMES}
            FROM plays h JOIN tracks m USING (track_uri) GROUP BY 1
            ORDER BY play_count DESC, h.artist NULLS LAST LIMIT 50""", _plays))

# Genres ----------------------------------------------------------------------------------------

_BY_GENRE = "plays h JOIN track_genres g USING (track_uri)"
_TOP_GENRES = f"""top_genres AS (SELECT g.name AS genre, {MS}, {TIMES},
    COUNT(DISTINCT track_uri) AS unique_tracks FROM {_BY_GENRE} WHERE ms_played > 0
  GROUP BY 1 ORDER BY total_ms DESC, genre LIMIT {{limit}})"""


def _evolution_sql(unit, periods, rank_by):
    return f"""periods AS ({periods.format(unit=unit)}),
      best AS (SELECT genre FROM periods GROUP BY 1 ORDER BY SUM({rank_by}) DESC, genre NULLS LAST LIMIT 10),
      folded AS (SELECT p.period, COALESCE(b.genre, 'Other') AS genre, SUM(plays) AS plays,
        SUM(total_ms) AS total_ms FROM periods p LEFT JOIN best b ON p.genre = b.genre GROUP BY 1, 2),
      evolution AS (SELECT CAST(period AS TIMESTAMP) AS period, genre, CAST(plays AS BIGINT) AS plays,
        CAST(total_ms AS BIGINT) AS total_ms,
        CAST(plays AS DOUBLE) / SUM(plays) OVER (PARTITION BY period) AS proportion FROM folded)"""


_TEXT_PERIODS = f"""SELECT DATE_TRUNC('{{unit}}', h.ts) AS period, m.genres AS genre,
  COUNT(*) AS plays, {MS} FROM plays h JOIN tracks m USING (track_uri) GROUP BY 1, 2"""
_GENRE_PERIODS = f"""SELECT DATE_TRUNC('{{unit}}', h.ts) AS period, g.name AS genre,
  COUNT(*) AS plays, {MS} FROM {_BY_GENRE} WHERE ms_played > 0 GROUP BY 1, 2"""
_PART = r("proportion") + " AS proportion"

for _suffix, _plays, _unit in (("", "ev", "week"), ("_years", "li", "month")):
    def _add(name, build, query, plays=_plays, suffix=_suffix):
        check(name + suffix, lambda t: build(getattr(t, plays), t), sql(query, plays))

    _add("top_genre_text", lambda p, t: genres.top_genre_text(p, t.tracks),
         f"""SELECT m.genres AS genre, {MS}, {TIMES}, COUNT(DISTINCT h.track) AS unique_tracks
           FROM plays h JOIN tracks m USING (track_uri) GROUP BY 1
           ORDER BY total_ms DESC, genre LIMIT 100""")
    _add("top_genres", lambda p, t: genres.top_genres_labelled(p, t.genres, t.track_genres),
         f"""{_TOP_GENRES.format(limit=50)}
           SELECT *, {item_label_sql("genre")} AS item_tooltip FROM top_genres""")
    _add("genre_totals", lambda p, t: genres.genre_totals(p, t.genres, t.track_genres, limit=8),
         f"""{_TOP_GENRES.format(limit=8)} SELECT COUNT(*) AS total_genres,
           CAST(SUM(total_ms) AS BIGINT) AS total_ms, CAST(SUM(unique_tracks) AS BIGINT) AS unique_tracks
           FROM top_genres""")
    _add("genre_text_evolution", lambda p, t, u=_unit: genres.genre_text_evolution(p, t.tracks, u),
         f"""{_evolution_sql(_unit, _TEXT_PERIODS, "plays")}
           SELECT period, genre, plays, {_PART} FROM evolution""")
    _add("genre_evolution",
         lambda p, t, u=_unit: genres.genre_evolution(p, t.genres, t.track_genres, u),
         f"""{_evolution_sql(_unit, _GENRE_PERIODS, "total_ms")}
           SELECT period, genre, plays, total_ms, {_PART} FROM evolution""")
    _add("genre_text_diversity", lambda p, t, u=_unit: genres.genre_text_diversity(p, t.tracks, u),
         f"""SELECT CAST(DATE_TRUNC('{_unit}', h.ts) AS TIMESTAMP) AS period,
           COUNT(DISTINCT m.genres) AS genre_count FROM plays h JOIN tracks m USING (track_uri) GROUP BY 1""")
    _add("genre_diversity",
         lambda p, t, u=_unit: genres.genre_diversity(p, t.genres, t.track_genres, u),
         f"""SELECT CAST(DATE_TRUNC('{_unit}', h.ts) AS TIMESTAMP) AS period,
           COUNT(DISTINCT g.name) AS genre_count FROM {_BY_GENRE} WHERE ms_played > 0 GROUP BY 1""")

check("genre_evolution_auto",
      lambda t: genres.genre_evolution(t.ev, t.genres, t.track_genres, "auto"),
      sql(f"""{_evolution_sql("day", _GENRE_PERIODS, "total_ms")}
        SELECT period, genre, plays, total_ms, {_PART} FROM evolution"""))
_BY_HOUR = f"""best AS (SELECT g.name FROM {_BY_GENRE} GROUP BY 1
    ORDER BY SUM(ms_played) DESC, g.name LIMIT 8)
  SELECT CAST({HOUR} AS BIGINT) AS hour, g.name AS genre, COUNT(*) AS count FROM {_BY_GENRE}
  WHERE ms_played > 0 AND {{where}} AND g.name IN (SELECT name FROM best) GROUP BY 1, 2"""
check("genre_by_hour", lambda t: genres.genre_by_hour(t.ev, t.genres, t.track_genres),
      sql(_BY_HOUR.format(where="true")))
check("genre_by_hour_filtered",
      lambda t: genres.genre_by_hour(t.ev, t.genres, t.track_genres, weekend()),
      sql(_BY_HOUR.format(where=WEEKEND)))
check("genre_order",
      lambda t: genres.genre_order(genres.genre_evolution(t.li, t.genres, t.track_genres, "month")),
      sql(f"""{_evolution_sql("month", _GENRE_PERIODS, "total_ms")}
        SELECT genre, {r("AVG(proportion)")} AS mean_proportion FROM evolution GROUP BY 1""", "li"))

# Releases --------------------------------------------------------------------------------------

_RELEASED = "EXTRACT(YEAR FROM album_release_date)"
_SANE = f"album_release_date IS NOT NULL AND {_RELEASED} > 1900 AND {_RELEASED} <= 1999"
_JOINED = "plays h JOIN tracks m USING (track_uri)"
_YEARS = f"""years AS (SELECT CAST({_RELEASED} AS BIGINT) AS release_year,
  COUNT(DISTINCT track_uri) AS unique_tracks, {MS}, {TIMES} FROM {_JOINED} WHERE {_SANE} GROUP BY 1)"""
_BY_MONTH = f"""SELECT CAST(DATE_TRUNC('month', h.ts) AS TIMESTAMP) AS period,
  CAST({_RELEASED} AS BIGINT) AS release_year, COUNT(*) AS count, {MS}
  FROM {_JOINED} WHERE {_SANE} GROUP BY 1, 2"""
_SAME_YEAR = f"""same_year AS (SELECT CAST(EXTRACT(YEAR FROM h.ts) AS BIGINT) AS year,
  COUNT(*) AS total_plays, CAST(SUM(CASE WHEN EXTRACT(YEAR FROM h.ts) = {_RELEASED} THEN 1 ELSE 0 END)
    AS BIGINT) AS same_year_plays FROM {_JOINED} WHERE album_release_date IS NOT NULL GROUP BY 1),
  shares AS (SELECT *, CAST(same_year_plays AS DOUBLE) / NULLIF(total_plays, 0) * 100 AS percentage
    FROM same_year)"""

check("release_years", lambda t: releases.release_years(t.li, t.tracks, as_of=AS_OF),
      sql(f"{_YEARS} SELECT * FROM years", "li"))
check("release_years_filtered",
      lambda t: releases.release_years(t.li, t.tracks, f.trailing("year", "1999-06-15 12:00:00"), AS_OF),
      sql(f"""{_YEARS.replace("WHERE ", "WHERE ts >= TIMESTAMP '1998-06-15 12:00:00' AND ")}
        SELECT * FROM years""", "li"))
check("release_decades", lambda t: releases.release_decades(t.li, t.tracks, as_of=AS_OF),
      sql(f"""{_YEARS} SELECT release_year // 10 * 10 AS decade, CAST(SUM(total_ms) AS BIGINT) AS total_ms,
        CAST(SUM(play_count) AS BIGINT) AS play_count, CAST(SUM(unique_tracks) AS BIGINT) AS unique_tracks
        FROM years GROUP BY 1""", "li"))
check("release_by_month", lambda t: releases.release_by_month(t.li, t.tracks, as_of=AS_OF),
      sql(_BY_MONTH, "li"))
check("avg_release_year", lambda t: releases.avg_release_year(t.li, t.tracks, as_of=AS_OF),
      sql(f"""SELECT CAST(DATE_TRUNC('month', h.ts) AS TIMESTAMP) AS period,
        {r(f"AVG({_RELEASED})")} AS avg_release_year, CAST(MIN({_RELEASED}) AS BIGINT) AS min_release_year,
        CAST(MAX({_RELEASED}) AS BIGINT) AS max_release_year FROM {_JOINED} WHERE {_SANE} GROUP BY 1""", "li"))
check("same_year_share", lambda t: releases.same_year_share(t.li, t.tracks),
      sql(f"""{_SAME_YEAR} SELECT year, total_plays, same_year_plays, {r("percentage")} AS percentage
        FROM shares""", "li"))

# Densities -------------------------------------------------------------------------------------


def _density_sql(source, group, value, low, high, steps, width):
    z = f"(g.at - s.{value}) / {width}"
    return f"""grid AS (SELECT {low} + i * ({high} - {low}) / CAST({steps} AS DOUBLE) AS at
        FROM range(0, {steps} + 1) AS r(i))
      SELECT s.{group}, {r("g.at")} AS {value}_at,
        {r(f"SUM(exp(-0.5 * {z} * {z})) / (COUNT(*) * {width} * sqrt(2 * pi()))")} AS density
      FROM {source} s CROSS JOIN grid g WHERE s.{value} IS NOT NULL GROUP BY s.{group}, g.at"""


check("density_genre_proportion",
      lambda t: density.grouped_density(
          genres.genre_evolution(t.li, t.genres, t.track_genres, "month"), "genre", "proportion", 0, 1, 50, 0.05),
      sql(f"""{_evolution_sql("month", _GENRE_PERIODS, "total_ms")},
        {_density_sql("evolution", "genre", "proportion", 0.0, 1.0, 50, 0.05)}""", "li"))
check("density_release_year",
      lambda t: density.grouped_density(
          releases.release_by_month(t.li, t.tracks, as_of=AS_OF), "period", "release_year", 1950, 2000, 25, 4.0),
      sql(f"""by_month AS ({_BY_MONTH}),
        {_density_sql("by_month", "period", "release_year", 1950.0, 2000.0, 25, 4.0)}""", "li"))
check("density_same_year_percentage",
      lambda t: density.grouped_density(
          releases.same_year_share(t.li, t.tracks), "year", "percentage", 0, 10, 40, 0.5),
      sql(f"{_SAME_YEAR}, {_density_sql('shares', 'year', 'percentage', 0.0, 10.0, 40, 0.5)}", "li"))
check("density_release_year_of_plays",
      lambda t: density.grouped_density(
          enrich.plays_with_tracks(t.li, t.tracks, "album_release_date").select(
              F.year("ts").alias("year"), F.year("album_release_date").alias("released")),
          "year", "released", 1950, 2024, 100, 3.0),
      sql(f"""dated AS (SELECT CAST(EXTRACT(YEAR FROM h.ts) AS BIGINT) AS year, {_RELEASED} AS released
          FROM {_JOINED}),
        counted AS (SELECT year, released, COUNT(*) AS w FROM dated WHERE released IS NOT NULL GROUP BY 1, 2),
        grid AS (SELECT 1950.0 + i * 74.0 / CAST(100 AS DOUBLE) AS at FROM range(0, 101) AS r(i))
      SELECT year, {r("g.at")} AS released_at,
        {r("SUM(w * exp(-0.5 * ((g.at - released) / 3.0) * ((g.at - released) / 3.0)))"
           " / (SUM(w) * 3.0 * sqrt(2 * pi()))")} AS density
      FROM counted CROSS JOIN grid g GROUP BY year, g.at""", "li"))

# Row-level joins -------------------------------------------------------------------------------

_FACTS = """CAST(m.album_release_date AS VARCHAR) AS album_release_date, m.track_popularity, m.explicit,
  m.album_type, m.total_tracks, {genres} AS genres, m.artist_popularity, m.artist_followers"""
_ENRICHED = f"""SELECT h.*, CAST(DATE_TRUNC('month', ts) AS TIMESTAMP) AS month,
  CAST(EXTRACT(YEAR FROM ts) AS BIGINT) AS year, CAST(EXTRACT(DOW FROM ts) AS BIGINT) AS weekday,
  CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS hour, {_FACTS}
  FROM plays h LEFT JOIN {{tracks}} m USING (track_uri)"""


def _renamed(tracks):
    """All tracks, of which every seventeenth goes by a URI that no play has."""
    other = F.concat(F.lit("other:"), "track_uri")
    return tracks.withColumn("track_uri", F.when(F.col("track_uri").cast("bigint") % 17 == 0, other).otherwise(F.col("track_uri")))


check("enriched_plays",
      lambda t: enrich.enriched_plays(t.ev, _renamed(t.tracks)),
      sql(_ENRICHED.format(genres="m.genres", tracks="""(SELECT * REPLACE (CASE WHEN
        CAST(track_uri AS BIGINT) % 17 = 0 THEN 'other:' || track_uri ELSE track_uri END AS track_uri) FROM tracks)""")))
check("enriched_plays_clean", lambda t: enrich.enriched_plays_clean(t.ev, t.tracks),
      sql(_ENRICHED.format(genres=r"regexp_replace(m.genres, '[\[\]\"]', '', 'g')", tracks="tracks")))
check("plays_with_tracks",
      lambda t: enrich.plays_with_tracks(t.ev, t.tracks, "track_popularity", filt=weekend()),
      sql(f"SELECT h.*, m.track_popularity FROM {_JOINED} WHERE {WEEKEND}"))
check("plays_with_genres",
      lambda t: enrich.plays_with_genres(t.ev, t.genres, t.track_genres).select("id", "track_uri", "genre"),
      sql(f"SELECT h.id, track_uri, g.name AS genre FROM {_BY_GENRE}"))
