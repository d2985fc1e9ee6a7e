"""Queries over the plays alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.filters import DOW, HOUR
from checks.registry import check
from checks.tables import number as r
from checks.tables import sql
from playtrail.functions import calendar, numeric, text
from playtrail.operators import overview, rankings, repetition, shares, timeline
from playtrail.plans import filters as f

WEEKEND = "EXTRACT(DOW FROM ts) IN (6, 0)"


def weekend():
    return f.build_filter(days=("Sat", "Sun"))


SKIPS = "SUM(CASE WHEN skipped THEN 1 ELSE 0 END)"
MS = "CAST(SUM(ms_played) AS BIGINT) AS total_ms"

# Overviews -------------------------------------------------------------------------------------

_STATS = f"""SELECT COUNT(DISTINCT track) AS unique_tracks, COUNT(DISTINCT artist) AS unique_artists,
  {r("SUM(ms_played) / 3600000.0")} AS total_hours,
  {r(f"CAST({SKIPS} AS DOUBLE) / COUNT(*)")} AS skip_rate FROM plays"""
check("overview_stats", lambda t: overview.overview_stats(t.ev), sql(_STATS))
check("overview_stats_filtered", lambda t: overview.overview_stats(t.ev, weekend()),
      sql(f"{_STATS} WHERE {WEEKEND}"))
check("overview_stats_years", lambda t: overview.overview_stats(t.li), sql(_STATS, "li"))

check("table_counts", lambda t: overview.table_counts(t.ev, t.tracks),
      sql("""SELECT (SELECT COUNT(*) FROM plays) AS history_count,
        (SELECT COUNT(*) FROM tracks) AS metadata_count"""))
check("table_counts_genres", lambda t: overview.table_counts(t.ev, t.tracks, with_genres=True),
      sql("""SELECT (SELECT COUNT(*) FROM plays) AS history_count,
        (SELECT COUNT(*) FROM tracks) AS metadata_count,
        (SELECT COUNT(*) FROM tracks WHERE genres IS NOT NULL AND genres <> '') AS genre_track_count"""))

_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
check("table_profile",
      lambda t: overview.table_profile(
          {**{n: t.raw(n) for n in _BASE}, "no_plays": t.ev.where("ms_played < 0")}),
      " UNION ALL ".join(
          [f"SELECT '{n}' AS table_name, COUNT(*) AS row_count, COUNT(*) = 0 AS is_empty FROM {n}"
           for n in _BASE]
          + ["SELECT 'no_plays', COUNT(*), COUNT(*) = 0 FROM events WHERE value < 0"]))

_COLUMN = """SELECT MIN({c}) AS min_value, MAX({c}) AS max_value, ROUND(AVG({c}), 6) AS avg_value,
  COUNT(*) AS count, COUNT(DISTINCT {c}) AS unique_count FROM {t} WHERE {c} IS NOT NULL"""
check("column_stats", lambda t: overview.column_stats(t.ev, "ms_played"),
      sql(_COLUMN.format(c="ms_played", t="plays")))
check("column_stats_price", lambda t: overview.column_stats(t.raw("lineitem"), "l_extendedprice"),
      _COLUMN.format(c="l_extendedprice", t="lineitem"))

_RANGE = """SELECT CAST(COALESCE(MIN(CAST(ts AS DATE)), DATE '2015-01-01') AS VARCHAR) AS min_date,
  CAST(COALESCE(MAX(CAST(ts AS DATE)), DATE '2024-06-01') AS VARCHAR) AS max_date FROM plays"""
check("date_range", lambda t: overview.date_range(t.li, as_of="2024-06-01"), sql(_RANGE, "li"))
check("date_range_empty",
      lambda t: overview.date_range(t.ev.where("ms_played < 0"), as_of="2024-06-01"),
      sql(f"{_RANGE} WHERE ms_played < 0"))

_SPAN = """SELECT MIN(ts) AS min_ts, MAX(ts) AS max_ts,
  CAST(EXTRACT(DAY FROM MAX(ts) - MIN(ts)) AS BIGINT) AS span_days,
  CASE WHEN EXTRACT(DAY FROM MAX(ts) - MIN(ts)) < 60 THEN 'day'
    WHEN EXTRACT(DAY FROM MAX(ts) - MIN(ts)) < 365 THEN 'week' ELSE 'month' END AS unit FROM plays"""
check("auto_granularity", lambda t: overview.auto_granularity(t.ev), sql(_SPAN))
check("auto_granularity_years", lambda t: overview.auto_granularity(t.li), sql(_SPAN, "li"))
check("auto_granularity_weeks",
      lambda t: overview.auto_granularity(t.li, f.between_days("1998-01-10", "1998-06-30")),
      sql(f"{_SPAN} WHERE CAST(ts AS DATE) BETWEEN DATE '1998-01-10' AND DATE '1998-06-30'", "li"))
check("auto_granularity_empty", lambda t: overview.auto_granularity(t.ev, F.col("ms_played") < 0),
      sql(f"{_SPAN} WHERE ms_played < 0"))

# Rankings --------------------------------------------------------------------------------------


def _ranking(keys, extra="", where="", limit=100, order="total_ms DESC NULLS LAST"):
    ties = ", ".join(f"{k} NULLS LAST" for k in keys.split(", "))
    return f"""SELECT {keys}, {MS}, COUNT(*) AS play_count{extra} FROM plays {where}
      GROUP BY {keys} ORDER BY {order}, {ties} LIMIT {limit}"""


_DISTINCT = ", COUNT(DISTINCT track) AS unique_tracks"
LISTENED = """CASE WHEN total_ms / 3600000.0 >= 1
  THEN 'Listened to ' || CAST(CAST(FLOOR(total_ms / 3600000.0) AS BIGINT) AS VARCHAR) || ' hours, '
  ELSE 'Listened to ' END
  || CAST(CAST(FLOOR((total_ms / 3600000.0 - FLOOR(total_ms / 3600000.0)) * 60) AS BIGINT) AS VARCHAR)
  || ' minutes'"""


def item_label_sql(name):
    return (f"COALESCE({name}, 'None') || chr(10) || {LISTENED} || chr(10) || 'Played ' "
            "|| format('{:,}', play_count) || ' times'")


for _suffix, _plays in (("", "ev"), ("_years", "li")):
    def _add(name, build, query, plays=_plays, suffix=_suffix):
        check(name + suffix, lambda t: build(getattr(t, plays)), sql(query, plays))

    _add("top_tracks", rankings.top_tracks, _ranking("track, artist"))
    _add("top_artists", rankings.top_artists, _ranking("artist", _DISTINCT))
    _add("top_albums", rankings.top_albums, _ranking("album, artist", _DISTINCT))
    _add("top_tracks_detail", rankings.top_tracks_detail,
         f"""best AS ({_ranking("track, artist, album", "", "WHERE ms_played > 0", 25)})
         SELECT *, artist || ' - ' || track AS track_label,
           CAST(total_ms // 86400000 AS VARCHAR) || 'd ' || CAST(total_ms % 86400000 // 3600000 AS VARCHAR)
           || 'h ' || CAST(total_ms % 3600000 // 60000 AS VARCHAR) || 'm' AS duration_display FROM best""")
    _add("top_artists_known", rankings.top_artists_known,
         f"""best AS ({_ranking("artist", "", "WHERE artist IS NOT NULL", 50)})
         SELECT *, {item_label_sql("artist")} AS item_tooltip FROM best""")
    _BEST_ALBUMS = f"""best AS ({_ranking("album, artist", _DISTINCT,
                                          "WHERE album IS NOT NULL AND album <> ''", 50)}),
      labelled AS (SELECT *, album || ' - ' || artist AS album_label FROM best)"""
    _add("top_albums_known", rankings.top_albums_known,
         f"{_BEST_ALBUMS} SELECT *, {item_label_sql('album_label')} AS item_tooltip FROM labelled")
    _add("album_completion", rankings.album_completion,
         f"""{_BEST_ALBUMS} SELECT album_label, unique_tracks, play_count,
           ROUND(CAST(unique_tracks AS DOUBLE) / play_count, 6) AS completion_ratio FROM labelled
         ORDER BY CAST(unique_tracks AS DOUBLE) / play_count, album NULLS LAST, artist NULLS LAST
         LIMIT 20""")

check("top_artists_filtered", lambda t: rankings.top_artists(t.ev, weekend()),
      sql(_ranking("artist", _DISTINCT, f"WHERE {WEEKEND}")))
check("most_listened", lambda t: rankings.most_listened(t.ev, 7),
      sql(f"""SELECT track, artist, {MS} FROM plays GROUP BY track, artist
        ORDER BY total_ms DESC, track NULLS LAST, artist NULLS LAST LIMIT 7"""))

# Over time -------------------------------------------------------------------------------------

_MONTHLY = f"""monthly AS (SELECT DATE_TRUNC('month', ts) AS month, artist, COUNT(*) AS plays, {MS}
  FROM plays WHERE artist IS NOT NULL GROUP BY 1, 2)"""
check("artist_monthly", lambda t: timeline.artist_monthly(t.li),
      sql(f"{_MONTHLY} SELECT CAST(month AS TIMESTAMP) AS month, artist, plays, total_ms FROM monthly", "li"))
check("artist_trends_top10", lambda t: timeline.artist_trends_top(t.li),
      sql(f"""{_MONTHLY}, best AS (SELECT artist FROM plays WHERE artist IS NOT NULL GROUP BY 1
        ORDER BY SUM(ms_played) DESC, artist LIMIT 10)
      SELECT CAST(month AS TIMESTAMP) AS month, artist, plays, total_ms FROM monthly
      WHERE artist IN (SELECT artist FROM best)""", "li"))

_PATTERNS = f"""patterns AS (SELECT CAST({DOW} AS BIGINT) AS weekday, CAST({HOUR} AS BIGINT) AS hour,
  COUNT(*) AS count, AVG(ms_played) / 60000.0 AS avg_duration_min FROM plays GROUP BY 1, 2)"""
_AVG = r("avg_duration_min") + " AS avg_duration_min"
check("daily_patterns", lambda t: timeline.daily_patterns(t.ev),
      sql(f"{_PATTERNS} SELECT weekday, hour, count, {_AVG} FROM patterns"))
check("daily_patterns_named", lambda t: timeline.daily_patterns_named(t.ev),
      sql(f"""{_PATTERNS} SELECT dayname(DATE '2023-01-01' + CAST(weekday AS INTEGER)) AS weekday,
        hour, count, {_AVG} FROM patterns"""))
check("hour_counts", lambda t: timeline.hour_counts(t.ev),
      sql(f"SELECT CAST({HOUR} AS BIGINT) AS hour, COUNT(*) AS count FROM plays GROUP BY 1"))
_PROFILE = """profile AS (SELECT hour, CAST(SUM(count) AS BIGINT) AS count,
  AVG(avg_duration_min) AS avg_duration_min FROM patterns GROUP BY 1)"""
check("hour_profile", lambda t: timeline.hour_profile(t.ev),
      sql(f"{_PATTERNS}, {_PROFILE} SELECT hour, count, {_AVG} FROM profile"))
check("hour_polar", lambda t: timeline.hour_polar(t.ev),
      sql(f"""{_PATTERNS}, {_PROFILE} SELECT hour, count, {_AVG},
        {r("hour * (2 * 3.14159 / 24)")} AS angle, count AS radius FROM profile"""))
_TRENDS = f"""trends AS (SELECT CAST(DATE_TRUNC('day', h.ts) AS TIMESTAMP) AS day,
  CAST(EXTRACT(HOUR FROM h.ts) AS BIGINT) AS hour, SUM(ms_played) / 60000.0 AS minutes,
  CAST({SKIPS} AS DOUBLE) / NULLIF(COUNT(*), 0) AS skip_rate FROM plays h GROUP BY 1, 2)"""
check("listening_trends", lambda t: timeline.listening_trends(t.ev),
      sql(f"""{_TRENDS} SELECT day AS ts, hour, {r("minutes")} AS ms_played,
        {r("skip_rate")} AS skip_rate FROM trends"""))
check("listening_trends_years", lambda t: timeline.listening_trends(t.li),
      sql(f"""{_TRENDS} SELECT day AS ts, hour, {r("minutes")} AS ms_played,
        {r("skip_rate")} AS skip_rate FROM trends""", "li"))
check("trend_overview", lambda t: timeline.trend_overview(t.ev),
      sql(f"{_TRENDS} SELECT day AS ts, {r('AVG(minutes)')} AS avg_minutes FROM trends GROUP BY 1"))
for _suffix, _plays in (("", "ev"), ("_years", "li")):
    check(f"artist_repetitiveness{_suffix}",
          lambda t, p=_plays: timeline.artist_repetitiveness(getattr(t, p)),
          sql(f"""SELECT CAST(DATE_TRUNC('day', h.ts) AS TIMESTAMP) AS ts, COUNT(*) AS total_plays,
            COUNT(DISTINCT artist) AS unique_artists,
            {r("(1 - CAST(COUNT(DISTINCT artist) AS DOUBLE) / NULLIF(COUNT(*), 0)) * 100")}
              AS repetitiveness FROM plays h WHERE artist IS NOT NULL GROUP BY 1""", _plays))
    check(f"plays_by_day{_suffix}", lambda t, p=_plays: timeline.plays_by_day(getattr(t, p)),
          sql(f"""SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS day, COUNT(*) AS play_count, {MS},
            {r("AVG(ms_played)")} AS avg_ms, {r("SUM(ms_played) / 60000.0")} AS total_minutes,
            {r("AVG(ms_played) / 60000.0")} AS avg_minutes FROM plays GROUP BY 1""", _plays))

check("consecutive_repeats", lambda t: repetition.consecutive_repeats(t.ev),
      sql(f"""ordered AS (SELECT ts, artist, LAG(artist) OVER (ORDER BY ts, id) AS previous FROM plays)
        SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS ts,
          {r("AVG(CASE WHEN artist = previous THEN 1.0 WHEN artist <> previous THEN 0.0 END)")}
            AS repetitiveness FROM ordered GROUP BY 1"""))

# Shares ----------------------------------------------------------------------------------------

_SKIP_KIND = "CASE WHEN skipped THEN 'Skipped' ELSE 'Completed' END"
_RING_KIND = "CASE WHEN LOWER(track) LIKE '%ring%' THEN 'Remix' ELSE 'Original' END"
_REMIX_KIND = "CASE WHEN LOWER(track) LIKE '%remix%' THEN 'Remix' ELSE 'Original' END"
_BY_COUNT = r("CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ()") + " AS percentage"
_BY_TIME = r("CAST(SUM(ms_played) AS DOUBLE) / SUM(SUM(ms_played)) OVER ()") + " AS percentage"


def _share_sql(kind, name, share, where="", time=False):
    total = f", {MS}" if time else ""
    return f"""SELECT {kind} AS {name}, COUNT(*) AS count{total}, {share} FROM plays {where}
      GROUP BY {kind}"""


check("skip_share", lambda t: shares.skip_share(t.ev), sql(_share_sql(_SKIP_KIND, "skipped", _BY_COUNT)))
check("skip_share_time", lambda t: shares.skip_share_time(t.ev),
      sql(_share_sql(_SKIP_KIND, "skipped", _BY_TIME, "WHERE skipped IS NOT NULL", True)))
check("skip_share_time_years", lambda t: shares.skip_share_time(t.li),
      sql(_share_sql(_SKIP_KIND, "skipped", _BY_TIME, "WHERE skipped IS NOT NULL", True), "li"))
check("remix_share", lambda t: shares.remix_share(t.ev, word="ring"),
      sql(_share_sql(_RING_KIND, "is_remix", _BY_COUNT)))
check("remix_share_default", lambda t: shares.remix_share(t.ev),
      sql(_share_sql(_REMIX_KIND, "is_remix", _BY_COUNT)))
check("remix_share_time", lambda t: shares.remix_share_time(t.ev, word="ring"),
      sql(_share_sql(_RING_KIND, "is_remix", _BY_TIME, "", True)))

# Expressions -----------------------------------------------------------------------------------

# Cubed so that the durations reach from seconds to years.
_LONG = "CAST(FLOOR(value * value * value * 1000000) AS BIGINT)"
check("duration_texts",
      lambda t: t.raw("events").select(
          "event_id", F.floor(F.col("value") * F.col("value") * F.col("value") * 1000000).alias("ms"))
      .select("event_id", text.duration_text(F.col("ms")).alias("short_text"),
              text.long_duration_text(F.col("ms")).alias("long_text"),
              text.long_duration_text(F.when(F.col("event_id") % 5 > 0, F.col("ms"))).alias("gap_text")),
      f"""WITH a AS (SELECT event_id, {_LONG} AS ms FROM events),
        b AS (SELECT *, CAST(ms AS DOUBLE) / 1000 / 60 AS minutes0 FROM a),
        c AS (SELECT *, minutes0 / 60 AS hours0, minutes0 / 60 / 24 AS days0,
          minutes0 / 60 / 24 / CAST(30.44 AS DOUBLE) AS months FROM b),
        d AS (SELECT *, CASE WHEN months >= 1 THEN days0 % CAST(30.44 AS DOUBLE) ELSE days0 END AS days FROM c),
        e AS (SELECT *, CASE WHEN days >= 1 THEN hours0 % 24 ELSE hours0 END AS hours FROM d),
        f AS (SELECT *, CASE WHEN hours >= 1 THEN minutes0 % 60 ELSE minutes0 END AS minutes FROM e),
        g AS (SELECT *, concat_ws(' ',
          CASE WHEN months >= 1 THEN CAST(CAST(FLOOR(months) AS BIGINT) AS VARCHAR) || 'mo' END,
          CASE WHEN days >= 1 THEN CAST(CAST(FLOOR(days) AS BIGINT) AS VARCHAR) || 'd' END,
          CASE WHEN hours >= 1 THEN CAST(CAST(FLOOR(hours) AS BIGINT) AS VARCHAR) || 'h' END,
          CASE WHEN minutes >= 1 OR NOT (months >= 1 OR days >= 1 OR hours >= 1)
            THEN CAST(CAST(FLOOR(minutes) AS BIGINT) AS VARCHAR) || 'm' END) AS long_text FROM f)
      SELECT event_id, CAST(ms // 86400000 AS VARCHAR) || 'd ' || CAST(ms % 86400000 // 3600000 AS VARCHAR)
        || 'h ' || CAST(ms % 3600000 // 60000 AS VARCHAR) || 'm' AS short_text, long_text,
        CASE WHEN event_id % 5 > 0 THEN long_text ELSE '0m' END AS gap_text FROM g""")
check("count_and_hour_texts",
      lambda t: t.raw("orders").select(
          "o_orderkey",
          text.count_text(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice"))).alias("count_text"),
          text.hours_text(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice"))).alias("hours_text"),
          text.or_default(F.nullif("o_orderstatus", F.lit("O")), "none").alias("status")),
      """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0
          THEN format('{:,}', CAST(FLOOR(o_totalprice) AS BIGINT)) ELSE '0' END AS count_text,
        CASE WHEN o_orderkey % 7 > 0 THEN format('{:.1f} hours', o_totalprice) ELSE 'N/A' END
          AS hours_text, COALESCE(NULLIF(o_orderstatus, 'O'), 'none') AS status FROM orders""")
check("genre_clean",
      lambda t: t.raw("documents").select(
          "doc_id", text.clean_genre(F.col("text")).alias("genre"),
          text.strip_list_marks(F.col("text")).alias("stripped"))
      .select("doc_id", F.md5("genre").alias("genre_md5"), F.length("genre").alias("genre_length"),
              F.md5("stripped").alias("stripped_md5")),
      r"""WITH cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(
          regexp_replace(trim(text, '[]"'''), '[^\p{L}\p{N}\s-]', '', 'g'), '^\s+', ''), '\s+$', '')
          AS genre, regexp_replace(text, '[\[\]"]', '', 'g') AS stripped FROM documents)
        SELECT doc_id, md5(genre) AS genre_md5, length(genre) AS genre_length,
          md5(stripped) AS stripped_md5 FROM cleaned""")
check("calendar_fields",
      lambda t: t.raw("orders").select(
          "o_orderkey", calendar.weekday("o_orderdate").alias("weekday"),
          calendar.year("o_orderdate").alias("year"), calendar.hour("o_orderdate").alias("hour"),
          calendar.decade(calendar.year("o_orderdate")).alias("decade"),
          *[calendar.period_start(u, "o_orderdate").alias(u) for u in ("day", "week", "month")],
          calendar.period_start(calendar.timeframe_unit("Year"), "o_orderdate").alias("year_start"),
          calendar.period_start(calendar.timeframe_unit("All Time"), "o_orderdate").alias("default_start")),
      """SELECT o_orderkey, CAST(EXTRACT(DOW FROM o_orderdate) AS BIGINT) AS weekday,
        CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS year,
        CAST(EXTRACT(HOUR FROM o_orderdate) AS BIGINT) AS hour,
        CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) // 10 * 10 AS decade,
        CAST(DATE_TRUNC('day', o_orderdate) AS TIMESTAMP) AS day,
        CAST(DATE_TRUNC('week', o_orderdate) AS TIMESTAMP) AS week,
        CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS month,
        CAST(DATE_TRUNC('year', o_orderdate) AS TIMESTAMP) AS year_start,
        CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS default_start FROM orders""")
check("unit_conversions",
      lambda t: t.ev.select("id", numeric.to_minutes(F.col("ms_played")).alias("minutes"),
                            numeric.to_hours(F.col("ms_played")).alias("hours"),
                            numeric.ratio(F.lit(1), F.col("ms_played")).alias("per_ms")),
      sql(f"""SELECT id, {r("ms_played / 60000.0")} AS minutes, {r("ms_played / 3600000.0")} AS hours,
        {r("1.0 / NULLIF(ms_played, 0)")} AS per_ms FROM plays"""))
check("jitter_bounds",
      lambda t: timeline.hour_counts(t.ev).withColumn(
          "moved", numeric.jittered_hour(F.col("hour"), seed=7) - F.col("hour"))
      .select("hour", "count", (F.abs("moved") <= 0.25).alias("near")),
      sql(f"SELECT CAST({HOUR} AS BIGINT) AS hour, COUNT(*) AS count, true AS near FROM plays GROUP BY 1"))
check("widened_integers", lambda t: numeric.widen_small_integers(t.raw("customer")),
      """SELECT c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
        ROUND(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer""")
