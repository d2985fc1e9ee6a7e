"""Sources, cleaning rules and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import check
from checks.tables import sql
from playtrail.functions.calendar import country_clock
from playtrail.operators import approximate, enrich, overview, repetition
from playtrail.plans.ordered import number_by_position
from playtrail.schemas import GENRES, PLAYS, TRACK_GENRES, TRACKS
from playtrail.session import scratch_path
from playtrail.sources import footers, genres, history, load, metadata, tables
from playtrail.streaming import daily, filedrop

_BULK = """SELECT at_second AS ts, ms AS ms_played, 'user ' || CAST(user_id AS VARCHAR) AS artist,
  'spotify:track:' || json_extract_string(props, '$.k') AS track_uri, reason_end,
  CASE WHEN event_type <> 'view' THEN event_type IN ('error', 'signup') END AS skipped, country
  FROM items WHERE music"""
_PLAYED = ("ts", "ms_played", "artist", "track_uri", "reason_end", "skipped", "country")

_REPORT = sql("""counted AS (SELECT no, COUNT(*) FILTER (music) AS inserted,
          COUNT(*) FILTER (NOT music) AS skipped_content FROM items GROUP BY 1),
        docs AS (SELECT DISTINCT CAST(event_id // 250 AS BIGINT) AS no FROM events)
      SELECT CAST(no AS VARCHAR) AS source_file, COALESCE(inserted, 0) AS inserted, CAST(0 AS BIGINT) AS failed,
        COALESCE(skipped_content, 0) AS skipped_content,
        CASE WHEN no % 5 = 4 OR inserted IS NULL THEN 'failed' WHEN inserted > 0 THEN 'loaded'
          ELSE 'skipped' END AS status
      FROM docs LEFT JOIN counted USING (no)""")


def _write_files(documents, folder) -> None:
    """Each document as one file. Tasks move their files into place themselves; the driver would move all of them one by one."""
    (documents.select("body").write.mode("append").option("maxRecordsPerFile", 1)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder))


def _as_files(t) -> str:
    """The documents as one file each, in a new shared folder."""
    folder = scratch_path(t.spark, "history")
    _write_files(t.documents, folder)
    return folder


def _from_files(t):
    return history.bulk_plays(history.read_documents(t.spark, _as_files(t))).select(*_PLAYED)


def _from_split_files(t):
    """Every file read by many tasks, in ranges of some objects."""
    staged = history.staged_history(t.spark, _as_files(t), whole_bytes=0, range_bytes=20000)
    return history.plays_of(staged).select(*_PLAYED)


def _from_quarantined_stream(t):
    """The same files by the stream that sets unreadable ones aside."""
    landing, checkpoint = scratch_path(t.spark, "landing"), scratch_path(t.spark, "progress")
    folder = _as_files(t)
    for _ in range(2):
        filedrop.ingest(t.spark, folder, landing, checkpoint, quarantine=True)
    refused = filedrop.refused_files(t.spark, landing).count()
    return filedrop.landed_plays(t.spark, landing).select(*_PLAYED, F.lit(refused).cast("bigint").alias("refused"))


def _from_stream(t):
    landing, checkpoint = scratch_path(t.spark, "landing"), scratch_path(t.spark, "progress")
    folder = _as_files(t)
    for _ in range(2):  # the second run finds nothing new
        filedrop.ingest(t.spark, folder, landing, checkpoint)
    return t.spark.read.parquet(landing).select(*_PLAYED)


check("history_parsed", lambda t: history.bulk_plays(t.documents).select(*_PLAYED),
      sql(_BULK))
check("history_files", _from_files, sql(_BULK))
check("history_stream", _from_stream, sql(_BULK))
check("history_split", _from_split_files, sql(_BULK))
check("history_quarantine", _from_quarantined_stream,
      sql(_BULK.replace("AS ts,", """AS ts, (SELECT COUNT(DISTINCT CASE WHEN (event_id // 250) % 5 = 4 THEN event_id // 250 END) FROM events) AS refused,""", 1)))
check("history_staged_report", lambda t: history.report_of(history.staged_plays(t.documents)),
      _REPORT)
check("history_load_report", lambda t: history.load_report(t.documents),
      _REPORT)
check("upload_cleaned",
      lambda t: history.upload_plays(t.readable_documents, recover=True),
      sql("""SELECT CAST(no AS VARCHAR) AS source_file, ROW_NUMBER() OVER (PARTITION BY no ORDER BY event_id) - 1 AS position, at_second - CASE country WHEN 'US' THEN INTERVAL 7 HOUR
          WHEN 'GB' THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS ts, 'spotify' AS platform,
        ms AS ms_played, '' AS track, 'user ' || CAST(user_id AS VARCHAR) AS artist, '' AS album,
        CASE WHEN music THEN 'spotify:track:' || json_extract_string(props, '$.k') ELSE '' END AS track_uri,
        'unknown' AS reason_start, COALESCE(reason_end, 'unknown') AS reason_end,
        event_type IN ('error', 'signup') AS skipped, country FROM readable_items"""))
check("country_clock",
      lambda t: t.ev.select("id", "country", country_clock(F.col("ts"), F.col("country")).alias("ts")),
      sql("""SELECT id, country, ts - CASE country WHEN 'US' THEN INTERVAL 7 HOUR
        WHEN 'GB' THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS ts FROM plays"""))
check("numbered_plays",
      lambda t: number_by_position(history.upload_plays(t.readable_documents, shift_clock=False, recover=True), start=1000)
      .select("id", "ts", "artist", "ms_played"),
      sql("""SELECT 1000 + ROW_NUMBER() OVER (ORDER BY CAST(no AS VARCHAR), event_id) AS id, at_second AS ts,
        'user ' || CAST(user_id AS VARCHAR) AS artist, ms AS ms_played FROM readable_items"""))


def _hourly(t):
    """Bulk plays with many shared times, numbered by their files, which settles their order."""
    return number_by_position(history.bulk_plays(t.documents)).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


check("consecutive_repeats_bulk", lambda t: repetition.consecutive_repeats(_hourly(t)),
      sql("""numbered AS (SELECT DATE_TRUNC('hour', at_second) AS ts, user_id,
          ROW_NUMBER() OVER (ORDER BY CAST(no AS VARCHAR), event_id) AS id FROM items WHERE music),
        ordered AS (SELECT ts, user_id, LAG(user_id) OVER (ORDER BY ts, id) AS previous FROM numbered)
      SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS ts,
        ROUND(AVG(CASE WHEN user_id = previous THEN 1.0 WHEN user_id <> previous THEN 0.0 END), 6) AS repetitiveness
      FROM ordered GROUP BY 1"""))


def _published(t):
    """Files dropped in two rounds, published after each and once more."""
    folder, landing, progress, table = (scratch_path(t.spark, n) for n in ("drop", "landing", "progress", "published"))
    for part, load in ((0, "first"), (1, "second"), (None, "second"), (None, "third")):
        if part is not None:
            _write_files(t.documents.where(F.col("source_file").cast("bigint") % 2 == part), folder)
            filedrop.ingest(t.spark, folder, landing, progress)
        assert filedrop.publish(t.spark, landing, table, load, "month") == (load != "third")
    plays = tables.read_plays(t.spark, table)
    return plays.select(*_PLAYED, (F.count(F.lit(1)).over(Window.partitionBy("id")) == 1).alias("once"),
                        F.col("id").between(1, F.lit(plays.count())).alias("within"))


check("history_published", _published,
      sql(_BULK.replace("AS ts,", "AS ts, true AS once, true AS within,", 1)))


def _reloaded(t):
    """Loads repeated in every mode, plain and through whole exports; what is left counts each load once."""
    path, root, export = (scratch_path(t.spark, n) for n in ("plays", "root", "export"))
    first, second = t.ev, t.li.select("ts", "ms_played", "track_uri")
    assert tables.load_plays(second, path, "old", "replace_all", "month")
    for _ in range(2):
        assert tables.load_plays(first, path, "first", "replace_all", "month")
    assert not tables.load_plays(first, path, "third", "if_empty", "month")
    for _ in range(2):
        assert tables.load_plays(second, path, "second", "append", "month")
    _write_files(t.documents, f"{export}/files")
    t.tracks.withColumn("album_release_date", F.col("album_release_date").cast("string")).write.parquet(f"{export}/metadata")

    for mode, name in (("if_empty", "a"), ("if_empty", "a"), ("append", "a"), ("append", "b"), ("append", "b"), ("replace_all", "c"), ("replace_all", "c")):
        load.load_export(t.spark, f"{export}/files", f"{export}/metadata", root, name, mode, "month", files="*.txt")
    return tables.read_plays(t.spark, path).unionByName(tables.read_plays(t.spark, f"{root}/plays"), allowMissingColumns=True).groupBy("load_id").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("total_ms"),
        F.count_distinct("play_date").alias("months"))


_LOAD = """SELECT '{name}' AS load_id, COUNT(*) AS plays, CAST(SUM(ms_played) AS BIGINT) AS total_ms,
  COUNT(DISTINCT DATE_TRUNC('month', ts)) AS months FROM plays"""
check("reload_modes", _reloaded,
      f"({sql(_LOAD.format(name='first'))}) UNION ALL ({sql(_LOAD.format(name='second'), 'li')}) UNION ALL ("
      + sql("""SELECT 'c' AS load_id, COUNT(*) AS plays, CAST(SUM(ms) AS BIGINT) AS total_ms,
        COUNT(DISTINCT DATE_TRUNC('month', at_second)) AS months FROM items WHERE music""") + ")")

# Metadata and genres ---------------------------------------------------------------------------

_TRACK_ROWS = """SELECT track_uri, track, COALESCE(artist, '') AS artist, track_popularity,
  CAST(album_release_date AS VARCHAR) AS album_release_date, album, duration_ms, explicit, album_type,
  total_tracks, genres, artist_popularity, artist_uri, artist_followers FROM tracks"""


def _metadata_from(t, kind):
    path = scratch_path(t.spark, "tracks")
    if kind == "csv":
        tables.export_csv(t.tracks, path)
        rows = metadata.read_metadata_csv(t.spark, path)
    else:
        t.tracks.write.parquet(path)
        rows = metadata.read_metadata_parquet(t.spark, path)
    return metadata.last_per_track(metadata.clean_metadata(rows)).select(*TRACKS.fieldNames())


check("metadata_csv", lambda t: _metadata_from(t, "csv"), sql(_TRACK_ROWS))
check("metadata_parquet", lambda t: _metadata_from(t, "parquet"), sql(_TRACK_ROWS))


def _upserted(t):
    """Every line item is an incoming row for its part, every order one for a new track."""
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    sold = t.raw("lineitem").select(
        F.col("l_partkey").cast("string").alias("track_uri"),
        F.col("l_quantity").cast("int").alias("track_popularity"),
        F.col("l_shipdate").cast("date").cast("string").alias("album_release_date"),
        F.struct(*order).alias("_load_order"))
    ordered = t.raw("orders").select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("track_uri"),
        F.length("o_orderpriority").alias("track_popularity"),
        F.lit("").alias("album_release_date"),
        F.struct(F.col("o_orderdate").alias("l_shipdate"), F.col("o_orderkey").alias("l_orderkey"),
                 F.lit(0).alias("l_linenumber"), F.lit(0.0).alias("l_extendedprice"),
                 F.lit(0.0).alias("l_quantity")).alias("_load_order"))
    incoming = metadata.clean_metadata(sold.unionByName(ordered))
    current = metadata.clean_metadata(t.tracks)
    return metadata.upsert_tracks(current, incoming).select(
        "track_uri", "track", "track_popularity", "album_release_date", "album_type", "explicit")


check("metadata_upsert", _upserted,
      sql("""incoming AS (SELECT CAST(l_partkey AS VARCHAR) AS track_uri,
          CAST(l_quantity AS BIGINT) AS track_popularity,
          CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS album_release_date,
          ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
            l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS place FROM lineitem
        UNION ALL SELECT 'o' || CAST(o_custkey AS VARCHAR), LENGTH(o_orderpriority), NULL,
          ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders),
        fresh AS (SELECT * FROM incoming WHERE place = 1)
      SELECT track_uri, '' AS track, track_popularity, album_release_date, 'unknown' AS album_type,
        false AS explicit FROM fresh
      UNION ALL SELECT track_uri, track, track_popularity, CAST(album_release_date AS VARCHAR), album_type,
        explicit FROM tracks WHERE track_uri NOT IN (SELECT track_uri FROM fresh)"""))
check("release_dates",
      lambda t: t.raw("orders").select(
          "o_orderkey",
          metadata.release_day(F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
                               .otherwise("")).alias("release_day"),
          metadata.release_day(F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM"))
                               .when(F.col("o_orderstatus") == "F", "unknown")
                               .otherwise(F.date_format("o_orderdate", "yyyy")), strict=False).alias("lenient_day")),
      """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END
          AS release_day,
        CASE o_orderstatus WHEN 'O' THEN CAST(CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS VARCHAR)
          WHEN 'F' THEN NULL ELSE CAST(CAST(DATE_TRUNC('year', o_orderdate) AS DATE) AS VARCHAR) END
          AS lenient_day FROM orders""")
check("genre_dimension",
      lambda t: genres.genre_dimension(t.tracks).groupBy("name").agg(F.count_distinct("genre_id").alias("ids")),
      sql("SELECT name, CAST(1 AS BIGINT) AS ids FROM track_genres GROUP BY 1"))
check("track_genre_bridge",
      lambda t: t.track_genres.join(t.genres, "genre_id").select("track_uri", "name"),
      sql("SELECT track_uri, name FROM track_genres"))

# Scan, SQL, export -----------------------------------------------------------------------------

check("table_scan", lambda t: t.ev, sql("SELECT * FROM plays"))
_AD_HOC = """SELECT p.artist, COUNT(*) AS plays, CAST(SUM(p.ms_played) AS BIGINT) AS total_ms
  FROM plays p JOIN tracks t ON p.track_uri = t.track_uri
  WHERE t.track_popularity >= 25 AND p.skipped GROUP BY p.artist"""
check("ad_hoc_sql", lambda t: tables.sql(t.spark, _AD_HOC.replace("FROM plays", "FROM {plays}").replace("JOIN tracks", "JOIN {tracks}"),
                             {"plays": t.li, "tracks": t.tracks}),
      sql(_AD_HOC, "li"))


def _exported(t):
    path = scratch_path(t.spark, "export")
    tables.export_csv(t.ev, path)
    back = t.spark.read.schema(t.ev.schema).options(**tables.CSV_READ_OPTIONS).csv(path)
    return back.groupBy("artist", "album").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("total_ms"),
        F.max("ts").alias("last_ts"), F.count_if("skipped").alias("skips"))


check("csv_export", _exported,
      sql("""SELECT artist, album, COUNT(*) AS plays, CAST(SUM(ms_played) AS BIGINT) AS total_ms,
        MAX(ts) AS last_ts, COUNT(*) FILTER (skipped) AS skips FROM plays GROUP BY 1, 2"""))


def _listed(t):
    """The catalog's tables and columns, with the rows of each."""
    named = {f"listed_{n}": t.raw(n) for n in ("events", "part", "lineitem", "documents")}
    tables.register_views(t.spark, named)
    names = [n for n in tables.list_tables(t.spark) if n in named and tables.table_exists(t.spark, n)]
    profile = overview.table_profile({n: t.spark.table(n) for n in names})
    widths = F.create_map(*[F.lit(v) for n in names for v in (n, len(tables.table_schema(t.spark, n)))])
    return profile.withColumn("columns", F.element_at(widths, F.col("table_name"))).drop("is_empty")


check("listed_tables", _listed,
      " UNION ALL ".join(
          f"""SELECT 'listed_{n}' AS table_name, COUNT(*) AS row_count, (SELECT COUNT(*)
            FROM (DESCRIBE SELECT * FROM {n})) AS columns FROM {n}"""
          for n in ("events", "part", "lineitem", "documents")))


def _accumulated(t):
    """The metadata of two exports and an uploaded CSV, all loaded twice: every track is there, and the last row of each stays."""
    root, work = scratch_path(t.spark, "root"), scratch_path(t.spark, "exports")
    key = F.col("track_uri").cast("bigint")

    def rows(low, high, name):
        chosen = t.tracks.where((key % 10 >= low) & (key % 10 < high))
        return chosen.withColumns({"track": F.concat(F.lit(name), "track"), "album_release_date": F.col("album_release_date").cast("string")})

    for name, low, high in (("a", 0, 5), ("b", 4, 8)):
        rows(low, high, name).write.parquet(f"{work}/{name}")
    rows(7, 10, "c").write.options(**tables.CSV_OPTIONS).csv(f"{work}/c")
    for _ in range(2):
        for name in "ab":
            incoming = metadata.clean_metadata(metadata.read_metadata_parquet(t.spark, f"{work}/{name}"))
            load.publish_tracks(t.spark, incoming, root, name)
        load.upload_metadata(t.spark, f"{work}/c", root, "c")
    current = load.read_version(t.spark, root, load.current_version(t.spark, root))["tracks"]
    return current.select("track_uri", "track", "genres")


check("accumulated_tracks", _accumulated,
      sql("""SELECT track_uri, CASE WHEN CAST(track_uri AS BIGINT) % 10 >= 7 THEN 'c' WHEN CAST(track_uri AS BIGINT) % 10 >= 4 THEN 'b'
        ELSE 'a' END || track AS track, genres FROM tracks"""))


def _defined(t):
    """The four tables created empty, filled with given data, opened and checked again."""
    root = scratch_path(t.spark, "defined")
    made = tables.defined_tables(t.spark, root)
    assert all(df.isEmpty() for df in made.values())
    given = {"plays": (t.ev, PLAYS), "tracks": (t.tracks, TRACKS), "genres": (t.genres, GENRES), "track_genres": (t.track_genres, TRACK_GENRES)}
    for name, (df, schema) in given.items():
        absent = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
        typed = df.withColumns(absent).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        typed.write.mode("append").parquet(f"{root}/{name}")
    return overview.table_profile(tables.defined_tables(t.spark, root)).drop("is_empty")


check("defined_tables", _defined,
      sql("""names AS (SELECT DISTINCT name FROM track_genres)
      SELECT 'plays' AS table_name, COUNT(*) AS row_count FROM plays UNION ALL SELECT 'tracks', COUNT(*) FROM tracks
      UNION ALL SELECT 'genres', COUNT(*) FROM names UNION ALL SELECT 'track_genres', COUNT(*) FROM track_genres"""))
check("preview",
      lambda t: enrich.preview(t.ev, 100).join(t.ev.select("id", "track_uri", "ms_played"), ["id", "track_uri", "ms_played"], "left_semi")
      .agg(F.count(F.lit(1)).alias("rows")),
      sql("SELECT LEAST(100, COUNT(*)) AS rows FROM plays"))


# Stored plays: footers, sketches, days of a stream, lookups ------------------------------------------


def _stored(t):
    """The plays as two loads, of days and of months."""
    path = scratch_path(t.spark, "stored")
    tables.load_plays(t.ev.where("id % 3 = 0"), path, "a", "append")
    tables.load_plays(t.ev.where("id % 3 <> 0"), path, "b", "append", "month")
    return path


check("stored_periods", lambda t: footers.stored_periods(t.spark, _stored(t)).withColumn("play_date", F.col("play_date").cast("timestamp_ntz")),
      sql("""SELECT CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS load_id,
        CAST(DATE_TRUNC(CASE WHEN id % 3 = 0 THEN 'day' ELSE 'month' END, ts) AS TIMESTAMP) AS play_date, COUNT(*) AS plays
        FROM plays GROUP BY 1, 2"""))
check("stored_counts", lambda t: footers.stored_counts(t.spark, {"plays": _stored(t), "none": scratch_path(t.spark, "none")}),
      sql("""SELECT 'plays' AS table_name, COUNT(*) AS row_count, COUNT(*) = 0 AS is_empty FROM plays
        UNION ALL SELECT 'none', 0, true"""))
check("stored_date_range", lambda t: footers.stored_date_range(t.spark, _stored(t)).select(
          *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("min_date", "max_date")]),
      sql("""SELECT CAST(CAST(MIN(ts) AS DATE) AS TIMESTAMP) AS min_date, CAST(CAST(MAX(ts) AS DATE) AS TIMESTAMP) AS max_date FROM plays"""))
check("track_lookup", lambda t: tables.read_plays(t.spark, _stored(t)).where(F.col("track_uri").endswith("7")).groupBy("track_uri").agg(
          F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("total_ms")),
      sql("""SELECT track_uri, COUNT(*) AS plays, CAST(SUM(ms_played) AS BIGINT) AS total_ms FROM plays
        WHERE track_uri LIKE '%7' GROUP BY 1"""))


def _near(estimate, exact):
    return (F.abs(F.col(estimate) - F.col(exact)) <= F.ceil(F.col(exact) * 0.05)).alias(f"{estimate}_near")


def _sketched(t):
    """Exact counts of each month, and whether merged sketches of days come near them."""
    days = approximate.day_sketches(t.li)
    exact = t.li.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count_distinct("track").alias("tracks"), F.count_distinct("artist").alias("artists"))
    found = [approximate.approximate_distinct(days, c).select("ts", F.col("distinct_values").alias(c)) for c in ("track", "artist")]
    return exact.join(found[0], "ts").join(found[1], "ts").select("ts", "tracks", "artists", _near("track", "tracks"), _near("artist", "artists"))


check("approximate_distinct", _sketched,
      sql("""SELECT CAST(DATE_TRUNC('month', ts) AS TIMESTAMP) AS ts, COUNT(DISTINCT track) AS tracks, COUNT(DISTINCT artist) AS artists,
        true AS track_near, true AS artist_near FROM plays GROUP BY 1""", "li"))


def _streamed_days(t):
    """Days that a stream has closed; a play far behind the others closes them all."""
    landing, out, progress = (scratch_path(t.spark, n) for n in ("landing", "days", "progress"))
    t.ev.select("ts", "ms_played").write.parquet(landing)
    daily.start_daily(t.spark, landing, out, progress, "40 days").awaitTermination()
    last = t.ev.agg((F.max("ts") + F.make_interval(years=F.lit(1))).alias("ts"), F.lit(0).cast("bigint").alias("ms_played"))
    last.write.mode("append").parquet(landing)
    daily.start_daily(t.spark, landing, out, progress, "40 days").awaitTermination()
    return t.spark.read.parquet(out)


check("plays_by_day_stream", _streamed_days,
      sql("""SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS day, COUNT(*) AS play_count, CAST(SUM(ms_played) AS BIGINT) AS total_ms,
        ROUND(AVG(ms_played), 6) AS avg_ms, ROUND(SUM(ms_played) / 60000.0, 6) AS total_minutes, ROUND(AVG(ms_played) / 60000.0, 6) AS avg_minutes
        FROM plays GROUP BY 1"""))
