"""Sketches against exact counts, footers against scans, days of a stream against days of a table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtrail.operators import approximate, overview, timeline
from playtrail.sources import footers, tables
from playtrail.streaming import daily


def _plays(spark, n, days=10, tracks=5000):
    return spark.range(n).select(
        (F.lit("2024-03-25 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") % days).cast("int"), secs=F.col("id") % 86_400)).alias("ts"),
        (F.col("id") % 100 * 1000).alias("ms_played"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(tracks))).alias("track"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(700)))).alias("artist"),
        F.lit(None).cast("string").alias("album"), (F.col("id") % 4 == 0).alias("skipped"))


def test_merged_sketches_are_near_exact_counts(spark, tmp_path):
    plays = _plays(spark, 60_000)
    for part in (0, 1):  # rows of two loads, for the same days
        approximate.day_sketches(plays.where(F.pmod(F.xxhash64("ts", "track"), F.lit(2)) == part)).write.parquet(str(tmp_path / f"load{part}"))
    days = spark.read.parquet(str(tmp_path / "load*"))
    assert days.count() == 20
    late = F.col("day") >= "2024-04-01"
    for filt, exact in ((None, overview.overview_stats(plays)), (late, overview.overview_stats(plays, F.col("ts") >= "2024-04-01"))):
        got, want = approximate.approximate_overview(days, filt).first(), exact.first()
        assert abs(got.unique_tracks / want.unique_tracks - 1) < 0.05 and abs(got.unique_artists / want.unique_artists - 1) < 0.05
        assert (got.total_hours, got.skip_rate) == (want.total_hours, want.skip_rate)
    exact = {r.ts: r for r in timeline.artist_repetitiveness(plays).collect()}
    got = approximate.approximate_repetitiveness(days).collect()
    assert {r.ts for r in got} == set(exact) and all(r.total_plays == exact[r.ts].total_plays for r in got)
    assert all(abs(r.unique_artists / exact[r.ts].unique_artists - 1) < 0.05 for r in got)
    months = {r.ts.month: r.distinct_values for r in approximate.approximate_distinct(days, "track").collect()}
    assert set(months) == {3, 4} and all(abs(v / 5000 - 1) < 0.05 for v in months.values())
    assert {r.distinct_values for r in approximate.approximate_distinct(days, "album").collect()} == {0}


def test_larger_sketches_err_less_and_merging_reads_no_plays(spark):
    plays = spark.range(200_000).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("ms_played"),
                                        F.lit(False).alias("skipped"), F.col("id").cast("string").alias("track"), F.lit("a").alias("artist"))
    for lg_k in (8, 14):
        days = approximate.day_sketches(plays, columns=("track", "artist"), lg_k=lg_k)
        got = approximate.approximate_overview(days).first()
        assert abs(got.unique_tracks / 200_000 - 1) < 4 * 1.04 / 2 ** (lg_k / 2) and got.unique_artists == 1
    nothing = approximate.approximate_overview(approximate.day_sketches(plays.where("false"), columns=("track", "artist"))).first()
    assert (nothing.unique_tracks, nothing.unique_artists, nothing.total_hours) == (0, 0, None)


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "plays")
    plays = _plays(spark, 5_000)
    assert footers.stored_date_range(spark, path, as_of="2024-06-01").first() == (dt.date(2015, 1, 1), dt.date(2024, 6, 1))
    tables.load_plays(plays, path, "a", "append")
    tables.load_plays(plays.where("ms_played > 50000"), path, "b", "append", "month")
    periods = footers.stored_periods(spark, path)
    assert "COUNT(*)" in periods._jdf.queryExecution().toString().split("PushedAggregation")[1][:40]
    stored = tables.read_plays(spark, path)
    assert sorted(map(tuple, periods.collect())) == sorted(map(tuple, stored.groupBy("load_id", "play_date").count().collect()))
    counts = footers.stored_counts(spark, {"plays": path, "none": str(tmp_path / "none")}).collect()
    assert [tuple(r) for r in counts] == [("plays", stored.count(), False), ("none", 0, True)]
    assert footers.stored_date_range(spark, path).first() == overview.date_range(stored).first()
    tables.load_plays(plays.where("false"), path, "c", "replace_all")
    assert footers.stored_counts(spark, {"plays": path}).first().row_count == 0
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_of_the_stream_equal_days_of_the_table(spark, tmp_path, zone):
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))
    before = spark.conf.get("spark.sql.session.timeZone")

    def land(df):
        df.select("ts", "ms_played").coalesce(1).write.mode("append").parquet(landing)

    def run():
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            daily.start_daily(spark, landing, out, progress, "1 day", files_per_batch=1).awaitTermination()
            return {r.day: tuple(r) for r in spark.read.parquet(out).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)

    plays = _plays(spark, 3_000, days=6)
    want = {r.day: tuple(r) for r in timeline.plays_by_day(plays).collect()}
    land(plays.where("ts < '2024-03-28'"))
    assert set(run()) == {d for d in want if d < dt.datetime(2024, 3, 26)}  # the 26th ends within a day of the latest play
    land(plays.where("ts >= '2024-03-28'"))
    land(spark.createDataFrame([(dt.datetime(2024, 5, 1), 1), (None, 5)], "ts timestamp_ntz, ms_played bigint"))
    assert run() == want
    # A play of a day that is written comes too late and changes nothing; one of an open day counts.
    land(spark.createDataFrame([(dt.datetime(2024, 3, 25, 12), 7), (dt.datetime(2024, 4, 30, 12), 9)], "ts timestamp_ntz, ms_played bigint"))
    land(spark.createDataFrame([(dt.datetime(2024, 6, 1), 1)], "ts timestamp_ntz, ms_played bigint"))
    got = run()
    assert {d: r for d, r in got.items() if d in want} == want
    assert {d: r[1] for d, r in got.items() if d not in want} == {dt.datetime(2024, 4, 30): 1, dt.datetime(2024, 5, 1): 1}
