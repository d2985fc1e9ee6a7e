"""Edge rows and properties the big comparisons do not show."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks.tables import Tables
from playtrail.functions import calendar, text
from playtrail.operators import genres, rankings, releases, repetition, shares, timeline
from playtrail.operators.overview import auto_granularity
from playtrail.plans import filters as f
from playtrail.plans.ordered import number_by_position

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def _at(spark, *stamps):
    return spark.createDataFrame([(dt.datetime.fromisoformat(s),) for s in stamps], "ts timestamp_ntz")


def _hours(df):
    return sorted(r.ts.hour for r in df.collect())


def test_day_parts_include_their_last_hour_or_not(spark):
    df = _at(spark, *[f"2024-01-01T{h:02}:59:00" for h in (0, 5, 6, 12, 18, 23)])
    assert _hours(df.where(f.build_filter(day_parts=["6AM-12PM"]))) == [6, 12]
    assert _hours(df.where(f.build_period_filter(day_parts=["6AM-12PM"]))) == [6]
    assert _hours(df.where(f.build_filter(day_parts=["12AM-6AM"]))) == [0, 5, 6]
    assert _hours(df.where(f.build_filter(day_parts=["6PM-12AM"]))) == [18, 23]


def test_inclusive_day_parts_hold_the_half_open_ones(t):
    for part in f.DAY_PARTS:
        half = t.ev.where(f.build_period_filter(day_parts=[part])).select("id")
        whole = t.ev.where(f.build_filter(day_parts=[part])).select("id")
        assert half.subtract(whole).isEmpty()


def test_date_range_includes_both_days_and_only_counts_for_all_time(spark):
    df = _at(spark, "2024-01-01T23:59:59.999999", "2024-01-02T00:00:00", "2024-01-03T23:59:59.999999",
             "2024-01-04T00:00:00")
    days = ("2024-01-02", "2024-01-03")
    assert df.where(f.build_filter(date_range=days)).count() == 2
    assert f.build_filter(date_range=None) is None
    assert df.where(f.build_filter("Day", date_range=days, as_of="2024-01-04T00:00:00")).count() == 2
    assert f.build_filter("no such frame", date_range=days) is None


def test_unknown_names(spark):
    assert f.build_filter(day_parts=["noon"]) is None
    for build in (lambda: f.build_filter(days=["Noday"]),
                  lambda: f.build_period_filter(day_parts=["noon"]),
                  lambda: f.build_period_filter("Decade")):
        with pytest.raises((KeyError, ValueError)):
            build()
    assert [calendar.timeframe_unit(n) for n in ("All Time", "Year", "Week", "Day", None, "x")] == [
        "month", "year", "week", "day", "month", "month"]


def test_weekday_numbers_and_names(spark):
    df = _at(spark, "2024-01-06", "2024-01-07", "2024-01-08").select(calendar.weekday("ts").alias("d"))
    assert [r.d for r in df.collect()] == [6, 0, 1]
    assert [r[0] for r in df.select(calendar.weekday_name(F.col("d"))).collect()] == [
        "Saturday", "Sunday", "Monday"]


def test_periods_do_not_depend_on_the_session_zone(spark):
    df = _at(spark, "2024-03-31T02:30:00", "2024-10-27T02:30:00")
    units = [calendar.period_start(u, "ts") for u in calendar.PERIOD_UNITS]
    here = df.select(*units).collect()
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(*units).collect() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_granularity_counts_elapsed_days(spark):
    def fitted(*stamps):
        return tuple(auto_granularity(_at(spark, *stamps)).select("span_days", "unit").first())

    assert fitted("2024-01-01T23:00:00", "2024-03-01T01:00:00") == (59, "day")
    assert fitted("2024-01-01T01:00:00", "2024-03-01T01:00:00") == (60, "week")
    assert fitted("2023-01-01T01:00:00", "2024-01-01T00:59:59") == (364, "week")
    assert fitted("2023-01-01T01:00:00", "2024-01-01T01:00:00") == (365, "month")


def test_a_play_counts_once_for_each_genre_of_its_track(spark):
    at = dt.datetime(2024, 1, 1, 6)
    plays = spark.createDataFrame(
        [(at, "u1", 10), (at, "u1", 0), (at, "u2", 5), (at, None, 9), (at, "gone", 9)],
        "ts timestamp_ntz, track_uri string, ms_played bigint")
    bridge = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 2)], "track_uri string, genre_id bigint")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "genre_id bigint, name string")
    for threshold in (10_000_000_000, -1):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            hours = genres.genre_by_hour(plays, names, bridge).collect()
            periods = genres.genre_evolution(plays, names, bridge, limit=1).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted((r.hour, r.genre, r["count"]) for r in hours) == [(6, "a", 1), (6, "b", 2)]
        assert sorted((r.genre, r.plays, r.total_ms) for r in periods) == [("Other", 1, 10), ("b", 2, 15)]


def test_texts(spark):
    ms = [0, 59_999, 60_000, 3_600_000, 90_061_000, 2_630_017_000, 2_630_017_000 + 43_200_000, None]
    df = spark.createDataFrame([(m,) for m in ms], "ms bigint")
    assert [r[0] for r in df.select(text.long_duration_text(F.col("ms"))).collect()] == [
        "0m", "0m", "1m", "1h", "1d 1h 1m", "1mo 730h 33m", "1mo 742h 33m", "0m"]
    assert [r[0] for r in df.limit(5).select(text.duration_text(F.col("ms"))).collect()] == [
        "0d 0h 0m", "0d 0h 0m", "0d 0h 1m", "0d 1h 0m", "1d 1h 1m"]
    label = text.item_label(F.lit(None).cast("string"), F.lit(5_460_000), F.lit(1234))
    assert df.limit(1).select(label).first()[0] == (
        "None\nListened to 1 hours, 30 minutes\nPlayed 1,234 times")  # the minutes come out of a double
    values = spark.createDataFrame([(1234.25,), (0.35,), (float("nan"),), (None,)], "v double")
    assert [tuple(r) for r in values.select(
        text.hours_text(F.col("v")), text.count_text(F.col("v"))).collect()] == [
        ("1234.2 hours", "1,234"), ("0.3 hours", "0"), ("N/A", "0"), ("N/A", "0")]


def test_equal_totals_at_the_limit_are_settled_by_key(spark):
    rows = [(a, 10) for a in "dcba"]
    plays = spark.createDataFrame(rows, "artist string, ms_played bigint").withColumn("track", F.lit("t"))
    assert [r.artist for r in rankings.top_artists(plays, limit=2).collect()] == ["a", "b"]


def test_remix_in_any_case_and_unknown_track(spark):
    rows = [("Song (ReMiX)", 1), ("Song", 2), (None, 3)]
    plays = spark.createDataFrame(rows, "track string, ms_played bigint")
    assert {r.is_remix: r["count"] for r in shares.remix_share(plays).collect()} == {
        "Remix": 1, "Original": 2}


def test_shares_add_up(t):
    for share in (shares.skip_share, shares.skip_share_time, shares.remix_share, shares.remix_share_time):
        assert share(t.ev).agg(F.sum("percentage")).first()[0] == pytest.approx(1)
    evolution = genres.genre_evolution(t.li, t.genres, t.track_genres)
    sums = evolution.groupBy("period").agg(F.sum("proportion").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_roll_ups_keep_their_totals(t):
    profile = {r.hour: r["count"] for r in timeline.hour_profile(t.ev).collect()}
    assert profile == {r.hour: r["count"] for r in timeline.hour_counts(t.ev).collect()}
    totals = [F.sum(c) for c in ("total_ms", "play_count", "unique_tracks")]
    years = releases.release_years(t.li, t.tracks, as_of="1999-06-15").agg(*totals).first()
    assert tuple(years) == tuple(
        releases.release_decades(t.li, t.tracks, as_of="1999-06-15").agg(*totals).first())


def test_empty_history(t):
    none = t.ev.where("ms_played < 0")
    assert shares.skip_share(none).isEmpty() and repetition.consecutive_repeats(none).isEmpty()


def _brute_repeats(rows):
    days, previous = {}, None
    for ts, _, artist in sorted(rows):
        known = days.setdefault(ts.date(), [])
        if artist is not None and previous is not None:
            known.append(artist == previous)
        previous = artist
    return {d: (sum(k) / len(k) if k else None) for d, k in days.items()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_consecutive_repeats_with_ties_gaps_and_a_hot_day(spark, batch):
    draw = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for n in range(900):
        # A third of all plays share one instant of one day; some days have one play or none.
        hot = n % 3 == 0
        ts = dt.datetime(2024, 1, 9, 12) if hot else start + dt.timedelta(hours=7 * draw.randrange(150))
        rows.append((ts, n, draw.choice(["a", "a", "b", None])))
    draw.shuffle(rows)
    plays = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint, artist string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.ts.date(): r.repetitiveness for r in repetition.consecutive_repeats(plays).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _brute_repeats(rows)
    assert got.keys() == want.keys()
    for day, value in want.items():
        assert got[day] == (None if value is None else pytest.approx(value))


def test_numbers_follow_files_and_positions(spark):
    rows = [(f"f{n % 7}", n // 7, n) for n in range(500)] + [("hot", n, 1000 + n) for n in range(400)]
    want = {n: i for i, (_, _, n) in enumerate(sorted(rows), 11)}
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "source_file string, position int, n bigint").repartition(parts)
        assert {r.n: r.id for r in number_by_position(df, start=10).collect()} == want


def test_repeats_do_not_depend_on_the_partitioning(spark):
    draw = random.Random(9)
    rows = [(f"f{n % 3}", n // 3, dt.datetime(2024, 1, 1 + draw.randrange(3)), draw.choice("ab")) for n in range(300)]
    got = []
    for parts in (1, 5, 9):
        plays = number_by_position(spark.createDataFrame(rows, "source_file string, position int, ts timestamp_ntz, artist string").repartition(parts))
        got.append(sorted(map(tuple, repetition.consecutive_repeats(plays).collect())))
    assert got[0] == got[1] == got[2]
