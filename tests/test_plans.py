"""Shapes the plans must keep to hold at scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.tables import Tables
from playtrail.operators import enrich, genres, rankings
from playtrail.plans import filters as f
from playtrail.sources import tables
from playtrail.sources.genres import genre_dimension, track_genre_bridge
from tests.compare import NO_BROADCASTS, settings

FOLDER = "/root/testdata/sf0.001"
FACT_FILES = ("events.parquet", "lineitem.parquet")

# Queries of one table of plays, which they may read once only.
ONE_SCAN = ["overview_full", "overview_full_years", "artist_trends_top10", "genre_evolution",
            "genre_evolution_years", "genre_text_evolution", "genre_text_evolution_years",
            "genre_by_hour", "genre_by_hour_filtered", "release_years", "top_genres", "album_completion",
            "skip_share_time", "listening_trends", "artist_repetitiveness", "same_year_share"]


def _executed(df):
    """The plan as run, without the initial plans adaptive execution shows below each final one."""
    df.collect()
    kept, skip_below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip_below is not None and depth >= skip_below:
            continue
        skip_below = depth if "== Initial Plan ==" in line else None
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture(autouse=True)
def whole_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("broadcasts", [True, False])
@pytest.mark.parametrize("name", ONE_SCAN)
def test_plays_are_scanned_once_and_never_crossed(spark, name, broadcasts):
    with settings(spark, {} if broadcasts else NO_BROADCASTS):
        final = _executed(entry.queries()[name](spark, FOLDER))
    scans = [p for p in re.findall(r"FileScan parquet [^\n]*", final) if any(x in p for x in FACT_FILES)]
    assert len(scans) == 1, scans
    assert "CartesianProduct" not in final and "BroadcastNestedLoopJoin" not in final
    assert broadcasts or "BroadcastHashJoin" not in final


@pytest.mark.parametrize("broadcasts", [True, False])
def test_plays_are_collapsed_before_they_meet_tracks(spark, broadcasts):
    """Fifty genres a track: plays are summed up by track in the scan stage, and no estimate broadcasts the bridge."""
    t = Tables(spark, FOLDER)
    plays = t.raw("lineitem").select(
        F.col("l_shipdate").alias("ts"), F.col("l_partkey").cast("string").alias("track_uri"),
        F.lit(1).cast("bigint").alias("ms_played"), F.lit(False).alias("skipped"))
    tracks = t.tracks.withColumn("genres", F.to_json(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda n: F.concat(F.lit("g"), n.cast("string")))))
    bridge, names = track_genre_bridge(tracks), genre_dimension(tracks)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"} if broadcasts else NO_BROADCASTS):
        df = genres.genre_evolution(plays, names, bridge, unit="year")
        initial = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastExchange" not in initial and "BroadcastHashJoin" not in initial
        plan = _executed(df)
    above = plan[:plan.index("lineitem.parquet")]
    assert "partial_count(1)" in above[list(re.finditer("(Hash|Merge)Join", above))[-1].end():]


def test_filters_reach_the_scan(spark, tmp_path):
    stamps = [dt.datetime(2024, m, 3, 4) for m in range(1, 10)]
    rows = [(s, n, f"a{n}", "t") for n, s in enumerate(stamps)]
    plays = spark.createDataFrame(rows, "ts timestamp_ntz, ms_played bigint, artist string, track string")
    path = str(tmp_path / "plays")
    tables.load_plays(plays.withColumn("unused", F.lit("x")), path, "a")
    window = f.build_filter(date_range=("2024-03-01", "2024-05-31"), partition=("play_date", "day"))
    top = rankings.top_artists_known(tables.read_table(spark, path), window)
    assert top.count() == 3
    scan = re.search(r"FileScan parquet [^\n]*", _executed(top)).group(0)
    assert "GreaterThanOrEqual(ts,2024-03-01T00:00)" in scan and "LessThan(ts,2024-06-01T00:00)" in scan
    assert "IsNotNull(artist)" in scan
    assert re.search(r"PartitionFilters: \[[^\]]*play_date[^\]]*>= 2024-03-01", scan)
    assert "unused" not in scan and "track" not in scan.split("]")[0]


def test_hot_track_in_a_row_level_join_is_split(spark):
    """A third of all plays on one track: adaptive execution splits its partition."""
    n = 300_000
    plays = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("track_uri"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.repeat(F.lit("x"), 50).alias("pad"), "id")
    tracks = spark.range(n).select(
        F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("track_uri"),
        F.lit("g").alias("genres"))
    changed = {**NO_BROADCASTS,
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    with settings(spark, changed):
        joined = enrich.enriched_plays(plays.repartition(16), tracks)
        assert "skew=true" in _executed(joined.select("id", "pad", "genres"))
        assert joined.where("genres = 'g'").count() == n
