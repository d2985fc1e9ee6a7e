"""Table definition, load modes, listing, streaming ingest and export."""

import json

import pytest
from pyspark.sql import functions as F

from playtrail.plans import filters as f
from playtrail.schemas import PLAYS, PLAYS_WITH_ID, TABLES, require_columns
from playtrail.sources import history, tables
from playtrail.streaming import filedrop
from tests.test_history import PLAY


def _plays(spark, count, day="2024-05-28"):
    items = [{**PLAY, "ts": f"{day}T10:00:{n:02}Z", "ms_played": n} for n in range(count)]
    docs = spark.createDataFrame([("a", json.dumps(items))], "source_file string, body string")
    return history.bulk_plays(docs).drop("source_file", "position")


def test_tables_are_created_once_and_checked(spark, tmp_path):
    made = tables.defined_tables(spark, str(tmp_path))
    assert {n: df.columns for n, df in made.items()} == {n: s.fieldNames() for n, s in TABLES.items()}
    assert all(df.isEmpty() for df in made.values())
    assert tables.defined_tables(spark, str(tmp_path)).keys() == made.keys()
    with pytest.raises(ValueError, match="missing columns"):
        tables.ensure_table(spark, f"{tmp_path}/genres", TABLES["plays"])
    with pytest.raises(ValueError, match="another type"):
        require_columns(made["plays"].withColumn("ms_played", F.lit("1")), PLAYS)


def test_load_modes(spark, tmp_path):
    path = str(tmp_path / "plays")
    assert tables.is_empty(spark, path)
    assert tables.load_plays(_plays(spark, 3), path, "a")
    assert not tables.load_plays(_plays(spark, 4), path, "b")
    for _ in range(2):
        tables.load_plays(_plays(spark, 5, "2024-06-01"), path, "b", "append")
    table = tables.read_table(spark, path)
    assert {r.load_id: r["count"] for r in table.groupBy("load_id").count().collect()} == {"a": 3, "b": 5}
    tables.load_plays(_plays(spark, 2), path, "c", "replace_all")
    assert tables.read_table(spark, path).count() == 2
    with pytest.raises(ValueError):
        tables.load_plays(_plays(spark, 2), path, "d", "no such mode")


def test_partition_bounds_prune_and_keep_every_row(spark, tmp_path):
    for grain in ("day", "month"):
        path = str(tmp_path / grain)
        for n, day in enumerate(("2024-03-30", "2024-04-02", "2024-05-28", "2024-06-01")):
            tables.load_plays(_plays(spark, n + 1, day), path, str(n), "append", grain)
        table = tables.read_table(spark, path)
        window = f.between_days("2024-04-02", "2024-05-28", partition=("play_date", grain))
        assert table.where(window).count() == 5
        last = f.trailing("month", "2024-06-02 00:00:00", partition=("play_date", grain))
        assert table.where(last).count() == 7


def test_listing_and_sql(spark):
    tables.register_views(spark, {"plays_listed": _plays(spark, 2)})
    assert "plays_listed" in tables.list_tables(spark)
    assert tables.table_exists(spark, "plays_listed") and not tables.table_exists(spark, "no_such_table")
    assert tables.table_schema(spark, "plays_listed")["ms_played"] == "bigint"
    rows = tables.sql(spark, "SELECT COUNT(*) AS n FROM {p} WHERE ms_played >= :least",
                      {"p": _plays(spark, 5)}, {"least": 3}).collect()
    assert rows[0].n == 2
    assert ("p", "ts", "timestamp_ntz") in tables.column_listing({"p": _plays(spark, 1)})
    spark.catalog.dropTempView("plays_listed")


def test_repeating_a_version_of_tracks_replaces_it(spark, tmp_path):
    for rows in (5, 3):
        tables.write_tracks(spark.range(rows), str(tmp_path / "v1"))
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 3


def test_sql_leaves_the_views_of_the_session(spark):
    spark.range(7).createOrReplaceTempView("mine")
    assert tables.sql(spark, "SELECT COUNT(*) AS n FROM {mine}", {"mine": spark.range(2)}).first().n == 2
    assert spark.table("mine").count() == 7
    spark.catalog.dropTempView("mine")


def test_export_keeps_values(spark, tmp_path):
    rows = [("a, b", 1), ('say "x"', 2), ("", 3), (None, 4), ("two\nlines", 5)]
    df = spark.createDataFrame(rows, "name string, n int")
    tables.export_csv(df, str(tmp_path / "out"))
    reader = spark.read.schema(df.schema).options(**tables.CSV_READ_OPTIONS, multiLine=True)
    back = reader.csv(str(tmp_path / "out"))
    assert sorted(back.collect(), key=lambda r: r.n) == df.collect()


def test_dropped_files_are_ingested_once_and_published(spark, tmp_path):
    folder, landing, progress = tmp_path / "in", str(tmp_path / "landing"), str(tmp_path / "progress")
    folder.mkdir()
    whole = json.dumps([{**PLAY, "ms_played": n} for n in range(4)])
    (folder / "a.json").write_text(whole)
    (folder / "b.json").write_text(whole[:-25])

    def landed():
        filedrop.ingest(spark, str(folder), landing, progress, mode="upload", files_per_batch=1)
        return spark.read.parquet(landing).count()

    assert landed() == 7
    assert landed() == 7
    (folder / "c.json").write_text(json.dumps([PLAY]))
    assert landed() == 8
    batch = history.upload_plays(history.read_documents(spark, f"{folder}/*.json"), recover=True)
    assert sorted(map(str, batch.collect())) == sorted(map(str, spark.read.parquet(landing).collect()))

    table = str(tmp_path / "plays")
    assert filedrop.publish(spark, landing, table, "first")
    first = tables.read_plays(spark, table)
    assert sorted(r.id for r in first.select("id").collect()) == list(range(1, 9))
    require_columns(first, PLAYS_WITH_ID)
    assert "source_file" not in spark.read.parquet(table).columns
    (folder / "d.json").write_text(json.dumps([PLAY] * 3))
    assert landed() == 11
    for load in ("first", "second", "second"):
        assert filedrop.publish(spark, landing, table, load)
    assert not filedrop.publish(spark, landing, table, "third")
    plays = tables.read_plays(spark, table)
    assert sorted(r.id for r in plays.collect()) == list(range(1, 12))
    assert {r.load_id: r["count"] for r in plays.groupBy("load_id").count().collect()} == {"first": 8, "second": 3}


def test_unreadable_dropped_file_fails_the_upload_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("invalid json")
    with pytest.raises(Exception, match="no JSON array"):
        filedrop.ingest(spark, str(folder), str(tmp_path / "l"), str(tmp_path / "p"), mode="upload")


@pytest.mark.parametrize("mode", ["upload", "bulk"])
def test_unreadable_files_go_into_quarantine(spark, tmp_path, mode):
    """Bad files between good ones: the good ones land, the bad ones are listed once, also when the stream runs again."""
    folder, landing, progress = tmp_path / "in", str(tmp_path / "landing"), str(tmp_path / "progress")
    folder.mkdir()
    late = {**PLAY, "ts": "28/05/2024"}
    bodies = {"a": json.dumps([PLAY, PLAY]), "b": "invalid json", "c": json.dumps([PLAY])[:-25], "d": json.dumps([PLAY, late]),
              "e": json.dumps([{**PLAY, "ms_played": "long"}]), "f": json.dumps([{**PLAY, "skipped": "perhaps"}]), "g": json.dumps([PLAY]), "h": "[]"}

    def run():
        filedrop.ingest(spark, str(folder), landing, progress, mode=mode, files_per_batch=2, quarantine=True)
        refused = sorted((r.source_file[-6], r.reason) for r in filedrop.refused_files(spark, landing).collect())
        return sorted(r.source_file[-6] for r in filedrop.landed_plays(spark, landing).collect()), refused

    for name in "abcdefgh":
        (folder / f"{name}.json").write_text(bodies[name])
    landed, refused = run()
    no_array = "no JSON array of plays"
    if mode == "upload":
        assert landed == ["a", "a", "g"]
        assert refused == [("b", no_array), ("c", no_array), ("d", "a time cannot be read"), ("e", "a duration cannot be read"),
                           ("f", "a skip flag cannot be read")]
    else:
        assert landed == ["a", "a", "d", "f", "g"]
        assert refused == [("b", no_array), ("c", no_array)]
    assert run() == (landed, refused)
    (folder / "i.json").write_text(json.dumps([PLAY]))
    (folder / "j.json").write_text("x")
    again = run()
    assert again == (sorted([*landed, "i"]), sorted([*refused, ("j", no_array)]))
    table = str(tmp_path / "plays")
    assert filedrop.publish(spark, landing, table, "first") and not filedrop.publish(spark, landing, table, "second")
    plays = tables.read_plays(spark, table)
    assert plays.count() == len(again[0])
    require_columns(plays, PLAYS_WITH_ID)


def test_accepted_uploads_are_the_same_with_and_without_quarantine(spark):
    bodies = [json.dumps([PLAY, None, {}, {**PLAY, "conn_country": "GB"}]), "null", json.dumps([{"ts": "2024-01-01T00:30:00Z"}])]
    docs = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "source_file string, body string")
    judged = history.upload_or_refuse(docs).drop("refused")
    plain = history.upload_plays(docs)
    assert judged.columns == plain.columns
    assert sorted(map(str, judged.collect())) == sorted(map(str, plain.collect()))


def test_looking_up_a_track_reads_little(spark, tmp_path):
    """Rows that leave the scan of a track: a page or two of each file, and none for a track that is not there."""
    path = str(tmp_path / "plays")
    plays = spark.range(400_000, numPartitions=4).select(
        (F.lit("2024-03-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 172_800)).alias("ts"),
        F.concat(F.lit("spotify:track:"), F.md5((F.col("id") % 30_000).cast("string"))).alias("track_uri"), F.col("id").alias("ms_played"))
    tables.load_plays(plays, path, "a", "append")

    def scanned(uri):
        found = tables.read_plays(spark, path).where(F.col("track_uri") == uri).select("ts", "ms_played")
        rows = found.count()
        plan = found._jdf.queryExecution().executedPlan()
        read = found.select("ms_played")
        assert len(read.collect()) == rows and plan is not None
        done = read._jdf.queryExecution().executedPlan()
        leaves = done.collectLeaves()
        return rows, sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))

    one = plays.where("id = 77").first().track_uri
    rows, read = scanned(one)
    assert rows in (13, 14) and rows <= read < 0.15 * 400_000
    assert scanned(one[:-1] + ("0" if one[-1] != "0" else "1")) == (0, 0)
    stored = tables.read_plays(spark, path)
    assert stored.count() == 400_000 and stored.select("play_date").distinct().count() == 2
