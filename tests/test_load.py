"""Whole loads from files to tables."""

import json

from playtrail.operators.enrich import preview
from playtrail.operators.genres import top_genres
from playtrail.operators.overview import overview_full
from playtrail.schemas import GENRES, TRACK_GENRES, TRACKS
from playtrail.sources import load
from playtrail.sources.tables import read_plays
from tests.test_history import PLAY, PODCAST
from tests.test_metadata import HEADER, ROW

URI = PLAY["spotify_track_uri"]


def _export(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    whole = json.dumps([PLAY, PODCAST, {**PLAY, "ms_played": 5}])
    (folder / "Streaming_History_Audio_1.json").write_text(whole)
    (folder / "Streaming_History_Audio_2.json").write_text(whole[:-40])
    metadata = str(tmp_path / "metadata.parquet")
    spark.createDataFrame(
        [(URI, "Mudflats", "The Herons", "['a', 'b']", 2.0), (None, "x", "y", "", 1.0),
         ("uri:2", None, None, None, None)],
        "track_uri string, track string, artist string, genres string, track_popularity double",
    ).write.parquet(metadata)
    return str(folder), metadata


def test_export_load(spark, tmp_path):
    folder, metadata = _export(spark, tmp_path)
    root = str(tmp_path / "root")
    done = load.load_export(spark, folder, metadata, root, "first")
    assert done.plays_written
    assert {r.table_name: r.row_count for r in done.counts.collect()} == {
        "plays": 3, "tracks": 2, "genres": 2, "track_genres": 2}
    report = {r.source_file[-6:]: (r.inserted, r.skipped_content, r.status) for r in done.report.collect()}
    assert report == {"1.json": (2, 1, "loaded"), "2.json": (1, 1, "loaded")}

    again = load.load_export(spark, folder, metadata, root, "second")
    assert not again.plays_written
    load.load_export(spark, folder, metadata, root, "third", mode="append")
    plays = read_plays(spark, f"{root}/plays")
    assert sorted(r.id for r in plays.collect()) == [1, 2, 3, 4, 5, 6]
    load.load_export(spark, folder, metadata, root, "third", mode="append")
    assert sorted(r.id for r in read_plays(spark, f"{root}/plays").collect()) == [1, 2, 3, 4, 5, 6]
    load.load_export(spark, folder, metadata, root, "fourth", mode="replace_all")
    plays = read_plays(spark, f"{root}/plays")
    assert plays.count() == 3

    read = {n: spark.read.schema(s).parquet(f"{root}/{n}/fourth")
            for n, s in (("tracks", TRACKS), ("genres", GENRES), ("track_genres", TRACK_GENRES))}
    top = top_genres(plays, read["genres"], read["track_genres"]).collect()
    assert [(r.genre, r.total_ms, r.play_count) for r in top] == [("a", 429011, 3), ("b", 429011, 3)]
    assert overview_full(plays, **read).first().unique_genres == 2
    assert preview(plays, 2).count() == 2


def test_uploads(spark, tmp_path):
    root = str(tmp_path / "root")
    for n in (1, 2):
        (tmp_path / f"up{n}.json").write_text(json.dumps([{**PLAY, "ms_played": i} for i in range(2 + n)]))
        for _ in range(2):  # a repeated upload changes nothing
            assert load.upload_history(spark, str(tmp_path / f"up{n}.json"), root, f"up{n}")
    plays = read_plays(spark, f"{root}/plays")
    assert sorted(r.id for r in plays.collect()) == list(range(1, 8))

    (tmp_path / "one.csv").write_text(HEADER + ROW)
    (tmp_path / "two.csv").write_text(HEADER + ROW.replace("marsh rock", "new genre") + ROW.replace(URI, "uri:2"))
    load.upload_metadata(spark, str(tmp_path / "one.csv"), root, "v1")
    tables = load.upload_metadata(spark, str(tmp_path / "two.csv"), root, "v2")
    assert {r.track_uri: r.genres for r in tables["tracks"].collect()} == {
        URI: "['new genre']", "uri:2": "['marsh rock']"}
    assert {r.name for r in tables["genres"].collect()} == {"new genre", "marsh rock"}
    assert spark.read.parquet(f"{root}/tracks/v1").count() == 1
    again = load.upload_metadata(spark, str(tmp_path / "one.csv"), root, "v1")  # repeating a version changes no later one
    assert again["tracks"].count() == 1 and load.current_version(spark, root) == "v2"
    third = load.upload_metadata(spark, str(tmp_path / "one.csv"), root, "v3")
    assert {r.track_uri: r.genres for r in third["tracks"].collect()} == {URI: "['marsh rock']", "uri:2": "['marsh rock']"}
