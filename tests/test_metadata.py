"""Track metadata: sources, defaults, upsert, and the genre tables made from it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtrail.schemas import GENRES, TRACK_GENRES, TRACKS, require_columns
from playtrail.sources import genres, metadata

HEADER = ("track_uri,artist_uri,genres,album,album_type,total_tracks,album_release_date,track,artist,duration_ms,explicit,"
          "artist_followers,artist_popularity,track_popularity\n")
ROW = ("spotify:track:heron7,spotify:artist:herons,\"['marsh rock']\",Low Tide,single,3,2021-08-19,Mudflats,The Herons,214503,True,"
       "4210,33,27\n")


def _read(spark, tmp_path, text, multi_line=False, **kw):
    path = tmp_path / "tracks.csv"
    path.write_text(text)
    return metadata.clean_metadata(metadata.read_metadata_csv(spark, str(path), multi_line), **kw)


def test_csv_row(spark, tmp_path):
    tracks = metadata.last_per_track(_read(spark, tmp_path, HEADER + ROW))
    row = require_columns(tracks, TRACKS).collect()[0]
    assert row.track_uri == "spotify:track:heron7" and row.album_release_date == dt.date(2021, 8, 19)
    assert row.genres == "['marsh rock']" and row.explicit is True and row.artist_followers == 4210


def test_missing_values_get_defaults(spark, tmp_path):
    row = _read(spark, tmp_path, "track_uri,genres\nuri:1,\n,x\n").drop("_load_order").collect()
    assert len(row) == 1
    got = row[0].asDict()
    assert got.pop("track_uri") == "uri:1" and got.pop("album_release_date") is None
    assert got == metadata.TRACK_DEFAULTS


def test_csv_without_the_key_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="track_uri"):
        _read(spark, tmp_path, "invalid csv\n")


def test_csv_value_of_the_wrong_type(spark, tmp_path):
    text = "track_uri,track_popularity\nuri:1,high\n"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        _read(spark, tmp_path, text).collect()
    assert _read(spark, tmp_path, text, strict=False).first().track_popularity == 0


def test_quoted_line_break_and_quote(spark, tmp_path):
    text = 'track_uri,track\nuri:1,"two\nlines, ""quoted"""\n'
    row = _read(spark, tmp_path, text, multi_line=True).first()
    assert row.track == 'two\nlines, "quoted"'
    with pytest.raises(ValueError, match="line break"):
        _read(spark, tmp_path, text)


def test_release_days(spark):
    texts = [("2024-05-28",), ("",), (None,), ("2024",), ("2024-05",), ("soon",)]
    df = spark.createDataFrame(texts, "d string")
    lenient = [r[0] for r in df.select(metadata.release_day(F.col("d"), strict=False)).collect()]
    assert lenient == [dt.date(2024, 5, 28), None, None, dt.date(2024, 1, 1), dt.date(2024, 5, 1), None]
    assert df.limit(3).select(metadata.release_day(F.col("d"))).count() == 3
    for bad in ("2024", "2024-05", "soon"):
        with pytest.raises(Exception, match="not a release date"):
            df.where(F.col("d") == bad).select(metadata.release_day(F.col("d"))).collect()


def test_last_row_of_a_key_wins_in_input_order(spark, tmp_path):
    rows = "".join(f"uri:{i % 3},{i}\n" for i in range(30))
    tracks = metadata.last_per_track(_read(spark, tmp_path, "track_uri,track_popularity\n" + rows))
    assert {r.track_uri: r.track_popularity for r in tracks.collect()} == {
        "uri:0": 27, "uri:1": 28, "uri:2": 29}


def test_upsert_twice_equals_once(spark, tmp_path):
    old = metadata.last_per_track(_read(spark, tmp_path, "track_uri,track\na,old\nb,old\n"))
    old = spark.createDataFrame(old.collect(), TRACKS)
    new = _read(spark, tmp_path, "track_uri,track\nb,new\nc,new\n")
    once = metadata.upsert_tracks(old, new)
    assert {r.track_uri: r.track for r in once.collect()} == {"a": "old", "b": "new", "c": "new"}
    twice = metadata.upsert_tracks(once, new)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_genre_names_from_text(spark):
    texts = ["['a b']", '["rock \'n\' roll"]', "[]", "", None, "['éire folk', 'r&b']", "['x','x']",
             "['rock 'n' roll', 'pop']", "indie, lo-fi"]
    rows = [(f"u{i}", t) for i, t in enumerate(texts)]
    tracks = spark.createDataFrame(rows, "track_uri string, genres string")
    bridge, names = genres.track_genre_bridge(tracks), genres.genre_dimension(tracks)
    require_columns(bridge, TRACK_GENRES), require_columns(names, GENRES)
    got = {}
    for r in bridge.join(names, "genre_id").collect():
        got.setdefault(r.track_uri, []).append(r.name)
    assert {k: sorted(v) for k, v in got.items()} == {
        "u0": ["a b"], "u1": ["rock n roll"], "u5": ["rb", "éire folk"], "u6": ["x"],
        "u7": ["pop", "rock n roll"], "u8": ["indie", "lo-fi"]}
    assert names.count() == names.select("genre_id").distinct().count() == 8
