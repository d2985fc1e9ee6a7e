"""Reading play history: healthy, cut and hopeless files; the two cleaning modes."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException

from playtrail.schemas import PLAYS
from playtrail.sources import history

PLAY = {
    "conn_country": "US",
    "master_metadata_album_album_name": "Low Tide",
    "master_metadata_album_artist_name": "The Herons",
    "master_metadata_track_name": "Mudflats",
    "ms_played": 214503,
    "platform": "linux",
    "reason_end": "endplay",
    "reason_start": "clickrow",
    "skipped": False,
    "spotify_track_uri": "spotify:track:heron7",
    "ts": "2022-11-03T21:40:15Z",
}
PODCAST = {**PLAY, "spotify_track_uri": None, "episode_name": "talk"}


def _without(name):
    return {k: v for k, v in PLAY.items() if k != name}


def _docs(spark, **bodies):
    return spark.createDataFrame(list(bodies.items()), "source_file string, body string")


def _report(spark, **bodies):
    rows = history.load_report(_docs(spark, **bodies)).collect()
    return {r.source_file: (r.inserted, r.failed, r.skipped_content, r.status) for r in rows}


def test_report_of_each_kind_of_file(spark):
    three = json.dumps([{**PLAY, "ms_played": n} for n in range(3)])
    nested = json.dumps([PLAY, {**PLAY, "extra": {"x": 1}}])
    assert _report(
        spark,
        whole=three,
        padded=f"\n {three} \n",
        cut_in_object=three[: three.rindex('"ts"')],
        cut_after_comma=three[: three.rindex("{")],
        cut_in_nested=nested[: nested.rindex("}")],
        broken_inside='[{"a":1},{"a":,},{"a":3}]',
        no_json="invalid json",
        no_array=json.dumps(PLAY),
        trailing_text="[{}] zzz",
        text_behind=three + " x",
        text_and_end_behind=f"[{json.dumps(PLAY)}] x ]",
        two_arrays=three + three,
        two_arrays_with_comma=f"{three},{three}",
        closed_twice=three + "]",
        field_behind=three + ',"x":[1]',
        nothing="[]",
        null="null",
        blank="",
        only_podcasts=json.dumps([PODCAST, PODCAST]),
        gaps=json.dumps([None, {}, PLAY, PODCAST]),
        unreadable=json.dumps([PLAY, {**PLAY, "ts": "yesterday"}, {**PLAY, "ms_played": "long"}]),
    ) == {
        "whole": (3, 0, 0, "loaded"),
        "padded": (3, 0, 0, "loaded"),
        "cut_in_object": (2, 0, 0, "loaded"),
        "cut_after_comma": (2, 0, 0, "loaded"),
        "cut_in_nested": (1, 0, 0, "loaded"),
        "broken_inside": (0, 0, 0, "failed"),
        "no_json": (0, 0, 0, "failed"),
        "no_array": (0, 0, 0, "failed"),
        "trailing_text": (0, 0, 0, "failed"),
        # Cut at their last "},": what is behind the array costs its last play, as a reader of the whole text would have it.
        "text_behind": (2, 0, 0, "loaded"),
        "text_and_end_behind": (0, 0, 0, "failed"),
        "two_arrays": (0, 0, 0, "failed"),
        "two_arrays_with_comma": (0, 0, 0, "failed"),
        "closed_twice": (2, 0, 0, "loaded"),
        "field_behind": (2, 0, 0, "loaded"),
        "nothing": (0, 0, 0, "empty"),
        "null": (0, 0, 0, "empty"),
        "blank": (0, 0, 0, "failed"),
        "only_podcasts": (0, 0, 2, "skipped"),
        "gaps": (1, 0, 1, "loaded"),
        "unreadable": (1, 2, 0, "loaded"),
    }


def test_second_cut_helps_where_the_first_does_not(spark):
    # The last brace closes a nested object, so closing the array there is no JSON.
    text = json.dumps([PLAY, PLAY, {**PLAY, "extra": {"x": 1}}])
    cut = text[: text.rindex("}]")]
    assert _report(spark, cut=cut)["cut"] == (2, 0, 0, "loaded")


def test_recovered_rows_are_a_prefix(spark):
    plays = [{**PLAY, "ms_played": n} for n in range(5)]
    whole = json.dumps(plays)
    for size in range(40, len(whole), 97):
        rows = history.bulk_plays(_docs(spark, a=whole[:size])).select("ms_played").collect()
        assert [r.ms_played for r in rows] == list(range(whole[:size].count("}")))


def test_bulk_rows(spark):
    body = json.dumps([
        {**PLAY, "reason_end": "forward"},
        {**PLAY, "reason_end": "back"},
        {**PLAY, "reason_end": None},
        _without("reason_end"),
        _without("platform"),
    ])
    plays = history.bulk_plays(_docs(spark, a=body))
    assert plays.columns == [*PLAYS.fieldNames(), "source_file", "position"]
    rows = plays.collect()
    assert [r.skipped for r in rows] == [True, True, False, None, False]
    assert rows[0].ts == dt.datetime(2022, 11, 3, 21, 40, 15) and rows[0].ms_played == 214503
    assert rows[4].platform is None and rows[0].platform == "linux"
    assert (rows[0].track, rows[0].artist, rows[0].album) == ("Mudflats", "The Herons", "Low Tide")


def test_upload_fills_gaps_and_moves_the_clock(spark):
    body = json.dumps([
        PLAY,
        {"ts": "2024-01-01T00:30:00Z", "conn_country": "DE"},
        {"ts": "2024-01-01T00:30:00Z"},
        {**PLAY, "conn_country": "GB", "skipped": True},
        PODCAST,
    ])
    rows = history.upload_plays(_docs(spark, a=body)).collect()
    assert [r.ts for r in rows] == [
        dt.datetime(2022, 11, 3, 14, 40, 15), dt.datetime(2023, 12, 31, 23, 30), dt.datetime(2024, 1, 1, 0, 30),
        dt.datetime(2022, 11, 3, 21, 40, 15), dt.datetime(2022, 11, 3, 14, 40, 15),
    ]
    gap = rows[2].asDict()
    del gap["ts"], gap["source_file"], gap["position"]
    assert gap == history.UPLOAD_DEFAULTS
    assert rows[0].platform == "spotify" and rows[3].skipped and rows[4].track_uri == ""


@pytest.mark.parametrize("body", ["invalid json", json.dumps([PLAY]) + " x", json.dumps([PLAY]) * 2, json.dumps([PLAY]) + "]",
                                  json.dumps([PLAY]) + ',"end":[1]', json.dumps([PLAY]) + "}", json.dumps([{**PLAY, "ts": "28/05/2024"}])])
def test_upload_refuses_what_it_cannot_read(spark, body):
    with pytest.raises(Exception, match="no JSON array|CANNOT_PARSE_TIMESTAMP"):
        history.upload_plays(_docs(spark, a=body)).collect()


def test_upload_keeps_items_without_fields(spark):
    rows = history.upload_plays(_docs(spark, a=json.dumps([{}, None, PLAY]))).orderBy("position").collect()
    assert [(r.position, r.ts is None, r.track) for r in rows] == [(0, True, ""), (1, False, "Mudflats")]


def test_positions_count_kept_plays_of_each_file(spark):
    body = json.dumps([PODCAST, PLAY, {**PLAY, "ts": "never"}, PLAY])
    rows = history.bulk_plays(_docs(spark, a=body, b=json.dumps([PLAY]))).collect()
    assert sorted((r.source_file, r.position) for r in rows) == [("a", 0), ("a", 1), ("b", 0)]


def test_empty_upload_is_no_error(spark):
    assert history.upload_plays(_docs(spark, a="[]", b="null")).count() == 0


def test_folder_reads_only_history_files(spark, tmp_path):
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps([PLAY]))
    (tmp_path / "Streaming_History_Audio_2.json").write_text(json.dumps([PLAY, PLAY])[:-30])
    (tmp_path / "Other.json").write_text(json.dumps([PLAY] * 5))
    assert history.bulk_plays(history.read_history(spark, str(tmp_path))).count() == 2


def _found(spark, path):
    return sorted((r.source_file, r.body) for r in history.read_documents(spark, path).collect())


def test_many_files_of_a_glob_are_listed_with_their_folder(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"Streaming_History_Audio_{n}.json").write_text(json.dumps([PLAY] * n))
    (tmp_path / "Other.json").write_text("[]")
    group = f"listing {tmp_path}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        documents = history.read_documents(spark, f"{tmp_path}/{history.HISTORY_GLOB}")
        staged = history.staged_history(spark, f"{tmp_path}/{history.HISTORY_GLOB}")
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert documents.count() == 40 and history.plays_of(staged).count() == sum(range(40))


def test_a_glob_finds_what_spark_finds(spark, tmp_path):
    for at in ("a.json", "b.json", "c.txt", "_d.json", ".e.json", "x y%.json"):
        (tmp_path / at).write_text(f"body\nof {at}\n")

    def same(path):
        want = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value").collect()
        assert _found(spark, path) == sorted(map(tuple, want))
        return len(want)

    for name, n in (("*.json", 3), ("[ab].json", 2), ("{a,c}.*", 2), ("?.json", 2), ("*", 4), ("a.json", 1)):
        assert same(f"{tmp_path}/{name}") == same(f"file://{tmp_path}/{name}") == n
    (tmp_path / "deep.json").mkdir()
    (tmp_path / "deep.json" / "part").write_text("below a folder that fits")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "f.json").write_text("below one that does not")
    assert same(f"{tmp_path}/*.json") == 4
    for missing in (f"{tmp_path}/*.csv", f"{tmp_path}/none/*.json"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            history.read_documents(spark, missing)
