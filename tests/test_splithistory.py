"""Files read by many tasks: the same plays, positions, cut points and report as files read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from playtrail.sources import history, load, splithistory
from playtrail.sources.tables import read_plays
from tests.compare import settings
from tests.test_history import PLAY, PODCAST

THREE = json.dumps([{**PLAY, "ms_played": n} for n in range(3)])
NESTED = json.dumps([PLAY, {**PLAY, "extra": {"x": [1, {"y": "}"}]}}, PODCAST, PLAY])
QUOTED = json.dumps([{**PLAY, "master_metadata_track_name": name, "ms_played": i}
                     for i, name in enumerate(["a}b", 'say "}," now', "back\\", "\\\"},{\\", "[{", "}]", "é}ü\n", ""])])
BODIES = {
    "whole": THREE, "padded": f"\n {THREE} \n\x0b", "cut_in_object": THREE[: THREE.rindex('"ts"')],
    "cut_after_comma": THREE[: THREE.rindex("{")], "cut_behind_brace": THREE[:-1], "nested": NESTED,
    "cut_in_nested": NESTED[: NESTED.rindex("}")], "quoted": QUOTED, "broken_inside": '[{"a":1},{"a":,},{"a":3}]',
    "broken_last": THREE[:-2] + ',"x":}]', "broken_escape": THREE[:-2] + ',"x":"\\}"}]', "no_json": "invalid json",
    "no_array": json.dumps(PLAY), "trailing_text": "[{}] zzz", "text_behind": THREE + " x",
    "text_and_end_behind": f"[{json.dumps(PLAY)}] x ]", "two_arrays": THREE + THREE, "two_arrays_with_comma": f"{THREE},{THREE}",
    "closed_twice": THREE + "]", "field_behind": THREE + ',"x":[1]', "nothing": "[]", "null": "null", "only_podcasts": json.dumps([PODCAST] * 2),
    "gaps": json.dumps([None, {}, PLAY, None, None, PODCAST, PLAY, None]), "number": json.dumps([PLAY, 3, PLAY]),
    "unreadable": json.dumps([PLAY, {**PLAY, "ts": "yesterday"}, {**PLAY, "ms_played": "long"}, PLAY]),
    "lists": json.dumps([PLAY, [PLAY], PLAY]), "open_string": THREE[:-2] + ',"x":"abc', "brace_first": "}" + THREE, "comma_first": "," + THREE,
    "starts_late": THREE[1:], "pretty": json.dumps([PLAY, PODCAST, PLAY], indent=2), "no_commas": THREE.replace("}, {", "} {"),
    "brace_in_last_string": THREE[:-2] + ',"x":"}', "comma_in_last_string": THREE[:-2] + ',"x":"}, "', "array_end_in_string": THREE[:-2] + ',"x":"]',
}


def rows_of(staged):
    plays = sorted(map(tuple, history.plays_of(staged).withColumn("source_file", F.substring_index("source_file", "/", -1)).collect()),
                   key=lambda r: (r[-2], r[-1]))
    report = sorted(tuple(r) for r in history.report_of(staged).withColumn(
        "source_file", F.substring_index("source_file", "/", -1)).select(
        "source_file", "inserted", "failed", "skipped_content", "status").collect())
    return plays, report


def staged(spark, folder, whole_bytes, split):
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}):
        found = history.staged_history(spark, str(folder), whole_bytes)
        return rows_of(found)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("bodies")
    for name, body in BODIES.items():
        (path / f"{name}.json").write_bytes(body.encode())
    return path


def test_split_files_equal_whole_files(spark, folder):
    whole = rows_of(history.staged_history(spark, str(folder)))
    assert len(whole[0]) > 30 and {r[-1] for r in whole[1]} == {"loaded", "failed", "skipped", "empty"}
    documents = history.read_documents(spark, str(folder))
    bulk = history.bulk_plays(documents).withColumn("source_file", F.substring_index("source_file", "/", -1)).collect()
    assert sorted(map(tuple, bulk), key=lambda r: (r[-2], r[-1])) == whole[0]
    for split in (1 << 20, 41):
        got = staged(spark, folder, 0, split)
        assert [(a, b) for a, b in zip(got[1], whole[1]) if a != b] == [] and len(got[1]) == len(whole[1])
        assert got[0] == whole[0]


def test_truncated_anywhere_in_many_ranges(spark, tmp_path):
    plays = [{**PLAY, "ms_played": n, "master_metadata_track_name": random.Random(n).choice(["x", "}", '"},', "{[", "\\"])} for n in range(40)]
    body = json.dumps(plays)
    for size in range(50, len(body), 1999):
        (tmp_path / f"{size:06}.json").write_text(body[:size])
    assert staged(spark, tmp_path, 0, 300) == rows_of(history.staged_history(spark, str(tmp_path)))


def test_ranges_are_read_by_many_tasks_and_blocks_meet_in_order(spark, tmp_path):
    plays = [{**PLAY, "ms_played": n, "extra": {"n": {"m": "}" * (n % 5)}}} for n in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps(plays))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "60000", "spark.sql.files.openCostInBytes": "1"}):
        assert splithistory.read_pieces(spark, [str(tmp_path / "big.json")]).rdd.getNumPartitions() > 15
        found, report = rows_of(history.staged_history(spark, str(tmp_path), 100_000))
    assert [(r[2], r[-1]) for r in found] == [(n, n) for n in range(3000)] and report == [("big.json", 3000, 0, 0, "loaded")]


def test_a_segment_above_the_cell_limit_is_unreadable_not_fatal(spark, tmp_path):
    """A quote that is never closed makes the rest of the file one segment; what is before the last comma stays, as always."""
    body = json.dumps([PLAY] * 30)
    (tmp_path / "a.json").write_text(body[:-2] + ',"x":"' + "y}" * 5000)
    (tmp_path / "b.json").write_text(json.dumps([PLAY, {**PLAY, "platform": "z}" * 5000}, PLAY]))
    items, files = splithistory.split_items(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], cell_bytes=6000)
    assert sorted((r[0][-6:], r[1]) for r in files.collect()) == [("a.json", False), ("b.json", True)]
    assert items.where(F.col("source_file").endswith("a.json")).count() == 29


def test_load_of_small_and_large_files_parses_once(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    (folder / "Streaming_History_Audio_1.json").write_text(json.dumps([{**PLAY, "ms_played": n} for n in range(200)])[:-9])
    (folder / "Streaming_History_Audio_2.json").write_text(json.dumps([PLAY, PODCAST]))
    (folder / "Streaming_History_Audio_3.json").write_text("nothing")
    metadata = str(tmp_path / "metadata.parquet")
    spark.createDataFrame([(PLAY["spotify_track_uri"], "Mudflats")], "track_uri string, track string").write.parquet(metadata)
    done = load.load_export(spark, str(folder), metadata, str(tmp_path / "root"), "one", whole_bytes=20_000)
    plan = done.report._jdf.queryExecution().toString()
    assert "wholetext" not in plan and "from_json" not in plan.lower()
    for file in folder.iterdir():  # the report no longer needs the files
        file.write_text("gone")
    assert sorted((r.source_file[-6:], r.inserted, r.skipped_content, r.status) for r in done.report.collect()) == [
        ("1.json", 199, 0, "loaded"), ("2.json", 1, 1, "loaded"), ("3.json", 0, 0, "failed")]
    plays = read_plays(spark, str(tmp_path / "root/plays")).orderBy("id").collect()
    assert [(r.id, r.ms_played) for r in plays] == [(n + 1, n) for n in range(199)] + [(200, 214503)]


def test_many_small_ranges_are_read_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.json").write_text('[{"ts":"2024-01-01T00:00:00Z"},{"ts":"2024-01-02T00:00:00Z"}]')
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "41"}):
        pieces = splithistory.read_pieces(spark, str(tmp_path), 0)
        assert pieces.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
        assert pieces.select("source_file", "block").distinct().count() > 60
    found = history.staged_history(spark, str(tmp_path), 0, range_bytes=41)
    assert rows_of(found) == rows_of(history.staged_history(spark, str(tmp_path)))
