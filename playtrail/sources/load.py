"""Whole loads: an export folder with its metadata, an uploaded history, an uploaded metadata file.

Below ``root`` plays lie in ``plays/load_id=.../play_date=...``. Tracks and the genre tables made from them are versions,
``tracks/<version>`` and so on. Versions accumulate: each is the one before it with the new rows put in, later rows of a
track winning, and ``track_versions`` lists them in order. Repeating a load or a version replaces it by the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.operators.overview import table_profile
from playtrail.schemas import TRACKS
from playtrail.session import scratch_path
from playtrail.sources.genres import genre_dimension, track_genre_bridge
from playtrail.sources.history import (
    HISTORY_GLOB,
    WHOLE_BYTES,
    load_report,
    plays_of,
    read_documents,
    report_of,
    staged_history,
    upload_plays,
)
from playtrail.sources.metadata import (
    clean_metadata,
    last_per_track,
    read_metadata_csv,
    read_metadata_parquet,
    upsert_tracks,
)
from playtrail.sources.tables import (
    is_empty,
    load_plays,
    number_new_plays,
    other_loads,
    read_plays,
    read_table,
    write_tracks,
)

_VERSIONS = "place bigint, version string"


class Loaded(NamedTuple):
    plays_written: bool
    report: DataFrame  # per history file, from the load itself; without a load it reads the files when used
    counts: DataFrame  # rows per table


def load_export(spark: SparkSession, history_folder: str, metadata_path: str, root: str, load_id: str,
                mode="if_empty", grain="day", files=HISTORY_GLOB, whole_bytes=WHOLE_BYTES) -> Loaded:
    """History and Parquet metadata of one export; ``load_id`` also names the track version.

    With ``if_empty`` plays are loaded into an empty table of plays, and metadata where there are no tracks yet. Plays
    are numbered in the order of their files, after those of the other loads.

    The files are read and parsed once, into a table in the shared folder that holds their plays in columns; numbers, plays
    and report come from there.
    """
    source, path = f"{history_folder}/{files}", f"{root}/plays"
    written = False
    if mode == "if_empty" and not is_empty(spark, path):
        report = load_report(read_documents(spark, source))
    else:
        stage = scratch_path(spark, "staged")
        staged = staged_history(spark, source, whole_bytes)
        staged.write.parquet(stage)
        staged = spark.read.schema(staged.schema).parquet(stage)
        report = report_of(staged)
        others = other_loads(spark, path, load_id) if mode == "append" else None
        plays = number_new_plays(plays_of(staged), others).drop("source_file", "position")
        written = load_plays(plays, path, load_id, mode, grain)
    current = current_version(spark, root)
    if mode != "if_empty" or current is None:
        incoming = clean_metadata(read_metadata_parquet(spark, metadata_path))
        tables = publish_tracks(spark, incoming, root, load_id)
    else:
        tables = read_version(spark, root, current)
    return Loaded(written, report, table_profile({**tables, "plays": read_plays(spark, path)}))


def upload_history(spark: SparkSession, files: str, root: str, load_id: str, grain="day") -> bool:
    """Uploaded history files as one load, numbered after the plays of the other loads."""
    plays = upload_plays(read_documents(spark, files))
    numbered = number_new_plays(plays, other_loads(spark, f"{root}/plays", load_id))
    return load_plays(numbered.drop("source_file", "position"), f"{root}/plays", load_id, "append", grain)


def upload_metadata(spark: SparkSession, csv: str, root: str, version: str, multi_line=False) -> dict[str, DataFrame]:
    """A metadata CSV upserted into the current tracks, as a new version."""
    return publish_tracks(spark, clean_metadata(read_metadata_csv(spark, csv, multi_line)), root, version)


def current_version(spark: SparkSession, root: str, before: str | None = None) -> str | None:
    """The last version of the tracks, or the one that ``before`` was or would be built on."""
    versions = read_table(spark, f"{root}/track_versions", _VERSIONS)
    if versions is None:
        return None
    if before is not None:
        own = versions.where(F.col("version") == before).agg(F.min("place")).first()[0]
        versions = versions.where(F.col("version") != before)
        versions = versions if own is None else versions.where(F.col("place") < own)
    return versions.agg(F.max_by("version", "place")).first()[0]


def read_version(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    """Tracks, genres and their bridge of one version."""
    return {n: spark.read.parquet(f"{root}/{n}/{version}") for n in ("tracks", "genres", "track_genres")}


def publish_tracks(spark: SparkSession, incoming: DataFrame, root: str, version: str) -> dict[str, DataFrame]:
    """Put incoming rows into the tracks of the version before, and derive the genre tables from what was written.

    The version is listed last, when all of it is there; a failed one is not seen and may be repeated.
    """
    previous = current_version(spark, root, before=version)
    if previous is None:
        tracks = last_per_track(incoming)
    else:
        tracks = upsert_tracks(spark.read.schema(TRACKS).parquet(f"{root}/tracks/{previous}"), incoming)
    path = f"{root}/tracks/{version}"
    write_tracks(tracks.select(*TRACKS.fieldNames()), path)
    stored = spark.read.schema(TRACKS).parquet(path)
    for name, df in {"genres": genre_dimension(stored), "track_genres": track_genre_bridge(stored)}.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{version}")
    listed = read_table(spark, f"{root}/track_versions", _VERSIONS)
    if listed is None or listed.where(F.col("version") == version).isEmpty():
        place = 1 if listed is None else (listed.agg(F.max("place")).first()[0] or 0) + 1
        entry = spark.createDataFrame([(place, version)], _VERSIONS).coalesce(1)
        entry.write.mode("append").parquet(f"{root}/track_versions")
    return read_version(spark, root, version)
