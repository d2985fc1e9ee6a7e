"""Counts and ranges of stored plays from the footers of their files, without reading columns.

Spark pushes a count per partition into Parquet footers when the files are read by its newer reader. A second session with that
reader is used, so the caller's settings stay as they are. Times have no usable statistics there, so a range of times reads
the first and the last period only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.operators.overview import date_range
from playtrail.schemas import PLAYS_STORED
from playtrail.sources.tables import read_plays, read_table

_SETTINGS = {
    "spark.sql.sources.useV1SourceList": "csv,json,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def _session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    for key, value in _SETTINGS.items():
        session.conf.set(key, value)
    return session


def stored_periods(spark: SparkSession, path: str) -> DataFrame:
    """(load_id, play_date, plays) for every period of every load."""
    plays = _session(spark).read.schema(PLAYS_STORED).parquet(path)
    return plays.groupBy("load_id", "play_date").agg(F.count(F.lit(1)).alias("plays"))


def stored_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``table_profile`` of folders of Parquet files: rows per table, and whether it is empty. A missing folder has no rows."""
    session = _session(spark)
    found = {name: read_table(session, path) for name, path in paths.items()}
    counts = [(name, 0 if df is None else df.agg(F.count(F.lit(1))).first()[0]) for name, df in found.items()]
    return spark.createDataFrame([(n, c, c == 0) for n, c in counts], "table_name string, row_count bigint, is_empty boolean")


def stored_date_range(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """``date_range`` of stored plays."""
    plays = read_plays(spark, path)
    if plays is None:
        return date_range(spark.createDataFrame([], PLAYS_STORED), as_of)
    first, last = stored_periods(spark, path).where("plays > 0").agg(F.min("play_date"), F.max("play_date")).first()
    return date_range(plays.where(F.col("play_date").isin(first, last)), as_of)
