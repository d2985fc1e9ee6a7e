"""Tables as Parquet folders: definition, loading, listing, ad-hoc SQL and export.

Plays are laid out as ``load_id=.../play_date=...``. Repeating a load under its id replaces that load.
``play_date`` is the first day of the partition's period: days suit large histories, months or years keep
the files of small ones from becoming tiny.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.functions import calendar
from playtrail.plans.ordered import number_by_position
from playtrail.schemas import PLAYS_STORED, TABLES, require_columns

LOAD_MODES = ("if_empty", "append", "replace_all")

# What plays are looked up by inside a period, in the order of a file's rows.
LOOKED_UP = ("track_uri", "ts")
# Adaptive filters take as many bytes as the distinct values of a row group need; dictionaries serve where there are few.
BLOOM_OPTIONS = {
    "parquet.bloom.filter.enabled#track_uri": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}

# Microseconds are kept, and a quote inside a value is doubled.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# A null text that occurs nowhere lets the reader tell an empty field (NULL) from a quoted one ('').
CSV_READ_OPTIONS = {**CSV_OPTIONS, "nullValue": "\0"}


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at ``path``, or None when nothing has been written there."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_plays(spark: SparkSession, path: str) -> DataFrame | None:
    """All loads of the plays. The fixed schema opens no files, and loads without ids read NULL."""
    return read_table(spark, path, PLAYS_STORED)


def is_empty(spark: SparkSession, path: str) -> bool:
    table = read_table(spark, path)
    return table is None or table.isEmpty()


def ensure_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, created empty when absent, checked against ``schema``."""
    table = read_table(spark, path)
    if table is None:
        spark.createDataFrame([], schema).write.parquet(path)
        table = spark.read.parquet(path)
    require_columns(table, schema)
    return table


def load_plays(plays: DataFrame, path: str, load_id: str, mode="if_empty", grain="day") -> bool:
    """Write ``plays`` as one load; says whether anything was written.

    ``if_empty`` writes only into an empty table, ``append`` adds this load or replaces the load of the
    same id, ``replace_all`` leaves this load alone: it is written first, and then every other load is
    emptied, so a failed job never leaves the table without plays.

    The rebalance before the write gathers each period into few files and, through adaptive execution,
    splits a period that holds much of the data. Rows of a file are sorted by track, so the statistics of its row groups and
    pages, its dictionaries and bloom filters leave little to read when a track is looked up.
    """
    if mode not in LOAD_MODES:
        raise ValueError(f"unknown load mode: {mode}")
    if mode == "if_empty" and not is_empty(plays.sparkSession, path):
        return False
    spark = plays.sparkSession
    dated = plays.withColumn("play_date", calendar.period_start(grain, "ts").cast("date"))
    placed = dated.hint("rebalance", "play_date")
    # The writer sorts by period anyway; the other keys come on top.
    placed = placed.sortWithinPartitions("play_date", *[c for c in LOOKED_UP if c in plays.columns])
    placed.write.mode("overwrite").options(**BLOOM_OPTIONS).partitionBy("play_date").parquet(f"{path}/load_id={load_id}")
    if mode == "replace_all":
        nothing = spark.createDataFrame([], dated.schema)
        # One row per load, not per play.
        for load in read_plays(spark, path).where(F.col("load_id") != load_id).select("load_id").distinct().collect():
            nothing.write.mode("overwrite").partitionBy("play_date").parquet(f"{path}/load_id={load[0]}")
    return True


def number_new_plays(plays: DataFrame, current: DataFrame | None) -> DataFrame:
    """``plays`` of files, in the order of files and positions, with ids that continue after the highest in ``current``."""
    start = 0
    if current is not None:
        start = current.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return number_by_position(plays, start=start)


def other_loads(spark: SparkSession, path: str, load_id: str) -> DataFrame | None:
    """The plays of all loads but one, or None when nothing has been written."""
    plays = read_plays(spark, path)
    return None if plays is None else plays.where(F.col("load_id") != load_id)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Write a version of the tracks; repeating a version replaces it."""
    tracks.write.mode("overwrite").parquet(path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, args=None) -> DataFrame:
    """Any SQL over the given tables, which the text names in braces; ``args`` are bound as named parameters.

    The session's own views stay as they are.
    """
    return spark.sql(text, args=args, **(tables or {}))


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_schema(spark: SparkSession, name: str) -> dict[str, str]:
    return {c.name: c.dataType for c in spark.catalog.listColumns(name)}


def column_listing(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    return [(n, f.name, f.dataType.simpleString()) for n, df in tables.items() for f in df.schema.fields]


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with header, written by all tasks. NULL is an empty field, '' is quoted."""
    df.write.options(**CSV_OPTIONS).csv(path)


def defined_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables below ``root``, created where absent."""
    return {n: ensure_table(spark, f"{root}/{n}", s) for n, s in TABLES.items()}
