"""Plays per day as an event-time stream, with late plays up to a limit.

A day is held as one row of state until the watermark, the latest time seen less ``late``, has passed its end; then it is
written once and its state goes. Plays that come later still are dropped. State is one row per open day, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playtrail.functions.numeric import to_minutes
from playtrail.schemas import PLAYS


def landed_stream(spark: SparkSession, landing: str, files_per_batch=1000) -> DataFrame:
    """Plays as they land in a folder of Parquet files."""
    return spark.readStream.schema(PLAYS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)


def plays_by_day(plays: DataFrame, late="1 day") -> DataFrame:
    """``timeline.plays_by_day`` of a stream; plays without time are left out. The session's time zone does not matter."""
    # Watermarks need an instant. The clock's time is taken as UTC, where days of the clock are the days of windows.
    parts = [F.extract(F.lit(part), F.col("ts")) for part in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")]
    days = plays.where(F.col("ts").isNotNull()).withColumn("instant", F.make_timestamp_ltz(*parts, F.lit("UTC")))
    found = days.withWatermark("instant", late).groupBy(F.window("instant", "1 day")).agg(
        F.count(F.lit(1)).alias("play_count"), F.sum("ms_played").alias("total_ms"), F.avg("ms_played").alias("avg_ms"))
    since = F.make_dt_interval(days=(F.unix_seconds("window.start") / 86_400).cast("int"))
    day = F.lit("1970-01-01").cast("timestamp_ntz") + since
    return found.select(day.alias("day"), "play_count", "total_ms", "avg_ms", to_minutes(F.col("total_ms")).alias("total_minutes"),
                        to_minutes(F.col("avg_ms")).alias("avg_minutes"))


def start_daily(spark, landing, out, checkpoint, late="1 day", files_per_batch=1000) -> StreamingQuery:
    """Add the days that are over to ``out`` and stop; a later start goes on from the checkpoint."""
    days = plays_by_day(landed_stream(spark, landing, files_per_batch), late)
    return (
        days.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )
