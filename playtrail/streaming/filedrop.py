"""Ingest of history files as they are dropped into a folder.

Each file is read once, tracked by the checkpoint, and goes through the same column expressions as the
batch load, so there is no state and no watermark. Rows land in Parquet with their file and position; ``publish`` numbers
the files that no load holds yet and adds them to the table as one load.

A file that cannot be read fails the upload, and keeps failing it. With ``quarantine`` it is listed with the reason instead,
in a folder beside the plays; both belong to one sink and one checkpoint, so neither can be there without the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playtrail.sources.history import bulk_or_refuse, bulk_plays, upload_or_refuse, upload_plays
from playtrail.sources.tables import load_plays, number_new_plays, other_loads, read_plays, read_table

CLEANERS = {
    "bulk": bulk_plays,
    "upload": lambda documents: upload_plays(documents, recover=True),
}
JUDGES = {
    "bulk": bulk_or_refuse,
    "upload": lambda documents: upload_or_refuse(documents, recover=True),
}


def dropped_documents(spark: SparkSession, folder: str, files_per_batch=1000) -> DataFrame:
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("body"))
    )


def start_ingest(spark, folder, landing, checkpoint, mode="bulk", files_per_batch=1000, quarantine=False) -> StreamingQuery:
    """Clean all files not seen before into ``landing`` and stop. A landing folder is either with quarantine or without."""
    documents = dropped_documents(spark, folder, files_per_batch)
    if quarantine:
        rows = JUDGES[mode](documents).withColumnRenamed("refused", "reason")
        writer = rows.withColumn("refused", F.col("reason").isNotNull()).writeStream.partitionBy("refused")
    else:
        writer = CLEANERS[mode](documents).writeStream
    return (
        writer.format("parquet")
        .option("path", landing)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def ingest(spark, folder, landing, checkpoint, mode="bulk", files_per_batch=1000, quarantine=False) -> None:
    """As ``start_ingest``, returning when done; without quarantine a failed file raises."""
    start_ingest(spark, folder, landing, checkpoint, mode, files_per_batch, quarantine).awaitTermination()


def landed_plays(spark, landing) -> DataFrame:
    """The plays in ``landing``, with file and position."""
    landed = spark.read.parquet(landing)
    return landed.where("refused = 'false'").drop("refused", "reason") if "refused" in landed.columns else landed


def refused_files(spark, landing) -> DataFrame:
    """(source_file, reason) of the files in quarantine, each once."""
    return spark.read.parquet(landing).where("refused = 'true'").select("source_file", "reason")


_PUBLISHED = "load_id string, source_file string"


def publish(spark, landing, table, load_id, grain="day") -> bool:
    """Number the landed plays that no other load holds and write them as the load ``load_id``; says whether there were any.

    ``<table>_files`` lists the files of each load. The list is written before the plays: should the job fail in
    between, repeating the same ``load_id`` completes it, and another one is refused until then, so no file is published twice
    and none is left out. Repeating a finished load gives the same rows and ids.
    """
    landed = landed_plays(spark, landing)
    ledger = f"{table}_files"
    published, known = read_table(spark, ledger, _PUBLISHED), False
    if published is not None:
        others = published.where(F.col("load_id") != load_id)
        plays = read_plays(spark, table)
        listed = others.select("load_id").distinct()
        unfinished = listed if plays is None else listed.join(plays, "load_id", "left_anti")
        lost = unfinished.first()
        if lost is not None:
            raise ValueError(f"load {lost[0]} was not finished; publish it again first")
        landed = landed.join(others.select("source_file").distinct(), "source_file", "left_anti")
        own = published.where(F.col("load_id") == load_id).select("source_file")
        known = not own.isEmpty()
        if known:  # a repeated load keeps to its files
            landed = landed.join(own.distinct(), "source_file", "left_semi")
    if not known:
        files = landed.select("source_file").distinct()
        if files.isEmpty():
            return False
        files.write.mode("overwrite").parquet(f"{ledger}/load_id={load_id}")
    numbered = number_new_plays(landed, other_loads(spark, table, load_id))
    return load_plays(numbered.drop("source_file", "position"), table, load_id, "append", grain)
