"""Structured Streaming: files that arrive become staged rows; events become windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import row_hash
from quernstone.operators import staging
from quernstone.sources.tables import VersionedTable


def staged_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds _row_hash over the columns, _source_file (base name) and row_idx (order within the file's hash)."""
    named = df.withColumn("_source_file", F.element_at(F.split(F.col("_source_path"), "/"), -1)).drop("_source_path")
    return named.withColumn("_row_hash", row_hash(columns)).withColumn("row_idx", F.monotonically_increasing_id())


def stream_into(spark: SparkSession, folder: str, schema: str, table: VersionedTable, checkpoint: str):
    """Stage every new CSV file below a folder once, as append loads; runs until all present files are read.

    Restarts continue where they stopped, and a file read again adds nothing: the load skips hashes it has staged.
    """
    source = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder).withColumn("_source_path", F.col("_metadata.file_path"))
    columns = [c for c in source.columns if c != "_source_path"]

    def load(batch: DataFrame, _: int) -> None:
        incoming = staged_rows(batch, columns)
        known = table.read()
        fresh = staging.first_in_file(incoming) if known is None else staging.append_load(known, incoming)
        table.append(fresh.withColumn("_deleted_at", F.lit(None).cast("timestamp")).drop("row_idx"))

    return source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and key; with a watermark, so that a stream's state stays bounded. Works on batches too."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: events closer than the gap."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
