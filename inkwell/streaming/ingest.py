"""Arriving files as a stream: a bounded number a trigger, each reported once, sources archived afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PER_TRIGGER = 10
#: What a registered report is looked up by.
LIBRARY = "id bigint, fingerprint string, created_at timestamp"


def arrivals(spark: SparkSession, path: str, archive: str | None = None, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """doc_id, text, path of text files as they arrive, ten at a time."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return files.select(F.xxhash64("path").alias("doc_id"), "text", "path")


def drain(stream: DataFrame, report: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Report on all that has arrived, batch by batch, and stop; a restart goes on where the checkpoint says."""

    def batch(docs: DataFrame, number: int) -> None:
        report(docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def register(stream: DataFrame, path: str, checkpoint: str, within: str = "1 hour") -> StreamingQuery:
    """Register arriving reports (id, fingerprint, created_at and others) in the library at path, batch by batch, and stop.

    A fingerprint that has come less than `within` ago goes at once, by a state that the watermark bounds. The others are looked up
    in the library: `decisions` tells for each its earliest and latest report with the same fingerprint (null: it is new), and
    new ones are added to `reports`. A batch that is run again after a failure replaces what it wrote and isn't looked up in itself.
    Arrivals later than the watermark are dropped; a null fingerprint is always new.
    """
    once = stream.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["fingerprint"])

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.limit(0).write.mode("ignore").parquet(f"{path}/reports/batch=-1")
        held = spark.read.schema(f"{LIBRARY}, batch bigint").parquet(f"{path}/reports").where(F.col("batch") < number)
        known = held.groupBy("fingerprint").agg(F.min_by("id", F.struct("created_at", "id")).alias("earliest"), F.max("id").alias("latest"))
        told = rows.join(known, "fingerprint", "left")
        told.select("id", "fingerprint", "earliest", "latest").write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        told.where("earliest IS NULL").select(*rows.columns).write.mode("overwrite").parquet(f"{path}/reports/batch={number}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; rows later than the watermark are dropped from state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
