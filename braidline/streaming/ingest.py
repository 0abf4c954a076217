"""Continuous ingest of feature lines, and event-time extras."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.gff import parse_rows


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feature lines of files as they arrive in a folder."""
    return spark.readStream.text(path).withColumn("file_order", F.lit(None).cast("long"))


def ingest_stream(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write good rows and findings of each batch; a batch that is run again overwrites itself."""
    def store(batch: DataFrame, number: int) -> None:
        rows = parse_rows(batch)
        rows.filter("error_kind IS NULL").write.mode("overwrite").parquet(f"{out}/features/batch={number}")
        rows.filter("error_kind IS NOT NULL").write.mode("overwrite").parquet(f"{out}/findings/batch={number}")

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extra, beyond the reference: counts of each type in tumbling event-time windows."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


