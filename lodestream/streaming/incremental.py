"""Messages as a stream: new files become cleaned rows, each id once within a watermark, with links to close neighbours.

A batch knows nothing of what arrives later, so conversations are rebuilt from the sink by operators.conversations; the
stream keeps that sink clean and up to date, and its checkpoint is the high-water mark of what has been fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.messages import MESSAGE_SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw messages of JSON-lines files as they arrive."""
    return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def clean_stream(raw: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Rows with text and sender, one for each (group, id) that arrives again within the watermark."""
    usable = raw.filter(F.col("text").isNotNull() & (F.col("text") != "") & (F.col("sender_id") != 0)).withColumn("ts", F.try_to_timestamp("date"))
    return usable.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["group_id", "id"])


def activity(clean: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Messages and senders (approximately) a group and window; state is one sketch a window until the watermark passes."""
    grouped = clean.groupBy("group_id", F.window("ts", window).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_messages"), F.approx_count_distinct("sender_id").alias("n_senders")).select("group_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_messages", "n_senders")


def run_into(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files below path; with available_now it ends when all that is there has been taken."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
