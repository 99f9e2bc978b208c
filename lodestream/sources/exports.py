"""JSON exports of raw messages and of conversation chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_position


_NULLS = {"ignoreNullFields": "false"}


def write_messages(messages: DataFrame, info: DataFrame, path: str) -> None:
    """Raw messages as JSON lines in `path/messages`, the fetch's description in `path/group_info`. Files are written by the
    tasks that hold the rows."""
    messages.write.mode("overwrite").json(f"{path}/messages")
    info.write.mode("overwrite").json(f"{path}/group_info")


def write_chunks(chunks: DataFrame, stats: DataFrame, path: str) -> None:
    """Conversation chunks and statistics as JSON lines in `path/conversation_chunks` and `path/processing_stats`."""
    chunks.write.mode("overwrite").json(f"{path}/conversation_chunks")
    stats.write.mode("overwrite").json(f"{path}/processing_stats")


def envelope_lines(chunks: DataFrame, stats: DataFrame, info: DataFrame, time_us: int, ids: int, min_participants: int) -> DataFrame:
    """(place, line): the lines of one JSON object with group_info, processing_parameters, processing_stats and
    conversation_chunks, a chunk a line, so that no row or task holds them all. Without messages the object has the last two
    only, and of the statistics the numbers of messages and chunks, both 0."""
    whole = F.struct("*")
    parameters = F.struct(F.lit(time_us / 60e6).alias("time_threshold_proximity_minutes"), F.lit(ids).alias("id_threshold_proximity"), F.lit(min_participants).alias("min_participants_per_chunk"))
    reduced = F.lit('{"total_messages_fetched":0,"final_chunks_exported":0}')
    line = lambda df, place, *parts: df.select(F.lit(place).cast("long").alias("place"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("line"))
    some = info.filter("total_messages_fetched > 0").limit(1)
    one = stats.sparkSession.range(1)
    counted = stats.drop("group_id").agg(F.first(F.to_json(whole, _NULLS)).alias("__s"))
    numbered = with_position(chunks, ["root_message_id", "id"], "__at").withColumn("__json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in chunks.columns]), _NULLS))
    rows = numbered.select(F.col("__at").cast("long").alias("place"), F.concat(F.when(F.col("__at") > 0, ",").otherwise(""), "__json").alias("line"))
    lines = [line(one, -5, "{"), line(some, -4, '"group_info":', F.to_json(whole, _NULLS), ","), line(some, -3, '"processing_parameters":', F.to_json(parameters, _NULLS), ","),
             line(counted, -2, '"processing_stats":', F.coalesce("__s", reduced), ","), line(one, -1, '"conversation_chunks":['), rows, line(one, (1 << 62), "]}")]
    return reduce(DataFrame.unionByName, lines)


def write_envelope(lines: DataFrame, path: str) -> None:
    """The lines of envelope_lines as text files whose order is that of their names: put together, they are the JSON object."""
    lines.orderBy("place").select("line").write.mode("overwrite").text(path)


def conversations_as_documents(chunks: DataFrame) -> DataFrame:
    """Conversation chunks in the shape that indexing takes: _id, text, title, type."""
    return chunks.select(F.col("id").alias("_id"), F.col("content").alias("text"), F.coalesce("group_name", F.lit("")).alias("title"), F.lit("conversation").alias("type"))
