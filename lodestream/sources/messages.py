"""Chat history as a table: scans from a high-water mark or from either end, cleaned and in the shape the engine works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import one_of_each

FETCH_LIMIT = 10_000
MESSAGE_SCHEMA = "id long, date string, sender_id long, text string, reply_to_msg_id long, original_reply_to long, inferred_reply_type string, group_id long"


def read_messages(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Raw messages from JSON lines or Parquet, one row a message."""
    return spark.read.schema(MESSAGE_SCHEMA).format(format).load(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an exported file: an object with the group's fields and an array of messages."""
    inner = "id long, date string, sender_id long, text string, reply_to_msg_id long, original_reply_to long, inferred_reply_type string"
    whole = spark.read.option("multiLine", "true").schema(f"group_id long, group_name string, messages array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in inner.split(','))}>>").json(path)
    return whole.select("group_id", "group_name", F.explode("messages").alias("m")).select("group_id", "group_name", "m.*")


def scan(df: DataFrame, start_id: int | None = None, limit: int | None = FETCH_LIMIT, oldest_first: bool = False) -> DataFrame:
    """The rows that a fetch looks at: those after start_id, oldest first; without it the newest, or the oldest. The limit
    bounds rows looked at, before any are dropped."""
    found = df.filter(F.col("id") > start_id) if start_id is not None else df
    if limit is None:
        return found
    upwards = start_id is not None or oldest_first
    return found.orderBy(F.col("id").asc() if upwards else F.col("id").desc()).limit(limit)


def valid(df: DataFrame, key: tuple[str, ...] | None = None) -> DataFrame:
    """Rows with a text and a sender (0 is none), one for each id of a group (documents.one_of_each says which)."""
    key = key or (("group_id", "id") if "group_id" in df.columns else ("id",))
    usable = df.filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col("sender_id").isNotNull() & (F.col("sender_id") != 0) & F.col("id").isNotNull())
    return one_of_each(usable, *key)


def fetch(df: DataFrame, start_id: int | None = None, limit: int | None = FETCH_LIMIT, oldest_first: bool = False) -> DataFrame:
    """scan, then valid. Consumers order by id; nothing is sorted here."""
    return valid(scan(df, start_id, limit, oldest_first))


@dataclass(frozen=True)
class ChatHistory:
    """A source of raw messages: where they lie, and how each fetch looks at them."""

    spark: SparkSession
    path: str
    format: str = "json"
    group_id: int | None = None
    limit: int | None = FETCH_LIMIT

    def read(self) -> DataFrame:
        """All raw messages, or those of the group."""
        every = read_messages(self.spark, self.path, self.format)
        return every if self.group_id is None else every.filter(F.col("group_id") == self.group_id)

    def fetch(self, start_id: int | None = None, oldest_first: bool = False) -> DataFrame:
        return fetch(self.read(), start_id, self.limit, oldest_first)


def to_messages(df: DataFrame, group_id: int | None = None) -> DataFrame:
    """The columns that conversations are built from. Dates are ISO-8601, read as UTC where they have no zone; one that can't
    be read gives a null time, which links to nothing."""
    group = F.col("group_id") if "group_id" in df.columns and group_id is None else F.lit(group_id or 0).cast("long")
    reply = F.col("reply_to_msg_id")
    return df.select(group.alias("group_id"), "id", "sender_id", F.try_to_timestamp("date").alias("ts"), F.col("date"), "text", reply.alias("reply_to"), F.col("original_reply_to").alias("original_reply_to"))


def group_info(df: DataFrame, group_name: str, group_id: int, start_id: int | None = None, limit: int = FETCH_LIMIT, oldest_first: bool = False) -> DataFrame:
    """One row that describes a fetch."""
    return df.agg(F.count(F.lit(1)).alias("total_messages_fetched")).select(
        F.lit(group_name).alias("group_name"), F.lit(group_id).cast("long").alias("group_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("export_date"),
        F.lit(start_id).cast("long").alias("fetch_start_id"), F.lit(limit).alias("fetch_message_limit"), F.lit(oldest_first or start_id is not None).alias("fetch_reverse"), "total_messages_fetched",
    )
