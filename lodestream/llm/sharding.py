"""Operator 6: sharding by weighted rendezvous hashing, in DataFrame functions alone.

Every shard bids for a record with ln(u) / weight, where u in (0, 1) is a hash of the record's key and the shard's
number; the highest bid wins, ties go to the smaller number. A new shard can only win records for itself, so growing
moves no record between old shards, and shards receive records in proportion to their weights.

Slots number the rows of a shard by key, size and checksum. Rows that are equal in all three are interchangeable; they are
told apart by a written number, so that copies of one row spread over all cells and tasks.

Defined cases: a null key is hashed as a key of its own kind; rows with equal keys share a shard; a null text has no
bytes; texts of any length count whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_slots, materialize

N_SHARDS = 40


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the key."""

    def bid(i: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.log(u) / weight).alias("bid"), F.lit(-i).alias("no"))

    bids = [bid(i, w) for i, w in enumerate(weights) if w > 0]
    best = bids[0] if len(bids) == 1 else F.greatest(*bids)
    return (-best["no"]).cast("int")


def shard_records(df: DataFrame, weights: list[float] | None = None, key_col: str = "doc_id", text_col: str = "text", spread: int | None = None) -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, law, shard, slot (gapless in its shard), grown_shard (with one more shard of weight 1)."""
    weights = weights or [1.0] * N_SHARDS
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = df.select(
        F.col(key_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key_col), weights).alias("shard"),
        rendezvous_shard(F.col(key_col), [*weights, 1.0]).alias("grown_shard"),
    )
    placed = materialize(placed.withColumn("__tie", F.monotonically_increasing_id()), "shards")
    slotted = dense_rank_slots(placed, ["shard"], ["doc_id", "size", "text_crc32", "__tie"], "slot", len(weights), spread)
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
