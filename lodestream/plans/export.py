"""Fetch, process and save the conversations of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import conversations as C
from ..sources import exports, messages
from ..sources.scratch import materialize


def export_conversations(spark: SparkSession, source: DataFrame, group_name: str, group_id: int, out: str | None = None, start_id: int | None = None, limit: int | None = messages.FETCH_LIMIT, oldest_first: bool = False, time_us: int = C.TIME_THRESHOLD_US, ids: int = C.ID_THRESHOLD, min_participants: int = C.MIN_PARTICIPANTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, statistics, group info) of a group's raw messages; written below `out` where it is given. What is fetched is
    written once, and so are the chunks: everything else is made from those tables."""
    raw = materialize(messages.fetch(source, start_id, limit, oldest_first), "raw")
    info = messages.group_info(raw, group_name, group_id, start_id, limit or 0, oldest_first)
    groups = spark.createDataFrame([(group_id, group_name)], "group_id long, group_name string")
    chunks, stats = C.process_messages(messages.to_messages(raw, group_id), groups, time_us, ids, min_participants, written=bool(out))
    if out:
        exports.write_envelope(exports.envelope_lines(chunks, stats, info, time_us, ids, min_participants), f"{out}/envelope")
        exports.write_messages(raw, info, out)
        exports.write_chunks(chunks, stats, out)
    return chunks, stats, info
