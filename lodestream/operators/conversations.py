"""Conversations from chat messages: inferred reply links, roots, capped threads, and anonymised text.

Messages have group_id, id, sender_id, ts, text, reply_to, original_reply_to; many groups are worked on at once, and a
group may hold any share of the rows. Ids are unique in a group.

- Neighbours in id order come from windows over cells of CELL consecutive ids, so a cell holds at most CELL rows whatever
  the group's size; across a cell's edge they come from one summary row a cell.
- A thread's tree is found by pointer doubling over reply links: five joins cover the 20 levels a thread can have.
- Order in a tree is (depth, path of ids), which is breadth-first order with children in order. The first FOLD rows of a
  tree are folded natively; a tree that isn't settled by then streams, sorted, through a task that holds 20 rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import materialize

CELL = 4096
#: Rows of a tree that are folded in the JVM before the streaming fold takes over.
FOLD = 256
# Caps of a thread, and the gap in microseconds up to which an unlinked message is an interjection.
MAX_MESSAGES, MAX_SENDERS, INTERJECTION_US = 20, 5, 30_000_000
TIME_THRESHOLD_US, ID_THRESHOLD, MIN_PARTICIPANTS = 300_000_000, 5, 2
#: What links are inferred from; texts join in once threads are known.
LINK_COLUMNS = ("group_id", "id", "sender_id", "ts", "reply_to", "original_reply_to")
SAME, ABA, PROXIMITY = "same_user_consecutive", "aba", "time_proximity"


def gap_us(later: Column, earlier: Column) -> Column:
    """Microseconds between two timestamps, with or without zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def with_neighbours(df: DataFrame, columns: list[str], cell: int = CELL) -> DataFrame:
    """df with structs before2, before, after: the given columns of the neighbours in id order inside the group."""
    row = F.struct(*columns)
    cells = df.withColumn("__cell", F.expr(f"(id - pmod(id, {cell}L)) div {cell}L"))
    inner = W.partitionBy("group_id", "__cell").orderBy("id")
    local = cells.withColumns({"__b2": F.lag(row, 2).over(inner), "__b1": F.lag(row, 1).over(inner), "__a1": F.lead(row, 1).over(inner), "__at": F.row_number().over(inner)})
    # one row a cell: its first and its last two messages; the last one knows the one before it
    edges = local.groupBy("group_id", "__cell").agg(F.min_by(row, "id").alias("first"), F.max_by(row, "id").alias("last"), F.max_by("__b1", "id").alias("second"))
    over = W.partitionBy("group_id").orderBy("__cell")
    last = F.lag("last", 1).over(over)
    edges = edges.select("group_id", "__cell", last.alias("__p1"), F.coalesce(F.lag("second", 1).over(over), F.lag("last", 2).over(over)).alias("__p2"), F.lead("first", 1).over(over).alias("__n1"))
    joined = local.join(edges, ["group_id", "__cell"])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(F.col("__at") == 1, F.col("__p2")).when(F.col("__at") == 2, F.col("__p1")).otherwise(F.col("__b2")).alias("before2"),
        F.coalesce("__b1", "__p1").alias("before"),
        F.coalesce("__a1", "__n1").alias("after"),
    )


def _inferred(m1: Column, m2: Column, m3: Column, time_us: int, ids: int) -> Column:
    """How m3, which replies to nothing, is linked to the message m2 before it (m1 comes before m2); null if it isn't."""
    same = (m2["sender_id"] == m3["sender_id"]) & m3["original_reply_to"].isNull()
    aba = (m1["sender_id"] == m3["sender_id"]) & (m1["sender_id"] != m2["sender_id"]) & (m2["original_reply_to"] == m1["id"])
    apart = m3["id"] - m2["id"]
    gap = gap_us(m3["ts"], m2["ts"])
    near = (m2["sender_id"] != m3["sender_id"]) & (gap > 0) & (gap <= time_us) & (apart > 0) & (apart <= ids)
    return F.when(m3["reply_to"].isNull(), F.when(same, F.lit(SAME)).when(aba, F.lit(ABA)).when(near, F.lit(PROXIMITY)))


def infer_links(df: DataFrame, time_us: int = TIME_THRESHOLD_US, ids: int = ID_THRESHOLD, cell: int = CELL) -> DataFrame:
    """df with reply (the stated or inferred link), inferred_reply_type, and what roots need of the next message:
    next_sender, next_reply, next_type, next_gap_us."""
    near = with_neighbours(df, ["id", "sender_id", "ts", "reply_to", "original_reply_to"], cell)
    own = F.struct("id", "sender_id", "ts", "reply_to", "original_reply_to")
    kind = _inferred(F.col("before2"), F.col("before"), own, time_us, ids)
    next_kind = _inferred(F.col("before"), own, F.col("after"), time_us, ids)
    linked = near.withColumns({"inferred_reply_type": kind, "next_type": next_kind})
    return linked.select(
        *[F.col(f"`{c}`") for c in df.columns if c != "inferred_reply_type"],
        "inferred_reply_type",
        F.when(F.col("inferred_reply_type").isNotNull(), F.col("before.id")).otherwise(F.col("reply_to")).alias("reply"),
        F.col("after.sender_id").alias("next_sender"),
        F.when(F.col("next_type").isNotNull(), F.col("id")).otherwise(F.col("after.reply_to")).alias("next_reply"),
        "next_type",
        gap_us(F.col("after.ts"), F.col("ts")).alias("next_gap_us"),
        F.col("after.id").isNotNull().alias("has_next"),
    )


def link_stats(linked: DataFrame) -> DataFrame:
    """One row a group: total_messages_fetched and the counts of the three kinds of inferred links."""
    count = lambda kind: F.count_if(F.col("inferred_reply_type") == kind)
    return linked.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("total_messages_fetched"), count(SAME).alias("same_user_chained_count"), count(ABA).alias("aba_inferred_count"), count(PROXIMITY).alias("proximity_inferred_count")
    )


def with_parent(linked: DataFrame) -> DataFrame:
    """linked with parent (the link if it leads to a message that is there) and root: whether a thread starts here.

    A message without parent starts one unless it is an interjection: nobody replies to it, and another sender's unlinked
    message follows within 30 seconds.
    """
    light = linked.select("group_id", "id", "sender_id", "ts", "reply", "inferred_reply_type", "next_sender", "next_reply", "next_type", "next_gap_us", "has_next")
    there = light.select("group_id", F.col("id").alias("parent"))
    # messages that reply to nothing stay out of the join: they have one key in common, and would meet in one task
    replies = F.coalesce(F.col("reply") != 0, F.lit(False))
    stated = light.filter(replies)
    led = stated.join(there, (stated.group_id == there.group_id) & (stated["reply"] == there.parent), "left").select(stated["*"], "parent")
    found = led.unionByName(light.filter(~replies).withColumn("parent", F.lit(None).cast(dict(light.dtypes)["id"])))
    parents = found.filter(F.col("parent").isNotNull()).select("group_id", F.col("parent").alias("id")).distinct().withColumn("__has", F.lit(True))
    whole = found.join(parents, ["group_id", "id"], "left")
    interjection = F.col("has_next") & (F.col("next_sender") != F.col("sender_id")) & F.col("next_reply").isNull() & F.col("__has").isNull() & (F.col("next_gap_us") <= INTERJECTION_US)
    root = F.col("parent").isNull() & ~F.coalesce(interjection, F.lit(False))
    return whole.select("group_id", "id", "sender_id", "ts", "reply", "inferred_reply_type", "parent", root.alias("root"))


def tree_paths(nodes: DataFrame, levels: int = MAX_MESSAGES) -> DataFrame:
    """nodes with root_id and path (ids below the root, down to the node) for every node of a tree down to `levels` levels.

    Pointer doubling: after k rounds a node knows its 2^k nearest ancestors. Each round is a written table."""
    start = nodes.select("group_id", "id", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), F.array("id")).otherwise(F.array().cast("array<bigint>")).alias("path"), F.when(F.col("root"), F.col("id")).alias("top"))
    known = materialize(start, "paths")
    reach = 1
    while reach < levels and known.filter("up is not null").limit(1).count():
        above = known.select("group_id", F.col("id").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("top").alias("__top"))
        # rows that know all their ancestors stay out of the join: without a key of their own they would meet in one task
        grown = known.filter("up is not null").join(above, ["group_id", "up"], "left")
        deeper = grown.select("group_id", "id", F.col("__up").alias("up"), F.concat("__path", "path").alias("path"), F.coalesce("top", "__top").alias("top"))
        # a path of too many ids can't be part of a thread: dropping it keeps cycles and deep trees small
        known = materialize(deeper.filter(F.size("path") < levels).unionByName(known.filter("up is null")), "paths")
        reach *= 2
    roots = known.filter(F.col("up").isNull() & F.col("top").isNotNull()).select("group_id", "id", F.col("top").alias("root_id"), "path")
    return nodes.join(roots, ["group_id", "id"])


def _members_native(trees: DataFrame) -> DataFrame:
    """One row a tree: accepted (ids in order) and settled, folded over its first FOLD rows in breadth-first order."""
    row = F.struct(F.size("path").alias("depth"), "path", "id", "sender_id", "ts", "reply", "inferred_reply_type", "parent")
    order = W.partitionBy("group_id", "root_id").orderBy(F.size("path"), "path")
    first = trees.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= FOLD + 1)
    rows = first.groupBy("group_id", "root_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    last_type = "struct<id:bigint,sender_id:bigint,ts:timestamp>" if dict(trees.dtypes)["ts"] == "timestamp" else "struct<id:bigint,sender_id:bigint,ts:timestamp_ntz>"
    sender_type = dict(trees.dtypes)["sender_id"]
    last_type = last_type.replace("sender_id:bigint", f"sender_id:{sender_type}")
    start = F.struct(F.array().cast("array<bigint>").alias("accepted"), F.array().cast(f"array<{sender_type}>").alias("senders"), F.lit(None).cast(last_type).alias("last"), F.lit(False).alias("stopped"))

    def step(s: Column, x: Column) -> Column:
        queued = ~s["stopped"] & (x["parent"].isNull() | F.array_contains(s["accepted"], x["parent"]))
        senders = F.when(queued, F.array_union(s["senders"], F.array(x["sender_id"]))).otherwise(s["senders"])
        stopped = s["stopped"] | (queued & ((F.size(s["accepted"]) >= MAX_MESSAGES) | (F.size(senders) > MAX_SENDERS)))
        aside = s["last"].isNotNull() & (x["reply"] != s["last"]["id"]) & (x["sender_id"] != s["last"]["sender_id"]) & ~x["inferred_reply_type"].eqNullSafe(F.lit(PROXIMITY)) & (gap_us(x["ts"], s["last"]["ts"]) <= INTERJECTION_US)
        take = queued & ~stopped & ~F.coalesce(aside, F.lit(False))
        return F.struct(
            F.when(take, F.concat(s["accepted"], F.array(x["id"]))).otherwise(s["accepted"]).alias("accepted"),
            senders.alias("senders"),
            F.when(take, F.struct(x["id"].alias("id"), x["sender_id"].alias("sender_id"), x["ts"].alias("ts"))).otherwise(s["last"]).alias("last"),
            stopped.alias("stopped"),
        )

    folded = rows.withColumn("__f", F.aggregate("rows", start, step)).withColumn("__n", F.size("rows"))
    return folded.select("group_id", "root_id", F.col("__f.accepted").alias("accepted"), (F.col("__f.stopped") | (F.col("__n") <= FOLD)).alias("settled"))


class ThreadFold:
    """The same fold for rows of a tree that arrive one by one."""

    def __init__(self):
        self.accepted: list[int] = []
        self.senders: set = set()
        self.last: tuple | None = None
        self.stopped = False

    def add(self, key, sender, at_us, reply, kind, parent) -> None:
        if self.stopped or (parent is not None and parent not in self.accepted):
            return
        self.senders.add(sender)
        if len(self.accepted) >= MAX_MESSAGES or len(self.senders) > MAX_SENDERS:
            self.stopped = True
            return
        if self.last:
            last_key, last_sender, last_us = self.last
            if reply != last_key and sender != last_sender and kind != PROXIMITY and None not in (at_us, last_us) and at_us - last_us <= INTERJECTION_US:
                return
        self.accepted.append(key)
        self.last = (key, sender, at_us)


def _members_streamed(trees: DataFrame) -> DataFrame:
    """The same members for trees of any size: sorted rows stream through tasks that hold one thread."""
    columns = ["group_id", "root_id", "id", "sender_id", "at_us", "reply", "inferred_reply_type", "parent"]
    rows = trees.withColumn("at_us", gap_us(F.col("ts"), F.lit("1970-01-01").cast(dict(trees.dtypes)["ts"]))).withColumn("__d", F.size("path"))
    dealt = rows.repartition("group_id", "root_id").sortWithinPartitions("group_id", "root_id", "__d", "path").select(*columns)

    def run(batches):
        at, fold = None, ThreadFold()
        out = lambda done: pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], pa.int64()) for i in (0, 1)] + [pa.array([d[1] for d in done], pa.list_(pa.int64()))], names=["group_id", "root_id", "accepted"])
        for b in batches:
            done = []
            for row in zip(*(b.column(n).to_pylist() for n in columns), strict=True):
                if row[:2] != at:
                    if at is not None:
                        done.append((at, fold.accepted))
                    at, fold = row[:2], ThreadFold()
                fold.add(*row[2:])
            yield out(done)
        yield out([(at, fold.accepted)] if at is not None else [])

    return dealt.mapInArrow(run, "group_id long, root_id long, accepted array<long>")


def thread_members(nodes: DataFrame) -> DataFrame:
    """(group_id, root_id, id, position in breadth-first order) of every message that a thread takes."""
    trees = materialize(tree_paths(nodes), "trees")
    native = materialize(_members_native(trees), "threads")
    long = native.filter(~F.col("settled")).select("group_id", "root_id")
    rest = _members_streamed(trees.join(long, ["group_id", "root_id"], "left_semi"))
    every = native.filter("settled").select("group_id", "root_id", "accepted").unionByName(rest)
    return every.select("group_id", "root_id", F.posexplode("accepted").alias("position", "id"))


def thread_turns(messages: DataFrame, members: DataFrame) -> DataFrame:
    """One row a turn: group_id, root_id, turn (from 0), user (user0, user1 ... by first message), text (its messages' texts,
    one a line), n_messages, and the ids and times of its first and last message. A thread has at most 20 messages."""
    rows = members.join(messages.select("group_id", "id", "sender_id", "ts", "text"), ["group_id", "id"])
    thread = W.partitionBy("group_id", "root_id")
    in_order = thread.orderBy("id")
    fresh = F.coalesce((F.lag("sender_id").over(in_order) != F.col("sender_id")).cast("int"), F.lit(1))
    marked = rows.withColumn("__new", fresh).withColumn("turn", F.sum("__new").over(in_order) - 1).withColumn("__first", F.min("id").over(W.partitionBy("group_id", "root_id", "sender_id")))
    named = marked.withColumn("__user", F.dense_rank().over(thread.orderBy("__first")) - 1)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return named.groupBy("group_id", "root_id", "turn").agg(
        F.concat(F.lit("user"), F.min("__user").cast("string")).alias("user"), F.array_join(texts, "\n").alias("text"), F.count(F.lit(1)).alias("n_messages"),
        F.min("id").alias("first_id"), F.min_by("ts", "id").alias("start_ts"), F.max("id").alias("last_id"), F.max_by("ts", "id").alias("end_ts"),
    )


def conversation_chunks(turns: DataFrame, groups: DataFrame | None = None, min_participants: int = MIN_PARTICIPANTS) -> DataFrame:
    """One row a thread with enough senders; groups: (group_id, group_name)."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "user", "text").alias("line")))), lambda x: x["line"])
    whole = turns.groupBy("group_id", "root_id").agg(
        F.min("first_id").alias("root_message_id"), F.min_by("start_ts", "first_id").alias("start_date"), F.max_by("end_ts", "last_id").alias("end_date"),
        F.count_distinct("user").cast("int").alias("participant_count"), F.sum("n_messages").cast("int").alias("message_count_original"), F.count(F.lit(1)).cast("int").alias("turn_count_condensed"), F.array_join(lines, "\n").alias("__content"),
    )
    from ..functions.text import strip

    kept = whole.filter(F.col("participant_count") >= min_participants)
    named = kept.join(groups, "group_id", "left") if groups is not None else kept.withColumn("group_name", F.lit(None).cast("string"))
    key = F.concat_ws("_", F.lit("tg"), F.col("group_id").cast("string"), F.col("root_message_id").cast("string"))
    return named.select(key.alias("id"), F.lit("telegram").alias("source"), "group_id", "group_name", "root_message_id", "start_date", "end_date", "participant_count", "message_count_original", "turn_count_condensed", strip(F.col("__content")).alias("content"))


def processing_stats(linked: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a group with the seven counters of a run."""
    threads = members.groupBy("group_id").agg(F.count_distinct("root_id").alias("total_raw_threads_built"))
    final = chunks.groupBy("group_id").agg(F.count(F.lit(1)).alias("final_chunks_exported"))
    joined = link_stats(linked).join(threads, "group_id", "left").join(final, "group_id", "left").na.fill(0, ["total_raw_threads_built", "final_chunks_exported"])
    return joined.withColumn("threads_filtered_out", F.col("total_raw_threads_built") - F.col("final_chunks_exported"))


def process_messages(messages: DataFrame, groups: DataFrame | None = None, time_us: int = TIME_THRESHOLD_US, ids: int = ID_THRESHOLD, min_participants: int = MIN_PARTICIPANTS, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(conversation chunks, statistics) of messages. written: the chunks are a written table, for callers that use both."""
    linked = materialize(infer_links(messages.select(*LINK_COLUMNS), time_us, ids), "linked")
    members = materialize(thread_members(with_parent(linked)), "members")
    chunks = conversation_chunks(thread_turns(messages, members), groups, min_participants)
    if written:
        chunks = materialize(chunks, "conversations")
    return chunks, processing_stats(linked, members, chunks)
