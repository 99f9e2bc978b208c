import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestream.operators import conversations as C
from lodestream.plans.export import export_conversations
from lodestream.sources import exports, messages as M

SCHEMA = "group_id long, id long, sender_id long, ts timestamp_ntz, text string, reply_to long, original_reply_to long"
START = datetime(2023, 1, 1, 12)


def table(spark, rows, group=9):
    return spark.createDataFrame([(group, i, s, START + timedelta(seconds=t), f"m{i}", r, r) for i, s, t, r in rows], SCHEMA)


def restated(rows):
    """Threads of one group by the rules, message by message: {root: ids in the order taken}, links."""
    rows = sorted(rows)
    reply = {i: r for i, _, _, r in rows}
    stated = dict(reply)
    kind = dict.fromkeys(reply)
    sender, at = {i: s for i, s, _, _ in rows}, {i: t for i, _, t, _ in rows}
    order = [i for i, *_ in rows]
    for a, b in zip(order, order[1:]):
        if sender[a] == sender[b] and stated[b] is None:
            reply[b], kind[b] = a, C.SAME
    for a, b, c in zip(order, order[1:], order[2:]):
        if sender[a] == sender[c] != sender[b] and stated[b] == a and reply[c] is None:
            reply[c], kind[c] = b, C.ABA
    for a, b in zip(order, order[1:]):
        if sender[a] != sender[b] and reply[b] is None and 0 < at[b] - at[a] <= 300 and 0 < b - a <= 5:
            reply[b], kind[b] = a, C.PROXIMITY
    children = defaultdict(list)
    for i in order:
        if reply[i] and reply[i] in reply:
            children[reply[i]].append(i)
    roots = []
    for n, i in enumerate(order):
        if reply[i] and reply[i] in reply:
            continue
        if n + 1 < len(order):
            x = order[n + 1]
            if sender[x] != sender[i] and reply[x] is None and not children[i] and at[x] - at[i] <= 30:
                continue
        roots.append(i)
    threads = {}
    for root in roots:
        taken, people, queue = [], set(), [root]
        while queue:
            x = queue.pop(0)
            people.add(sender[x])
            if len(taken) >= 20 or len(people) > 5:
                break
            if taken:
                p = taken[-1]
                if reply[x] != p and sender[x] != sender[p] and kind[x] != C.PROXIMITY and at[x] - at[p] <= 30:
                    continue
            taken.append(x)
            queue += sorted(children[x])
        threads[root] = taken
    return threads, {i: (reply[i], kind[i]) for i in order}


def members_of(spark, rows, **options):
    nodes = C.with_parent(C.infer_links(table(spark, rows), **options))
    found = defaultdict(dict)
    for r in C.thread_members(nodes).collect():
        found[r.root_id][r.position] = r.id
    return {root: [at[i] for i in sorted(at)] for root, at in found.items()}


def random_rows(r, n):
    rows, i, t = [], 0, 0.0
    for _ in range(n):
        i += r.choice([1, 1, 1, 2, 9])
        t += r.choice([0, 1, 20, 40, 200, 400, -5])
        back = [row[0] for row in rows[-12:]]
        rows.append((i, r.randrange(1, 8), t, r.choice(back) if back and r.random() < 0.4 else r.choice([None, None, None, 10**9])))
    return rows


@pytest.mark.parametrize("fold", [C.FOLD, 1])
@pytest.mark.parametrize("seed", range(2))
def test_random_groups(spark, seed, fold, monkeypatch):
    """Folded in the JVM, or streamed through Python: the same threads."""
    monkeypatch.setattr(C, "FOLD", fold)
    rows = random_rows(random.Random(seed), 700)
    threads, links = restated(rows)
    assert members_of(spark, rows) == threads
    got = {r.id: (r.reply, r.inferred_reply_type) for r in C.infer_links(table(spark, rows), cell=7).collect()}
    assert got == links


def test_cells_don_t_show(spark):
    rows = random_rows(random.Random(5), 300)
    plain = C.infer_links(table(spark, rows)).orderBy("id").collect()
    assert plain == C.infer_links(table(spark, rows), cell=1).orderBy("id").collect() == C.infer_links(table(spark, rows), cell=3).orderBy("id").collect()


def test_stated_conversation(spark, tmp_path):
    texts = ["Hello everyone!", "This is a follow-up message.", "Hi! Nice to meet you.", "Nice to meet you too!", "Different conversation now."]
    rows = [(1, 100, 0, None), (2, 100, 60, None), (3, 200, 120, 1), (4, 100, 180, None), (5, 300, 600, None)]
    df = spark.createDataFrame([(12345678, i, s, START + timedelta(seconds=t), texts[i - 1], r, r) for i, s, t, r in rows], SCHEMA)
    groups = spark.createDataFrame([(12345678, "G")], "group_id long, group_name string")
    chunks, stats = C.process_messages(df, groups)
    (c,) = chunks.collect()
    assert c.id == "tg_12345678_1" and c.group_name == "G"
    assert (c.participant_count, c.message_count_original, c.turn_count_condensed) == (2, 4, 3)
    assert (c.start_date, c.end_date) == (START, START + timedelta(seconds=180))
    assert c.content == "user0: Hello everyone!\nThis is a follow-up message.\nuser1: Hi! Nice to meet you.\nuser0: Nice to meet you too!"
    (s,) = stats.collect()
    assert (s.total_messages_fetched, s.same_user_chained_count, s.aba_inferred_count, s.proximity_inferred_count, s.total_raw_threads_built, s.threads_filtered_out, s.final_chunks_exported) == (5, 1, 0, 1, 2, 1, 1)
    info = M.group_info(df, "G", 12345678)
    exports.write_envelope(exports.envelope_lines(chunks, stats, info, C.TIME_THRESHOLD_US, C.ID_THRESHOLD, 2), str(tmp_path / "e"))
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*"))))
    assert whole["processing_parameters"]["time_threshold_proximity_minutes"] == 5.0 and len(whole["conversation_chunks"]) == 1
    assert whole["conversation_chunks"][0]["content"] == c.content and whole["group_info"]["group_name"] == "G"
    assert whole["processing_stats"]["final_chunks_exported"] == 1


def test_empty_envelope(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    chunks, stats = C.process_messages(empty)
    lines = exports.envelope_lines(chunks, stats, M.group_info(empty, "G", 1), C.TIME_THRESHOLD_US, C.ID_THRESHOLD, 2)
    whole = json.loads("".join(r.line for r in lines.orderBy("place").collect()))
    assert whole == {"processing_stats": {"total_messages_fetched": 0, "final_chunks_exported": 0}, "conversation_chunks": []}


def test_ids_repeat_across_groups(spark):
    raw = spark.createDataFrame([(5, "d", 1, "a", None, None, None, g) for g in (1, 2, 2)], M.MESSAGE_SCHEMA)
    assert sorted((r.group_id, r.id) for r in M.fetch(raw).collect()) == [(1, 5), (2, 5)]


@pytest.mark.parametrize(("rows", "threads"), [
    ([(1, 1, 0, None), (2, 2, 40, 1), (3, 1, 9999, None)], {1: [1, 2, 3]}),
    ([(1, 1, 0, None), (2, 2, 0, None)], {2: [2]}),
    ([(1, 1, 0, None), (7, 2, 60, None)], {1: [1], 7: [7]}),
    ([(1, 1, 0, None), (2, 2, 10, 99)], {1: [1], 2: [2]}),
    ([(i, 1, i, None) for i in range(1, 26)], {1: list(range(1, 21))}),
    ([(1, 1, 0, 2), (2, 2, 10, 1)], {}),
])
def test_stated_threads(spark, rows, threads):
    assert members_of(spark, rows) == threads


def test_hot_root(spark):
    """One message with thousands of replies is one thread of 20 or fewer."""
    rows = [(1, 1, 0, None)] + [(i, 1 + i % 5, 60 * i, 1) for i in range(2, 3000)]
    assert members_of(spark, rows) == restated(rows)[0]


def test_groups_are_apart(spark):
    rows = random_rows(random.Random(3), 150)
    both = table(spark, rows, 1).union(table(spark, rows, 2))
    chunks, stats = C.process_messages(both)
    one, two = [[tuple(r)[4:] for r in chunks.filter(F.col("group_id") == g).orderBy("root_message_id").collect()] for g in (1, 2)]
    assert one == two and stats.count() == 2


def test_empty(spark):
    chunks, stats = C.process_messages(spark.createDataFrame([], SCHEMA))
    assert chunks.collect() == [] and stats.collect() == []


def test_fetch(spark):
    rows = [(5, "2023-01-01T12:00:00+02:00", 1, "a", None), (6, "bad date", 1, "b", None), (7, "2023-01-01T12:00:00Z", 0, "c", None), (8, None, 2, "", None), (9, None, 2, "d", 5), (9, None, 2, "d", 5), (10, None, None, "e", None)]
    raw = spark.createDataFrame([(i, d, s, t, r, r, None, 3) for i, d, s, t, r in rows], M.MESSAGE_SCHEMA)
    assert sorted(r.id for r in M.fetch(raw).collect()) == [5, 6, 9]
    assert sorted(r.id for r in M.fetch(raw, start_id=5, limit=2).collect()) == [6]
    assert sorted(r.id for r in M.fetch(raw, limit=3).collect()) == [9]
    got = {r.id: r.ts for r in M.to_messages(M.fetch(raw)).select("id", F.col("ts").cast("string").alias("ts")).collect()}
    assert got == {5: "2023-01-01 10:00:00", 6: None, 9: None}


def test_chat_history(spark, tmp_path):
    rows = [(i, "2023-01-01T12:00:00Z", 1, f"m{i}", None, None, None, 1 + i % 2) for i in range(1, 9)]
    spark.createDataFrame(rows, M.MESSAGE_SCHEMA).write.json(str(tmp_path / "h"))
    history = M.ChatHistory(spark, str(tmp_path / "h"), group_id=1, limit=3)
    assert sorted(r.id for r in history.fetch().collect()) == [4, 6, 8]
    assert sorted(r.id for r in history.fetch(start_id=2).collect()) == [4, 6, 8]
    assert sorted(r.id for r in history.fetch(oldest_first=True).collect()) == [2, 4, 6]
    assert M.ChatHistory(spark, str(tmp_path / "h"), limit=None).fetch().count() == 8


def test_connected_leaves_a_running_session_alone(spark):
    from lodestream.session import connected

    with connected() as same:
        assert same.range(3).count() == 3
    assert spark.range(2).count() == 2


def test_rows_without_a_key_do_not_meet_in_one_task(spark, monkeypatch):
    """Messages that reply to nothing, and those whose ancestors are all known, stay out of the joins by link and by ancestor."""
    rows = [(i * 10, i % 7, i * 600, None if i % 20 else i * 10 - 10 if i else None) for i in range(2000)]
    messages = table(spark, rows).repartition(8)
    frames = []
    keep = C.materialize

    def seen(df, name):
        frames.append((name, [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]))
        return keep(df, name)

    monkeypatch.setattr(C, "materialize", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        nodes = C.with_parent(C.infer_links(messages.select(*C.LINK_COLUMNS)))
        plan = nodes._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan
        got = C.thread_members(nodes).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    paths = [counts for name, counts in frames if name == "paths"]
    assert len(paths) > 1 and all(max(counts) < 0.4 * sum(counts) for counts in paths[1:])
    threads = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        threads[r.root_id].append(r.id)
    assert dict(threads) == {root: taken for root, taken in restated(rows)[0].items() if taken}


def test_export_makes_messages_and_chunks_once(spark, tmp_path):
    """Everything that an export writes comes from one table of fetched messages and one of chunks."""
    rows = [(i, i % 3, i * 10, i - 1 if i > 1 else None) for i in range(1, 13)]
    source = table(spark, rows).select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), (F.col("sender_id") + 1).alias("sender_id"), "text", F.col("reply_to").alias("reply_to_msg_id"), F.col("original_reply_to"), F.lit(None).cast("string").alias("inferred_reply_type"), "group_id")
    chunks, stats, info = export_conversations(spark, source, "g", 9, str(tmp_path / "out"), limit=None)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (chunks, info)]
    assert not any("Join" in p or "min_by" in p for p in plans)
    got = spark.read.json(str(tmp_path / "out" / "conversation_chunks"))
    assert {r.id for r in got.collect()} == {r.id for r in chunks.collect()} == {"tg_9_1"}
    assert stats.first().final_chunks_exported == 1 and info.first().total_messages_fetched == 12
    assert spark.read.json(str(tmp_path / "out" / "messages")).count() == 12
