"""Queries that rebuild conversations from the events table read as chat messages, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as C
from ..sources import messages as M
from ..sources.scratch import materialize
from .document_queries import table


def messages(spark, sf_dir):
    """Events as messages of one group: ids jump after every five, some replies are stated, some lead nowhere."""
    number = lambda e: e + 1 + 7 * F.floor(e / 5)
    k = F.get_json_object("props", "$.k").cast("long")
    back = F.col("event_id") - 1 - F.floor(k / 10) % 4
    reply = F.when(k == 99, number(F.col("event_id")) + 100_000_000).when((k % 10 < 3) & (back >= 0), number(back))
    return table(spark, sf_dir, "events").select(
        F.lit(1).cast("long").alias("group_id"), number(F.col("event_id")).cast("long").alias("id"), "ts", (1 + F.col("user_id") % 8).cast("long").alias("sender_id"), F.concat_ws(" ", "event_type", "props").alias("text"),
        reply.cast("long").alias("reply_to"), reply.cast("long").alias("original_reply_to"),
    )


def _raw(spark, sf_dir):
    """Messages as a chat source has them; sender 0 is none."""
    m = messages(spark, sf_dir)
    return m.select("id", (F.col("sender_id") - 1).alias("sender_id"), "text", F.col("reply_to").alias("reply_to_msg_id"))


def msg_scan_since(spark, sf_dir):
    return M.fetch(_raw(spark, sf_dir), start_id=100, limit=700).select("id", "sender_id", "reply_to_msg_id")


def msg_scan_latest(spark, sf_dir):
    return M.fetch(_raw(spark, sf_dir), limit=500).select("id", "sender_id", "reply_to_msg_id")


def msg_scan_earliest(spark, sf_dir):
    return M.fetch(_raw(spark, sf_dir), limit=500, oldest_first=True).select("id", "sender_id", "reply_to_msg_id")


def msg_two_groups(spark, sf_dir):
    """Two groups with the same ids, each message twice: one row an id and group."""
    raw = _raw(spark, sf_dir)
    both = raw.withColumn("group_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 2)])))
    return M.valid(both).select("group_id", "id", "sender_id")


def _links(spark, sf_dir):
    return C.infer_links(messages(spark, sf_dir).select(*C.LINK_COLUMNS))


def _of(spark, sf_dir, kind):
    return _links(spark, sf_dir).filter(F.col("inferred_reply_type") == kind).select("id", F.col("reply").alias("reply_to"))


def link_same_user(spark, sf_dir):
    return _of(spark, sf_dir, C.SAME)


def link_aba(spark, sf_dir):
    return _of(spark, sf_dir, C.ABA)


def link_proximity(spark, sf_dir):
    return _of(spark, sf_dir, C.PROXIMITY)


def links_all(spark, sf_dir):
    return _links(spark, sf_dir).select("id", "sender_id", F.col("reply").alias("reply_to"), "inferred_reply_type")


def link_stats(spark, sf_dir):
    return C.link_stats(_links(spark, sf_dir))


def _nodes(spark, sf_dir):
    return C.with_parent(materialize(_links(spark, sf_dir), "linked"))


def thread_roots(spark, sf_dir):
    return _nodes(spark, sf_dir).filter("root").select("id")


def reply_children(spark, sf_dir):
    """Children of every message with replies, as a count and the smallest and largest id."""
    found = _nodes(spark, sf_dir).filter("parent is not null").groupBy("parent")
    return found.agg(F.count(F.lit(1)).alias("n_children"), F.min("id").alias("first_child"), F.max("id").alias("last_child"))


def thread_members(spark, sf_dir):
    return C.thread_members(_nodes(spark, sf_dir)).select("root_id", "position", "id")


def _turns(spark, sf_dir):
    source = messages(spark, sf_dir)
    return C.thread_turns(source, C.thread_members(_nodes(spark, sf_dir)))


def thread_turns(spark, sf_dir):
    return _turns(spark, sf_dir).select("root_id", F.col("turn").cast("int").alias("turn"), "user", "text", "n_messages")


def conversation_chunks(spark, sf_dir):
    groups = spark.createDataFrame([(1, "events")], "group_id long, group_name string")
    return C.conversation_chunks(_turns(spark, sf_dir), groups)


def conversation_stats(spark, sf_dir):
    return C.process_messages(messages(spark, sf_dir))[1]


QUERIES = {f.__name__: f for f in (
    msg_scan_since, msg_scan_latest, msg_scan_earliest, msg_two_groups, link_same_user, link_aba, link_proximity, links_all, link_stats, thread_roots, reply_children, thread_members, thread_turns, conversation_chunks, conversation_stats,
)}

_F = "({0} + 1 + 7 * ({0} // 5))"
_MESSAGES = f"""
    k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    b AS (SELECT *, event_id - 1 - (k // 10) % 4 AS back FROM k),
    m AS (SELECT {_F.format("event_id")} AS id, ts, 1 + user_id % 8 AS sender_id, event_type || ' ' || props AS text,
                 CASE WHEN k = 99 THEN {_F.format("event_id")} + 100000000 WHEN k % 10 < 3 AND back >= 0 THEN {_F.format("back")} END AS stated FROM b)"""
_LINKED = f"""{_MESSAGES},
    n AS (SELECT *, lag(id) OVER w AS p_id, lag(sender_id) OVER w AS p_sender, lag(stated) OVER w AS p_stated, lag(ts) OVER w AS p_ts, lag(id, 2) OVER w AS pp_id, lag(sender_id, 2) OVER w AS pp_sender FROM m WINDOW w AS (ORDER BY id)),
    t AS (SELECT *, CASE WHEN stated IS NULL THEN CASE
            WHEN p_sender = sender_id THEN 'same_user_consecutive'
            WHEN pp_sender = sender_id AND pp_sender <> p_sender AND p_stated = pp_id THEN 'aba'
            WHEN p_sender <> sender_id AND date_diff('microsecond', p_ts, ts) > 0 AND date_diff('microsecond', p_ts, ts) <= 300000000 AND id - p_id > 0 AND id - p_id <= 5 THEN 'time_proximity' END END AS kind FROM n),
    l AS (SELECT *, CASE WHEN kind IS NOT NULL THEN p_id ELSE stated END AS reply FROM t)"""
_ROOTED = f"""{_LINKED},
    x AS (SELECT *, lead(sender_id) OVER w AS x_sender, lead(reply) OVER w AS x_reply, lead(ts) OVER w AS x_ts, lead(id) OVER w AS x_id FROM l WINDOW w AS (ORDER BY id)),
    g AS (SELECT x.*, p.id AS parent FROM x LEFT JOIN m p ON p.id = x.reply AND x.reply <> 0),
    r AS (SELECT *, parent IS NULL AND NOT coalesce(x_id IS NOT NULL AND x_sender <> sender_id AND x_reply IS NULL AND id NOT IN (SELECT parent FROM g WHERE parent IS NOT NULL)
            AND date_diff('microsecond', ts, x_ts) <= 30000000, false) AS root FROM g)"""
_THREADS = f"""{_ROOTED},
    tree AS (SELECT id AS root_id, id, 0 AS depth, []::BIGINT[] AS path FROM r WHERE root
             UNION ALL SELECT tree.root_id, c.id, tree.depth + 1, list_append(tree.path, c.id) FROM tree JOIN r c ON c.parent = tree.id WHERE tree.depth < 19),
    o AS (SELECT tree.root_id, r.id, r.sender_id, r.ts, r.reply, r.kind, r.parent, row_number() OVER (PARTITION BY tree.root_id ORDER BY tree.depth, tree.path) AS rk FROM tree JOIN r USING (id)),
    fold AS (
        SELECT root_id, 0::BIGINT AS rk, []::BIGINT[] AS accepted, []::BIGINT[] AS senders, NULL::BIGINT AS last_id, NULL::BIGINT AS last_sender, NULL::TIMESTAMP AS last_ts, false AS stopped FROM (SELECT DISTINCT root_id FROM o)
        UNION ALL
        SELECT root_id, rk, CASE WHEN take THEN list_append(accepted, id) ELSE accepted END, senders, CASE WHEN take THEN id ELSE last_id END, CASE WHEN take THEN sender_id ELSE last_sender END, CASE WHEN take THEN ts ELSE last_ts END, stopped
        FROM (SELECT *, queued AND NOT stopped AND NOT coalesce(last_id IS NOT NULL AND reply <> last_id AND sender_id <> last_sender AND kind IS DISTINCT FROM 'time_proximity' AND date_diff('microsecond', last_ts, ts) <= 30000000, false) AS take
              FROM (SELECT * EXCLUDE (stopped), stopped OR (queued AND (len(accepted) >= 20 OR len(senders) > 5)) AS stopped
                    FROM (SELECT f.root_id, o.rk, f.accepted, o.id, o.sender_id, o.ts, o.reply, o.kind, f.last_id, f.last_sender, f.last_ts, f.stopped, q.queued,
                                 CASE WHEN q.queued AND NOT list_contains(f.senders, o.sender_id) THEN list_append(f.senders, o.sender_id) ELSE f.senders END AS senders
                          FROM fold f JOIN o ON o.root_id = f.root_id AND o.rk = f.rk + 1,
                               LATERAL (SELECT NOT f.stopped AND (o.parent IS NULL OR list_contains(f.accepted, o.parent)) AS queued) q)))),
    e AS (SELECT root_id, arg_max(accepted, rk) AS accepted FROM fold GROUP BY root_id),
    a AS (SELECT root_id, unnest(range(0, len(accepted))) AS position, unnest(accepted) AS id FROM e)"""
_TURNS = f"""{_THREADS},
    s AS (SELECT a.root_id, m.id, m.sender_id, m.ts, m.text, coalesce(lag(m.sender_id) OVER w <> m.sender_id, true) AS fresh, min(m.id) OVER (PARTITION BY a.root_id, m.sender_id) AS first_of FROM a JOIN m USING (id) WINDOW w AS (PARTITION BY a.root_id ORDER BY m.id)),
    u AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY root_id ORDER BY id) - 1 AS turn, 'user' || (dense_rank() OVER (PARTITION BY root_id ORDER BY first_of) - 1) AS usr FROM s),
    v AS (SELECT root_id, turn::INTEGER AS turn, min(usr) AS usr, string_agg(text, chr(10) ORDER BY id) AS text, count(*) AS n_messages, min(id) AS first_id, max(id) AS last_id FROM u GROUP BY root_id, turn),
    c AS (SELECT root_id, min(first_id) AS root_message_id, max(last_id) AS last_id, count(DISTINCT usr)::INTEGER AS participant_count, sum(n_messages)::INTEGER AS message_count_original, count(*)::INTEGER AS turn_count_condensed,
                 trim(string_agg(usr || ': ' || text, chr(10) ORDER BY turn)) AS content FROM v GROUP BY root_id)"""
_SCAN = f"WITH {_MESSAGES} SELECT id, sender_id - 1 AS sender_id, stated AS reply_to_msg_id FROM (SELECT * FROM m {{}}) WHERE sender_id <> 1 AND text <> ''"
ORACLES = {
    "msg_scan_since": _SCAN.format("WHERE id > 100 ORDER BY id LIMIT 700"),
    "msg_scan_latest": _SCAN.format("ORDER BY id DESC LIMIT 500"),
    "msg_scan_earliest": _SCAN.format("ORDER BY id LIMIT 500"),
    "msg_two_groups": f"WITH {_MESSAGES} SELECT g AS group_id, id, sender_id - 1 AS sender_id FROM m, (VALUES (1::BIGINT), (2)) t(g) WHERE sender_id <> 1 AND text <> ''",
    "link_same_user": f"WITH {_LINKED} SELECT id, reply AS reply_to FROM l WHERE kind = 'same_user_consecutive'",
    "link_aba": f"WITH {_LINKED} SELECT id, reply AS reply_to FROM l WHERE kind = 'aba'",
    "link_proximity": f"WITH {_LINKED} SELECT id, reply AS reply_to FROM l WHERE kind = 'time_proximity'",
    "links_all": f"WITH {_LINKED} SELECT id, sender_id, reply AS reply_to, kind AS inferred_reply_type FROM l",
    "link_stats": f"WITH {_LINKED} SELECT 1::BIGINT AS group_id, count(*) AS total_messages_fetched, count(*) FILTER (kind = 'same_user_consecutive') AS same_user_chained_count, count(*) FILTER (kind = 'aba') AS aba_inferred_count, count(*) FILTER (kind = 'time_proximity') AS proximity_inferred_count FROM l",
    "thread_roots": f"WITH {_ROOTED} SELECT id FROM r WHERE root",
    "reply_children": f"WITH {_ROOTED} SELECT parent, count(*) AS n_children, min(id) AS first_child, max(id) AS last_child FROM r WHERE parent IS NOT NULL GROUP BY parent",
    "thread_members": f"WITH RECURSIVE {_THREADS} SELECT root_id, position::INTEGER AS position, id FROM a",
    "thread_turns": f"WITH RECURSIVE {_TURNS} SELECT root_id, turn, usr AS user, text, n_messages FROM v",
    "conversation_chunks": f"""WITH RECURSIVE {_TURNS} SELECT 'tg_1_' || root_message_id AS id, 'telegram' AS source, 1::BIGINT AS group_id, 'events' AS group_name, root_message_id, f.ts AS start_date, z.ts AS end_date, participant_count, message_count_original, turn_count_condensed, content
        FROM c JOIN m f ON f.id = root_message_id JOIN m z ON z.id = last_id WHERE participant_count >= 2""",
    "conversation_stats": f"""WITH RECURSIVE {_TURNS} SELECT 1::BIGINT AS group_id, (SELECT count(*) FROM l) AS total_messages_fetched, (SELECT count(*) FROM l WHERE kind = 'same_user_consecutive') AS same_user_chained_count,
        (SELECT count(*) FROM l WHERE kind = 'aba') AS aba_inferred_count, (SELECT count(*) FROM l WHERE kind = 'time_proximity') AS proximity_inferred_count, count(*) AS total_raw_threads_built, count(*) FILTER (participant_count < 2) AS threads_filtered_out, count(*) FILTER (participant_count >= 2) AS final_chunks_exported FROM c""",
}
