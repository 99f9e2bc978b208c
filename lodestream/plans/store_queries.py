"""Queries that write to collections and files in the shared folder and read the outcome back, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import conversations as C
from ..operators.embedding import HashingProvider, PerWorker
from ..sources import exports, messages
from ..sources.json_documents import read_json_documents, read_json_lines
from ..sources.scratch import materialize, scratch_root
from ..sources.store import DocumentStore, VectorStore
from . import conversation_queries, text_queries
from .document_queries import table
from .export import export_conversations
from .index import Indexer

WIDTH = 1024
QUERY_TEXT = "all rights reserved under this license"


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def json_documents(spark, sf_dir):
    """Documents as JSON lines, written and read back with an id field."""
    path = _folder(spark, "json")
    table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title")).write.json(path)
    return read_json_lines(spark, path, "content", "doc_id").select("_id", "text", "title", "type")


def store_documents(spark, sf_dir):
    """Insert twice, update and delete in a collection; what it holds then."""
    store = DocumentStore(spark, _folder(spark, "documents"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), "lang", "source", "n_chars")
    store.insert("c", docs)
    store.insert("c", docs.withColumn("lang", F.lit("refused")))
    store.update_many("c", {"lang": "de"}, {"$set": {"source": "x"}, "$inc": {"n_chars": 1}})
    store.update("c", "7", {"lang": "yy"})
    store.delete_many("c", {"n_chars": {"$lt": 100}})
    store.delete("c", "9")
    return store.read("c")


def store_vectors(spark, sf_dir):
    """Insert keys twice and delete some; the latest row of each key."""
    store = VectorStore(spark, _folder(spark, "vectors"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vector_id"), "embedding")
    store.create_vectors("v", 64)
    store.insert("v", rows)
    store.insert("v", rows.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.delete("v", ["v3", "v5"])
    return store.all("v").select("vector_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").alias("width"))


def store_exists(spark, sf_dir):
    """Which collections are there after one was made, made anew and dropped, and how many documents they hold."""
    store = DocumentStore(spark, _folder(spark, "documents"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), "lang")
    for name in ("kept", "emptied", "dropped"):
        store.insert(name, docs)
    store.create("kept", docs.schema)
    store.create("emptied", docs.schema, recreate=True)
    store.drop("dropped")
    found = [(name, store.exists(name), store.stats(name).get("entities", 0)) for name in ("kept", "emptied", "dropped", "never")]
    return spark.createDataFrame(found, "name string, there boolean, entities long")


def store_embedding_setup(spark, sf_dir):
    """The collections of an embedding store, with the width that they are made for."""
    store = VectorStore(spark, _folder(spark, "vectors"))
    return spark.createDataFrame([(n, store.dimension(n), store.stats(n)["entities"]) for n in store.setup_embeddings(64)], "name string, dimension int, entities long")


def store_index_search(spark, sf_dir):
    """A collection with an index: half of the vectors before it is built, the others after, some deleted. All lists are probed,
    so the result is the exact one."""
    store = VectorStore(spark, _folder(spark, "vectors"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vector_id"), "embedding", "vec_id")
    store.create_vectors("v", 64)
    store.insert("v", rows.filter("vec_id % 2 = 0").drop("vec_id"))
    store.build_index("v", 64)
    store.insert("v", rows.filter("vec_id % 2 = 1").drop("vec_id"))
    store.delete("v", ["v2", "v3", "v4", "v5"])
    query = rows.filter("vec_id = 0").select("embedding").first()[0]
    return store.search("v", query, 25, n_probe=64).select("vector_id", F.round("score", 6).alias("score"))


def _json_files(spark, sf_dir) -> str:
    """Documents as JSON files of every shape, a hundred ids a file: lists, objects with items, objects of documents, and such
    objects with a key that starts with an underscore."""
    path = _folder(spark, "shapes")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("doc_id", F.col("text").alias("content"), F.col("source").alias("title")).alias("d"))
    files = docs.groupBy((F.col("doc_id") % 4).alias("shape"), F.floor(F.col("doc_id") / 400).alias("file")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "d"))).alias("rows"))
    each = F.transform("rows", lambda x: x["d"])
    named = lambda prefix: F.to_json(F.map_from_entries(F.transform("rows", lambda x: F.struct(F.concat(F.lit(prefix), x["doc_id"].cast("string")), x["d"]))))
    shape = F.when(F.col("shape") == 0, F.to_json(each)).when(F.col("shape") == 1, F.to_json(F.struct(each.alias("items")))).when(F.col("shape") == 2, named("d")).otherwise(named("_d"))
    files.select("shape", "file", shape.alias("value")).write.partitionBy("shape", "file").text(path)
    return path


def json_file_shapes(spark, sf_dir):
    """As an indexer reads them: objects with an underscore key have no documents."""
    return read_json_documents(spark, _json_files(spark, sf_dir), "content", "doc_id").select("_id", "text", "title", "type")


def json_file_shapes_store(spark, sf_dir):
    """As a store loads them: the values of such objects are documents."""
    return read_json_documents(spark, _json_files(spark, sf_dir), "content", "doc_id", underscore_guard=False).select("_id", "text", "title", "type")


def _sourced(spark, sf_dir):
    """Messages in the shape of a chat source."""
    m = conversation_queries.messages(spark, sf_dir)
    return m.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), "sender_id", "text", F.col("reply_to").alias("reply_to_msg_id"), "original_reply_to", F.lit(None).cast("string").alias("inferred_reply_type"), F.lit(1).cast("long").alias("group_id"))


def export_raw_messages(spark, sf_dir):
    """Raw messages written as JSON lines and read back, with the number that the fetch describes."""
    path = _folder(spark, "raw")
    raw = messages.fetch(_sourced(spark, sf_dir), limit=None)
    exports.write_messages(raw, messages.group_info(raw, "events", 1), path)
    total = spark.read.schema("total_messages_fetched long").json(f"{path}/group_info")
    return messages.read_messages(spark, f"{path}/messages").crossJoin(F.broadcast(total)).select("id", "sender_id", "text", "reply_to_msg_id", "total_messages_fetched")


def export_conversations_files(spark, sf_dir):
    """Fetch, process and save the conversations of a group; the chunks read back."""
    path = _folder(spark, "conversations")
    export_conversations(spark, _sourced(spark, sf_dir), "events", 1, path, limit=None)
    return spark.read.schema("id string, group_name string, participant_count int, message_count_original int, content string").json(f"{path}/conversation_chunks")


def export_envelope(spark, sf_dir):
    """The chunk lines of the one-object export, read back from its files."""
    path = _folder(spark, "envelope")
    groups = spark.createDataFrame([(1, "events")], "group_id long, group_name string")
    source = conversation_queries.messages(spark, sf_dir)
    chunks, stats = C.process_messages(source, groups, written=True)
    exports.write_envelope(exports.envelope_lines(chunks, stats, messages.group_info(source, "events", 1), C.TIME_THRESHOLD_US, C.ID_THRESHOLD, C.MIN_PARTICIPANTS), path)
    lines = spark.read.text(path).filter(F.col("value").contains('"root_message_id"'))
    one = F.from_json(F.ltrim(F.col("value"), F.lit(",")), "id string, participant_count int, content string")
    return lines.select(one.alias("c")).select("c.*")


def export_empty(spark, sf_dir):
    """The lines of an export without messages."""
    source = conversation_queries.messages(spark, sf_dir).filter("id < 0")
    chunks, stats = C.process_messages(source)
    return exports.envelope_lines(chunks, stats, messages.group_info(source, "events", 1), C.TIME_THRESHOLD_US, C.ID_THRESHOLD, C.MIN_PARTICIPANTS)


def export_chunks(spark, sf_dir):
    """Conversation chunks and statistics written as JSON, and the chunks read back."""
    path = _folder(spark, "export")
    chunks, stats = C.process_messages(conversation_queries.messages(spark, sf_dir), written=True)
    exports.write_chunks(chunks, stats, path)
    return spark.read.schema("id string, participant_count int, message_count_original int, content string").json(f"{path}/conversation_chunks")


def index_search(spark, sf_dir):
    """Index all documents with the offline provider, at the width of a small model, and search a text: of the 50 best hits those
    that are better than the last one, as many may tie with it up to rounding."""
    index = Indexer(spark, _folder(spark, "index"), PerWorker(lambda: HashingProvider(WIDTH)), dimension=WIDTH)
    index.setup()
    docs = table(spark, sf_dir, "documents")
    index.index(docs.select(F.col("doc_id").cast("string").alias("_id"), "text", F.col("source").alias("title"), F.col("lang").alias("type")))
    found = materialize(index.search(QUERY_TEXT, 50).withColumn("score", F.round("score", 5)), "found")
    last = found.agg(F.min("score")).scalar()
    return found.filter(F.col("score") > last).select("score", F.col("chunk._id").alias("chunk_id"), F.col("document._id").alias("document_id"), F.col("document.title").alias("title"))


QUERIES = {f.__name__: f for f in (
    json_documents, json_file_shapes, json_file_shapes_store, store_documents, store_exists, store_vectors, store_embedding_setup, store_index_search,
    export_raw_messages, export_chunks, export_conversations_files, export_envelope, export_empty, index_search,
)}


def _hashed(rows: str) -> str:
    """(key, b, e): the non-zero numbers of the offline provider's vectors, in single precision, for (key, text)."""
    return f"""(
        SELECT key, b, (c / sqrt(sum(c * c) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS e
        FROM (SELECT key, ('0x' || substr(md5(w), 1, 8))::BIGINT % {WIDTH} AS b, count(*) AS c FROM (SELECT key, unnest(string_split(lower(text), ' ')) AS w FROM {rows}) WHERE w <> '' GROUP BY 1, 2))"""


ORACLES = {
    "json_documents": "SELECT doc_id::VARCHAR AS _id, text, coalesce(source, '') AS title, '' AS type FROM documents",
    "store_documents": """
        SELECT doc_id::VARCHAR AS _id, CASE WHEN doc_id = 7 THEN 'yy' ELSE lang END AS lang, CASE WHEN lang = 'de' THEN 'x' ELSE source END AS source, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars
        FROM documents WHERE NOT coalesce(CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END < 100, false) AND doc_id <> 9""",
    "json_file_shapes": "SELECT doc_id::VARCHAR AS _id, text, coalesce(source, '') AS title, '' AS type FROM documents WHERE doc_id % 4 <> 3",
    "json_file_shapes_store": "SELECT doc_id::VARCHAR AS _id, text, coalesce(source, '') AS title, '' AS type FROM documents",
    "store_exists": "SELECT 'kept' AS name, true AS there, (SELECT count(*) FROM documents) AS entities UNION ALL VALUES ('emptied', true, 0), ('dropped', false, 0), ('never', false, 0)",
    "store_embedding_setup": "SELECT name, 64::INTEGER AS dimension, 0::BIGINT AS entities FROM (VALUES ('conversations'), ('category_embeddings'), ('cluster_centroids')) t(name)",
    "store_index_search": "SELECT 'v' || e.vec_id AS vector_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id NOT IN (2, 3, 4, 5) ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vector_id LIMIT 25",
    "export_raw_messages": f"WITH {conversation_queries._MESSAGES} SELECT id, sender_id, text, stated AS reply_to_msg_id, count(*) OVER () AS total_messages_fetched FROM m WHERE text <> ''",
    "export_conversations_files": f"WITH RECURSIVE {conversation_queries._TURNS} SELECT 'tg_1_' || root_message_id AS id, 'events' AS group_name, participant_count, message_count_original, content FROM c WHERE participant_count >= 2",
    "export_envelope": f"WITH RECURSIVE {conversation_queries._TURNS} SELECT 'tg_1_' || root_message_id AS id, participant_count, content FROM c WHERE participant_count >= 2",
    "export_empty": """SELECT * FROM (VALUES (-5::BIGINT, '{'), (-2, '"processing_stats":{"total_messages_fetched":0,"final_chunks_exported":0},'), (-1, '"conversation_chunks":['), (4611686018427387904, ']}')) t(place, line)""",
    "store_vectors": "SELECT 'v' || vec_id AS vector_id, round(-(embedding[1]::DOUBLE), 6) AS first, len(embedding)::INTEGER AS width FROM embeddings WHERE vec_id NOT IN (3, 5)",
    "export_chunks": f"WITH RECURSIVE {conversation_queries._TURNS} SELECT 'tg_1_' || root_message_id AS id, participant_count, message_count_original, content FROM c WHERE participant_count >= 2",
    "index_search": f"""WITH RECURSIVE {text_queries._folded(text_queries._slices(1000), 1000, 50, 1, True)},
        k AS (SELECT doc_id, doc_id::VARCHAR || '_' || i AS key, done[i + 1] AS text FROM (SELECT doc_id, done, unnest(range(0, len(done))) AS i FROM chunked)),
        v AS (SELECT * FROM {_hashed("k")}),
        q AS (SELECT * FROM {_hashed(f"(SELECT 0 AS key, '{QUERY_TEXT}' AS text)")}),
        s AS (SELECT v.key, coalesce(sum(v.e * q.e) / sqrt(sum(v.e * v.e)) / (SELECT sqrt(sum(e * e)) FROM q), 0) AS s FROM v LEFT JOIN q USING (b) GROUP BY v.key),
        h AS (SELECT key, round(s, 5) AS score FROM s ORDER BY s DESC, key LIMIT 50)
        SELECT score, k.key AS chunk_id, d.doc_id::VARCHAR AS document_id, d.source AS title FROM h JOIN k USING (key) JOIN documents d USING (doc_id) WHERE score > (SELECT min(score) FROM h)""",
}
