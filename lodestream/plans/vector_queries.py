"""Queries over the vector collection (embeddings), each with its oracle where the result is exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity
from ..operators import vectors as V
from ..sources.scratch import materialize
from .document_queries import table
from .search import search_chunks

#: Vectors whose id it divides are the queries of a batch.
EVERY = 50
#: Vectors, none of the query set, on which the number of probed lists is chosen.
SAMPLE = 256


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _query(spark, sf_dir):
    """One vector, as an application would hold that of a text."""
    return _vectors(spark, sf_dir).filter("vec_id = 0").select("embedding").first()[0]


def vec_topk(spark, sf_dir):
    found = V.search_vectors(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, "vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def vec_topk_batched(spark, sf_dir):
    """The query set is stated; it meets all rows block by block."""
    queries = _vectors(spark, sf_dir).filter(F.col("vec_id") % EVERY == 0)
    found = V.search_table(_vectors(spark, sf_dir), queries, 10, "vec_id", "vec_id")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vec_cosine_pairs(spark, sf_dir):
    """Each vector and the next one by id."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def vec_get_many(spark, sf_dir):
    found = V.get_vectors(_vectors(spark, sf_dir), [3, 77, 78, 499, -1], "vec_id", "vec_id")
    return found.select("vec_id", "label", F.size("embedding").alias("width"))


def vec_get_one(spark, sf_dir):
    return V.get_vector(_vectors(spark, sf_dir), 77, "vec_id").select("vec_id", "label")


def vec_delete(spark, sf_dir):
    return V.delete_vectors(_vectors(spark, sf_dir), [2, 3, 5], "label").select("vec_id", "label")


def vec_all_dedup(spark, sf_dir):
    """Keys that repeat: the label is the key, the latest row of each counts."""
    found = V.all_vectors(_vectors(spark, sf_dir), "label", "vec_id")
    return found.select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def vec_stats(spark, sf_dir):
    return V.collection_stats(_vectors(spark, sf_dir))


def vec_ivf_topk(spark, sf_dir):
    """Approximate top-k for the query set of vec_topk_batched: an inverted file of the operator's number of lists, fitted on a
    bounded sample, over all rows. As many lists are probed as SAMPLE other vectors, chosen by a hash, need for a recall of 0.95."""
    v = _vectors(spark, sf_dir)
    centroids = V.fit_lists(v)
    listed = V.assign_lists(v, centroids).repartitionByRange("list_id", F.xxhash64("vec_id")).sortWithinPartitions("list_id")
    indexed = materialize(listed, "lists")
    sample = v.filter(F.col("vec_id") % EVERY != 0).filter("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE).collect()
    probes = V.probes_for(indexed, centroids, [r["vec_id"] for r in sample], [r["embedding"] for r in sample], 10, 0.95, "vec_id") if sample else len(centroids)
    found = V.search_lists_table(indexed, centroids, v.filter(F.col("vec_id") % EVERY == 0), 10, probes, "vec_id", "vec_id")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def ivf_recall(spark, sf_dir):
    """Share of vec_topk_batched's exact rows that vec_ivf_topk finds, over the whole query set."""
    exact, found = (q(spark, sf_dir).select("query_id", "vec_id") for q in (vec_topk_batched, vec_ivf_topk))
    return exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.count("hit") / F.count(F.lit(1))).first()[0]


def vec_ivf_recall(spark, sf_dir):
    """Whether the inverted file finds nine in ten of the exact rows, and for how many queries it was asked."""
    n = _vectors(spark, sf_dir).filter(F.col("vec_id") % EVERY == 0).count()
    return spark.createDataFrame([(n, bool(ivf_recall(spark, sf_dir) >= 0.9))], "n_queries long, nine_in_ten boolean")


def vec_scan_ids(spark, sf_dir):
    """The surrogate ids that a full scan meets, one for each row with a key and a vector."""
    return V.latest_with_ids(_vectors(spark, sf_dir), "label", "vec_id")[1]


def search_join(spark, sf_dir):
    """Vectors stand for chunks: their texts are documents with the same id, whose parent is the id without its last digit."""
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("vector_id"), "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), "lang", "n_chars")
    chunks = docs.withColumn("parent_id", F.expr("left(_id, length(_id) - 1)"))
    found = search_chunks(vectors, chunks, docs, _query(spark, sf_dir), 50)
    return found.select(F.round("score", 6).alias("score"), F.col("chunk._id").alias("chunk_id"), F.col("chunk.parent_id").alias("parent_id"), F.col("document._id").alias("document_id"), F.col("document.n_chars").alias("document_chars"))


QUERIES = {f.__name__: f for f in (vec_topk, vec_topk_batched, vec_cosine_pairs, vec_get_many, vec_get_one, vec_delete, vec_all_dedup, vec_stats, vec_scan_ids, vec_ivf_topk, vec_ivf_recall, search_join)}

_SCORE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_ONE = f"SELECT e.vec_id, e.label, {_SCORE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
ORACLES = {
    "vec_topk": f"SELECT vec_id, label, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 10",
    "vec_topk_batched": f"""
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_SCORE} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10""",
    "vec_cosine_pairs": f"SELECT e.vec_id, round({_SCORE}, 6) AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id + 1",
    "vec_get_many": "SELECT vec_id, label, len(embedding)::INTEGER AS width FROM embeddings WHERE vec_id IN (3, 77, 78, 499, -1)",
    "vec_get_one": "SELECT vec_id, label FROM embeddings WHERE vec_id = 77",
    "vec_delete": "SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 3, 5)",
    "vec_all_dedup": "SELECT label, max(vec_id) AS vec_id, round(arg_max(embedding, vec_id)[1]::DOUBLE, 6) AS first FROM embeddings GROUP BY label",
    "vec_stats": "SELECT count(*) AS entities, min(len(embedding))::INTEGER AS min_dimension, max(len(embedding))::INTEGER AS max_dimension FROM embeddings",
    "vec_scan_ids": "SELECT vec_id FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0",
    "vec_ivf_recall": f"SELECT count(*) AS n_queries, true AS nine_in_ten FROM embeddings WHERE vec_id % {EVERY} = 0",
    "search_join": f"""
        WITH h AS (SELECT vec_id, s FROM ({_ONE}) ORDER BY s DESC, vec_id::VARCHAR LIMIT 50)
        SELECT round(s, 6) AS score, c.doc_id::VARCHAR AS chunk_id, left(c.doc_id::VARCHAR, length(c.doc_id::VARCHAR) - 1) AS parent_id, d.doc_id::VARCHAR AS document_id, d.n_chars AS document_chars
        FROM h JOIN documents c ON c.doc_id = h.vec_id LEFT JOIN documents d ON d.doc_id::VARCHAR = left(c.doc_id::VARCHAR, length(c.doc_id::VARCHAR) - 1)""",
}
