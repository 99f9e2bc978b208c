"""Queries over document collections, each with its oracle. Keys name what they cover; documents are the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import MODEL_DIMENSIONS, embedding_dimension
from ..operators import documents as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _heads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _labelled(spark, sf_dir):
    return _heads(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def docs_point_lookup(spark, sf_dir):
    return D.get_document(_heads(spark, sf_dir), 7, "doc_id")


def docs_filter_eq(spark, sf_dir):
    return D.query_documents(_heads(spark, sf_dir), {"lang": "de", "source": "src9"}, id_col="doc_id")


def docs_filter_range_or(spark, sf_dir):
    query = {"$or": [{"n_chars": {"$gte": 10000}}, {"$and": [{"lang": "fr"}, {"n_chars": {"$lt": 200, "$gt": 20}}]}]}
    return D.query_documents(_heads(spark, sf_dir), query, id_col="doc_id")


def docs_filter_in_nin(spark, sf_dir):
    return D.query_documents(_heads(spark, sf_dir), {"lang": {"$in": ["de", "es"]}, "source": {"$nin": ["src0", "src1", None]}}, id_col="doc_id")


def docs_filter_null_exists(spark, sf_dir):
    query = {"$or": [{"quality": None, "lang": {"$ne": "en"}}, {"quality": {"$exists": True}, "toxic": {"$not": {"$lt": 1}}}]}
    return D.query_documents(_labelled(spark, sf_dir), query, id_col="doc_id")


def docs_filter_regex(spark, sf_dir):
    return D.query_documents(table(spark, sf_dir, "documents"), {"text": {"$regex": "[Ll]icen[sc]e"}, "$nor": [{"lang": "es"}]}, id_col="doc_id").select("doc_id", "lang", "n_chars")


def docs_find_first(spark, sf_dir):
    return D.find_document(_heads(spark, sf_dir), {"lang": "es", "n_chars": {"$gt": 3000}}, "doc_id")


def docs_sort_skip_limit(spark, sf_dir):
    return D.query_documents(table(spark, sf_dir, "orders"), {"o_orderstatus": {"$ne": "P"}}, limit=50, offset=20, sort_by=[("o_orderpriority", 1), ("o_totalprice", -1)], id_col="o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


def docs_count_all(spark, sf_dir):
    return D.count_documents(table(spark, sf_dir, "lineitem"))


def docs_count_filtered(spark, sf_dir):
    return D.count_documents(table(spark, sf_dir, "events"), {"event_type": "click", "value": {"$gte": 10}})


def docs_insert_dedup(spark, sf_dir):
    """The labels table is the collection, documents come in: ids that are there are refused."""
    return D.insert_documents(table(spark, sf_dir, "labels"), _heads(spark, sf_dir).select("doc_id", "lang"), "doc_id")


def docs_update_one(spark, sf_dir):
    return D.update_document(_heads(spark, sf_dir), 7, {"lang": "xx"}, "doc_id", "changed")


def docs_update_many(spark, sf_dir):
    return D.update_documents(_labelled(spark, sf_dir), {"n_chars": {"$gt": 5000}}, {"$set": {"source": "long"}, "$inc": {"quality": 1}, "$unset": {"toxic": ""}}, "changed")


def docs_update_first(spark, sf_dir):
    return D.update_first(_heads(spark, sf_dir), {"lang": "fr"}, {"$inc": {"n_chars": 5}}, "doc_id", "changed")


def docs_delete_one(spark, sf_dir):
    return D.delete_document(_heads(spark, sf_dir), 7, "doc_id")


def docs_delete_many(spark, sf_dir):
    return D.delete_documents(_labelled(spark, sf_dir), {"quality": {"$ne": 1}, "n_chars": {"$lte": 4000}})


def docs_delete_first(spark, sf_dir):
    return D.delete_first(_heads(spark, sf_dir), {"lang": "de"}, "doc_id")


def embed_model_dims(spark, sf_dir):
    names = [*MODEL_DIMENSIONS, "another-model"]
    return spark.createDataFrame([(n, embedding_dimension(n)) for n in names], "model string, dimension int")


QUERIES = {f.__name__: f for f in (
    docs_point_lookup, docs_filter_eq, docs_filter_range_or, docs_filter_in_nin, docs_filter_null_exists, docs_filter_regex, docs_find_first, docs_sort_skip_limit, docs_count_all, docs_count_filtered,
    docs_insert_dedup, docs_update_one, docs_update_many, docs_update_first, docs_delete_one, docs_delete_many, docs_delete_first, embed_model_dims,
)}

_HEADS = "SELECT doc_id, lang, source, n_chars FROM documents"
_LABELLED = "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"
ORACLES = {
    "docs_point_lookup": f"{_HEADS} WHERE doc_id = 7",
    "docs_filter_eq": f"{_HEADS} WHERE lang = 'de' AND source = 'src9'",
    "docs_filter_range_or": f"{_HEADS} WHERE n_chars >= 10000 OR (lang = 'fr' AND n_chars < 200 AND n_chars > 20)",
    "docs_filter_in_nin": f"{_HEADS} WHERE lang IN ('de', 'es') AND source IS NOT NULL AND source NOT IN ('src0', 'src1')",
    "docs_filter_null_exists": f"{_LABELLED} WHERE (quality IS NULL AND (lang IS NULL OR lang <> 'en')) OR (quality IS NOT NULL AND NOT coalesce(toxic < 1, false))",
    "docs_filter_regex": "SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, '[Ll]icen[sc]e') AND NOT coalesce(lang = 'es', false)",
    "docs_find_first": f"{_HEADS} WHERE lang = 'es' AND n_chars > 3000 ORDER BY doc_id LIMIT 1",
    "docs_sort_skip_limit": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 50 OFFSET 20",
    "docs_count_all": "SELECT count(*) AS n FROM lineitem",
    "docs_count_filtered": "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value >= 10",
    "docs_insert_dedup": "SELECT doc_id, quality, toxic, NULL::VARCHAR AS lang FROM labels UNION ALL SELECT doc_id, NULL, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "docs_update_one": "SELECT doc_id, CASE WHEN doc_id = 7 THEN 'xx' ELSE lang END AS lang, source, n_chars, doc_id = 7 AND lang IS DISTINCT FROM 'xx' AS changed FROM documents",
    "docs_update_many": f"WITH d AS ({_LABELLED}) SELECT doc_id, lang, CASE WHEN n_chars > 5000 THEN 'long' ELSE source END AS source, n_chars, CASE WHEN n_chars > 5000 THEN coalesce(quality, 0) + 1 ELSE quality END AS quality, CASE WHEN n_chars > 5000 THEN NULL ELSE toxic END AS toxic, n_chars > 5000 AS changed FROM d",
    "docs_update_first": "SELECT doc_id, lang, source, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'fr') THEN n_chars + 5 ELSE n_chars END AS n_chars, doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'fr') AS changed FROM documents",
    "docs_delete_one": f"{_HEADS} WHERE doc_id <> 7",
    "docs_delete_many": f"{_LABELLED} WHERE NOT ((quality IS NULL OR quality <> 1) AND coalesce(n_chars <= 4000, false))",
    "docs_delete_first": f"{_HEADS} WHERE doc_id <> (SELECT min(doc_id) FROM documents WHERE lang = 'de')",
    "embed_model_dims": "SELECT model, dimension::INTEGER AS dimension FROM (VALUES ('voyage-3-large', 4096), ('voyage-3-mini', 1024), ('voyage-2', 1024), ('voyage-large-2', 1536), ('voyage-code-2', 1536), ('another-model', 4096)) AS t(model, dimension)",
}
