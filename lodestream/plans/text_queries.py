"""Queries that split documents into lines, slices and chunks, and embed them, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chunking import chunk_documents
from ..operators.embedding import HashingProvider, PerWorker, batch_tokens, embed_documents, with_embedding
from ..sources.scratch import materialize
from .document_queries import table
from .index import chunk_vectors, document_vectors


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _typed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("_id"), "text", F.col("source").alias("title"), F.col("lang").alias("type"))


def text_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))


def text_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.lines(F.col("text"), "sentence")).alias("line_no", "line"))


def text_long_slices(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.slices(X.lines(F.col("text")), 1000)).alias("piece_no", "piece"))


def text_merge(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.merge(X.lines(F.col("text")), 600, 50, 2)).alias("chunk_no", "chunk"))


def chunk_documents_default(spark, sf_dir):
    return chunk_documents(_docs(spark, sf_dir).withColumnRenamed("doc_id", "_id"))


def chunk_documents_small(spark, sf_dir):
    return chunk_documents(_docs(spark, sf_dir).withColumnRenamed("doc_id", "_id"), max_size=200, min_size=30, overlap=0)


def chunk_stats(spark, sf_dir):
    made = _docs(spark, sf_dir).withColumn("c", X.chunks(F.col("text")))
    return made.select("doc_id", F.size("c").alias("n_chunks"), F.coalesce(F.array_max(F.transform("c", F.char_length)), F.lit(0)).alias("longest"))


def embed_valid_docs(spark, sf_dir):
    """Four-dimensional vectors of the offline provider, as columns."""
    made = embed_documents(_docs(spark, sf_dir).withColumnRenamed("doc_id", "_id"), HashingProvider(4), "text", "offline")
    e = F.col("embedding")
    return made.select("_id", "embedding_id", "embedding_model", *[F.round(e[i].cast("double"), 4).alias(f"e{i}") for i in range(4)])


class _Fails(HashingProvider):
    """A provider that fails where a text has certain words."""

    def __call__(self, texts, model, input_type):
        if any("rights reserved" in t for t in texts):
            raise ValueError("refused")
        return super().__call__(texts, model, input_type)


def embed_drop_failed(spark, sf_dir):
    """Documents whose batch, here of one text, failed are left out; their numbers are missing."""
    provider = PerWorker(lambda: _Fails(4))
    made = embed_documents(_docs(spark, sf_dir).withColumnRenamed("doc_id", "_id"), provider, "text", "offline", 1, drop_failed=True)
    return made.select("_id", "embedding_id", "embedding_model", F.size("embedding").alias("width"))


def embed_batch_tokens(spark, sf_dir):
    return batch_tokens(_docs(spark, sf_dir).withColumnRenamed("doc_id", "_id"), PerWorker(lambda: HashingProvider(4)), "text", "offline")


def index_document_meta(spark, sf_dir):
    made = document_vectors(with_embedding(_typed(spark, sf_dir), HashingProvider(4), "text", "offline"))
    return made.select("vector_id", "metadata.title", "metadata.type", F.size("embedding").alias("width"))


def index_chunk_meta(spark, sf_dir):
    chunks = materialize(chunk_documents(_typed(spark, sf_dir)), "chunks")
    made = chunk_vectors(with_embedding(chunks, HashingProvider(4), "text", "offline"))
    return made.select("vector_id", "metadata.parent_id", "metadata.chunk_index", "metadata.title")


QUERIES = {f.__name__: f for f in (text_lines, text_sentences, text_long_slices, text_merge, chunk_documents_default, chunk_documents_small, chunk_stats, embed_valid_docs, embed_drop_failed, embed_batch_tokens, index_document_meta, index_chunk_meta)}


def _lines(pattern: str = r"([\\.?!])\\s+") -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{pattern}', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _slices(size: int) -> str:
    step = size - max(50, size // 10)
    return f"flatten(list_transform({_lines()}, lambda p: CASE WHEN length(p) > {size} THEN list_transform(range(0, length(p), {step}), lambda i: substr(p, (i + 1)::BIGINT, {size})) ELSE [p] END))"


def _folded(pieces: str, size: int, least: int, overlap: int, short: bool) -> str:
    """Common table expressions that end in `chunked` (doc_id, done): a recursion over the pieces of each document."""
    shared = f"CASE WHEN len(held) >= {overlap} THEN held[-{overlap}:] ELSE [] END" if overlap else "[]"
    whole = f"length(coalesce(text, '')) BETWEEN 1 AND {least - 1}" if short else "false"
    return f"""
        pieces AS (SELECT doc_id, CASE WHEN {whole} THEN [text] WHEN {"length(coalesce(text, '')) = 0" if short else "false"} THEN [] ELSE {pieces} END AS p, {whole} AS whole FROM documents),
        fold AS (
            SELECT doc_id, p, 1 AS i, []::VARCHAR[] AS held, 0::BIGINT AS size, []::VARCHAR[] AS done FROM pieces WHERE NOT whole
            UNION ALL
            SELECT doc_id, p, i + 1,
                   list_append(CASE WHEN closes THEN shared ELSE held END, p[i]),
                   CASE WHEN closes THEN greatest(list_sum(list_transform(shared, lambda x: length(x) + 1))::BIGINT - 1, 0) ELSE size END + length(p[i]) + 1,
                   CASE WHEN closes THEN list_append(done, array_to_string(held, ' ')) ELSE done END
            FROM (SELECT *, size + length(p[i]) > {size} AND len(held) > 0 AS closes, ({shared})::VARCHAR[] AS shared FROM fold WHERE i <= len(p))),
        chunked AS (
            SELECT doc_id, CASE WHEN len(held) > 0 AND size >= {least} THEN list_append(done, array_to_string(held, ' ')) ELSE done END AS done FROM fold WHERE i = len(p) + 1
            UNION ALL SELECT doc_id, p FROM pieces WHERE whole)"""


def _chunk_rows(size: int, least: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {_folded(_slices(size), size, least, overlap, True)},
        rows_ AS (SELECT doc_id, done, unnest(range(0, len(done))) AS i FROM chunked)
        SELECT doc_id::VARCHAR || '_' || i AS _id, done[i + 1] AS text, i::INTEGER AS chunk_index, len(done)::INTEGER AS chunk_count, doc_id::VARCHAR AS parent_id FROM rows_
        UNION ALL SELECT doc_id::VARCHAR, text, NULL, NULL, NULL FROM documents WHERE coalesce(text, '') = ''"""


_NUMBERED = "SELECT doc_id, unnest(range(0, len(p))) AS i, p FROM ({}) WHERE len(p) > 0"
ORACLES = {
    "text_lines": "SELECT doc_id, i::INTEGER AS line_no, p[i + 1] AS line FROM (" + _NUMBERED.format(f"SELECT doc_id, {_lines()} AS p FROM documents") + ")",
    "text_sentences": "SELECT doc_id, i::INTEGER AS line_no, p[i + 1] AS line FROM (" + _NUMBERED.format(f"SELECT doc_id, {_lines(r'([.?!])\s+')} AS p FROM documents") + ")",
    "text_long_slices": "SELECT doc_id, i::INTEGER AS piece_no, p[i + 1] AS piece FROM (" + _NUMBERED.format(f"SELECT doc_id, {_slices(1000)} AS p FROM documents") + ")",
    "text_merge": f"WITH RECURSIVE {_folded(_lines(), 600, 50, 2, False)} SELECT doc_id, i::INTEGER AS chunk_no, p[i + 1] AS chunk FROM (" + _NUMBERED.format("SELECT doc_id, done AS p FROM chunked") + ")",
    "chunk_documents_default": _chunk_rows(1000, 50, 1),
    "chunk_documents_small": _chunk_rows(200, 30, 0),
    "chunk_stats": f"WITH RECURSIVE {_folded(_slices(1000), 1000, 50, 1, True)} SELECT doc_id, len(done)::INTEGER AS n_chunks, coalesce(list_max(list_transform(done, lambda x: length(x))), 0)::INTEGER AS longest FROM chunked",
    "embed_valid_docs": """
        WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE text <> ''),
        w AS (SELECT doc_id, i, unnest(string_split(lower(text), ' ')) AS w FROM d),
        b AS (SELECT doc_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % 4 AS b FROM w WHERE w <> ''),
        c AS (SELECT doc_id, i, count(*) FILTER (b = 0) AS c0, count(*) FILTER (b = 1) AS c1, count(*) FILTER (b = 2) AS c2, count(*) FILTER (b = 3) AS c3 FROM b GROUP BY doc_id, i),
        n AS (SELECT *, sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3) AS n FROM c)
        SELECT d.doc_id AS _id, d.doc_id::VARCHAR || '_' || d.i AS embedding_id, 'offline' AS embedding_model,
               round((coalesce(c0 / n, 0))::FLOAT::DOUBLE, 4) AS e0, round((coalesce(c1 / n, 0))::FLOAT::DOUBLE, 4) AS e1, round((coalesce(c2 / n, 0))::FLOAT::DOUBLE, 4) AS e2, round((coalesce(c3 / n, 0))::FLOAT::DOUBLE, 4) AS e3
        FROM d LEFT JOIN n USING (doc_id)""",
    "embed_drop_failed": "SELECT doc_id AS _id, 'emb_' || i AS embedding_id, 'offline' AS embedding_model, 4::INTEGER AS width FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE text <> '') WHERE NOT contains(text, 'rights reserved')",
    "embed_batch_tokens": "SELECT i // 10 AS batch, count(*) AS n_texts, sum(len(list_filter(string_split(lower(text), ' '), lambda w: w <> '')))::BIGINT AS n_tokens FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE text <> '') GROUP BY 1",
    "index_document_meta": "SELECT doc_id::VARCHAR AS vector_id, coalesce(source, '') AS title, coalesce(lang, '') AS type, 4::INTEGER AS width FROM documents WHERE text <> ''",
    "index_chunk_meta": f"""WITH RECURSIVE {_folded(_slices(1000), 1000, 50, 1, True)},
        rows_ AS (SELECT doc_id, unnest(range(0, len(done))) AS i FROM chunked)
        SELECT doc_id::VARCHAR || '_' || i AS vector_id, doc_id::VARCHAR AS parent_id, i::INTEGER AS chunk_index, coalesce(source, '') AS title FROM rows_ JOIN documents USING (doc_id)""",
}
