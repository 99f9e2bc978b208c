"""The write path: documents are stored, embedded, chunked, and their chunks stored and embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import embedding_dimension
from ..operators.chunking import chunk_documents
from ..operators.embedding import Provider, with_embedding
from ..sources.json_documents import read_json_documents
from ..sources.scratch import materialize
from ..sources.store import DOCUMENT_SCHEMA, DocumentStore, VectorStore

_METADATA = "struct<title: string, type: string, parent_id: string, chunk_index: int>"


def document_vectors(docs: DataFrame) -> DataFrame:
    """vector_id, embedding, metadata {title, type} of embedded documents; those without a vector are left out."""
    title, kind = F.coalesce("title", F.lit("")), F.coalesce("type", F.lit(""))
    metadata = F.struct(title.alias("title"), kind.alias("type"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("chunk_index"))
    return docs.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("_id").alias("vector_id"), "embedding", metadata.cast(_METADATA).alias("metadata"))


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """vector_id, embedding, metadata {parent_id, chunk_index, title} of embedded chunks. A document without text that is its
    own chunk has no vector."""
    parent = F.coalesce("parent_id", "_id")
    metadata = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.lit(None).cast("string").alias("type"), parent.alias("parent_id"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))
    return chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("_id").alias("vector_id"), "embedding", metadata.cast(_METADATA).alias("metadata"))


class Indexer:
    """The stores of an index below a root folder, and its provider of embeddings."""

    def __init__(self, spark: SparkSession, root: str, provider: Provider, model: str = "voyage-3-large", dimension: int | None = None):
        self.spark, self.provider, self.model = spark, provider, model
        self.dimension = dimension or embedding_dimension(model)
        self.documents, self.vectors = DocumentStore(spark, f"{root}/documents"), VectorStore(spark, f"{root}/vectors")

    def setup(self, recreate: bool = False) -> bool:
        """Create the collections, wide enough for the model; recreate empties documents and vectors alike."""
        for name in ("documents", "chunks"):
            self.documents.create(name, DOCUMENT_SCHEMA + (", chunk_index int, chunk_count int, parent_id string" if name == "chunks" else ""), recreate)
        for name in ("documents", "chunks", "categories"):
            self.vectors.create_vectors(name, self.dimension, recreate)
        return True

    def index(self, docs: DataFrame, chunk_size: int = 1000) -> DataFrame:
        """Index documents (_id, text, title, type) and return the ids that are new. One pass each for documents and chunks,
        whose vectors are written once, where they stay; every written table is made from another written one, so a lost executor
        repeats one step."""
        texts = docs.select("_id", "text", "title", "type")
        new = self.documents.insert("documents", texts)  # what was stored, and nothing else, is embedded and chunked
        self.vectors.insert("documents", document_vectors(with_embedding(new, self.provider, "text", self.model)))
        chunks = materialize(chunk_documents(new, "text", max_size=chunk_size), "chunks")
        self.documents.insert("chunks", chunks)
        self.vectors.insert("chunks", chunk_vectors(with_embedding(chunks, self.provider, "text", self.model)))
        return new.select("_id")

    def index_file(self, path: str, text_field: str = "content", chunk_size: int = 1000, id_field: str | None = None) -> DataFrame:
        """Index the documents of JSON files."""
        return self.index(materialize(read_json_documents(self.spark, path, text_field, id_field), "json"), chunk_size)

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        """score, chunk, document of the best chunks for a text, best first."""
        from ..operators.embedding import generate_embedding
        from .search import search_chunks

        vector = generate_embedding(query, self.provider, self.model)
        chunks, docs = self.documents.read("chunks"), self.documents.read("documents")
        if vector is None:
            return search_chunks(self.vectors.read("chunks").limit(0), chunks, docs, [0.0] * self.dimension, top_k)
        return search_chunks(self.vectors.read("chunks"), chunks, docs, vector, top_k)
