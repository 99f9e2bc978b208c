"""Named collections of documents or vectors on files, as immutable versions.

A collection is a folder `root/name` with versions v000001, v000002 ...; the current one is the last that Spark has marked as
complete. Inserts append files to it; updates and deletes read it, write the next version and so never touch the files they
read. A DataFrame that was read lists its files once, so a later append doesn't show in it. Folders are listed through
Hadoop's file systems, so a root may lie wherever Spark can write. One writer a collection.

A vector collection may have an index beside it: its rows sorted by the number of their nearest centroid, and the centroids. A
search that names how many lists to probe reads those lists, and every row that came after the index was built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import documents as D
from ..operators import vectors as V

VECTOR_SCHEMA = "id long, vector_id string, embedding array<float>, metadata struct<title: string, type: string, parent_id: string, chunk_index: int>"
# The collections of an embedding store.
EMBEDDING_COLLECTIONS = ("conversations", "category_embeddings", "cluster_centroids")
#: What the two tables of a collection's index are called, after the collection.
_LISTS, _CENTROIDS = "__lists", "__centroids"
DOCUMENT_SCHEMA = "_id string, text string, title string, type string"


class Collections:
    """Catalogue of the collections below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path_exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _versions(self, name: str) -> list[str]:
        fs, where = self._fs(f"{self.root}/{name}")
        if not fs.exists(where):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory()]
        return sorted(p for p in found if self.path_exists(f"{p}/_SUCCESS"))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no collection {name}")
        return self.spark.read.parquet(versions[-1])

    def write(self, name: str, df: DataFrame) -> None:
        """The next version of a collection; older ones but the last are removed."""
        versions = self._versions(name)
        number = int(versions[-1].rsplit("v", 1)[1]) + 1 if versions else 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{number:06d}")
        for old in versions[:-1]:
            fs, where = self._fs(old)
            fs.delete(where, True)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._versions(name)[-1])

    def create(self, name: str, schema: T.StructType | str, recreate: bool = False) -> bool:
        """Make a collection if it isn't there, or anew. True, as afterwards it exists."""
        if recreate:
            self.drop(name)
        if not self.exists(name):
            self.write(name, self.spark.createDataFrame([], schema))
        return True

    def drop(self, name: str) -> None:
        fs, where = self._fs(f"{self.root}/{name}")
        fs.delete(where, True)

    def stats(self, name: str) -> dict[str, Any]:
        if not self.exists(name):
            return {"exists": False}
        df = self.read(name)
        return {"exists": True, "name": name, "entities": df.count(), "schema": df.schema.simpleString()}


class DocumentStore(Collections):
    """Documents by string `_id`."""

    def insert(self, name: str, docs: DataFrame) -> DataFrame:
        """Append documents with new ids; of several with one id one is taken, as documents.one_of_each says. Ids that are there
        already are refused. Returns the inserted documents, as a written table."""
        docs = docs.withColumn("_id", F.coalesce(F.col("_id").cast("string"), F.expr("uuid()")) if "_id" in docs.columns else F.expr("uuid()"))
        from .scratch import materialize

        there = self.exists(name)
        fresh = materialize(D.new_documents(self.read(name), docs) if there else D.one_of_each(docs, "_id"), "insert")
        if there:
            self.append(name, fresh)
        else:
            self.write(name, fresh)
        return fresh

    def get(self, name: str, key: str) -> DataFrame:
        return D.get_document(self.read(name), str(key))

    def find(self, name: str, query: Mapping[str, Any] | None = None, **options) -> DataFrame:
        return D.query_documents(self.read(name), query, **options)

    def count(self, name: str, query: Mapping[str, Any] | None = None) -> int:
        return D.count_documents(self.read(name), query).first()["n"]

    def _swap(self, name: str, marked: DataFrame) -> int:
        from .scratch import materialize

        done = materialize(marked, "update")
        n = done.filter("__changed").count()
        if n:
            self.write(name, done.drop("__changed"))
        return n

    def update(self, name: str, key: str, updates: Mapping[str, Any]) -> bool:
        """Whether the document with the id changed."""
        return self._swap(name, D.update_document(self.read(name), str(key), updates, changed="__changed")) > 0

    def update_first(self, name: str, query: Mapping[str, Any] | None, updates: Mapping[str, Any]) -> int:
        return self._swap(name, D.update_first(self.read(name), query, updates, changed="__changed"))

    def update_many(self, name: str, query: Mapping[str, Any] | None, updates: Mapping[str, Any]) -> int:
        """How many matching documents changed."""
        return self._swap(name, D.update_documents(self.read(name), query, updates, changed="__changed"))

    def _delete(self, name: str, kept: DataFrame) -> int:
        from .scratch import materialize

        done = materialize(kept, "delete")  # one pass over the collection; both counts come from files' footers
        gone = self.read(name).count() - done.count()
        if gone:
            self.write(name, done)
        return gone

    def delete(self, name: str, key: str) -> bool:
        return self._delete(name, D.delete_document(self.read(name), str(key))) > 0

    def delete_first(self, name: str, query: Mapping[str, Any] | None) -> int:
        return self._delete(name, D.delete_first(self.read(name), query))

    def delete_many(self, name: str, query: Mapping[str, Any] | None) -> int:
        return self._delete(name, D.delete_documents(self.read(name), query))


class VectorStore(Collections):
    """Vectors of one width a collection; keys may repeat, the latest row counts in reads of all vectors."""

    def create_vectors(self, name: str, dimension: int, recreate: bool = False) -> bool:
        """The width is kept with the column, in the files' schema."""
        schema = T._parse_datatype_string(VECTOR_SCHEMA)
        schema["embedding"].metadata["dimension"] = dimension
        return self.create(name, schema, recreate)

    def dimension(self, name: str) -> int | None:
        return self.read(name).schema["embedding"].metadata.get("dimension")

    def insert(self, name: str, vectors: DataFrame) -> None:
        """Append (vector_id, embedding, metadata); ids follow the largest one there. Fails on other widths or long keys."""
        width = self.dimension(name)
        if width:
            vectors = V.check_vectors(vectors, width)
        empty = F.lit(None).cast("struct<title: string, type: string, parent_id: string, chunk_index: int>")
        metadata = F.col("metadata") if "metadata" in vectors.columns else empty
        first = self.read(name).agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).first()["m"] + 1
        embedding = F.col("embedding").cast("array<float>").alias("embedding", metadata={"dimension": width} if width else {})
        self.append(name, vectors.select((F.monotonically_increasing_id() + F.lit(first)).alias("id"), "vector_id", embedding, metadata.alias("metadata")))

    def setup_embeddings(self, dimension: int, recreate: bool = False) -> list[str]:
        """Create the collections of an embedding store; their names."""
        for name in EMBEDDING_COLLECTIONS:
            self.create_vectors(name, dimension, recreate)
        return list(EMBEDDING_COLLECTIONS)

    def build_index(self, name: str, n_lists: int = 1024, **fit) -> None:
        """Build or rebuild the inverted file of a collection, over all its rows."""
        df = self.read(name)
        centroids = V.fit_lists(df, n_lists, **fit)
        listed = V.assign_lists(df, centroids).repartitionByRange("list_id", F.xxhash64("id")).sortWithinPartitions("list_id")
        last = df.agg(F.max("id")).first()[0]
        self.write(f"{name}{_LISTS}", listed)
        rows = [(i, [float(x) for x in c], last) for i, c in enumerate(centroids)]
        self.write(f"{name}{_CENTROIDS}", self.spark.createDataFrame(rows, "list_id int, centroid array<double>, last_id long"))

    def has_index(self, name: str) -> bool:
        return self.exists(f"{name}{_CENTROIDS}")

    def drop_index(self, name: str) -> None:
        self.drop(f"{name}{_LISTS}")
        self.drop(f"{name}{_CENTROIDS}")

    def _index(self, name: str) -> tuple[DataFrame, list, int]:
        """Indexed rows, centroids (as many as lists), and the last id they cover."""
        rows = sorted(self.read(f"{name}{_CENTROIDS}").collect(), key=lambda r: r["list_id"])
        return self.read(f"{name}{_LISTS}"), [r["centroid"] for r in rows], rows[0]["last_id"] if rows else -1

    def drop(self, name: str) -> None:
        super().drop(name)
        if not name.endswith((_LISTS, _CENTROIDS)):
            self.drop_index(name)

    def get(self, name: str, key: str) -> DataFrame:
        return V.get_vector(self.read(name), key)

    def get_many(self, name: str, keys: Sequence[str]) -> DataFrame:
        return V.get_vectors(self.read(name), keys)

    def all(self, name: str) -> DataFrame:
        return V.all_vectors(self.read(name))

    def search(self, name: str, query: Sequence[float], top_k: int = 10, n_probe: int | None = None) -> DataFrame:
        """The top_k rows nearest to a query: exact, or with n_probe and an index among the lists of the n_probe nearest centroids
        and the rows that are newer than the index."""
        if n_probe is None or not self.has_index(name):
            return V.search_vectors(self.read(name), query, top_k)
        listed, centroids, last = self._index(name)
        near = V.nearest_lists(centroids, query, n_probe)
        fresh = self.read(name).filter(F.col("id") > last)
        probed = listed.filter(F.col("list_id").isin(near)).drop("list_id").unionByName(fresh)
        return V.search_vectors(probed, query, top_k)

    def search_many(self, name: str, query_ids: Sequence, queries: Sequence[Sequence[float]], top_k: int = 5) -> DataFrame:
        return V.search_nested(self.read(name), query_ids, queries, top_k)

    def delete(self, name: str, values: Sequence, column: str = "vector_id") -> bool:
        """Whether rows with one of the values were there; they are gone."""
        from .scratch import materialize

        kept = materialize(V.delete_vectors(self.read(name), values, column), "delete")
        gone = self.read(name).count() - kept.count()
        if gone:
            self.write(name, kept)
            if self.has_index(name):
                self.write(f"{name}{_LISTS}", V.delete_vectors(self.read(f"{name}{_LISTS}"), values, column))
        return gone > 0
