"""Vector collections: exact and approximate cosine top-k, lookups, deletes, the latest row of each key.

A collection has id (LONG), vector_id (STRING), embedding (ARRAY<FLOAT>), metadata. Top-k never shuffles the collection
row by row: one query is a product in the tasks, which keep what can be among the best, under TakeOrderedAndProject; a list of queries is a matrix in the tasks; a table
of queries meets the vectors in blocks. At most k rows a query and task travel, ties included: they go by key inside the tasks
as they do in the end. What a task or the driver holds is bounded in bytes, whatever the width of the vectors.

Vectors of unequal width raise an error, wherever they meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.scratch import materialize

#: Queries scored together, and vectors of an Arrow batch scored together, with them or with one query.
QUERY_BLOCK, VECTOR_BLOCK, SCORED_BLOCK = 1024, 4096, 1024
#: Bytes of a block of vectors or queries, of the blocks of queries a task holds before it hands their best rows on, of packed
#: queries that are broadcast, and of the vectors that an index is fitted on.
BLOCK_BYTES, HELD_BYTES, BROADCAST_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 20, 64 << 20, 256 << 20
#: Scores of a block of queries that a task makes at a time.
SCORES = 1 << 19


def _scored(df: DataFrame, query: Sequence[float], top_k: int, vector: str) -> DataFrame:
    """df with its score, without rows that can't be among the top_k: of each part of an Arrow batch those as good as its top_k-th.

    A row's score depends on its numbers alone, not on the rows beside it, so that equal vectors tie."""
    wanted = np.array([float(v) for v in query], np.float64)
    length = float(np.sqrt((wanted * wanted).sum()))
    schema = T.StructType([f for f in df.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            for start, n in _parts(b.column(vector), SCORED_BLOCK):
                part = b.slice(start, n)
                column = part.column(vector)
                at, matrix = _matrix(column)
                scores, unknown = np.zeros(n), np.zeros(n, bool)
                if len(at) and len(wanted):
                    if matrix.shape[1] != len(wanted):
                        raise ValueError("vectors of unequal length")
                    size = np.sqrt((matrix * matrix).sum(1)) * length
                    scores[at] = np.divide((matrix * wanted).sum(1), size, out=np.zeros(len(at)), where=size != 0)
                    numbers = column.flatten()
                    if numbers.null_count:  # a vector that lacks a number has no score
                        unknown[at] = pc.is_null(numbers).to_numpy(zero_copy_only=False).reshape(len(at), -1).any(1)
                rank = np.where(unknown, -np.inf, np.where(np.isnan(scores), np.inf, scores))
                kept = np.flatnonzero(rank >= np.partition(rank, n - top_k)[n - top_k]) if 0 < top_k < n else np.arange(n if top_k else 0)
                best = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(best.column(c) for c in names), pa.array(scores[kept], pa.float64(), mask=unknown[kept])], names=schema.names)

    return df.mapInArrow(run, schema)


def search_vectors(df: DataFrame, query: Sequence[float], top_k: int = 10, key: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """The top_k rows nearest to one query vector, with their score, best first; ties by key."""
    return _scored(df, query, top_k, vector).orderBy(F.desc("score"), key).limit(top_k)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors that are neither null nor empty, and their matrix in double precision."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    valid = np.flatnonzero(sizes)
    if not len(valid):
        return valid, np.empty((0, 0))
    width = sizes[valid[0]]
    if (sizes[valid] != width).any():
        raise ValueError("vectors of unequal length")
    lists = column.take(pa.array(valid, pa.int64())) if len(valid) < len(column) else column
    return valid, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(valid), width)


def _parts(column: pa.Array, rows: int) -> list[tuple[int, int]]:
    """(start, length) of parts of a column of vectors with at most so many rows and BLOCK_BYTES of numbers in double precision."""
    widest = pc.max(pc.list_value_length(column)).as_py() or 1
    rows = max(1, min(rows, BLOCK_BYTES // (8 * widest)))
    return [(at, min(rows, len(column) - at)) for at in range(0, len(column), rows)]


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class _Best:
    """The best top_k rows so far of a block of queries, ties by key (nulls first)."""

    def __init__(self, ids: list, block: np.ndarray, top_k: int):
        self.ids, self.block, self.top_k = ids, block, top_k
        self.scores = np.full((len(ids), 0), -2.0)
        self.keys: np.ndarray = np.empty((len(ids), 0), object)

    def add(self, keys: list, matrix: np.ndarray) -> None:
        """Some rows at a time, so that their scores with all queries of the block are at most SCORES, or top_k a query."""
        if not len(keys):
            return
        if matrix.shape[1] != self.block.shape[1]:
            raise ValueError("vectors and queries of unequal length")
        rows = max(1, self.top_k, SCORES // max(1, len(self.ids)))
        for at in range(0, len(keys), rows):
            self._add(keys[at : at + rows], matrix[at : at + rows])

    def _rescored(self, unit: np.ndarray) -> np.ndarray:
        """Scores with all queries. A matrix product rounds equal vectors differently by their places, so that they wouldn't tie:
        what can be among the best is multiplied once more, pair by pair; the rest is worse than anything."""
        rough, k = self.block @ unit.T, self.top_k
        known = ~np.isnan(rough)
        every = np.concatenate([self.scores, rough if known.all() else np.where(known, rough, -3.0)], 1)
        least = np.partition(every, every.shape[1] - k, axis=1)[:, [every.shape[1] - k]] if 0 < k < every.shape[1] else -4.0
        near = rough >= least - 1e-9
        rough[known & ~near] = -3.0
        queries, rows = np.nonzero(near)
        step = max(1, (BLOCK_BYTES >> 2) // (8 * unit.shape[1]))
        for at in range(0, len(rows), step):
            q, r = queries[at : at + step], rows[at : at + step]
            rough[q, r] = (self.block[q] * unit[r]).sum(1)
        return rough

    def _add(self, keys: list, matrix: np.ndarray) -> None:
        scores = np.concatenate([self.scores, self._rescored(_unit(matrix))], 1)
        every = np.concatenate([self.keys, np.broadcast_to(np.array(keys, object), (len(self.ids), len(keys)))], 1)
        k = self.top_k
        if scores.shape[1] > k:
            order = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            cut = np.take_along_axis(scores, order, 1).min(1, keepdims=True)
            for row in np.flatnonzero((scores >= cut).sum(1) > k).tolist():  # several rows tie for the last place
                tied = np.flatnonzero(scores[row] == cut[row])
                above = np.flatnonzero(scores[row] > cut[row])
                of = every[row]
                order[row] = [*above.tolist(), *heapq.nsmallest(k - len(above), tied.tolist(), key=lambda i: (of[i] is not None, of[i]))]  # noqa: B023
            scores, every = np.take_along_axis(scores, order, 1), np.take_along_axis(every, order, 1)
        self.scores, self.keys = scores, every

    def rows(self, id_type: pa.DataType, key_type: pa.DataType, key: str) -> pa.RecordBatch:
        n = self.scores.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(self.ids, object), n).tolist(), id_type), pa.array(self.keys.ravel().tolist(), key_type), pa.array(self.scores.ravel())], names=["query_id", key, "score"])


def _ranked(found: DataFrame, key: str, top_k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def search_batch(df: DataFrame, query_ids: Sequence, queries: Sequence[Sequence[float]], top_k: int = 10, key: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank from 1) of the top_k rows for each of a list of queries; ties by key.

    For the queries of a call, which the driver holds. A block of them is a matrix of bounded size and one scan of (key,
    vector), which finds top_k rows a query inside every task before anything is exchanged."""
    if not len(query_ids):
        kinds = {"query_id": "string", key: df.schema[key].dataType.simpleString(), "score": "double", "rank": "int"}
        return df.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items()))
    if len({len(q) for q in queries}) > 1:
        raise ValueError("query vectors of unequal length")
    id_type = T.StringType() if isinstance(query_ids[0], str) else T.LongType()
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField(key, df.schema[key].dataType), T.StructField("score", T.DoubleType())])
    found = None
    size = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * max(1, len(queries[0])))))
    for at in range(0, len(query_ids), size):
        ids = list(query_ids[at : at + size])
        block = _unit(np.array(queries[at : at + size], np.float64))

        def score(batches, ids=ids, block=block):
            best, kind = _Best(ids, block, top_k), None
            for b in batches:
                kind = b.column(0).type
                for start, n in _parts(b.column(1), VECTOR_BLOCK):
                    part = b.slice(start, n)
                    rows, matrix = _matrix(part.column(1))
                    best.add(part.column(0).take(pa.array(rows, pa.int64())).to_pylist(), matrix)
            if kind is not None:
                yield best.rows(pa.string() if isinstance(ids[0], str) else pa.int64(), kind, key)

        part = df.select(key, vector).mapInArrow(score, schema)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, key, top_k)


def _blocks(df: DataFrame, key: str, vector: str, rows: int, prefix: str) -> DataFrame:
    """Rows of df packed into blocks: keys, their matrix as bytes in double precision, its width."""
    schema = T.StructType([T.StructField(f"{prefix}_keys", T.ArrayType(df.schema[key].dataType)), T.StructField(f"{prefix}_data", T.BinaryType()), T.StructField(f"{prefix}_width", T.IntegerType())])

    def run(batches):
        for b in batches:
            for start, n in _parts(b.column(1), rows):
                part = b.slice(start, n)
                at, matrix = _matrix(part.column(1))
                if len(at):
                    keys = part.column(0).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([_unit(matrix).tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], names=schema.names)

    return df.select(key, vector).mapInArrow(run, schema)


def search_table(df: DataFrame, queries: DataFrame, top_k: int = 10, query_key: str = "query_id", key: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """The same for a table of queries of any size, none of which reaches the driver: blocks of queries meet blocks of vectors,
    and each task keeps the best top_k rows of the queries it has met. query_key: the queries' id column.

    The packed queries are written once. They are broadcast if that table's bytes are few, which is looked up; otherwise every
    part of the vectors reads them block by block."""
    # a row of the join has two blocks: an Arrow batch, which Python holds whole, has 16 MB of them, or one row
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    packed = materialize(_blocks(queries, query_key, vector, QUERY_BLOCK, "q"), "queries")
    held = packed.agg(F.sum(F.octet_length("q_data"))).first()[0] or 0
    pairs = _blocks(df, key, vector, VECTOR_BLOCK, "v").join(F.broadcast(packed) if held <= BROADCAST_BYTES else packed, how="cross")
    schema = T.StructType([T.StructField("query_id", queries.schema[query_key].dataType), T.StructField(key, df.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def score(batches):
        best: dict = {}
        kinds, held = None, 0
        for b in batches:
            kinds = b.column("q_keys").type.value_type, b.column("v_keys").type.value_type
            for i in range(b.num_rows):
                ids, keys = b.column("q_keys")[i].as_py(), b.column("v_keys")[i].as_py()
                matrix = lambda name, n: np.frombuffer(b.column(f"{name}_data")[i].as_buffer(), np.float64).reshape(n, -1)  # noqa: B023, E731
                if ids[0] not in best:
                    block = matrix("q", len(ids)).copy()
                    size = block.nbytes + 100 * top_k * len(ids)
                    if best and held + size > HELD_BYTES:
                        yield from (x.rows(*kinds, key) for x in best.values())
                        best.clear()
                        held = 0
                    best[ids[0]] = _Best(ids, block, top_k)
                    held += size
                best[ids[0]].add(keys, matrix("v", len(keys)))
        yield from (x.rows(*kinds, key) for x in best.values())

    return _ranked(pairs.mapInArrow(score, schema), key, top_k)


def search_nested(df: DataFrame, query_ids: Sequence, queries: Sequence[Sequence[float]], top_k: int = 5, **columns) -> DataFrame:
    """One row a query: query_id and hits, an array of at most top_k (score, key), best first."""
    key = columns.get("key", "vector_id")
    found = search_batch(df, query_ids, queries, top_k, **columns)
    return found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", key))).alias("hits"))


def get_vector(df: DataFrame, key_value, key: str = "vector_id") -> DataFrame:
    """One row with the key, or none."""
    return df.filter(F.col(key) == F.lit(key_value)).limit(1)


def get_vectors(df: DataFrame, keys: Sequence, key: str = "vector_id", surrogate: str = "id") -> DataFrame:
    """The latest row of each of a list of keys; absent keys give none. Long lists are joined, not listed."""
    if len(keys) <= 1000:
        return latest(df.filter(F.col(key).isin(list(keys))), key, surrogate)
    wanted = df.sparkSession.createDataFrame([(k,) for k in set(keys)], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    return latest(df.join(wanted, key, "left_semi"), key, surrogate)


def latest_with_ids(df: DataFrame, key: str = "vector_id", surrogate: str = "id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """A full scan page by page gives every row: the latest row of each key, and the surrogate ids of all rows that have a
    key and a vector, in order."""
    usable = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(vector).isNotNull() & (F.size(vector) > 0))
    return latest(usable, key, surrogate), usable.select(surrogate)


def latest(df: DataFrame, key: str = "vector_id", surrogate: str = "id") -> DataFrame:
    """The row with the largest surrogate id of each key. A maximum, so that copies of one key are combined in the tasks
    that hold them."""
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(surrogate)).alias("__row")
    return df.groupBy(F.col(key).alias("__key")).agg(row).select("__row.*")


def all_vectors(df: DataFrame, key: str = "vector_id", surrogate: str = "id", vector: str = "embedding") -> DataFrame:
    """The latest row of each key, without rows that lack a key or a vector."""
    return latest_with_ids(df, key, surrogate, vector)[0]


def delete_vectors(df: DataFrame, values: Sequence, column: str = "vector_id") -> DataFrame:
    """The collection without all rows with one of the values; by vector_id or by surrogate id."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def check_vectors(df: DataFrame, dimension: int, key: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """df, failing on a vector of another width or a key over 100 characters when it is computed."""
    wide = F.size(vector) == dimension
    short = F.char_length(F.col(key).cast("string")) <= 100
    checked = F.when(F.coalesce(wide & short, F.lit(False)), F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors need {dimension} numbers and keys at most 100 characters")).cast(df.schema[vector].dataType))
    return df.withColumn(vector, checked)


def collection_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: entities and the smallest and largest vector width."""
    return df.agg(F.count(F.lit(1)).alias("entities"), F.min(F.size(vector)).alias("min_dimension"), F.max(F.size(vector)).alias("max_dimension"))


def fit_lists(df: DataFrame, n_lists: int = 1024, sample_rows: int = 16_384, rounds: int = 12, vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centroids of an inverted-file index by spherical k-means on at most sample_rows vectors and SAMPLE_BYTES, chosen by a
    hash. They come to the driver as one Arrow table."""
    some = df.select(vector).filter(F.size(vector) > 0)
    widest = some.agg(F.max(F.size(vector))).first()[0] or 1
    rows = some.orderBy(F.xxhash64(vector, F.lit(seed))).limit(min(sample_rows, SAMPLE_BYTES // (8 * widest))).toArrow()
    if not rows.num_rows:
        return np.empty((0, 0))
    points = _unit(_matrix(rows.column(0).combine_chunks())[1])
    random = np.random.RandomState(seed)
    centroids = points[random.choice(len(points), min(n_lists, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(points[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        filled = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = np.where(filled[:, None], _unit(sums), centroids)
    return centroids


def assign_lists(df: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every row of df with list_id, the number of its nearest centroid. Write it partitioned by list_id, and a search reads
    only the lists it probes."""
    schema = T.StructType([*df.schema.fields, T.StructField("list_id", T.IntegerType())])

    def run(batches):
        for b in batches:
            lists = np.full(b.num_rows, -1, np.int32)
            for start, n in _parts(b.column(vector), VECTOR_BLOCK):
                rows, matrix = _matrix(b.column(vector).slice(start, n))
                if len(rows) and len(centroids):
                    lists[start + rows] = (_unit(matrix) @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists)], names=[*b.schema.names, "list_id"])

    return df.mapInArrow(run, schema)


def nearest_lists(centroids, query: Sequence[float], n_probe: int) -> list[int]:
    """Numbers of the n_probe centroids nearest to a query."""
    if not len(centroids):
        return []
    return np.argsort(-(np.array(centroids, np.float64) @ np.array(query, np.float64)), kind="stable")[:n_probe].tolist()


def search_lists(indexed: DataFrame, centroids: np.ndarray, query: Sequence[float], top_k: int = 10, n_probe: int = 16, **columns) -> DataFrame:
    """The top_k rows nearest to a query among the lists of its n_probe nearest centroids."""
    return search_vectors(indexed.filter(F.col("list_id").isin(nearest_lists(centroids, query, n_probe))), query, top_k, **columns)


def _list_blocks(df: DataFrame, key: str, vector: str, rows: int, prefix: str) -> DataFrame:
    """As _blocks, of rows of one list_id each: neighbouring rows of a list share blocks, so sort df by list_id first."""
    schema = T.StructType([T.StructField("list_id", T.IntegerType()), T.StructField(f"{prefix}_keys", T.ArrayType(df.schema[key].dataType)), T.StructField(f"{prefix}_data", T.BinaryType())])

    def run(batches):
        for b in batches:
            lists = b.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(lists)) + 1
            for first, last in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                for start, n in _parts(b.column(1).slice(first, last - first), rows):
                    part = b.slice(first + start, n)
                    at, matrix = _matrix(part.column(1))
                    if len(at):
                        keys = part.column(0).take(pa.array(at, pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([lists[first]], pa.int32()), pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([_unit(matrix).tobytes()], pa.binary())], names=schema.names)

    return df.select(key, vector, "list_id").mapInArrow(run, schema)


def probed_lists(queries: DataFrame, centroids: np.ndarray, n_probe: int, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """A row (query_key, vector, list_id) for each query and each of the lists of its n_probe nearest centroids."""
    schema = T.StructType([queries.schema[query_key], queries.schema[vector], T.StructField("list_id", T.IntegerType())])

    def run(batches):
        for b in batches:
            for start, n in _parts(b.column(1), QUERY_BLOCK):
                part = b.slice(start, n)
                rows, matrix = _matrix(part.column(1))
                if len(rows) and len(centroids):
                    near = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :n_probe].astype(np.int32)
                    for column in near.T:
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows, pa.int64())).columns, pa.array(column)], names=schema.names)

    return queries.select(query_key, vector).mapInArrow(run, schema)


def search_lists_table(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, top_k: int = 10, n_probe: int = 16, query_key: str = "query_id", key: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank from 1) of the top_k rows among the probed lists for each query of a table of any size, none
    of which reaches the driver: blocks of a list's queries meet blocks of its vectors. Ties by key."""
    wanted = probed_lists(queries, centroids, n_probe, query_key, vector).repartition("list_id").sortWithinPartitions("list_id")
    pairs = _list_blocks(indexed, key, vector, VECTOR_BLOCK, "v").join(_list_blocks(wanted, query_key, vector, QUERY_BLOCK, "q"), "list_id")
    schema = T.StructType([T.StructField("query_id", queries.schema[query_key].dataType), T.StructField(key, indexed.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def score(batches):
        for b in batches:
            kinds = b.column("q_keys").type.value_type, b.column("v_keys").type.value_type
            for i in range(b.num_rows):
                ids, keys = b.column("q_keys")[i].as_py(), b.column("v_keys")[i].as_py()
                matrix = lambda name, n: np.frombuffer(b.column(f"{name}_data")[i].as_buffer(), np.float64).reshape(n, -1)  # noqa: B023, E731
                best = _Best(ids, matrix("q", len(ids)), top_k)
                best.add(keys, matrix("v", len(keys)))
                yield best.rows(*kinds, key)

    return _ranked(pairs.mapInArrow(score, schema), key, top_k)


def probes_for(indexed: DataFrame, centroids: np.ndarray, query_ids: Sequence, queries: Sequence[Sequence[float]], top_k: int = 10, recall: float = 0.9, key: str = "vector_id", vector: str = "embedding") -> int:
    """The fewest lists to probe so that a sample of queries finds `recall` of its exact top_k; at most QUERY_BLOCK queries.

    Neighbours come from an exact search; a neighbour is found once its list is probed, so the lists' ranks decide."""
    query_ids, queries = list(query_ids)[:QUERY_BLOCK], list(queries)[:QUERY_BLOCK]
    exact = search_batch(indexed, query_ids, queries, top_k, key, vector).select("query_id", key)
    lists = indexed.select(key, "list_id").join(F.broadcast(exact), key).select("query_id", "list_id").collect()  # top_k a query
    rank = {q: np.argsort(np.argsort(-(centroids @ np.array(v, np.float64)), kind="stable")) for q, v in zip(query_ids, queries, strict=True)}
    needed = np.sort([int(rank[r["query_id"]][r["list_id"]]) + 1 for r in lists])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1
