"""Embeddings through a pluggable provider, in Arrow batches.

A provider is a picklable callable (texts, model, input_type) -> list of vectors, which runs on the executors. One with
sockets or keys can't be pickled: PerWorker takes a function that makes it, and makes it once in each worker. A batch that
fails gives null for each of its texts and nothing else. HashingProvider works offline.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import embedding_dimension
from .numbering import with_position

Provider = Callable[[list[str], str, str], list]
BATCH = 10
#: Rows whose vectors a task holds before it hands them on; words whose numbers a process remembers, and their length at most.
EMBEDDED_ROWS, KNOWN_WORDS, KNOWN_LENGTH = 256, 1 << 17, 64


class _Numbers(dict):
    """The number of a word, which its digest gives. Short words are remembered: KNOWN_WORDS of them, and those of the memory that
    was full before, so that words which are met again stay."""

    def __init__(self):
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        number = self.older.get(word)
        if number is None:
            number = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = number
        return number


_numbers = _Numbers()


class HashingProvider:
    """Deterministic offline provider: lower-case words between single spaces, hashed into dimensions, of unit length."""

    def __init__(self, dimension: int | None = None):
        self.dimension = dimension

    def __call__(self, texts: list[str], model: str, input_type: str) -> list[np.ndarray]:
        width = self.dimension or embedding_dimension(model)
        out = []
        for text in texts:
            words = [w for w in text.lower().split(" ") if w]
            numbers = np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words))
            counts = np.bincount(numbers % width, minlength=width).astype(np.float64)
            size = np.sqrt((counts * counts).sum())
            out.append(counts / size if size else counts)
        return out

    def count_tokens(self, texts: list[str], model: str) -> int:
        return sum(1 for text in texts for word in text.lower().split(" ") if word)


#: Providers made in this process, by the number of their PerWorker.
_made: dict[str, Provider] = {}


class PerWorker:
    """A provider that factory() makes where it is used: once in each worker process, whatever the tasks and queries that it
    serves. Only the factory is pickled."""

    def __init__(self, factory: Callable[[], Provider]):
        self.factory, self.number = factory, uuid.uuid4().hex

    def provider(self) -> Provider:
        if self.number not in _made:
            _made[self.number] = self.factory()
        return _made[self.number]

    def __call__(self, texts: list[str], model: str, input_type: str) -> list:
        return self.provider()(texts, model, input_type)

    def count_tokens(self, texts: list[str], model: str) -> int:
        return self.provider().count_tokens(texts, model)


def _batched(texts: Iterator[str | None], provider: Provider, model: str, input_type: str, batch_size: int, pause: float) -> Iterator[list]:
    def embed(batch: list[str]) -> list:
        try:
            found = list(provider(batch, model, input_type))
            return found if len(found) == len(batch) else [None] * len(batch)
        except Exception:  # a provider's failure is data here: nulls for the batch
            return [None] * len(batch)

    held: list[str] = []
    first = True
    for text in texts:
        held.append(text)
        if len(held) == batch_size:
            if not first and pause:
                time.sleep(pause)
            yield embed(held)
            held, first = [], False
    if held:
        if not first and pause:
            time.sleep(pause)
        yield embed(held)


def generate_embeddings(texts: list[str], provider: Provider, model: str = "voyage-3-large", input_type: str = "document", batch_size: int = BATCH, pause: float = 0.0) -> list:
    """Vectors of a short list of texts on the driver; null for every text of a failed batch."""
    return [v for batch in _batched(iter(texts), provider, model, input_type, batch_size, pause) for v in batch]


def generate_embedding(text: str, provider: Provider, model: str = "voyage-3-large", input_type: str = "query") -> list[float] | None:
    """The vector of one text, for queries; None for an empty text, without a call."""
    return generate_embeddings([text], provider, model, input_type)[0] if text else None


def _vectors(found: list) -> pa.Array:
    """Vectors, some of them null, in single precision. Those of a provider that makes arrays are copied as they are."""
    if not all(v is None or isinstance(v, np.ndarray) for v in found) or all(v is None for v in found):
        return pa.array(found, pa.list_(pa.float32()))
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in found)], dtype=np.int32)
    values = np.concatenate([np.asarray(v, np.float32) for v in found if v is not None])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float32()), mask=pa.array([v is None for v in found]))


def with_embedding(df: DataFrame, provider: Provider, text_col: str = "text", model: str = "voyage-3-large", input_type: str = "document", batch_size: int = BATCH, pause: float = 0.0, out: str = "embedding") -> DataFrame:
    """df with the vector of each row's text; null where the text is empty or its batch failed. No shuffle: batches are cut
    inside the tasks, and a task holds one Arrow batch of texts and the vectors of EMBEDDED_ROWS of them at a time."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.FloatType()))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            asked = [t for t in texts if t]
            made = chain.from_iterable(_batched(iter(asked), provider, model, input_type, batch_size, pause))
            for at in range(0, len(texts), EMBEDDED_ROWS):
                part = b.slice(at, EMBEDDED_ROWS)
                vectors = _vectors([next(made) if t else None for t in texts[at : at + EMBEDDED_ROWS]])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), vectors], names=[*names, out])

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that have a text."""
    return df.filter(F.col(text_col).isNotNull() & (F.col(text_col) != ""))


def batch_tokens(df: DataFrame, provider: Provider, text_col: str = "text", model: str = "voyage-3-large", batch_size: int = BATCH, id_col: str = "_id") -> DataFrame:
    """(batch, n_texts, n_tokens) of the batches that the documents with text make in the order of their ids; n_tokens is the
    sum of the provider's counts, null if one of them fails."""
    numbered = with_position(with_text(df, text_col), [id_col], "__i").select(F.floor(F.col("__i") / batch_size).cast("long").alias("batch"), text_col)

    def count(text: str) -> int | None:
        try:
            return provider.count_tokens([text], model)
        except Exception:  # as in embedding: a provider's failure is data
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["batch", "n"])

    counted = numbered.mapInArrow(run, "batch long, n long")
    total = F.when(F.count("n") == F.count(F.lit(1)), F.sum("n"))
    return counted.groupBy("batch").agg(F.count(F.lit(1)).alias("n_texts"), total.alias("n_tokens"))


def embed_documents(df: DataFrame, provider: Provider, text_col: str = "text", model: str = "voyage-3-large", batch_size: int = BATCH, id_col: str = "_id", drop_failed: bool = False, pause: float = 0.0) -> DataFrame:
    """Documents with text, and embedding, embedding_model, embedding_id.

    embedding_id numbers the documents with text in the order of their ids: `{id}_{i}`, or `emb_{i}` with drop_failed, which
    also drops documents whose batch failed (numbers then have gaps). Otherwise those stay, with nulls in the three columns.
    """
    numbered = with_position(with_text(df, text_col), [id_col], "__i")
    made = with_embedding(numbered, provider, text_col, model, "document", batch_size, pause)
    number = F.col("__i").cast("string")
    label = F.concat(F.lit("emb_"), number) if drop_failed else F.concat_ws("_", F.coalesce(F.col(id_col).cast("string"), F.lit("")), number)
    ok = F.col("embedding").isNotNull()
    out = made.withColumn("embedding_model", F.when(ok, F.lit(model))).withColumn("embedding_id", F.when(ok, label)).drop("__i")
    return out.filter(ok) if drop_failed else out
