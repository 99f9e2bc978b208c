"""The read path: top-k chunks joined to their texts and their parent documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import search_vectors
from ..sources.scratch import materialize


#: Hits that are broadcast at most; an id and a score each.
BROADCAST_HITS = 100_000


def search_chunks(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, query: Sequence[float], top_k: int = 10) -> DataFrame:
    """score, chunk, document (structs; document may be null), best first. Hits whose chunk is gone are skipped.

    Hits and the chunks found are at most top_k rows each. They are written, so that the vectors are scanned once, and, up to
    BROADCAST_HITS of them, broadcast to the scans of chunks and documents: no table is shuffled."""
    small = F.broadcast if top_k <= BROADCAST_HITS else (lambda df: df)
    hits = search_vectors(vectors.select("vector_id", "embedding"), query, top_k).select(F.col("vector_id").alias("__hit"), "score")
    hits = small(materialize(hits, "hits"))
    found = materialize(chunks.join(hits, chunks["_id"] == F.col("__hit")).select("score", "__hit", F.struct(*[chunks[c] for c in chunks.columns]).alias("chunk")), "found")
    wanted = small(found.select(F.col("chunk.parent_id").alias("__p")).distinct())
    parents = documents.join(wanted, documents["_id"] == F.col("__p"), "left_semi")
    named = parents.select(F.col("_id").alias("__doc"), F.struct(*documents.columns).alias("document"))
    joined = found.join(named, F.col("chunk.parent_id") == F.col("__doc"), "left")
    return joined.orderBy(F.desc("score"), "__hit").select("score", "chunk", "document")
