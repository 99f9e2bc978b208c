"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width of each embedding model's vectors, and of any other model's.
MODEL_DIMENSIONS = {"voyage-3-large": 4096, "voyage-3-mini": 1024, "voyage-2": 1024, "voyage-large-2": 1536, "voyage-code-2": 1536}
OTHER_DIMENSION = 4096


def embedding_dimension(model: str = "voyage-3-large") -> int:
    """Width of a model's vectors."""
    return MODEL_DIMENSIONS.get(model, OTHER_DIMENSION)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine of two vectors; 0 where one is null, empty or zero. Vectors of unequal length raise an error."""
    size = norm(a) * (norm(b) if b_norm is None else b_norm)
    unequal = F.raise_error(F.lit("vectors of unequal length")).cast("double")
    value = F.when(F.size(a) != F.size(b), unequal).when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value)
