"""Column expressions: text splitting and vector arithmetic."""

from .text import chunks, lines, merge, slices, strip
from .vectors import cosine_similarity, dot, embedding_dimension, norm, vector_literal

__all__ = ["chunks", "cosine_similarity", "dot", "embedding_dimension", "lines", "merge", "norm", "slices", "strip", "vector_literal"]
