"""Documents to chunks: a flat map over rows, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks


def chunk_documents(df: DataFrame, text_col: str = "text", max_size: int = 1000, min_size: int = 50, overlap: int = 1, mode: str = "line", id_col: str = "_id") -> DataFrame:
    """One row a chunk: the document's columns with the chunk as text and `{id}_{i}` as id, and chunk_index, chunk_count,
    parent_id. A document without text is returned as it is, with nulls there; one whose text yields no chunk disappears.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    pieces = df.withColumn("__chunks", chunks(F.col(text_col), max_size, min_size, overlap, mode))
    textless = F.coalesce(F.char_length(text_col), F.lit(0)) == 0
    rows = F.when(textless, F.array(F.lit(None).cast("string"))).otherwise(F.col("__chunks"))
    each = pieces.select(*[F.col(f"`{c}`") for c in df.columns], F.size("__chunks").alias("__n"), F.posexplode(rows).alias("__i", "__chunk"))
    made = F.col("__chunk").isNotNull()
    return each.withColumns({
        "chunk_index": F.when(made, F.col("__i")),
        "chunk_count": F.when(made, F.col("__n")),
        "parent_id": F.when(made, key),
        id_col: F.when(made, F.concat_ws("_", key, F.col("__i").cast("string"))).otherwise(F.col(id_col).cast("string")),
        text_col: F.when(made, F.col("__chunk")).otherwise(F.col(text_col)),
    }).drop("__i", "__n", "__chunk")
