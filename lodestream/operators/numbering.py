"""Gapless numbers over a whole table, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

_IN_PARTITION = (1 << 33) - 1


def with_position(df: DataFrame, order: list[str], out: str = "position", partitions: int | None = None) -> DataFrame:
    """df with a column that numbers its rows from 0 in the given order (nulls first).

    Rows are range-partitioned and sorted, and written once; each range starts where the counts of the ranges before it
    end, one count a partition. Equal rows may fall into several ranges, so no value is too common.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*order, "__tie")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")
    placed = materialize(ranged.withColumn("__m", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__m", 33).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(first)
        first += counts.get(p, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), part + 1)
    return placed.withColumn(out, base + F.col("__m").bitwiseAND(F.lit(_IN_PARTITION))).drop("__m")
