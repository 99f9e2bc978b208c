"""Shared plumbing of the training-data operators: scratch tables, Arrow helpers, text normalisation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_root

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: bytes.translate table that lower-cases A-Z only; every other byte of UTF-8 stays.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


#: Lists of the paths given out inside scratch_made.
_recording: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recording:
        made.append(path)
    return path


@contextmanager
def scratch_made():
    """The paths of tables written inside, for a caller that knows when nothing reads them any more."""
    _recording.append(made := [])
    try:
        yield made
    finally:
        _recording[:] = [x for x in _recording if x is not made]


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs at most the step that ran on it."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def bucketed(df: DataFrame, name: str, column: str, **options: str) -> DataFrame:
    """Write df to the shared folder bucketed by a column and read it back: groups and joins by that column move none of it. The
    catalogue forgets the table at once; its files stay with the other scratch tables."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    df.write.bucketBy(shuffle_partitions(spark), column).options(path=path, **options).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing reads any more: all that came of them is written. Others are left alone."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            delete_paths(table.sparkSession, [path])


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of few rows and bytes: Python workers then hold megabytes even where every text is very long. Results are
    lazy and read the setting when they run, so it stays with the session; every operator that runs Python sets it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: What operators remember in a Python worker, by name: how to forget it.
_memories: dict[str, Callable[[], None]] = {}


def forget_others(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called by an operator where its work in a Python worker begins, with a function of its module (which is pickled by
    reference, so that it finds the worker's own memory): workers outlive stages, and what other operators
    remembered in one is forgotten, so that a worker holds one operator's memory at a time."""
    for other, clear in list(_memories.items()):
        if other != name:
            clear()
            del _memories[other]
    if forget:
        _memories[name] = forget


def rows_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, max_bytes: int, column: str):
    """Cut incoming record batches so that a slice holds at most max_bytes of the column, or a single row."""
    for batch in batches:
        at, held, start = batch.column(column), 0, 0
        sizes = pa.compute.binary_length(at).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held + n > max_bytes and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_names(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """df with its columns named c0, c1 ..., and the new name of an old one: no column then clashes with an operator's own."""
    names = list(df.columns)
    return df.toDF(*[f"c{i}" for i in range(len(names))]), lambda name: f"c{names.index(name)}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Offsets of cells that are broadcast at most; a cell's offset is some tens of bytes.
BROADCAST_CELLS = 200_000


def dense_rank_slots(df: DataFrame, group: list[str], order: list[str], out: str, n_groups: int, spread: int | None = None) -> DataFrame:
    """Number the rows of each of at most n_groups groups from 0 without gaps and without one task per group.

    Rows of a group are dealt over `spread` cells by a hash of the ordering columns; a cell is numbered alone, and the
    cells' counts (spread rows a group) give each cell's offset. Any group may hold all rows. The spread grows with the
    session's shuffle partitions; n_groups times spread bounds the table of offsets, which is broadcast only if that is small.
    """
    from pyspark.sql import Window as W

    spread = spread or max(64, shuffle_partitions(df.sparkSession) // 2)
    cell = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(spread)))
    counts = cell.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = W.partitionBy(*group, "__cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = cell.withColumn("__at", F.row_number().over(inner).cast("long") - 1)
    joined = numbered.join(F.broadcast(offsets) if n_groups * spread <= BROADCAST_CELLS else offsets, [*group, "__cell"])
    return joined.withColumn(out, F.col("__at") + F.col("__before")).drop("__at", "__before", "__cell")
