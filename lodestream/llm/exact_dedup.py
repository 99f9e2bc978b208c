"""Operator 1: exact dedup with a log-structured merge index.

Each task collects rows in a memtable. When the memtable is full, it is flushed as a run: entries sorted by digest, one
for each distinct text with its smallest key and its members. Every run has a filter, the first 8 bytes of its entries'
digests. Before compaction the filters are probed against each other: an entry that no other one answers for is unique, stays
where it is and its text never moves. The entries that hit are dealt by digest, merged in sorted order, the smallest
identifier is kept, and the bytes of every hit are compared with the entry it hit. Runs are Parquet files with a bloom filter
on the digest besides, so that point lookups skip the files that cannot hold a digest.

A hot text reaches compaction once a run, not once a row, because the memtable has folded its copies together. Only texts
that may be copies are shuffled, once. What compaction found goes back to the runs as bits of their entries.

Defined cases: a null text counts as empty; texts of any length are compared whole; a null id loses to every other id; of rows
with the same text and id one stays; an empty table gives an empty result; other columns, whatever their names, are not read
(dedup) or pass through unchanged (drop_duplicates).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, bucketed, discard, forget_others, materialize, plain_names

#: Bytes of text that a memtable holds before it is flushed.
MEMTABLE_BYTES = 16 << 20
#: Entries of one digest that a task merges.
HOT_ENTRIES = 1024
#: Entries of a block, whose filter hits and losers are the bits of one bitmap.
BLOCK = 1 << 15
_BLOOM = {"parquet.bloom.filter.enabled#__digest": "true", "parquet.bloom.filter.expected.ndv#__digest": "50000"}
_NULL_LAST = (1 << 63) - 1


def normalise(text: bytes) -> bytes:
    """Lower-case A-Z only."""
    return text.translate(ASCII_LOWER)


def _order_key(key: int | None, keep: str) -> int:
    """Smallest first; ~ turns the order round without overflow."""
    return _NULL_LAST if key is None else key if keep == "smallest" else ~key


def _flusher(id_col: str, text_col: str, keep: str, members: bool, limit: int, digest_bytes: int, lower: bool, schema: pa.Schema):
    def flush(held: list[pa.RecordBatch], first_uid: int, block: int) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids = table.column(id_col).to_pylist()
        texts = table.column(text_col).cast(pa.binary()).to_pylist()
        entries: dict[bytes, list[list]] = {}
        for row, (key, text) in enumerate(zip(ids, texts, strict=True)):
            text = (text or b"").translate(ASCII_LOWER) if lower else text or b""
            order = (_order_key(key, keep), row)
            digest = hashlib.sha256(text).digest()
            same = entries.setdefault(digest[:digest_bytes], [])
            for entry in same:
                if entry[0] == text:  # a hit is believed only when the bytes agree
                    entry[2].append(row)
                    entry[1] = min(entry[1], order)
                    break
            else:
                same.append([text, order, [row], digest])
        run = sorted(((digest, *entry) for digest, same in entries.items() for entry in same), key=lambda e: (e[0], e[2]))
        rep = [order[1] for _, _, order, *_ in run]
        columns = {name: table.column(name).take(pa.array(rep, pa.int64())) for name in table.column_names if not (members and name == text_col)}
        if members:
            columns[text_col] = pa.array([text for _, text, *_ in run], pa.binary())
            columns["__ids"] = pa.array([[ids[i] for i in rows] for *_, rows, _ in run], pa.list_(pa.int64()))
            columns["__uids"] = pa.array([[first_uid + i for i in rows] for *_, rows, _ in run], pa.list_(pa.int64()))
            columns["__sha"] = pa.array([sha.hex() for *_, sha in run], pa.string())
        columns["__digest"] = pa.array([digest for digest, *_ in run], pa.binary())
        columns["__order"] = pa.array([order[0] for _, _, order, *_ in run], pa.int64())
        columns["__filter"] = pa.array([int.from_bytes(digest[:8], "little", signed=True) for digest, *_ in run], pa.int64())
        columns["__block"] = pa.array([block + i // BLOCK for i in range(len(run))], pa.int64())
        columns["__bit"] = pa.array([i % BLOCK for i in range(len(run))], pa.int64())
        columns["__uid"] = pa.array([first_uid + i for i in rep], pa.int64())
        return pa.table([columns[n].cast(schema.field(n).type) for n in schema.names], names=schema.names).to_batches(max_chunksize=4096)

    def run(batches):
        from pyspark import TaskContext

        forget_others("exact_dedup")
        uid, held, size = TaskContext.get().partitionId() << 33, [], 0
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                size += part.get_total_buffer_size() if batch.num_rows <= 512 else max(1, batch.nbytes * part.num_rows // batch.num_rows)
                if size >= limit:
                    yield from flush(held, uid, block)
                    rows = sum(b.num_rows for b in held)
                    uid, block, held, size = uid + rows, block + rows // BLOCK + 1, [], 0
        if held:
            yield from flush(held, uid, block)

    return run


def _merger(by: list[str], text_col: str, members: bool, lower: bool, schema: pa.Schema):
    """Merge runs that arrive sorted by (*by, order, uid): the first entry of each distinct text in a part wins.

    With members, every entry comes out with its winner's uid, and only winners keep their text; else only winners do."""

    def run(batches):
        part, same = None, []
        for batch in batches:
            rows, winners, texts_out = [], [], []
            columns = (batch.column(n).to_pylist() for n in ("__uid", *by))
            for row, (text, uid, *at) in enumerate(zip(batch.column(text_col).cast(pa.binary()).to_pylist(), *columns, strict=True)):
                text = (text or b"").translate(ASCII_LOWER) if lower and not members else text or b""
                if at != part:
                    part, same = at, []
                entry = next((e for e in same if e[0] == text), None)  # a hit is believed only when the bytes agree
                if entry is None:
                    same.append(entry := (text, uid))
                elif not members:
                    continue
                rows.append(row)
                winners.append(entry[1])
                texts_out.append(text if entry[1] == uid else None)
            got = batch.take(pa.array(rows, pa.int64()))
            made = {"__winner": pa.array(winners, pa.int64())}
            if members:
                made[text_col] = pa.array(texts_out, pa.binary())
            yield pa.RecordBatch.from_arrays([(made[n] if n in made else got.column(n)).cast(schema.field(n).type) for n in schema.names], names=schema.names)

    return run


def _merge(entries: DataFrame, by: list[str], text_col: str, members: bool, lower: bool) -> DataFrame:
    schema = T.StructType([f for f in entries.schema.fields if f.name != "__salt"] + [T.StructField("__winner", T.LongType())])
    ordered = entries.repartition(*by).sortWithinPartitions(*by, "__order", "__uid")
    return ordered.mapInArrow(_merger(by, text_col, members, lower, _arrow(schema)), schema)


def compact(entries: DataFrame, text_col: str, members: bool, lower: bool, hot_entries: int) -> tuple[DataFrame, list[DataFrame]]:
    """Entries (digest, order, uid, text, ...) with the uid of the entry that wins their text, over all runs; and the tables
    to discard once that is written."""
    counts = entries.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"))
    hot = materialize(counts.filter(F.col("__n") > hot_entries), "lsm-hot")
    if not hot.limit(1).count():
        return _merge(entries, ["__digest"], text_col, members, lower), [hot]
    marked = entries.join(hot, "__digest", "left").select(*entries.columns, "__n")
    salted = marked.filter("__n is not null").withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.ceil(F.col("__n") / hot_entries))).drop("__n")
    first = materialize(_merge(salted, ["__digest", "__salt"], text_col, members, lower), "lsm-level")
    winners = first.filter("__winner = __uid").drop("__winner")
    second = _merge(marked.filter("__n is null").drop("__n").unionByName(winners), ["__digest"], text_col, members, lower)
    if not members:
        return second, [hot, first]
    second = materialize(second, "lsm-merged")
    ends = second.select(F.col("__uid").alias("__part"), F.col("__winner").alias("__end"))
    rest = first.filter("__winner <> __uid").join(ends, F.col("__winner") == F.col("__part")).withColumn("__winner", F.col("__end")).select(*second.columns)
    return second.unionByName(rest), [hot, first, second]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema, timestamp_utc=True)


def flush_runs(df: DataFrame, id_col: str, text_col: str, keep: str, members: bool, memtable_bytes: int = MEMTABLE_BYTES, digest_bytes: int = 32, lower: bool = True) -> DataFrame:
    """Write the sorted runs of df to the shared folder and return them as a table."""
    extra = [T.StructField("__digest", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("__order", "__uid", "__filter", "__block", "__bit"))]
    if members:
        longs = T.ArrayType(T.LongType())
        schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(text_col, T.BinaryType()), T.StructField("__ids", longs), T.StructField("__uids", longs), T.StructField("__sha", T.StringType()), *extra])
    else:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + extra)
    runs = df.mapInArrow(_flusher(id_col, text_col, keep, members, memtable_bytes, digest_bytes, lower, _arrow(schema)), schema)
    return bucketed(runs, "lsm-runs", "__block", **_BLOOM)


def _bits(marked: DataFrame) -> DataFrame:
    """(block, bits): the bitmap of each block's entries (__block, __bit) among the marked ones."""
    return marked.groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("bits")).withColumnRenamed("__block", "block")


def _where(runs: DataFrame, bits: DataFrame, how: str) -> DataFrame:
    """The entries of the runs whose bit is set (left_semi) or isn't (left_anti). The bitmaps go to the blocks; no run moves."""
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0
    return runs.join(bits.hint("shuffle_hash"), (F.col("__block") == F.col("block")) & is_set, how)


def filter_hits(runs: DataFrame) -> DataFrame:
    """Bitmaps of the entries for which the filter of another entry answers: all that may be copies, and few others."""
    filters = runs.select("__filter", "__block", "__bit")
    twice = filters.groupBy("__filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__filter")
    return materialize(_bits(filters.join(twice, "__filter")), "lsm-hits")


def lookup(runs: DataFrame, digests: list[bytes]) -> DataFrame:
    """Entries of the runs with one of a few digests; row groups whose filter lacks them are not read."""
    return runs.filter(F.col("__digest").isin([F.lit(d) for d in digests]))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_bytes: int = MEMTABLE_BYTES, digest_bytes: int = 32, lower: bool = True, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    keep: whether the smallest or the largest id of equal texts stays. digest_bytes: length of the digests that the index
    is sorted by; short ones collide, and the comparison of bytes keeps the result right.
    """
    rows = df.select(F.col(id_col).cast("long").alias("__key"), F.col(text_col).alias("__text"))
    runs = flush_runs(rows, "__key", "__text", keep, True, memtable_bytes, digest_bytes, lower)
    hits = filter_hits(runs)
    entries = materialize(_where(runs.select("__digest", "__order", "__uid", "__text", "__block", "__bit"), hits, "left_semi").drop("__block", "__bit"), "lsm-entries")
    merged, used = compact(entries, "__text", True, lower, hot_entries)
    merged = materialize(merged.select("__uid", "__winner"), "lsm-merged")
    discard(hits, entries, *used)
    members = runs.select("__uid", "__key", "__ids", "__uids", "__sha")
    placed = members.join(merged, "__uid", "left").withColumn("__winner", F.coalesce("__winner", "__uid"))
    # an aggregate, so that a hot text's entries are combined where they lie
    key = F.max(F.when(F.col("__uid") == F.col("__winner"), F.col("__key")))
    groups = placed.groupBy("__winner").agg(F.sum(F.size("__ids")).cast("long").alias("group_size"), key.alias("keep_id"), F.max("__sha").alias("text_sha256"))
    each = placed.select("__winner", "__ids", "__uids").join(groups, "__winner").select("*", F.explode(F.arrays_zip("__ids", "__uids")).alias("__row"))
    return each.select(F.col("__row.__ids").alias("doc_id"), "keep_id", "group_size", (F.col("__row.__uids") == F.col("__winner")).alias("kept"), "text_sha256")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_bytes: int = MEMTABLE_BYTES, lower: bool = True, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """The rows of df that stay, with all their columns, whatever their names; only texts that may be copies move."""
    rows, name = plain_names(df)
    text = name(text_col)
    runs = flush_runs(rows.withColumn("__key", F.col(name(id_col)).cast("long")), "__key", text, keep, False, memtable_bytes, 32, lower)
    hits = filter_hits(runs)
    entries = materialize(_where(runs.select("__digest", "__order", "__uid", F.col(text).cast("binary").alias("__text"), "__block", "__bit"), hits, "left_semi"), "lsm-entries")
    winners, used = compact(entries.drop("__block", "__bit"), "__text", False, lower, hot_entries)
    losers = materialize(_bits(entries.select("__uid", "__block", "__bit").join(winners.select("__uid"), "__uid", "left_anti")), "lsm-losers")
    discard(hits, entries, *used)
    return _where(runs, losers, "left_anti").select(*rows.columns).toDF(*df.columns)
