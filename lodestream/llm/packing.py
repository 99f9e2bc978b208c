"""Operator 10: packing token sequences by minimum bin slack.

Documents become token ids and an end id; only documents over the capacity are cut, the remainder first, so that all
other pieces are full sequences of their own. What is left to pack is described completely by a histogram of lengths,
which has at most `capacity` rows however many pieces there are. On the histogram, each bin is opened by the longest
length left and filled by a bitset subset-sum over the available lengths, which finds the fullest feasible combination;
that combination is removed as often as the counts allow, so the number of steps does not depend on the number of pieces.
Pieces then take their places by arithmetic: a gapless number within their length leads to a bin and an offset. No task
holds more than a share of a length's pieces. Pieces of full length are sequences already and are neither counted nor moved.

Defined cases: a null text counts as empty and is the end id alone; texts of any length are encoded whole, runs of millions
of equal characters or spaces included; ids may be null, and rows with equal ids or texts are separate pieces; pieces of
equal length are interchangeable, so a tie goes by a number of the row; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, dense_rank_slots, forget_others, materialize

CAPACITY = 1024
END_ID = 2
#: White space in a row from which on the rank array encodes a text: the library's regular expression backtracks over such a
#: run and gives up on about a million characters.
LONG_SPACE = 100_000
_SPACE = re.compile(r"\s+")
#: Numbers of full-length sequences start here, beyond those of all others.
FULL = 1 << 62


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_loaded: dict = {}


def _forget() -> None:
    _loaded.clear()


def has_long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACE.finditer(text))


def token_encoder(path: str, vocabulary: str | None = None):
    """Encoder of the public byte-level vocabulary as ranks; it gives the ids of its tokenizers file, special token included.

    Texts with very long white space go to the rank array of operator 3 with the same vocabulary (its tokenizers file is
    `vocabulary`), which has the same ids and no regular expression that backtracks."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        spaced = vocabulary or bpe.default_vocabulary()
        _loaded[path] = lambda text: bpe.codec(spaced).encode(text) if has_long_space(text) else encoding.encode(text, allowed_special="all")
    return _loaded[path]


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, uid of every piece of every document."""
    path = ranks or default_ranks()
    bounded_batches(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        forget_others("packing", _forget)
        encode, uid = token_encoder(path), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                data = memoryview(array("I", ids)).cast("B")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    for column, v in zip(out, (key, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), uid), strict=True):
                        column.append(v)
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return df.select(df[id_col].cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def fullest_combination(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum of at most `room`, by bitset subset-sum.

    Bit s of a reached set says that some choice among the lengths so far sums to s. Longer lengths come first, and going
    back takes as few of the shorter ones as it can, which keeps small pieces for later bins.
    """
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            left, take = left - take, take * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins take it) for all pieces of the histogram."""
    counts, plan = dict(histogram), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        combination = fullest_combination(counts, capacity - longest)
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in combination.items())
        for n, k in combination.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        plan.append((combination, times))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length and a uid that is unique."""
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.lit(FULL) + F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    pieces = pieces.filter(F.col("length") < capacity)
    # at most `capacity` rows reach the driver, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, bins, used = [], 0, dict.fromkeys(histogram, 0)
    for combination, times in plan_bins(histogram, capacity):
        offset = 0
        for n, k in sorted(combination.items(), reverse=True):
            rows.append((n, used[n], used[n] + k * times, k, bins, offset))
            used[n] += k * times
            offset += n * k
        bins += times
    # A combination is used until a length runs short of it, so its rows are bounded by the capacity, not by the pieces.
    plan = spark.createDataFrame(rows, "length long, from_slot long, to_slot long, per_bin long, first_bin long, first_offset long")
    cells = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from_slot", "to_slot", "per_bin", "first_bin", "first_offset"))).alias("__plan"))
    slots = dense_rank_slots(pieces, ["length"], ["uid"], "__slot", capacity)
    placed = slots.join(F.broadcast(cells), "length").withColumn("__p", F.filter("__plan", lambda p: (p["from_slot"] <= F.col("__slot")) & (F.col("__slot") < p["to_slot"]))[0])
    at = F.col("__slot") - F.col("__p.from_slot")
    packed = placed.withColumn("sequence_id", F.col("__p.first_bin") + F.floor(at / F.col("__p.per_bin"))).withColumn("offset", F.col("__p.first_offset") + F.pmod(at, F.col("__p.per_bin")) * F.col("length")).drop("__plan", "__p", "__slot")
    return packed.unionByName(full)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_pieces(df, capacity, end_id, ranks, id_col, text_col), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
