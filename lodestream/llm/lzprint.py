"""Operator 5: Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest string from the current place on that is not yet in
the dictionary, and joins it. The set of phrases is hashed and condensed into the minima of BINS equal shares of the hash
range; a share without a phrase borrows from the next one that has some. The part of equal minima estimates how much of
their dictionaries two texts share, which is what compressing them together would gain.

Fingerprints keep 8 bits a bin, two hexadecimal digits each; the estimate is corrected for the 1 in 256 that agree by
chance. Dictionaries are prefix-closed, so the end of a phrase is searched outwards from the length of the last one.

Neighbours are found without a global sort: ids are cut into ranges of equal counts, each range is sorted in one task, and
the first document of a range is lent to the range before it. An id that fills whole ranges, and the null id, are cut further
by the hash of the text into as many cells as there are shuffle partitions, so that no id is too common. Rows with both id and
text in common stand side by side and are parsed once.

Defined cases: texts of any length are parsed whole; a null text counts as empty and has the empty fingerprint, which is like another empty one (1) and unlike
all others (0); documents are ordered by descending id, null ids last, equal ids by a hash of their text; a single document
is its own next one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions

BINS = 128
#: Cells that a common id's range is cut into at least, as a power of two; more with more shuffle partitions.
CELL_BITS = 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def parse(text: str, at: int, seen: set[str]) -> list[int]:
    """Ends of the phrases from `at` on; seen is the dictionary so far and grows. The rest of the text is a known phrase."""
    n, size, ends, add = len(text), 4, [], seen.add
    while at < n:
        if size > n - at:
            size = n - at
        phrase = text[at : at + size]
        if phrase in seen:
            while phrase in seen:
                if at + size >= n:
                    return ends
                size += 1
                phrase = text[at : at + size]
        else:
            while size > 1:
                shorter = text[at : at + size - 1]
                if shorter in seen:
                    break
                size -= 1
                phrase = shorter
        add(phrase)
        at += size
        ends.append(at)
    return ends


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            t = np.full(max(n, 1 << 16), base, np.uint64)
            t[0] = 1
            made.append(np.multiply.accumulate(t))
        _powers[:] = made
    return _powers


def signature(text: str, ends: list[int]) -> bytes:
    """The fingerprint of a text that was parsed so; a known phrase at its end counts too."""
    n = len(text)
    if not n:
        return b""
    cuts = np.array([0, *ends] + ([n] if not ends or ends[-1] < n else []), np.int64)
    power, inverse = _tables(n + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * power[:n], out=sums[1:])
    h = (sums[cuts[1:]] - sums[cuts[:-1]]) * inverse[cuts[:-1]]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    h.sort()
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = bins[first]
    # each bin takes the minimum of the next filled one round the circle, mixed with the distance
    source = np.searchsorted(filled, np.arange(BINS))
    wraps = source == len(filled)
    source[wraps] = 0
    distance = (filled[source] - np.arange(BINS)) % BINS
    values = (h[first][source] + distance.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)) * _BASE
    return (values >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated similarity of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = int(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) / BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str) -> bytes:
    return signature(text, parse(text, 0, set()))


@lru_cache(1)
def both_fingerprints(text: str, after: str) -> tuple[bytes, str, bytes]:
    """Fingerprint of text, its edited text (last third replaced by the start of `after`), and that one's fingerprint.

    The parse of what the two have in common is made once."""
    third = len(text) // 3
    shared = text[: len(text) - third]
    edited = shared + after[:third]
    seen: set[str] = set()
    ends = parse(shared, 0, seen)
    at = ends[-1] if ends else 0
    other = ends + parse(edited, at, seen.copy())
    return signature(text, ends + parse(text, at, seen)), edited, signature(edited, other)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every whole text."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or "").hex() for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _range_number(key, bounds: list[int]):
    """How many bounds the key reaches, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= key))
    inner = F.size(F.filter(F.array(*[longs(b) for b in blocks])[F.greatest(block - 1, F.lit(0))], lambda x: x <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner)


def with_next(df: DataFrame) -> DataFrame:
    """Rows (range, lent, key, tie, text) dealt and sorted so that each range's documents stand in descending order and the
    first document of the following range comes last, as a lent row."""
    spark = df.sparkSession
    parts = 4 * shuffle_partitions(spark)
    bits = max(CELL_BITS, shuffle_partitions(spark).bit_length())
    found = [int(c) for c in df.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)]
    common = {a for a, b in zip(found, found[1:], strict=False) if a == b}  # ids that fill a range or more have one of their own
    number = _range_number(F.col("key"), sorted({*found, *(c + 1 for c in common)}))
    cut = F.col("key").isNull() | (F.col("key").isin(list(common)) if common else F.lit(False))
    cell = F.when(cut, F.pmod(F.shiftright("tie", 64 - bits) + (1 << (bits - 1)), F.lit(1 << bits))).otherwise(0)
    ranged = df.withColumn("range", F.when(F.col("key").isNull(), F.lit(-1)).otherwise(number).cast("long") * (1 << bits) + cell)
    # one row a range: some times the partitions, whatever the input
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max(F.struct("key", "tie")).alias("top")).collect()}
    order = sorted(tops)
    rows = ranged.withColumn("lent", F.lit(False))
    if not order:
        return rows
    # a range's first document follows the last one of the range above; the topmost follows the lowest
    above = dict(zip(order, order[1:] + order[:1], strict=True))
    lenders = spark.createDataFrame([(r, tops[r]["key"], tops[r]["tie"], above[r]) for r in order], "range long, __top long, __tie long, __to long")
    lent = ranged.join(F.broadcast(lenders), "range").filter(F.col("key").eqNullSafe(F.col("__top")) & (F.col("tie") == F.col("__tie")))
    lent = lent.select("key", "text", "tie", F.col("__to").alias("range"), F.lit(True).alias("lent"))
    return rows.unionByName(lent).repartition("range").sortWithinPartitions("range", "lent", F.desc_nulls_last("key"), F.desc("tie"))


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    bounded_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def stream(batches):
        ahead, waiting = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(n).to_pylist() for n in ("range", "lent", "key", "text")), strict=True):
                if ahead is not None:
                    waiting = _advance(ahead, row if row[0] == ahead[0] else None, waiting, out)
                ahead = row
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        out = []
        if ahead is not None:
            _advance(ahead, None, waiting, out)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    done = with_next(source).select("range", "lent", "key", "text").mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done


def _advance(row: tuple, after: tuple | None, waiting: tuple | None, out: list[tuple]) -> tuple | None:
    """Take one row; `after` is the next row of its range. waiting is the document before it, whose next one it is."""
    lent, key, text = row[1:]
    if lent:
        if waiting:
            out.append(_settled(waiting, fingerprint(text)))
        return None
    own, edited, other = both_fingerprints(text, after[3] if after else "")
    if waiting:
        out.append(_settled(waiting, own))
    return key, len(text), sha256(edited.encode()).hexdigest(), own, other


def _settled(waiting: tuple, next_print: bytes) -> tuple:
    key, n, edited, own, other = waiting
    return key, n, edited, own.hex(), other.hex(), likeness(own, other), likeness(own, next_print)
