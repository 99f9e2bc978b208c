"""Operator 9: near-duplicate documents by circulant MinHash, confirmed by exact Jaccard similarity.

Two permutations make a whole signature: sigma scatters a document's hashed shingles over 2^32 places, and coordinate k is
the smallest value of pi on the places shifted by k round the circle. Signatures are cut into bands; documents that agree
on a band are candidates, and every link is confirmed on the full shingle sets.

The work of a bucket is linear in its size where it can be. (1) Documents with equal shingle sets are one node. (2) In each
bucket every node is compared with the bucket's smallest node; links found so give components. (3) Only a bucket that
then still holds several components needs more: its nodes outside the commonest component, the probes, are compared with
all others. A pair is skipped only where both documents are linked already, so the components are those of all candidate
pairs. Texts are read once for signatures and once more, for candidates only, for verification.

Step 3 is exact and has to look at every pair of near misses in a bucket: bands that are long enough to part pairs at 0.75
from pairs at 0.8 would have to be so many, at the chance MISS, that near misses meet in them all the same. What it costs is
bounded: nodes are cut into blocks and probes into groups of BLOCK_BYTES of shingles each; a task holds an index of one block
and streams one group past it, so no worker holds a bucket. A block's frequent shingles are columns of a matrix and the others
lists, so that a pair costs some tens of nanoseconds. A bucket of n bytes, all near misses, ships n * n / BLOCK_BYTES * 2.

The chance that a pair just at the threshold is no candidate is below MISS; it falls quickly above the threshold.

What is kept is decided by row, not by id: every row has a written unique uid, and of each component one row is kept, that
with the smallest id (nulls last) and, among rows with that id, the smallest uid.

Defined cases: texts of any length are read whole; null and empty texts, and texts of white space, have no shingles, are linked with nothing and are kept; a
text with fewer words than a shingle is one shingle; rows with equal ids are separate rows, linked by their texts alone, so
each may be kept or not; rows with a null id take part, and a component of null ids alone has a null id and keeps one row;
an empty table gives an empty result; other columns are not read (near_duplicates) or pass through (drop_near_duplicates).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, bounded_batches, discard, forget_others, materialize, plain_names
from .components import connected_components

WORDS = 5
THRESHOLD = 80
ROWS = 5
MISS = 1e-6
#: Bytes of shingle hashes that a task indexes when a bucket's components are compared, and those of probes that pass by it.
BLOCK_BYTES = 16 << 20
#: Probes whose counts are one matrix product.
PROBES = 128
#: Nodes that are compared with one copy of their center.
SALTED = 512
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def bands_for(threshold: int, rows: int = ROWS) -> int:
    """Bands needed so that a pair at the threshold is missed with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (threshold / 100) ** rows))


class _WordHash(dict):
    """64-bit hashes of words; the memory is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHash()


def _forget() -> None:
    _word_hash.clear()


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    tokens = text.translate(ASCII_LOWER).split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word_hash.__getitem__, tokens), np.uint64, n)
    width = min(words, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h ^= w[j : n - width + 1 + j]
        h *= _P1
        h ^= h >> np.uint64(29)
    h *= _P2
    h ^= h >> np.uint64(32)
    h.sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _mix32(x: np.ndarray, t: np.ndarray) -> None:
    """A bijection of 32-bit integers, in place; t is room to work in."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=t)
    np.bitwise_xor(x, t, out=x)


def circulant_signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k coordinates for each non-empty set, from one sigma and one pi."""
    out = np.empty((len(sets), k), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        places = np.concatenate(sets[begin:end]).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        t, x = np.empty_like(places), np.empty_like(places)
        _mix32(np.bitwise_xor(places, np.uint32(0x5BD1E995), out=places), t)
        for i in range(k):
            np.add(places, np.uint32(i + 1), out=x)
            _mix32(x, t)
            out[begin:end, i] = np.minimum.reduceat(x, starts)
        begin = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            h ^= signatures[:, b * rows + r].astype(np.uint64)
            h *= _P1
            h ^= h >> np.uint64(31)
        keys[:, b] = h
    return keys.view(np.int64)


def _signer(words: int, bands: int, rows: int):
    """Rows are doc_id, text and columns that pass through."""
    names = ["uid", "n_shingles", "d1", "d2", "keys"]

    def run(batches):
        from pyspark import TaskContext

        forget_others("neardup", _forget)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            sets = [shingle_set(x or b"", words) for x in b.column("text").cast(pa.binary()).to_pylist()]
            full = [s for s in sets if len(s)]
            made = iter(band_keys(circulant_signatures(full, bands * rows), bands, rows) if full else [])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + b.num_rows), pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digests], pa.int64()),
                pa.array([next(made).tolist() if len(s) else None for s in sets], pa.list_(pa.int64())), *b.columns,
            ], names=[*names, *b.schema.names])
            uid += b.num_rows

    return run


def _sets_of(words: int):
    def run(batches):
        forget_others("neardup", _forget)
        for b in batches:
            sets = [shingle_set(x or b"", words).tobytes() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, on full sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < threshold * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _compare_with_center(threshold: int):
    """Rows arrive by (center, salts, salt), the center's own row first."""

    def run(batches):
        at, center_set = None, None
        for b in batches:
            a, c = [], []
            for node, center, salts, salt, own, data in zip(*(b.column(n).to_pylist() for n in ("node", "center", "salts", "salt", "own", "set")), strict=True):
                if own:
                    at, center_set = (center, salts, salt), np.frombuffer(data, np.uint64)
                elif at == (center, salts, salt) and linked(np.frombuffer(data, np.uint64), center_set, threshold):
                    a.append(node)
                    c.append(center)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


class BlockIndex:
    """Exact intersections of one set with all sets of a block. Shingles in a quarter of the sets or more are columns of a
    matrix, which has at most 4 times the entries of the sets; the others have lists of the sets that hold them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        n = len(sets)
        every, of = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.of = every[order], of[order]
        self.first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.shingles, self.held = every[self.first], np.diff(np.append(self.first, len(every)))
        common = 4 * self.held >= n
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((n, int(common.sum())), np.float32)
        for c, (at, k) in enumerate(zip(self.first[common].tolist(), self.held[common].tolist(), strict=True)):
            self.matrix[self.of[at : at + k], c] = 1

    def shared(self, probes: list[np.ndarray]) -> np.ndarray:
        """How many shingles each probe (row) shares with each set of the block."""
        n = len(self.sizes)
        columns, counts = np.zeros((len(probes), self.matrix.shape[1]), np.float32), []
        for row, probe in enumerate(probes):
            at = np.searchsorted(self.shingles, probe)
            at[at == len(self.shingles)] = 0
            at = at[self.shingles[at] == probe]
            column = self.column[at]
            columns[row, column[column >= 0]] = 1
            rare = at[column < 0]
            k = self.held[rare]
            places = np.arange(k.sum()) + np.repeat(self.first[rare] - np.cumsum(k) + k, k)
            counts.append(np.bincount(self.of[places], minlength=n))
        return np.array(counts) + (columns @ self.matrix.T).astype(np.int64)


class _Cell:
    """One block of a bucket and the probes that pass by it. Links are given as far as they join components."""

    def __init__(self, threshold: int):
        self.threshold, self.own, self.index, self.root = threshold, [], None, {}

    def find(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def seal(self):
        """All of the block is there; its own probes go first."""
        if self.index is None and self.own:
            self.index = BlockIndex([x[3] for x in self.own])
            self.nodes, self.labels, self.probes = (np.array([x[i] for x in self.own]) for i in range(3))
            yield from self.compare([(n, c, data) for n, c, probe, data in self.own if probe])

    def compare(self, probes: list[tuple[int, int, np.ndarray]]):
        for at in range(0, len(probes) if self.index else 0, PROBES):
            some = probes[at : at + PROBES]
            both = self.index.shared([data for *_, data in some])
            sizes = np.array([len(data) for *_, data in some])[:, None]
            near = 100 * both >= self.threshold * (self.index.sizes + sizes - both)
            for row in np.flatnonzero(near.any(1)).tolist():
                node, label, _ = some[row]
                # two probes meet twice; once is enough
                hits = np.flatnonzero(near[row] & (self.labels != label) & (~self.probes | (self.nodes < node)))
                labels, first = np.unique(self.labels[hits], return_index=True)
                for other, hit in zip(labels.tolist(), hits[first].tolist(), strict=True):
                    if self.find(other) != self.find(label):
                        self.root[self.find(other)] = self.find(label)
                        yield node, int(self.nodes[hit])


def _compare_blocks(threshold: int):
    """Rows arrive by (bucket, block, group), the block's own nodes first: own says that a row belongs to the block, probe that
    it belongs to the group of nodes outside the bucket's main component, which are compared with the block."""

    def out(found: list):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    def run(batches):
        at, cell = None, _Cell(threshold)
        for b in batches:
            found, passing = [], []
            for bucket, block, group, node, label, own, probe, data in zip(*(b.column(n).to_pylist() for n in ("bucket", "block", "group", "node", "label", "own", "probe", "set")), strict=True):
                if (bucket, block, group) != at:
                    found += [*cell.seal(), *cell.compare(passing)]
                    at, cell, passing = (bucket, block, group), _Cell(threshold), []
                if own:
                    cell.own.append((node, label, probe, np.frombuffer(data, np.uint64)))
                else:
                    found += cell.seal()
                    passing.append((node, label, np.frombuffer(data, np.uint64)))
            found += cell.compare(passing)
            yield out(found)
        yield out(list(cell.seal()))

    return run


def find_links(signed: DataFrame, nodes: DataFrame, threshold: int, words: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Labels (node, label) of the nodes with a confirmed link, and the tables of those links (a, b)."""
    members = nodes.select("node", "n_shingles", F.explode("keys").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("center"), F.min_by("n_shingles", "node").alias("center_n"), F.count(F.lit(1)).alias("size"))
    buckets = materialize(buckets.filter("size > 1"), "nd-buckets")
    members = materialize(members.join(buckets, "bucket").select("bucket", "center", "center_n", "size", "node", "n_shingles"), "nd-members")
    discard(buckets)
    # A pair is sized by the largest bucket that it shares; a center's pairs are dealt over as many salts as that needs.
    pairs = members.filter("node <> center").filter(100 * F.least("n_shingles", "center_n") >= threshold * F.greatest("n_shingles", "center_n"))
    pairs = pairs.groupBy("node", "center").agg(F.ceil(F.max("size") / SALTED).cast("int").alias("salts"))
    pairs = materialize(pairs, "nd-pairs")

    busy = members.filter("size > 2")
    wanted = pairs.select("node").union(pairs.select("center")).union(busy.select("node")).distinct()
    texts = signed.select(F.col("uid").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = materialize(texts.mapInArrow(_sets_of(words), "node long, set binary"), "nd-sets")

    centers = pairs.select("center", "salts").distinct().select(F.col("center").alias("node"), "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    center_rows = centers.join(sets, "node").select("node", F.col("node").alias("center"), "salts", "salt", F.lit(True).alias("own"), "set")
    member_rows = pairs.join(sets, "node").select("node", "center", "salts", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("own"), "set")
    dealt = center_rows.union(member_rows).repartition("center", "salts", "salt").sortWithinPartitions("center", "salts", "salt", F.desc("own"))
    first = materialize(dealt.mapInArrow(_compare_with_center(threshold), "a long, b long"), "nd-links")
    labels = connected_components(first)

    # Buckets that still hold several components. Two nodes alone have been compared already.
    known = busy.join(labels, "node", "left").select("bucket", "size", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    known = materialize(known, "nd-known")
    discard(members, pairs)
    mixed = known.groupBy("bucket", "size").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"))
    mixed = mixed.filter("lo <> hi").groupBy("size", "print").agg(F.min("bucket").alias("bucket"))
    # counted before the join: a large bucket is a row a label and task by then
    counted = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")).join(mixed.select("bucket"), "bucket")
    # written, so that the join below has plain exchanges on both sides and a large bucket's can be split
    m, cuts = F.max(F.struct("n", "label", "w")), lambda w: F.greatest(F.ceil(8 * w / block_bytes).cast("int"), F.lit(1))
    main = counted.groupBy("bucket").agg(m.alias("m"), F.sum("w").alias("w"))
    main = materialize(main.select("bucket", F.col("m.label").alias("main"), cuts(F.col("w")).alias("blocks"), cuts(F.col("w") - F.col("m.w")).alias("groups")), "nd-main")
    plan = known.join(main, "bucket").withColumn("probe", F.col("label") != F.col("main"))
    plan = plan.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "group": F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")})
    cell = lambda block, group, own, probe: F.struct(block.alias("block"), group.alias("group"), own.alias("own"), probe.alias("probe"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = F.transform(upto("groups"), lambda g: cell(F.col("block"), g, F.lit(True), F.col("probe") & (g == F.col("group"))))
    passing = F.transform(F.filter(upto("blocks"), lambda b: b != F.col("block")), lambda b: cell(b, F.col("group"), F.lit(False), F.lit(True)))
    spread = plan.select("bucket", "node", "label", F.explode(F.when(F.col("probe"), F.concat(held, passing)).otherwise(held)).alias("c"))
    rows = spread.join(sets, "node").select("bucket", "c.block", "c.group", "node", "label", "c.own", "c.probe", "set")
    dealt = rows.repartition("bucket", "block", "group").sortWithinPartitions("bucket", "block", "group", F.desc("own"))
    second = materialize(dealt.mapInArrow(_compare_blocks(threshold), "a long, b long"), "nd-links")
    discard(known, sets, main)
    if second.limit(1).count():
        discard(labels)
        labels = connected_components(first.union(second))
    return labels, [first, second]


def _decide(source: DataFrame, threshold: int, words: int, rows: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """source (doc_id, text and others) as written, with a uid a row, and (uid, doc_id, n_shingles, component_id, kept) of every row."""
    bounded_batches(source.sparkSession)
    bands = bands_for(threshold, rows)
    made = T.StructType.fromDDL("uid long, n_shingles long, d1 long, d2 long, keys array<long>")
    signed = materialize(source.mapInArrow(_signer(words, bands, rows), T.StructType([*made, *source.schema])), "nd-signed")
    some = signed.filter("n_shingles > 0")
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    classes = materialize(some.groupBy("d1", "d2").agg(F.min("uid").alias("node"), F.min(best).alias("least")), "nd-classes")
    nodes = materialize(some.select(F.col("uid").alias("node"), "n_shingles", "keys").join(classes.select("node"), "node", "left_semi"), "nd-nodes")
    labels, links = find_links(signed, nodes, threshold, words, block_bytes)
    named = classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("label"), "least")
    named = materialize(named, "nd-named")
    discard(classes, nodes, labels, *links)
    least = named.groupBy("label").agg(F.min("least").alias("best")).select("label", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("keeper"))
    component = materialize(named.join(least, "label").select("d1", "d2", "component_id", "keeper"), "nd-components")
    discard(named)
    linked_rows = some.select("uid", "doc_id", "n_shingles", "d1", "d2").join(component, ["d1", "d2"]).select("uid", "doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("keeper")).alias("kept"))
    alone = signed.filter("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return signed, linked_rows.union(alone)


def near_duplicates(df: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id (smallest id reachable), kept (one row of each component)."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _decide(source, threshold, words, rows, block_bytes)[1].drop("uid")


def drop_near_duplicates(df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay: of each component one row, with its smallest id."""
    rows, name = plain_names(df)
    text = name(text_col)
    source = rows.select(F.col(name(id_col)).cast("long").alias("doc_id"), F.col(text).alias("text"), *[c for c in rows.columns if c != text])
    signed, found = _decide(source, threshold, WORDS, ROWS)
    kept = signed.join(found.filter(~F.col("kept")).select("uid"), "uid", "left_anti")
    return kept.select(*[F.col("text" if c == text else c) for c in rows.columns]).toDF(*df.columns)
