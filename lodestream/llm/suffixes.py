"""Operator 7: exact substring dedup by suffix sorting.

Every byte covered by a `length`-byte string that starts at two or more places of the corpus is removed. Matches never
cross documents.

Suffix sorting is two-stage: a suffix that is smaller than its successor (type B) is sorted directly; all others (type A)
are induced by one scan over the buckets of first bytes, each bucket handing its suffixes' predecessors on to later
buckets in order. Common prefixes of adjacent suffixes then tell which strings repeat.

Sorting is spared for text that cannot repeat. Equal strings have equal hashes and equal least k-gram hashes (anchors), so
1. anchors are counted over all documents; windows whose anchor occurs once are done;
2. the other windows are counted by their own hash; unique ones are done. Windows of one hot anchor spread over all tasks;
3. what survives is cut into contexts at changes of anchor, equal contexts of a chunk are folded together, and contexts of
   one anchor meet in one task, where those that occur once are suffix-sorted with the rest of their anchor's contexts;
4. the windows of an anchor that occurs in more than HOT_CHUNKS chunks stay where they are. One that repeats in its chunk is
   settled there; the others ask for the number of equal strings, which is a sum with partial sums in every task.
Hashes only ever spare work: a collision sends a string to the exact comparison. Counts travel as sorted arrays, one for
each chunk of documents and part of the hash range, holding a hash at most twice, so a hot string costs a chunk two
entries. The documents are written once as a table bucketed by chunk, so the passes over text shuffle no text.

A chunk ends at a number of documents or of bytes, whichever comes first, so that what a task holds of it is bounded in bytes
(by one document more).

Defined cases: a null text counts as empty; texts of any length are searched whole, in segments; texts shorter than `length`
stay as they are; null ids are ids like others; rows with equal ids are separate documents, so two equal rows remove each other's text; an empty table gives an empty result; other columns are not read
(digests) or pass through unchanged (remove_repeats). Removal works on bytes; where it cuts a character, remove_repeats
drops the character's remains.
"""

from __future__ import annotations

import struct
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, bucketed, discard, forget_others, materialize, plain_names, shuffle_partitions

LENGTH = 200
GRAM = 80
#: Documents in a small corpus' chunk, as a power of two; window starts hashed at a time; bytes suffix-sorted at a time.
CHUNK_BITS, SEGMENT, SORT_BYTES = 10, 1 << 20, 1 << 19
#: Bytes of text in a chunk for each document it may hold: 2 MB in a small corpus, 32 MB at most.
DOCUMENT_BYTES = 2048
#: Suffixes whose bytes are held at a time while they are sorted.
SORTED = 1 << 16
#: Bytes of a chunk's text up to which its windows' hashes are kept between steps; beyond it they are made again.
KEPT_BYTES = 8 << 20
#: Chunks whose contexts of one anchor may meet in a task.
HOT_CHUNKS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _forget() -> None:
    _powers.clear()


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i : i + width] for each i."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


class Windows:
    """Hashes of all windows that start in a run of segments. A segment never crosses documents."""

    def __init__(self, segments: list[tuple[int, int, bytes]], length: int, gram: int):
        self.segments, self.length = segments, length
        self.text = b"".join(s[2] for s in segments)
        data = np.frombuffer(self.text, np.uint8)
        n = len(data)
        power, inverse = _power_tables(max(n + 1, 1 << 16))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        grams = _mixed((sums[gram:] - sums[:-gram]) * inverse[: n + 1 - gram])
        width = length - gram + 1
        minima = _slide(grams, width, np.minimum)
        starts = np.cumsum([0, *(len(s[2]) for s in segments)])
        self.starts = starts[:-1]
        valid = np.ones(len(minima), bool)
        for stop in starts[1:-1]:
            valid[max(0, stop - length + 1) : stop] = False
        minima = np.where(valid, minima, np.uint64(0))  # a window that crosses documents has no anchor
        self.change = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]]))
        self.minima, self.grams, self.width = minima, grams, width

    def anchors(self) -> np.ndarray:
        """Hash of each place whose k-gram is the least of some window."""
        padded = np.concatenate([np.zeros(self.width - 1, np.uint64), self.minima, np.zeros(self.width - 1, np.uint64)])
        most = _slide(padded, self.width, np.maximum)
        return self.grams[(most == self.grams) & (most > 0)]

    def anchor_set(self) -> np.ndarray:
        """The same hashes, each at least once."""
        values = self.minima[self.change]
        return values[values > 0]

    def candidates(self, repeated: np.ndarray, parts: int) -> np.ndarray:
        """Starts of windows whose anchor is repeated."""
        values = self.minima[self.change]
        hit = _among(short_keys(values, parts), repeated) & (values > 0)
        first = self.change[hit]
        sizes = np.diff(np.append(self.change, len(self.minima)))[hit]
        if not len(first):
            return first
        return np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)

    def settle(self) -> "Windows":
        """Forget what only the count of anchors needs."""
        self.grams = None
        return self

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[at + self.length] - self._sums[at]) * self._inverse[at])

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and byte offset in its document of each start."""
        which = np.searchsorted(self.starts, at, side="right") - 1
        rows, bases = np.array([s[0] for s in self.segments]), np.array([s[1] for s in self.segments])
        return rows[which], at - self.starts[which] + bases[which]


def windows_of(texts: list[bytes], length: int, gram: int):
    """Windows objects that together hold every window of every text once."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, SEGMENT):
            piece = text[base : base + SEGMENT + length - 1]
            if held and size + len(piece) > SEGMENT:
                yield Windows(held, length, gram)
                held, size = [], 0
            held.append((row, base, piece))
            size += len(piece)
    if held:
        yield Windows(held, length, gram)


def short_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part number above 32 bits of hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return ordered[at] == keys


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting: numpy's own unique hashes, which takes several times as long."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _at_most_twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and whether each occurs more than once."""
    keys, counts = np.unique(keys, return_counts=True)
    return keys, counts > 1


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("__text").cast(pa.binary()).to_pylist()]


def _blobs(chunk: int, kind: int, keys: np.ndarray, twice: np.ndarray, parts: int) -> list[dict]:
    cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [{"part": p, "chunk": chunk, "keys": low[a:b].tobytes(), "twice": np.packbits(twice[a:b]).tobytes()} for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


_BLOB = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
_FLAG = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("bits", pa.binary()), ("hot", pa.binary())])


def _count_repeats(kind: int, hot_chunks: int = HOT_CHUNKS):
    """For each part of the hash range, whose rows arrive one after the other: which keys of each chunk occur twice or more in
    all, and which in many chunks."""

    def count(rows: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], "<u4") for r in rows]
        twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, keys, strict=True)]
        order = np.sort(np.concatenate([*keys, *(k[t] for k, t in zip(keys, twice, strict=True))]))
        repeated = _distinct(order[1:][order[1:] == order[:-1]])
        present = np.sort(np.concatenate(keys))
        hot = _distinct(present[hot_chunks:][present[hot_chunks:] == present[:-hot_chunks]]) if len(rows) > hot_chunks else present[:0]
        mark = lambda k: np.packbits(found).tobytes() if len(hot) and (found := _among(k, hot)).any() else None
        out = [{"chunk": r["chunk"], "kind": kind, "part": r["part"], "bits": np.packbits(_among(k, repeated)).tobytes(), "hot": mark(k)} for r, k in zip(rows, keys, strict=True)]
        return pa.RecordBatch.from_pylist(out, schema=_FLAG)

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and row["part"] != held[0]["part"]:
                    yield count(held)
                    held = []
                held.append(row)
        if held:
            yield count(held)

    return run


def _by_part(blobs: DataFrame) -> DataFrame:
    """Rows dealt so that every task has the same number of parts; hashing a few parts would give some tasks several times as many."""
    n = shuffle_partitions(blobs.sparkSession)
    return blobs.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int")).sortWithinPartitions("part")


def _apply_flags(keys: np.ndarray, flags: dict[int, bytes], parts: int) -> np.ndarray:
    """The repeated ones among a chunk's sorted distinct keys."""
    cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    bits = np.zeros(len(keys), bool)
    for p, data in flags.items():
        a, b = cuts[p], cuts[p + 1]
        bits[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
    return keys[bits]


def _flag_maps(flags: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes], dict[int, bytes]]:
    """By part: repeated anchors, repeated windows, hot anchors."""
    maps: tuple[dict, dict, dict] = ({}, {}, {})
    for r in flags.to_pylist():
        maps[r["kind"]][r["part"]] = r["bits"]
        if r["kind"] == 0 and r["hot"] is not None:
            maps[2][r["part"]] = r["hot"]
    return maps


def _anchor_pass(length: int, gram: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        found = [short_keys(w.anchors(), parts) for w in windows_of(_texts(table), length, gram)]
        keys, twice = _at_most_twice(np.concatenate(found)) if found else (np.empty(0, np.uint64), np.empty(0, bool))
        return pa.Table.from_pylist(_blobs(table.column("__chunk")[0].as_py(), 0, keys, twice, parts), schema=_BLOB)

    return run


def _all_windows(texts: list[bytes], anchors: dict[int, bytes], length: int, gram: int, parts: int):
    """Windows objects, candidate starts and their short keys. Windows are kept between the two steps where that is cheap."""
    kept = [w.settle() for w in windows_of(texts, length, gram)] if sum(map(len, texts)) <= KEPT_BYTES else None
    again = lambda: kept if kept is not None else windows_of(texts, length, gram)
    made = [_distinct(short_keys(w.anchor_set(), parts)) for w in again()]
    repeated = _apply_flags(_distinct(np.concatenate(made)), anchors, parts) if made else np.empty(0, np.uint64)
    for w in again() if len(repeated) else ():
        at = w.candidates(repeated, parts)
        if len(at):
            yield w, at, short_keys(w.hashes(at), parts)


def _window_pass(length: int, gram: int, parts: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows or not flags.num_rows:
            return _BLOB.empty_table()
        found = [keys for _, _, keys in _all_windows(_texts(docs), _flag_maps(flags)[0], length, gram, parts)]
        if not found:
            return _BLOB.empty_table()
        keys, twice = _at_most_twice(np.concatenate(found))
        return pa.Table.from_pylist(_blobs(docs.column("__chunk")[0].as_py(), 1, keys, twice, parts), schema=_BLOB)

    return run


_CONTEXT = pa.schema([("anchor", pa.int64()), ("context", pa.binary()), ("chunk", pa.int64()), ("refs", pa.binary()), ("hot", pa.bool_())])


def _context_pass(length: int, gram: int, parts: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows or not flags.num_rows:
            return _CONTEXT.empty_table()
        anchors, windows, hot_bits = _flag_maps(flags)
        texts, uids = _texts(docs), np.array(docs.column("__uid").to_pylist(), np.int64)
        every = _all_windows(texts, anchors, length, gram, parts)
        kept = list(every) if sum(map(len, texts)) <= KEPT_BYTES else None
        again = lambda: kept if kept is not None else _all_windows(texts, anchors, length, gram, parts)
        keys = _distinct(np.concatenate([np.empty(0, np.uint64), *(k for _, _, k in again())]))
        repeated = _apply_flags(keys, windows, parts)
        hot = np.empty(0, np.uint64)
        if hot_bits:
            hot = _apply_flags(_distinct(np.concatenate([short_keys(w.anchor_set(), parts) for w in windows_of(texts, length, gram)])), hot_bits, parts)
        folded: dict[tuple[int, bytes, bool], list[tuple[int, int]]] = {}
        for w, at, keys in again() if len(repeated) else ():
            at = at[_among(keys, repeated)]
            if not len(at):
                continue
            least = w.minima[at]
            is_hot = _among(short_keys(least, parts), hot)
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | is_hot[1:]]))
            first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
            rows, offsets = w.place(first)
            refs = zip(uids[rows].tolist(), offsets.tolist(), strict=True)
            for a, b, m, h, ref in zip(first.tolist(), (last + length).tolist(), least[cut].view(np.int64).tolist(), is_hot[cut].tolist(), refs, strict=True):
                folded.setdefault((m, w.text[a:b], h), []).append(ref)
        chunk = docs.column("__chunk")[0].as_py()
        return pa.table([
            pa.array([m for m, _, _ in folded], pa.int64()), pa.array([c for _, c, _ in folded], pa.binary()), pa.array([chunk] * len(folded), pa.int64()),
            pa.array([struct.pack(f"<{2 * len(r)}q", *chain.from_iterable(r)) for r in folded.values()], pa.binary()), pa.array([h for _, _, h in folded], pa.bool_()),
        ], schema=_CONTEXT)

    return run


def _direct_order(data: np.ndarray, text: bytes, direct: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes: by their first 8 bytes all at once, and in slices of some SORTED of them
    by the others, so that few keys are held however many suffixes there are."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[direct].view(">u8")[:, 0] if len(direct) else np.empty(0, np.uint64)
    order = np.argsort(first, kind="stable")
    direct, first = direct[order], first[order]
    ends = np.append(np.flatnonzero(first[1:] != first[:-1]) + 1, len(direct))
    at = 0
    while at < len(direct):
        stop = int(ends[np.searchsorted(ends, min(at + SORTED, len(direct)))])
        keys = [text[i : i + depth] for i in direct[at:stop].tolist()]
        direct[at:stop] = direct[at:stop][np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
        at = stop
    return direct


def suffix_order(data: np.ndarray, included: np.ndarray, depth: int) -> np.ndarray:
    """Included suffixes of data in order of their first `depth` bytes, by two-stage sorting.

    The successor of an included type A suffix must be included. Separators are larger than every other byte.
    """
    n, text = len(data), data.tobytes()
    smaller = np.zeros(n, bool)  # type B: smaller than its successor
    differs = np.flatnonzero(data[1:] != data[:-1])
    if len(differs):
        run_end = np.searchsorted(differs, np.arange(n))
        inside = run_end < len(differs)
        ends = differs[np.minimum(run_end, len(differs) - 1)]
        smaller = inside & (data[ends] < data[np.minimum(ends + 1, n - 1)])
    direct = _direct_order(data, text, np.flatnonzero(smaller & included), depth)
    by_byte = np.argsort(data[direct], kind="stable")
    direct = direct[by_byte]
    cuts = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets = []
    for c in range(256):
        own = induced[c]
        newest = np.concatenate(own) if own else np.empty(0, np.int64)
        parts = [newest]
        while len(newest):  # runs of the byte itself
            before = newest[newest > 0] - 1
            newest = before[(data[before] == c) & included[before] & ~smaller[before]]
            parts.append(newest)
        bucket = np.concatenate([*parts, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        buckets.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & included[before]]
        bytes_before = data[before]
        order = np.argsort(bytes_before, kind="stable")
        before, bytes_before = before[order], bytes_before[order]
        for byte in np.flatnonzero(np.bincount(bytes_before, minlength=256)).tolist():
            a, b = np.searchsorted(bytes_before, [byte, byte + 1])
            induced[byte].append(before[a:b])
    return np.concatenate(buckets) if buckets else np.empty(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, up to cap."""
    padded = np.concatenate([data, np.zeros(cap + 8, np.uint8)])
    found = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    step = 0
    while len(live) and step < cap:
        same = padded[order[live] + step] == padded[order[live - 1] + step]
        if step % 8 == 0 and step + 8 <= cap:
            a = np.lib.stride_tricks.sliding_window_view(padded, 8)
            whole = (a[order[live] + step] == a[order[live - 1] + step]).all(1)
            found[live[whole]] = step + 8
            rest = live[~whole]
            if len(rest):
                differ = np.argmin(a[order[rest] + step] == a[order[rest - 1] + step], 1)
                found[rest] = step + differ
            live, step = live[whole], step + 8
        else:
            live, step = live[same], step + 1
            found[live] = step
    return found


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its window starts hold a string that starts at two or more places of the contexts."""
    data = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.cumsum(sizes) - sizes
    n = len(data)
    differs = np.append(data[1:] != data[:-1], True)
    up = np.append(data[:-1] < data[1:], False)
    # The first type B place at or after each context's last window; the byte before a separator is always one.
    change = np.flatnonzero(differs)
    run_end = change[np.searchsorted(change, np.arange(n))]
    type_b = up[run_end]
    places = np.flatnonzero(type_b)
    last = starts + sizes - 1 - length
    stop = places[np.searchsorted(places, last)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stop + 1, -1)
    included = np.cumsum(edge[:-1]) > 0
    edge[:] = 0
    np.add.at(edge, starts, 1)
    np.add.at(edge, last + 1, -1)
    is_window = np.cumsum(edge[:-1]) > 0
    order = suffix_order(data, included, length)
    order = order[is_window[order]]
    long = common_prefixes(data, order, length) >= length
    again = np.zeros(n, bool)
    again[order[long]] = True
    again[order[np.flatnonzero(long) - 1]] = True
    return [again[a : b + 1] for a, b in zip(starts.tolist(), last.tolist(), strict=True)]


_SPAN = pa.schema([("__chunk", pa.int64()), ("refs", pa.binary()), ("windows", pa.int64())])


def _verify(length: int):
    """Rows arrive by (anchor, context). Equal contexts repeat as a whole; others are suffix-sorted by anchor."""

    def settle(groups: list[list[list]]):
        """groups: per anchor [context, whether it repeats as a whole, its row or None]."""
        flat = [e for g in groups if any(not e[1] for e in g) for e in g]
        if not flat:
            return
        for (context, whole, row), again in zip(flat, repeated_windows([e[0] for e in flat], length), strict=True):
            if whole:
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                refs = np.frombuffer(row[1], np.int64).reshape(-1, 2) + np.array([0, a])
                yield row[0], refs.tobytes(), b - a

    def out(found):
        found = list(found)
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int64())], schema=_SPAN)

    def run(batches):
        anchor, group, held, size = None, [], [], 0
        for b in batches:
            found = []
            for m, context, chunk, refs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if m != anchor:
                    if group:
                        held.append(group)
                    if size > SORT_BYTES:
                        found += settle(held)
                        held, size = [], 0
                    anchor, group = m, []
                windows = len(context) - length + 1
                if group and group[-1][0] == context:
                    if not group[-1][1]:
                        first = group[-1][2]
                        found.append((first[0], first[1], windows))
                        group[-1][1:] = [True, None]
                    found.append((chunk, refs, windows))
                elif len(refs) > 16:
                    group.append([context, True, None])
                    found.append((chunk, refs, windows))
                    size += len(context)
                else:
                    group.append([context, False, (chunk, refs)])
                    size += len(context)
            yield out(found)
        yield out(settle([*held, group]))

    return run


def _removed_runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _finish(length: int, each, schema: pa.Schema):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        of: dict[int, list[tuple[int, int]]] = {}
        for refs, windows in zip(spans.column("refs").to_pylist(), spans.column("windows").to_pylist(), strict=True):
            for uid, at in np.frombuffer(refs, np.int64).reshape(-1, 2).tolist():
                of.setdefault(uid, []).append((at, at + windows - 1 + length))
        return each(docs, [_removed_runs(of.get(uid, [])) for uid in docs.column("__uid").to_pylist()])

    return run


def _kept(text: bytes, runs: list[list[int]]) -> bytes:
    if not runs:
        return text
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _chunk_bits(count: int) -> int:
    """Documents in a chunk, as a power of two. A chunk sends a row to each part of the hash range, so with more parts chunks
    are larger: from 1,024 documents below 4 million to 16,384 at 64 million and above."""
    return min(CHUNK_BITS + 4, max(CHUNK_BITS, CHUNK_BITS + (count >> 22).bit_length()))


def _number(documents: int):
    """Adds __uid and __chunk to rows with a __text. A task's chunks end at so many documents or DOCUMENT_BYTES times as many bytes."""

    def run(batches):
        from pyspark import TaskContext

        forget_others("suffixes", _forget)
        task = TaskContext.get().partitionId()
        uid, chunk, rows, size = task << 40, task << 32, 0, 0
        for b in batches:
            chunks = []
            for n in pa.compute.binary_length(b.column("__text")).fill_null(0).to_pylist():
                if rows == documents or (rows and size + n > documents * DOCUMENT_BYTES):
                    chunk, rows, size = chunk + 1, 0, 0
                chunks.append(chunk)
                rows, size = rows + 1, size + n
            uids = np.arange(uid, uid + b.num_rows)
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(uids, pa.int64()), pa.array(chunks, pa.int64())], names=[*b.schema.names, "__uid", "__chunk"])

    return run


def _stage(df: DataFrame) -> tuple[DataFrame, int]:
    """The documents as a table bucketed by chunk in the shared folder, and the number of parts of the hash range."""
    spark, count = df.sparkSession, df.count()
    longs = [T.StructField(n, T.LongType()) for n in ("__uid", "__chunk")]
    rows = df.mapInArrow(_number(1 << _chunk_bits(count)), T.StructType([*df.schema, *longs]))
    return bucketed(rows, "repeats", "__chunk"), max(2 * shuffle_partitions(spark), count // 16_384)


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """Spans of hot windows, each a context of its own: those that their chunk holds twice, and those with an equal one elsewhere."""
    here = F.length("refs") / 16
    hot = contexts.filter("hot").withColumn("n", here.cast("long"))
    settled, asking = hot.filter("n > 1").select("chunk", "refs"), hot.filter("n = 1")
    equal = hot.groupBy("context").agg(F.sum("n").alias("__all")).filter("__all > 1")
    answered = asking.join(equal, "context").select("chunk", "refs")
    return settled.union(answered).select(F.col("chunk").alias("__chunk"), "refs", F.lit(1).cast("long").alias("windows"))


def _spans(staged: DataFrame, parts: int, length: int, gram: int, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    docs = staged.select("__chunk", "__uid", "__text")
    cogroup = lambda flags, fn, schema: docs.groupBy("__chunk").cogroup(flags.groupBy("chunk")).applyInArrow(fn, schema)
    blob, flag = "part long, chunk long, keys binary, twice binary", "chunk long, kind int, part long, bits binary, hot binary"
    anchors = materialize(_by_part(docs.groupBy("__chunk").applyInArrow(_anchor_pass(length, gram, parts), blob)).mapInArrow(_count_repeats(0, hot_chunks), flag), "sa-anchors")
    windows = materialize(_by_part(cogroup(anchors, _window_pass(length, gram, parts), blob)).mapInArrow(_count_repeats(1, hot_chunks), flag), "sa-windows")
    contexts = cogroup(anchors.union(windows), _context_pass(length, gram, parts), "anchor long, context binary, chunk long, refs binary, hot boolean")
    some_hot = bool(anchors.filter("hot is not null").limit(1).count())
    if some_hot:
        contexts = materialize(contexts, "sa-contexts")
    dealt = (contexts.filter("not hot") if some_hot else contexts).drop("hot").repartition("anchor").sortWithinPartitions("anchor", "context")
    spans = dealt.mapInArrow(_verify(length), "__chunk long, refs binary, windows long")
    found = materialize(spans.union(_hot_spans(contexts)) if some_hot else spans, "sa-spans")
    discard(anchors, windows, contexts)
    return found


def repeat_digests(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    bounded_batches(df.sparkSession)
    staged, parts = _stage(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")))
    spans = _spans(staged, parts, length, gram, hot_chunks)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def each(docs: pa.Table, runs: list) -> pa.Table:
        texts = _texts(docs)
        return pa.table([
            docs.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
            pa.array([len(r) for r in runs], pa.int64()), pa.array([sha256(_kept(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)], pa.string()),
        ], schema=schema)

    done = staged.groupBy("__chunk").cogroup(spans.groupBy("__chunk"))
    return done.applyInArrow(_finish(length, each, schema), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """df with the repeated bytes of its text column removed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    rows, name = plain_names(df)
    names, text = rows.columns, name(text_col)
    staged, parts = _stage(rows.withColumnRenamed(text, "__text"))
    spans = _spans(staged, parts, length, gram)
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    schema = to_arrow_schema(fields, timestamp_utc=True)

    def each(docs: pa.Table, runs: list) -> pa.Table:
        texts = docs.column("__text").to_pylist()
        kept = [t if not r else _kept(t.encode(), r).decode("utf-8", errors="ignore") for t, r in zip(texts, runs, strict=True)]
        return pa.table([pa.array(kept, pa.string()) if n == text else docs.column(n).cast(schema.field(n).type) for n in names], schema=schema)

    done = staged.groupBy("__chunk").cogroup(spans.groupBy("__chunk")).applyInArrow(_finish(length, each, schema), fields)
    return done.toDF(*df.columns)
