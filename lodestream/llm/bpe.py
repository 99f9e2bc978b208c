"""Operator 3: byte-level BPE encoding and decoding on a contiguous rank array.

A word is a list of part boundaries and, beside it, the rank of each adjacent pair. The smallest rank is found by a scan,
its boundary is deleted, and the two neighbouring ranks are refreshed, until no pair has a rank. Scans are cheap because
words are short; words over LONG bytes use a heap over linked parts, which merges in the same order without the
quadratic cost.

Defined cases: a null text counts as empty and has no ids; special tokens in a text become their single id; texts of any
length are encoded whole; rows are independent, so ties, repeated rows and empty tables need no rule; other columns are
not read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

NONE = 1 << 60
#: Words over so many bytes are merged by a heap.
LONG = 256
#: Words whose ids a Python worker remembers; the memory is emptied when full.
CACHE_WORDS = 300_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers of the regex library that came after Unicode 16, which the vocabulary's library follows.
LATE_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATE_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
_ranges = lambda pairs: "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)
_LATE = re.compile(f"[{_ranges(LATE_LETTERS + LATE_NUMBERS)}]")
_LETTER, _NUMBER = f"[\\p{{L}}--[{_ranges(LATE_LETTERS)}]]", f"[\\p{{N}}--[{_ranges(LATE_NUMBERS)}]]"
#: The same split where a text has such characters.
LATE_SPLIT = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:(?!{_LETTER}|{_NUMBER})\S)+|\s+(?!\S)|\s+"
#: The same split for texts of these characters alone, where the faster standard library agrees with \p classes.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ‘-„–—]")
_PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ranks: dict[bytes, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(as_bytes(left) + as_bytes(right), rank)
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in special.items()}
        self.special = special
        self.split, self.late_split = regex.compile(SPLIT), regex.compile(LATE_SPLIT)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        whole = self.ids.get(word)
        if whole is not None and (len(word) == 1 or word in self.ranks):
            # a vocabulary made of merges reaches a whole-word token whenever one exists
            return (whole,)
        if len(word) > LONG:
            return self._merge_long(word)
        rank, n = self.ranks.get, len(word)
        at = list(range(n + 1))
        ranks = [rank(word[i : i + 2], NONE) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            del at[i + 1]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(word[at[i] : at[i + 2]], NONE)
            if i:
                ranks[i - 1] = rank(word[at[i - 1] : at[i + 1]], NONE)
        ids = self.ids
        return tuple([ids[word[a:b]] for a, b in zip(at, at[1:], strict=False)])

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        n, rank = len(word), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        live = bytearray(b"\x01" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or end[j] != stop:  # one of the two parts has changed meanwhile
                continue
            live[j], end[i], after[i] = 0, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank(word[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if (p := before[i]) >= 0 and (r := rank(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ids[word[i : end[i]]])
            i = after[i]
        return tuple(out)

    def words(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return _PLAIN_SPLIT.findall(text)
        return (self.late_split if _LATE.search(text) else self.split).findall(text)

    def _ordinary(self, text: str) -> list[int]:
        cache, words = self.cache, self.words(text)
        try:
            return list(chain.from_iterable([cache[w] for w in words]))
        except KeyError:
            pass
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out: list[int] = []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = self.merge_word(w.encode())
                if len(w) <= 64:
                    cache[w] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if i % 2 else self._ordinary(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; unknown ids are left out, byte sequences that are not UTF-8 become U+FFFD."""
        token = self.tokens.get
        return b"".join([token(i, b"") for i in ids]).decode("utf-8", errors="replace")


_loaded: dict[str, RankArrayBPE] = {}


def codec(path: str) -> RankArrayBPE:
    """The worker's one codec for a vocabulary."""
    if path not in _loaded:
        _loaded[path] = RankArrayBPE(path)
    return _loaded[path]


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode_documents(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    path = vocabulary or default_vocabulary()
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = codec(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(df[id_col].cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids count as none."""
    path = vocabulary or default_vocabulary()
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without shipping ids between processes."""
    path = vocabulary or default_vocabulary()
    bounded_batches(df.sparkSession)

    def run(batches):
        bpe = codec(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_sha.append(sha256(little_endian(ids)).hexdigest())
                text_sha.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
