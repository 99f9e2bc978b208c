"""Operator 4: fuzzy search for short licence notices.

A text is brought to lower-case words with single spaces. A notice that may have k errors is cut into k + 1 pieces; by the
pigeonhole principle any match with at most k edits holds one of them unchanged, so an automaton over all pieces finds
every candidate place. The regex library's bounded-error matching then verifies the edits in the window of each candidate
and gives the span; a window is as long as its notice with all errors, so the search is linear in the text. Edits are counted
on characters. Of matches of one notice that share a word the one with the fewest edits is reported, the first of equals; so
every place with at most k edits shares a word with a reported one that has no more. Base phrases are matched exactly, word
by word, at all their places.

Defined cases: a null text counts as empty and has no words, labels or places and the score 0; texts of any length are
searched whole; rows are independent, so ties, repeated rows, null ids and empty tables need no rule; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (notice, label, errors allowed)
NOTICES = (
    ("released under the mit license", "mit", 1),
    ("licensed under the mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache-2.0", 3),
    ("apache license version 2 0", "apache-2.0", 2),
    ("gnu general public license", "gpl", 2),
    ("licensed under the gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license version 2 0", "mpl-2.0", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("creative commons attribution", "cc-by", 2),
    ("all rights reserved", "reserved", 1),
    ("released into the public domain", "public-domain", 2),
    ("this is free and unencumbered software", "unlicense", 3),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
)
#: A-Z to a-z; every byte that is no word character to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Windows whose verification a Python worker remembers; the memory is emptied when full.
KNOWN_WINDOWS = 50_000


@dataclass(frozen=True)
class Hit:
    label: str
    base: bool
    first_word: int
    n_words: int
    edits: int
    likeness: float
    matched: str


class Scanner:
    """Base phrases and notices, ready for search."""

    def __init__(self, base=BASE_PHRASES, notices=NOTICES):
        import ahocorasick
        import regex

        self.base = [(f" {p} ", label, len(p.split())) for p, label in base]
        self.seeds = ahocorasick.Automaton()
        self.notices = []
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for no, (notice, label, k) in enumerate(notices):
            padded = f" {notice} "
            if len(padded) <= 4 * k:
                raise ValueError(f"{k} errors are too many for {notice!r}: a window could hold two notices")
            self.notices.append((regex.compile(f"(?b)(?:{regex.escape(padded, literal_spaces=True)}){{e<={k}}}"), label, padded, k))
            cuts = [len(padded) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(padded[a:b], []).append((no, b))
        for seed, places in found.items():
            self.seeds.add_word(seed, places)
        self.seeds.make_automaton()

    def verify(self, letters: str, no: int, start: int) -> tuple[int, int, int] | None:
        """(start, stop, edits) of the best match in the window that a seed asks for: where the notice would start at `start`,
        with room for all its errors on both sides. The window bounds the cost, and equal windows are verified once."""
        pattern, _, padded, k = self.notices[no]
        if letters.startswith(padded, start):
            return start, start + len(padded), 0
        a, b = max(0, start - k), start + len(padded) + k
        window = letters[a:b]
        try:
            hit = self.known[no, window]
        except KeyError:
            if len(self.known) >= KNOWN_WINDOWS:
                self.known.clear()
            m = pattern.search(window)
            hit = self.known[no, window] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m and m.group().strip() else None
        return hit and (a + hit[0], a + hit[1], hit[2])

    def scan(self, text: str) -> tuple[int, list[Hit]]:
        """Number of words, and all hits: base phrases at every place; of a notice's matches that share a word the one with the
        fewest edits (the first of equals)."""
        words = text.encode().translate(_TABLE).split()
        letters = f" {b' '.join(words).decode()} "
        found: list[tuple[str, bool, int, int, int, float]] = []  # label, base, start and stop without outer spaces, edits, likeness
        for phrase, label, _ in self.base:
            at = letters.find(phrase)
            while at >= 0:
                found.append((label, True, at + 1, at + len(phrase) - 1, 0, 1.0))
                at = letters.find(phrase, at + 1)
        asked = {(no, max(0, end + 1 - stop)) for end, places in self.seeds.iter(letters) for no, stop in places}
        if not found and not asked:
            return len(words), []
        spaces = [i for i, c in enumerate(letters) if c == " "]
        matches: dict[int, set[tuple[int, int, int]]] = {}
        for no, start in asked:
            if hit := self.verify(letters, no, start):
                a, b, edits = hit
                while letters[a] == " ":
                    a += 1
                while letters[b - 1] == " ":
                    b -= 1
                matches.setdefault(no, set()).add((edits, a, b))
        for no, several in matches.items():
            _, label, padded, _ = self.notices[no]
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(several):
                span = bisect_left(spaces, a) - 1, bisect_left(spaces, b)  # its first word, and the one after it
                at = bisect_left(taken, span)
                if (at < len(taken) and taken[at][0] < span[1]) or (at and taken[at - 1][1] > span[0]):
                    continue
                taken.insert(at, span)
                found.append((label, False, a, b, edits, 1 - edits / len(padded)))
        hits = []
        for label, base, a, b, edits, likeness in found:
            first = bisect_left(spaces, a) - 1
            hits.append(Hit(label, base, first, bisect_left(spaces, b) - first, edits, likeness, letters[a:b]))
        return len(words), hits


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def notice_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a hit: doc_id, label, base, first_word, n_words, edits, likeness, matched."""
    bounded_batches(df.sparkSession)

    def run(batches):
        scan = scanner().scan
        for b in batches:
            rows = [(key, h) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in scan(text or "")[1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in rows], pa.int64()), pa.array([h.label for _, h in rows], pa.string()), pa.array([h.base for _, h in rows], pa.bool_()), pa.array([h.first_word for _, h in rows], pa.int64()),
                pa.array([h.n_words for _, h in rows], pa.int64()), pa.array([h.edits for _, h in rows], pa.int32()), pa.array([h.likeness for _, h in rows], pa.float64()), pa.array([h.matched for _, h in rows], pa.string()),
            ], names=["doc_id", "label", "base", "first_word", "n_words", "edits", "likeness", "matched"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, label string, base boolean, first_word long, n_words long, edits int, likeness double, matched string")


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best likeness)."""
    bounded_batches(df.sparkSession)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def digest(text: str) -> tuple:
        n, hits = scanner().scan(text)
        base = [h for h in hits if h.base]
        places = [h.first_word for h in base]
        joined = lambda found: ",".join(sorted({h.label for h in found}))
        return n, len(base), min(places, default=None), max(places, default=None), joined(base), joined(hits), max((h.likeness for h in hits), default=0.0)

    def run(batches):
        for b in batches:
            rows = [digest(t or "") for t in b.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
