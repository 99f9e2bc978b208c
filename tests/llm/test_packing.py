import struct
import zlib

import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe
from lodestream.llm import packing as P

from .conftest import ODD_ROWS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def check(rows, texts, library):
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    sequences = {}
    for r in rows:
        assert 1 <= r.length <= 1024
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if len(ids[r.doc_id]) == 1:
            part = ids[r.doc_id][0][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(x) for lists in ids.values() for x in lists)
    for key, lists in ids.items():
        if len(lists) == 1:
            own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == key)
            assert [p for p, _, _ in own] == list(range(len(own))) and own[0][1] == 0
            assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
            assert len(own) == 1 if len(lists[0]) <= 1024 else all(n == 1024 for _, _, n in own[1:])
    return len(sequences)


def test_whole_table(documents, texts, library):
    rows = P.pack_documents(documents).collect()
    bins = check(rows, texts, library)
    least = -(-sum(r.length for r in rows) // 1024)
    assert bins <= least * 1.02 + 1


def test_odd_rows(odd, empty, library):
    rows = P.pack_documents(odd).collect()
    check(rows, ODD_ROWS, library)
    assert P.pack_documents(empty).collect() == []


def test_runs_of_millions_of_characters(spark, library):
    texts = [(i, run) for i, run in enumerate(["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "^" * 1_200_000, "\x00" * 2_000_000, "\u2003 " * 600_000, " " * 99_999])]
    rows = P.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    check(rows, texts, library)


def test_fullest_combination_is_exact():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(200):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(0, 60)
        got = P.fullest_combination(counts, room)
        assert all(got[n] <= counts[n] for n in got)
        best = max(s for pick in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * k for n, k in zip(counts, pick))) <= room)
        assert sum(n * k for n, k in got.items()) == best


def test_plan_takes_everything_once():
    import random

    r = random.Random(1)
    histogram = {n: r.randrange(1, 10_000) for n in r.sample(range(1, 600), 300)}
    used: dict[int, int] = {}
    bins = 0
    for combination, times in P.plan_bins(histogram):
        assert sum(n * k for n, k in combination.items()) <= 1024
        bins += times
        for n, k in combination.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
    assert bins <= -(-sum(n * c for n, c in histogram.items()) // 1024) * 1.01 + 1
