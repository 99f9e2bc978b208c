import hashlib
import random

import numpy as np
import pytest

from lodestream.llm import suffixes as X

from .conftest import ODD_ROWS


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    places = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = b"\x01" * length
    out = []
    for (key, _), t, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((key, len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shape(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_matches_brute_force(documents, texts):
    assert shape(X.repeat_digests(documents)) == brute(texts, 200)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab") for _ in range(r.randrange(20, 90))) for _ in range(12)] + ["a" * 70, "ab" * 40, "é" * 25]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice("abcdé") for _ in range(30)) for _ in range(r.randrange(0, 8)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shape(X.repeat_digests(df, length=50, gram=20)) == brute(rows, 50)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors(spark, hot, monkeypatch):
    """Anchors in more than `hot` chunks take the way that keeps their windows in place."""
    monkeypatch.setattr(X, "CHUNK_BITS", 2)
    r = random.Random(hot)
    common = "".join(r.choice("abcdefgh") for _ in range(90))
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(r.randrange(5, 80))) + (common if i % 3 else common[:70]) + "".join(r.choice("ab") for _ in range(40))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shape(X.repeat_digests(df, length=50, gram=20, hot_chunks=hot)) == brute(rows, 50)


def test_one_document_repeats_itself(spark):
    rows = [(1, "x" * 1000), (2, "0123456789" * 100), (3, "".join(chr(97 + i * i % 26) + str(i) for i in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shape(X.repeat_digests(df)) == brute(rows, 200)


def test_odd_rows(odd, empty):
    rows = [(k, t) for k, t in ODD_ROWS]
    got = {r[0]: r for r in shape(X.repeat_digests(odd))}
    assert len(X.repeat_digests(odd).collect()) == len(rows)
    assert got[4][2] == got[4][1]  # the long text but for nothing stands in another document
    assert got[11][2] == 5000
    assert X.repeat_digests(empty).collect() == []
    assert X.remove_repeats(empty).columns == empty.columns
    out = X.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(rows)


def test_removed_texts_agree_with_digests(documents):
    texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in X.remove_repeats(documents).collect()}
    digests = {r.doc_id: r.kept_sha256 for r in X.repeat_digests(documents).collect()}
    same = sum(texts[k] == digests[k] for k in texts)
    assert same >= 0.95 * len(texts)  # the rest lost a cut character's remains


def test_suffix_order_is_sorted():
    r = random.Random(1)
    for alphabet in (b"ab", b"abcdefgh", b"a"):
        data = np.array([r.choice(alphabet) for _ in range(500)] + [255], np.uint8)
        order = X.suffix_order(data, np.ones(len(data), bool), 600)
        text = data.tobytes()
        assert order.tolist() == sorted(range(len(text) - 1), key=lambda i: text[i:])  # the separator itself isn't sorted
        lcp = X.common_prefixes(data, order, 600)
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), lcp[1:].tolist()):
            m = 0
            while max(a, b) + m < len(text) and text[a + m] == text[b + m]:
                m += 1
            assert n == m


def test_chunks_are_bounded_in_bytes_and_leave_no_table(spark):
    rows = [(i, ("abcdefghij"[i % 10] * 30_000) if i % 2 else "short") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, __text string").coalesce(1)
    staged, _ = X._stage(df)
    sizes = {}
    for r in staged.collect():
        sizes.setdefault(r["__chunk"], []).append(len(r["__text"]))
    limit = (1 << X.CHUNK_BITS) * X.DOCUMENT_BYTES
    assert len(sizes) > 1 and all(sum(s) <= limit or len(s) == 1 for s in sizes.values())
    assert sum(map(len, sizes.values())) == 300 and len({r["__uid"] for r in staged.collect()}) == 300
    X.repeat_digests(df.withColumnRenamed("__text", "text")).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


def test_direct_sorting_in_small_slices(monkeypatch):
    r = random.Random(12)
    for _ in range(40):
        data = np.frombuffer(bytes(r.choice(b"ab\x00\xfe") for _ in range(300)) + b"abab" * 20, np.uint8)
        some = np.array(sorted(r.sample(range(len(data)), 150)))
        text = data.tobytes()
        want = sorted((text[i : i + 50] for i in some.tolist()))
        monkeypatch.setattr(X, "SORTED", r.choice([1, 7, 1000]))
        assert [text[i : i + 50] for i in X._direct_order(data, text, some, 50).tolist()] == want
