import re

import numpy as np
import pytest

from lodestream.llm import neardup as N

from .conftest import LONG, ODD_ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(find(i), []).append(key)
    pick = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(((key, len(sets[i]), pick[find(i)], key == pick[find(i)]) for i, (key, _) in enumerate(rows)), key=str)


def shape(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold", [80, 85])
def test_matches_brute_force(documents, texts, threshold):
    assert shape(N.near_duplicates(documents, threshold)) == brute(texts, threshold)


def test_planted_copies(spark):
    import random

    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(25):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60, 300))]
        for c in range(r.randrange(1, 6)):
            copy = list(words)
            for _ in range(c):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy) if c % 2 else " ".join(copy).upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for threshold in (80, 85):
        assert shape(N.near_duplicates(df, threshold)) == brute(rows, threshold)


def test_hot_group_of_near_copies(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{words} own{i}" if i % 3 == 0 else f"alone{i} " * 8) for i in range(900)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 85).collect()
    assert len(got) == 900
    assert {r.component_id for r in got if r.doc_id % 3 == 0} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id % 3)


def test_family_of_near_misses_in_small_blocks(spark):
    """Texts around the threshold: many meet in one bucket and few are links. Blocks of two kilobytes cut it into many cells."""
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(240):
        copy = list(words)
        for _ in range(2 if i % 5 else 1):
            copy[r.randrange(len(copy))] = f"own{r.randrange(60)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 85)
    assert 1 < len({c for _, _, c, _ in want}) < 240
    for size in (2_000, 20_000, N.BLOCK_BYTES):
        assert shape(N.near_duplicates(df, 85, block_bytes=size)) == want


def test_block_index_counts_exactly():
    r = np.random.RandomState(5)
    common = r.randint(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[r.rand(60) < 0.7], r.randint(0, 1 << 62, 30).astype(np.uint64), r.randint(0, 400, 40).astype(np.uint64)])) for _ in range(90)]
    want = [[len(np.intersect1d(a, b)) for b in sets[:50]] for a in sets[50:]]
    assert N.BlockIndex(sets[:50]).shared(sets[50:]).tolist() == want


def test_odd_rows(odd, empty):
    got = N.near_duplicates(odd, 85)
    want = brute(ODD_ROWS, 85)
    assert [(a, b, c) for a, b, c, _ in shape(got)] == [(a, b, c) for a, b, c, _ in want]
    assert N.near_duplicates(empty).collect() == []
    out = N.drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.count() >= 1
    assert N.drop_near_duplicates(empty).count() == 0


def test_null_and_repeated_ids_row_by_row(spark):
    """One row of each component stays, whatever the ids: against brute force on the rows' own numbers."""
    import random

    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda: " ".join(r.choice(vocabulary) for _ in range(80))
    near = lambda text, own: f"{text} own{own}"
    a, b, c, d, e = (fresh() for _ in range(5))
    rows = [
        (3, a), (5, near(a, 1)), (5, fresh()),  # a repeated id whose second row is clean
        (7, b), (7, near(b, 2)), (7, b), (9, near(b, 3)),  # the smallest id repeats inside the component
        (None, c), (4, near(c, 4)), (None, near(c, 5)),  # null ids linked to a document
        *[(None, near(d, n)) for n in range(40)], (None, d),  # null ids alone
        (None, None), (None, ""), (6, None), (6, ""), (6, e), (None, e), (None, fresh()),
    ]
    root = brute([(n, t) for n, (_, t) in enumerate(rows)], 80)
    component = {n: least for n, _, least, _ in root}
    groups = {}
    for n in range(len(rows)):
        groups.setdefault(component[n], []).append(n)
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(5)
    stays = [x.row for x in N.drop_near_duplicates(df).collect()]
    assert len(stays) == len(set(stays)) == len(groups)
    order = lambda n: (rows[n][0] is None, rows[n][0] or 0)
    for members in groups.values():
        (one,) = set(members) & set(stays)
        assert order(one) == min(map(order, members))
    got = N.near_duplicates(df).collect()
    least = {n: min((rows[m][0] for m in members if rows[m][0] is not None), default=None) for members in groups.values() for n in members}
    assert sorted(str((x.doc_id, x.component_id)) for x in got) == sorted(str((rows[n][0], least[n])) for n in range(len(rows)))
    assert sorted(str((x.doc_id, x.component_id)) for x in got if x.kept) == sorted(str((rows[n][0], least[n])) for n in stays)


def test_signature_agrees_with_similarity():
    a = N.shingle_set(" ".join(f"w{i}" for i in range(1000)).encode())
    b = N.shingle_set(" ".join(f"w{i}" for i in range(200, 1200)).encode())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = N.circulant_signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - true) < 0.08


def test_words_and_long_texts():
    assert len(N.shingle_set("a b c\x0bd e f".encode())) == 1
    assert len(N.shingle_set("a\x1cb c\x0bd e f g".encode())) == len(shingles("a\x1cb c\x0bd e f g"))
    assert len(N.shingle_set(LONG.encode())) == len(shingles(LONG))
