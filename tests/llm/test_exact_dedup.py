import hashlib

import pytest

from lodestream.llm import exact_dedup as E

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, keep):
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    pick = {t: (max if keep == "largest" else min)((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return sorted(((k, pick[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, text in rows for t in [(text or "").translate(LOWER)]), key=str)


def shape(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("memtable", "digest", "hot"), [(16 << 20, 32, 1024), (2000, 32, 1024), (500, 1, 2)])
def test_matches_brute_force(documents, texts, memtable, digest, hot):
    """Many runs, short digests that collide, and hot digests change nothing."""
    df = E.exact_dedup(documents.repartition(5), keep="largest", memtable_bytes=memtable, digest_bytes=digest, hot_entries=hot)
    assert shape(df) == brute(texts, "largest")


def test_one_row_of_a_group_is_kept(documents):
    rows = E.exact_dedup(documents, keep="largest").collect()
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(odd, keep):
    from .conftest import ODD_ROWS

    df = E.exact_dedup(odd, keep=keep, memtable_bytes=3000)
    assert shape(df) == brute(ODD_ROWS, keep)
    assert sum(r.kept for r in df.collect()) == len({(t or "").translate(LOWER) for _, t in ODD_ROWS})


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) as text").repartition(20)
    got = E.exact_dedup(df, keep="smallest", memtable_bytes=1, hot_entries=4)
    assert {(r.group_size, r.keep_id) for r in got.filter("doc_id % 3 = 0").collect()} == {(1000, 0)}
    assert got.count() == 3000 and got.filter("kept").count() == 2001
    assert E.drop_duplicates(df, memtable_bytes=1, hot_entries=4).count() == 2001


def test_drop_keeps_columns(odd, documents):
    from .conftest import ODD_ROWS

    out = E.drop_duplicates(odd, memtable_bytes=3000)
    assert out.columns == odd.columns
    assert out.count() == len({(t or "").translate(LOWER) for _, t in ODD_ROWS})
    kept = E.exact_dedup(documents, keep="smallest").filter("kept")
    assert sorted(r.doc_id for r in E.drop_duplicates(documents).collect()) == sorted(r.doc_id for r in kept.collect())


def test_empty(empty):
    assert E.exact_dedup(empty).collect() == []
    assert E.drop_duplicates(empty).columns == empty.columns and E.drop_duplicates(empty).count() == 0


def test_lookup(documents):
    runs = E.flush_runs(documents.selectExpr("doc_id as __key", "text as __text"), "__key", "__text", "smallest", True)
    some = runs.first()["__digest"]
    assert E.lookup(runs, [bytes(some)]).count() >= 1
    assert E.lookup(runs, [b"x" * 32]).count() == 0


def test_filters_let_unique_texts_stay_where_they_are(documents):
    """Only entries that another entry's filter answers for reach compaction, and nothing exchanges the runs themselves."""
    runs = E.flush_runs(documents.repartition(5).selectExpr("doc_id as __key", "text as __text"), "__key", "__text", "smallest", False, 2000)
    counts = {}
    for r in runs.select("__digest").collect():
        counts[bytes(r[0])] = counts.get(bytes(r[0]), 0) + 1
    hits = E._where(runs, E.filter_hits(runs), "left_semi").collect()
    assert sorted(bytes(r["__digest"]) for r in hits) == sorted(d for d, n in counts.items() if n > 1 for _ in range(n))
    plan = E.drop_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    above_runs = [line for line in plan.splitlines() if "Exchange" in line and "text" in line]
    assert above_runs == []
