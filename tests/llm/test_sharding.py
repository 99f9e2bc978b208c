import math
import zlib
from collections import Counter

import xxhash

from lodestream.llm import sharding as S

from .conftest import ODD_ROWS


def test_law_slots_and_growth(documents, texts):
    rows = S.shard_records(documents).collect()
    of = dict(texts)
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        assert r.size == len(of[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(of[r.doc_id].encode())
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_the_highest_bid_wins(documents):
    """Against bids made one by one, with the hash of another library."""
    as_bytes = lambda x, n: x.to_bytes(n, "little", signed=True)

    def bid(key, i):
        h = xxhash.xxh64_intdigest(as_bytes(i, 4), xxhash.xxh64_intdigest(as_bytes(key, 8), 42))
        return math.log(((h >> 11) + 0.5) / 2**53)

    for r in S.shard_records(documents).collect():
        bids = [bid(r.doc_id, i) for i in range(41)]
        assert r.shard == max(range(40), key=bids.__getitem__) and r.grown_shard == max(range(41), key=bids.__getitem__)


def test_copies_of_one_row_spread_over_cells(spark):
    from lodestream.llm.common import dense_rank_slots

    df = spark.range(6400).selectExpr("1 as shard", "7L as doc_id", "id as tie")
    plan = dense_rank_slots(df, ["shard"], ["doc_id", "tie"], "slot", 1, 64)
    assert sorted(r.slot for r in plan.collect()) == list(range(6400))
    rows = S.shard_records(spark.range(4000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")).collect()
    assert sorted(r.slot for r in rows) == list(range(4000))


def test_shares_follow_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    found = Counter(r.shard for r in S.shard_records(df, [1.0, 2.0, 0.0, 1.0]).select("shard").collect())
    assert 2 not in found
    assert abs(found[1] / 20_000 - 0.5) < 0.02 and abs(found[0] / 20_000 - 0.25) < 0.02


def test_few_records_move(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    moved = S.shard_records(df).filter("shard <> grown_shard").count()
    assert 300 < moved < 700  # about 1 / 41


def test_no_python_in_the_plan(documents):
    plan = S.shard_records(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_rows(odd, empty):
    rows = S.shard_records(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 16 for _, t in ODD_ROWS)
    assert len({r.shard for r in rows if r.doc_id == 8}) == 1
    assert S.shard_records(empty).collect() == []


def test_hot_key(spark):
    df = spark.range(5000).selectExpr("7L as doc_id", "'x' as text")
    rows = S.shard_records(df).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(5000))
