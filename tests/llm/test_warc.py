import gzip
import hashlib

import pytest

from lodestream.llm import warc as W
from lodestream.llm.common import read_table


@pytest.fixture(scope="module")
def pages(spark, sf):
    return read_table(spark, sf, "pages")


def test_write_and_read(pages, tmp_path):
    archive = W.lay_out(W.to_records(pages))
    W.write_warc(archive, str(tmp_path / "a"))
    back = W.read_warc(pages.sparkSession, str(tmp_path / "a")).collect()
    assert sorted((r.url, r.html) for r in back) == sorted((r.url, r.html) for r in pages.collect())
    leaves = W.leaves(archive).collect()
    assert sorted((r.offset, r.length) for r in back) == sorted((r.start, r.stop - r.start) for r in leaves)


def test_audit_finds_the_damage_and_little_else(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://x/', id) as url", "concat('<p>', id, '</p>') as html")
    archive = W.lay_out(W.to_records(pages))
    bad = archive.selectExpr("page_id", "url", "if(page_id in (5, 1717), concat(left(record, length(record) - 5), '?', right(record, 4)), record) as record", "file", "pos")
    found, compared = W.audit(W.build_tree(W.leaves(archive)), W.build_tree(W.leaves(bad)))
    assert sorted(r.page_id for r in found.collect()) == [5, 1717]
    assert compared[0] == 1 and compared[-1] == 2 * W.FAN
    same, compared = W.audit(W.build_tree(W.leaves(archive)), W.build_tree(W.leaves(archive)))
    assert same.count() == 0 and compared[0] == 1 and sum(compared[1:]) == 0


def test_missing_records(spark):
    pages = spark.range(600).selectExpr("id as page_id", "'u' as url", "'h' as html")
    archive = W.lay_out(W.to_records(pages))
    found, _ = W.audit(W.build_tree(W.leaves(archive)), W.build_tree(W.leaves(archive.filter("page_id <> 77"))))
    kinds = {r.page_id: (r.kind, r.actual is None) for r in found.collect()}
    assert kinds == {77: ("missing", True), 78: ("moved", False), 79: ("moved", False)}


def test_report_against_brute_force(pages):
    rows = W.fixity_report(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.damaged == (r.page_id % 97 == 13 or r.page_id % 211 == 5 or r.page_id % 401 == 7) == (r.record_sha256 != r.replica_sha256)
        assert (r.replica_sha256 is None) == (r.page_id % 401 == 7)
    records = {r.page_id: r.record for r in W.to_records(pages).collect()}
    assert all(hashlib.sha256(records[r.page_id].encode()).hexdigest() == r.record_sha256 for r in rows)
    order = sorted(rows, key=lambda r: (r.file, r.start))
    assert [r.page_id for r in order] == sorted(records)


def test_odd_rows(spark):
    rows = [(None, None, None)] * 700 + [(1, "u", "h")] * 700 + [(2, "", ""), (3, "ü", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("missing", "x").selectExpr("*", "1 as file", "2 as pos", "'r' as record")
    got = W.fixity_report(pages).collect()
    assert len(got) == len(rows)
    assert max(r.file for r in got) == (len(rows) - 1) // W.FILE_RECORDS
    assert W.fixity_report(pages.limit(0)).collect() == []


RECORD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u%d\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def ranges(data):
    return [(r["pos"], r["offset"], r["length"], r["inner"], r["status"]) for r in W.parse_warc(data)]


def test_gzip_members():
    members = [gzip.compress(RECORD % i) for i in range(3)]
    found = list(W.parse_warc(b"".join(members)))
    assert [r["content"] for r in found] == [b"hello"] * 3
    at = 0
    for r, m in zip(found, members):
        assert (r["offset"], r["length"], r["inner"]) == (at, len(m), 0) and gzip.decompress(b"".join(members)[at : at + len(m)]) == RECORD % r["pos"]
        at += len(m)
    one = gzip.compress(b"".join(RECORD % i for i in range(3)))
    assert [r[:4] for r in ranges(one)] == [(i, 0, len(one), i * len(RECORD % 1)) for i in range(3)]


def test_damage_is_reported_and_the_scan_goes_on():
    a, b, c = (RECORD % i for i in range(3))
    n = len(a)
    assert ranges(a + b + c) == [(i, i * n, n, 0, "ok") for i in range(3)]
    assert ranges(a + b"x" + b + c) == [(0, 0, n, 0, "ok"), (None, n, 1, 0, "stray"), (1, n + 1, n, 0, "ok"), (2, 2 * n + 1, n, 0, "ok")]
    assert ranges(a + b + c[:-6]) == [(0, 0, n, 0, "ok"), (1, n, n, 0, "ok"), (2, 2 * n, n - 6, 0, "damaged")]
    assert ranges(a + b[: n - 9] + b"\r\n\r\n" + c) == [(0, 0, n, 0, "ok"), (1, n, n - 5, 0, "damaged"), (2, 2 * n - 5, n, 0, "ok")]
    for length in (b"x", b"99999", b"3", b"-1", b""):
        broken = b.replace(b"Content-Length: 5", b"Content-Length: " + length)
        assert [r[-1] for r in ranges(a + broken + c)] == ["ok", "damaged", "ok"] and ranges(a + broken + c)[1][1:3] == (n, len(broken))
    assert ranges(b"") == [] and ranges(b"no archive") == [(None, 0, 10, 0, "stray")]
    members = [gzip.compress(x) for x in (a, b, c)]
    bad = bytearray(members[1])
    bad[len(bad) // 2] ^= 255
    statuses = [(r[1], r[-1]) for r in ranges(members[0] + bytes(bad) + members[2])]
    assert statuses[0] == (0, "ok") and (len(members[0]), "broken") in statuses and statuses[-1] == (len(members[0]) + len(bad), "ok")
    assert "broken" in [r[-1] for r in ranges(members[0] + members[1][:-12])]


def test_audit_of_written_archives(spark, pages, tmp_path):
    archive = W.lay_out(W.to_records(pages)).cache()
    for name, compression in (("a", "none"), ("b", "gzip"), ("c", "none")):
        W.write_warc(archive, str(tmp_path / name), compression)
    same, compared = W.audit_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert same.count() == 0 and compared[0] == 1 and sum(compared[1:]) == 0
    (file,) = (tmp_path / "c" / "file=0").glob("part-*")
    data = bytearray(file.read_bytes())
    places = sorted((r.start, r.stop, r.pos) for r in W.leaves(archive).filter("file = 0").collect())
    (start, stop, _), (_, later, _) = places[3], places[9]
    data[(start + stop) // 2] ^= 1
    del data[later - 20 : later - 15]
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink()  # as of a file that comes from elsewhere
    found = {r.pos: r.kind for r in W.audit_archives(spark, str(tmp_path / "a"), str(tmp_path / "c"))[0].collect()}
    assert found[3] == found[9] == "changed" and set(found.values()) == {"changed", "moved"}
    assert sorted(p for p, kind in found.items() if kind == "changed") == [3, 9]
    scanned = W.read_warc(spark, str(tmp_path / "c" / "file=0")).collect()
    assert len(scanned) == len(places) and sum(r.status == "damaged" for r in scanned) >= 1


def test_moved_ranges_change_the_nodes_above(spark):
    leaf = spark.createDataFrame([(i, 0, i, 10 * i, 10 * i + 10, f"h{i}") for i in range(40)], "page_id long, file long, pos long, start long, stop long, hash string")
    moved = leaf.selectExpr("page_id", "file", "pos", "start + if(pos > 20, 1, 0) as start", "stop + if(pos > 20, 1, 0) as stop", "hash")
    found, compared = W.audit(W.build_tree(leaf), W.build_tree(moved))
    assert compared[0] == 1 and {r.kind for r in found.collect()} == {"moved"}
