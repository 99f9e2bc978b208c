import hashlib
import random

from pyspark.sql import functions as F

from lodestream.llm import lzprint as Z

from .conftest import ODD_ROWS


def phrases(text):
    """The plain parse: shortest new string at each place; what is left may be a known one."""
    seen, at, out = set(), 0, []
    while at < len(text):
        size = 1
        while text[at : at + size] in seen and at + size < len(text):
            size += 1
        out.append(text[at : at + size])
        seen.add(out[-1])
        at += size
    return out


def test_parse_is_the_plain_one():
    r = random.Random(2)
    for n in [0, 1, 2, 5, 50, 400, 3000]:
        for alphabet in ("a", "ab", "abcdefghij klmno"):
            text = "".join(r.choice(alphabet) for _ in range(n))
            ends = Z.parse(text, 0, set())
            cuts = [0, *ends] + ([n] if n and (not ends or ends[-1] < n) else [])
            assert [text[a:b] for a, b in zip(cuts, cuts[1:])] == phrases(text)


def brute(rows):
    order = sorted(rows, key=lambda x: -x[0])
    out = {}
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = Z.fingerprint(text), Z.fingerprint(edited), Z.fingerprint(after)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), other.hex(), Z.likeness(own, other), Z.likeness(own, following))
    return out


def test_matches_brute_force(documents, texts):
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in Z.edit_fingerprints(documents.repartition(7)).collect()}
    assert got == brute(texts)


def test_edited_texts_are_nearer_than_others(documents):
    rows = [r for r in Z.edit_fingerprints(documents).collect() if r.n_chars > 500]
    assert sum(r.near_edited for r in rows) / len(rows) > 0.35
    assert sum(r.near_edited > r.near_next for r in rows) / len(rows) > 0.9


def test_likeness_follows_shared_text():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(2000))
    parts = [Z.likeness(Z.fingerprint(text), Z.fingerprint(text[: int(len(text) * keep)] + " ".join(r.choice(words) for _ in range(int(2000 * (1 - keep)))))) for keep in (1.0, 0.8, 0.5, 0.0)]
    assert parts[0] == 1.0 and parts[0] > parts[1] > parts[2] > parts[3]


def test_equal_texts_and_empty_ones():
    assert Z.fingerprint("same text") == Z.fingerprint("same text")
    assert Z.likeness(Z.fingerprint(""), Z.fingerprint("")) == 1.0
    assert Z.likeness(Z.fingerprint(""), Z.fingerprint("x")) == 0.0


def test_odd_rows(odd, empty, spark):
    got = Z.edit_fingerprints(odd).collect()
    assert len(got) == len(ODD_ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert Z.edit_fingerprints(empty).collect() == []
    assert Z.fingerprints(empty).collect() == []
    (one,) = Z.edit_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_common_ids(spark):
    """A null id and another one that hold a third of the rows each: spread over tasks, and every row has its next one."""
    rows = [((None, 5, i)[i % 3], f"text number {i} " * 3) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    prepared = Z.with_next(df.selectExpr("doc_id as key", "text").withColumn("tie", F.xxhash64("text")))
    ranges = [r["count"] for r in prepared.filter("not lent").groupBy("range").count().collect()]
    assert max(ranges) < 200 and sum(ranges) == 900
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    ids = [r.doc_id for r in Z.edit_fingerprints(df).collect()]
    assert sorted(ids, key=str) == sorted([r[0] for r in order], key=str)
    ties = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -ties[r[1]]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + order[(i + 1) % 900][1][: len(t) // 3]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in Z.edit_fingerprints(df).collect()) == want
