import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators.chunking import chunk_documents


def restated(pieces, size, least, overlap):
    """The packing rule, one piece at a time."""
    held, n, out = [], 0, []
    for piece in pieces:
        if held and n + len(piece) > size:
            out.append(" ".join(held))
            held = held[-overlap:] if 0 < overlap <= len(held) else []
            n = sum(map(len, held)) + len(held) - 1 if held else 0
        held.append(piece)
        n += len(piece) + 1
    return [*out, " ".join(held)] if held and n >= least else out


def split(spark, text, size=1000, least=50, overlap=1, mode="line"):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(X.chunks(F.col("text"), size, least, overlap, mode)).first()[0]


@pytest.mark.parametrize(("text", "size", "least", "overlap", "want"), [
    ("", 1000, 50, 1, []),
    (None, 1000, 50, 1, []),
    ("  hi  ", 1000, 50, 1, ["  hi  "]),
    ("\n".join(["a" * 30, "b" * 30, "c" * 20]), 60, 10, 1, ["a" * 30, "a" * 30 + " " + "b" * 30, "b" * 30 + " " + "c" * 20]),
    ("a" * 40 + "\n" + "b" * 40, 60, 50, 0, ["a" * 40]),
    ("a" * 20 + "\n" * 40, 1000, 50, 1, []),
    ("One. Two! Three?", 1000, 5, 1, ["One. Two! Three?"]),
    ("a" * 49 + "\n", 1000, 50, 1, ["a" * 49]),
])
def test_stated_cases(spark, text, size, least, overlap, want):
    assert split(spark, text, size, least, overlap) == want


def test_long_line(spark):
    assert [len(c) for c in split(spark, "x" * 1900)] == [1000, 2001, 1101]


def test_literal_backslash_s_breaks_a_line(spark):
    assert split(spark, r"One.\sss Two " + "x" * 50, 1000, 5, 1) == ["One. Two " + "x" * 50]
    df = spark.createDataFrame([(r"One.\sss Two?\snd a. b",)], "text string")
    assert df.select(X.lines(F.col("text"))).first()[0] == ["One.", "Two?", "nd a. b"]
    assert df.select(X.lines(F.lit("One. Two!  Three"), "sentence")).first()[0] == ["One.", "Two!", "Three"]


def test_strip_is_unicode(spark):
    df = spark.createDataFrame([("\x1c 　 a b  \x85\t",)], "text string")
    assert df.select(X.strip(F.col("text"))).first()[0] == "a b"


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        X.slice_step(50)


@pytest.mark.parametrize(("size", "least", "overlap"), [(100, 20, 1), (80, 50, 0), (120, 10, 3)])
def test_random_texts(spark, size, least, overlap):
    r = random.Random(size)
    texts = ["\n".join("".join(r.choice("abé😀 ") for _ in range(r.choice([3, 20, 60, 150, 400]))) for _ in range(r.randrange(0, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = dict(df.select("i", X.chunks(F.col("text"), size, least, overlap)).collect())
    step = size - max(50, int(size * 0.1))
    for i, text in enumerate(texts):
        if len(text) < least:
            assert got[i] == ([text] if text else [])
            continue
        pieces = [p for line in text.split("\n") if (s := line.strip()) for p in ([s[a : a + size] for a in range(0, len(s), step)] if len(s) > size else [s])]
        assert got[i] == restated(pieces, size, least, overlap)
        assert all(len(c) <= 2 * size + 1 for c in got[i]) or overlap > 1


def test_chunk_rows(spark):
    df = spark.createDataFrame([("d1", "a" * 1900, "T"), ("d2", None, "U"), ("d3", "\n" * 60, "V"), (None, "short", "W")], "_id string, text string, title string")
    rows = chunk_documents(df).orderBy("title", "chunk_index").collect()
    assert [(r._id, r.chunk_index, r.chunk_count, r.parent_id) for r in rows] == [("d1_0", 0, 3, "d1"), ("d1_1", 1, 3, "d1"), ("d1_2", 2, 3, "d1"), ("d2", None, None, None), ("_0", 0, 1, "")]
    assert rows[0].title == "T" and rows[3].text is None
