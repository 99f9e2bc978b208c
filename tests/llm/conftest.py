import pytest

from lodestream.llm.common import read_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return read_table(spark, sf, "documents").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) of the supplied documents, on the driver."""
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())


LONG = " ".join(f"word{i % 977} filler" for i in range(60_000))

#: Nulls, empty, white space, very long, ties, repeated rows.
ODD_ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, LONG + " end"), (6, "one"), (7, "ONE"), (8, "one two three four five six"), (8, "one two three four five six"),
    (None, "without an id, five words"), (None, None), (9, "Ünï©ode 😀 ﬁ " * 40), (10, "<|endoftext|> all rights reserved"), (11, "a" * 5000), (12, "\x00\x01 control"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with extra columns whose names operators might use themselves."""
    rows = [(k, t, "xx", None, 5, i, f"k{i}", None) for i, (k, t) in enumerate(ODD_ROWS)]
    return spark.createDataFrame(rows, DOCS + ", __uid long, __text string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
