import numpy as np
import pytest

from lodestream.llm import quality as Q
from lodestream.llm.common import read_table


def test_agreement_with_labels(spark):
    """Labels of people are only used here."""
    d = "/root/testdata/sf0.01"
    scores = Q.score_documents(read_table(spark, d, "documents"))
    rows = scores.join(read_table(spark, d, "labels"), "doc_id").collect()
    right = sum(r.keep == bool(r.quality) for r in rows) / len(rows)
    clean = [r.keep for r in rows if r.quality == 1]
    assert right > 0.95
    assert sum(clean) / len(clean) > 0.98


def test_held_out_accuracy(spark):
    """The labelled documents take no part in votes and sample."""
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = Q.fit(docs.join(labels, "doc_id", "left_anti"))
    rows = Q.score_documents(docs.join(labels, "doc_id", "left_semi"), model=model).join(labels, "doc_id").collect()
    assert len(rows) == labels.count()
    assert sum(r.keep == bool(r.quality) for r in rows) / len(rows) > 0.97
    clean = [r.keep for r in rows if r.quality == 1]
    assert sum(clean) / len(clean) > 0.99


def drawn(seed, rows, junk_share, kinds, good):
    """Vote patterns drawn from known rates: kinds of junk (share, flag rates), and good documents' flag rates."""
    random = np.random.RandomState(seed)
    shares = np.array([1 - junk_share, *(junk_share * s for s, _ in kinds)])
    rates = np.array([good, *(r for _, r in kinds)])
    which = random.choice(len(shares), rows, p=shares)
    votes = np.where(random.rand(rows, len(Q.LABELLERS)) < rates[which], Q.JUNK, Q.GOOD)
    codes, counts = np.unique(votes @ 3 ** np.arange(len(Q.LABELLERS)), return_counts=True)
    return dict(zip(codes.tolist(), counts.tolist())), (rates[1:] * shares[1:, None]).sum(0) / junk_share


@pytest.mark.parametrize(
    "kinds, good",
    [
        ([(1.0, [0.95] * 8)], [0.01] * 8),
        ([(1.0, [0.9, 0.8, 0.7, 0.6, 0.6, 0.7, 0.8, 0.5])], [0.03, 0.02, 0.01, 0.05, 0.02, 0.01, 0.03, 0.04]),
        ([(0.5, [0.97, 0.95, 0.9, 0.02, 0.02, 0.02, 0.02, 0.02]), (0.5, [0.02, 0.02, 0.02, 0.02, 0.9, 0.95, 0.97, 0.02])], [0.01] * 8),
    ],
)
def test_known_rates_are_recovered(kinds, good):
    patterns, junk = drawn(3, 100_000, 0.2, kinds, good)
    posterior, rates = Q.estimate(patterns)
    assert all(0 <= p <= 1 for p in posterior.values())
    assert np.abs(rates[0] - junk).max() < 0.02
    assert np.abs(rates[1] - good).max() < 0.02
    assert posterior[sum(Q.GOOD * 3**i for i in range(len(Q.LABELLERS)))] > 0.9


def test_whole_tokens_and_whole_texts_count():
    letters = "abcdefghij" * 40
    assert Q.tokens_of(letters) == [letters[i : i + 64] for i in range(0, 400, 64)]
    weights = np.random.RandomState(1).rand(1 << Q.BITS)
    scored = [Q.score(weights, *Q.analyse(t, True)[1:]) for t in (letters, letters[:399] + "#", "a1" * 32, "a1" * 31 + "b#")]
    assert len(set(scored)) == 4
    long = " ".join(f"w{i % 700}" for i in range(50_000))
    assert abs(Q.analyse(long, False)[0]["-distinct"] + 0.7) < 0.01
    assert Q.analyse("spam " * 50_000, False)[0]["-distinct"] > -0.01


def test_odd_rows(odd, empty):
    got = Q.score_documents(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert Q.score_documents(empty).collect() == []
    assert Q.drop_rejected(odd).columns == odd.columns
    assert Q.drop_rejected(empty).count() == 0


def test_drop_agrees_with_scores(documents):
    kept = {r.doc_id for r in Q.score_documents(documents).collect() if r.keep}
    assert {r.doc_id for r in Q.drop_rejected(documents).collect()} == kept


def test_the_sample_does_not_depend_on_partitions(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    scores = [{r.doc_id: r.score for r in Q.score_documents(docs.repartition(n), train_rows=300).collect()} for n in (1, 7)]
    assert scores[0] == scores[1]
