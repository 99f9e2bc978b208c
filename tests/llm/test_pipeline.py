import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tokenizers import Tokenizer

from lodestream.llm import bpe, quality
from lodestream.llm.common import materialize

from .conftest import ODD_ROWS
from .test_exact_dedup import LOWER
from .test_neardup import brute as near_brute
from .test_packing import check as packing_check
from .test_suffixes import brute as repeats_brute


def test_stages_against_brute_force(spark, sf, documents):
    docs, at = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.columns == documents.columns
        at[name] = before, docs
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    before, after = at["quality classifier"]
    assert ids(after) == sorted(r.doc_id for r in quality.score_documents(before).collect() if r.keep)
    before, after = at["exact dedup"]
    first = {}
    for key, text in rows(before):
        first.setdefault(text.translate(LOWER), key)
    assert ids(after) == sorted(first.values())
    before, after = at["MinHash near-dedup"]
    assert ids(after) == sorted(key for key, _, _, kept in near_brute(rows(before), 80) if kept)
    before, after = at["suffix-array dedup"]
    removed = {k: n for k, _, n, _, _ in repeats_brute(rows(before), 200)}
    lost = dict(rows(after))
    assert all((len(t.encode()) - len(lost[k].encode())) - removed[k] in range(7 * 30) for k, t in rows(before))
    assert all(r.n_chars == len(r.text) for r in after.collect())

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    packing_check(packed, rows(docs), Tokenizer.from_file(bpe.default_vocabulary()))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_rows_pass_all_stages(spark, sf, odd, documents):
    docs = odd.unionByName(documents.withColumn("doc_id", documents.doc_id + 1000), allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "odd")
        assert docs.columns == odd.columns
    kept = docs.collect()
    assert {8, 9} & {r.doc_id for r in kept} and sum(not r.text for r in kept if (r.doc_id or 0) < 1000) <= 1
    assert len(kept) > 100 and len([r for r in kept if (r.doc_id or 0) < 1000]) < len(ODD_ROWS)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    packing_check(packed, [(r.doc_id, r.text) for r in kept], Tokenizer.from_file(bpe.default_vocabulary()))


def test_empty_table_passes_all_stages(spark, sf, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "empty")
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect() == []
