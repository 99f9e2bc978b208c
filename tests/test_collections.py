import json
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.cli import main
from lodestream.functions.vectors import cosine_similarity
from lodestream.operators import documents as D
from lodestream.operators import embedding as E
from lodestream.operators import vectors as V
from lodestream.operators.filters import matching
from lodestream.operators.numbering import with_position
from lodestream.plans.index import Indexer
from lodestream.sources.json_documents import read_json_documents, read_json_lines
from lodestream.sources.scratch import scratch_root
from lodestream.sources.store import DocumentStore, VectorStore


@pytest.fixture
def docs(spark):
    rows = [("1", "x", 1, ["a", "b"], (5,)), ("2", None, 2, [], (None,)), ("3", "y", None, None, None), ("4", "x", 9, ["b"], (7,))]
    return spark.createDataFrame(rows, "_id string, name string, value int, tags array<string>, sub struct<n: int>")


@pytest.mark.parametrize(("query", "ids"), [
    ({}, "1234"), (None, "1234"), ({"name": "x"}, "14"), ({"name": None}, "2"), ({"missing": None}, "1234"), ({"missing": 1}, ""), ({"name": {"$ne": "x"}}, "23"),
    ({"value": {"$gt": 1}}, "24"), ({"value": {"$gte": 1, "$lt": 9}}, "12"), ({"value": {"$nin": [1, 2]}}, "34"), ({"value": {"$in": [1, None]}}, "13"), ({"value": {"$not": {"$lte": 2}}}, "34"),
    ({"tags": "b"}, "14"), ({"tags": ["a", "b"]}, "1"), ({"tags": {"$in": ["a", "z"]}}, "1"), ({"sub.n": {"$gt": 5}}, "4"), ({"sub.n": None}, "23"), ({"sub.no": {"$exists": False}}, "1234"),
    ({"name": {"$exists": True}}, "134"), ({"$or": [{"name": "y"}, {"value": 2}]}, "23"), ({"$nor": [{"name": "y"}, {"value": 2}]}, "14"), ({"$and": [{"name": "x"}, {"value": 9}]}, "4"), ({"name": {"$regex": "^[xy]$"}}, "134"), ({"_id": {"$in": []}}, ""),
])
def test_filters(docs, query, ids):
    assert "".join(sorted(r._id for r in matching(docs, query).collect())) == ids


@pytest.mark.parametrize("query", [{"name": {"$near": 1}}, {"$where": "1"}])
def test_unknown_operators(docs, query):
    with pytest.raises(ValueError):
        matching(docs, query)


def test_filters_are_pushed_down(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = D.query_documents(df, {"o_totalprice": {"$gt": 1000}}, limit=5, sort_by=[("o_totalprice", -1)], id_col="o_orderkey").select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "TakeOrderedAndProject" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1][:120]


def test_sorted_reads(docs):
    ids = lambda **k: "".join(r._id for r in D.query_documents(docs, **k).collect())
    assert ids(sort_by=[("value", 1)]) == "3124" and ids(sort_by=[("value", -1)]) == "4213"
    assert ids(sort_by=[("name", 1), ("value", -1)], offset=1, limit=2) == "41" and ids(offset=3) == "4" and ids(limit=-1) == "1234"


def test_document_store(spark, docs, tmp_path):
    store = DocumentStore(spark, str(tmp_path))
    store.insert("c", docs.drop("tags", "sub"))
    assert store.count("c") == 4 and store.stats("c")["entities"] == 4 and not store.exists("d")
    again = store.insert("c", spark.createDataFrame([("4", "z", 1), ("5", "Test", 123), ("5", "Test", 123)], "_id string, name string, value int"))
    assert [r._id for r in again.collect()] == ["5"] and store.count("c") == 5
    assert store.find("c", {"name": "Test"}).first()["value"] == 123
    assert store.update("c", "5", {"$set": {"value": 456}}) and not store.update("c", "5", {"value": 456}) and not store.update("c", "nobody", {"value": 1})
    assert store.get("c", "5").first()["value"] == 456
    assert store.update_many("c", {"name": "x"}, {"$inc": {"value": 1}}) == 2 and store.update_first("c", {"name": "x"}, {"$unset": {"value": 1}}) == 1
    assert {r._id: r.value for r in store.read("c").collect()} == {"1": None, "2": 2, "3": None, "4": 10, "5": 456}
    assert store.delete("c", "2") and not store.delete("c", "2") and store.delete_first("c", {"name": "x"}) == 1 and store.delete_many("c", {"value": {"$gt": 5}}) == 2
    assert [r._id for r in store.read("c").collect()] == ["3"]
    store.create("c", "_id string", recreate=True)
    assert store.count("c") == 0
    with pytest.raises(ValueError):
        D.update_documents(docs, {}, {"$push": {"tags": 1}})


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create_vectors("v", 3)
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [1.0, 1.0, 0.0])]
    store.insert("v", spark.createDataFrame(rows, "vector_id string, embedding array<float>"))
    store.insert("v", spark.createDataFrame([("a", [0.0, 0.0, 1.0])], "vector_id string, embedding array<float>"))
    assert store.stats("v")["entities"] == 4 and store.dimension("v") == 3
    assert {r.vector_id: list(r.embedding) for r in store.all("v").collect()}["a"] == [0.0, 0.0, 1.0]
    assert [r.vector_id for r in store.search("v", [1.0, 0.1, 0.0], 2).collect()] == ["a", "c"]
    nested = {r.query_id: [h.vector_id for h in r.hits] for r in store.search_many("v", ["q", "r"], [[1.0, 0.1, 0.0], [0.0, 0.0, 2.0]], 1).collect()}
    assert nested == {"q": ["a"], "r": ["a"]}
    assert store.get("v", "b").count() == 1 and store.get_many("v", ["a", "nobody"]).count() == 1
    assert store.delete("v", ["a"]) and not store.delete("v", ["a"]) and store.read("v").count() == 2
    with pytest.raises(Exception, match="3 numbers"):
        store.insert("v", spark.createDataFrame([("d", [1.0])], "vector_id string, embedding array<float>"))


def test_cosine(spark):
    pairs = [([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 2.0], [2.0, 4.0], 1.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0)]
    from lodestream.functions import cosine_similarity

    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a array<double>, b array<double>")
    for (value,), (_, _, want) in zip(df.select(cosine_similarity(F.col("a"), F.col("b"))).collect(), pairs):
        assert value == pytest.approx(want, abs=1e-6)
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine_similarity(F.col("a"), F.col("b"))).collect()


def test_batched_search_equals_single(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(3)
    queries = df.orderBy("vec_id").limit(7).collect()
    batch = V.search_batch(df, [q.vec_id for q in queries], [q.embedding for q in queries], 5, "vec_id").collect()
    for q in queries:
        one = [r.vec_id for r in V.search_vectors(df, q.embedding, 5, "vec_id").collect()]
        assert [r.vec_id for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == q.vec_id] == one
    table = V.search_table(df, df.filter("vec_id < 7"), 5, "vec_id", "vec_id").collect()
    rounded = lambda rows: sorted((r.query_id, r.vec_id, round(r.score, 9), r["rank"]) for r in rows)
    assert rounded(table) == rounded(batch)
    assert V.search_table(df, df.limit(0), 5, "vec_id", "vec_id").collect() == []


def test_ties_go_by_key(spark):
    df = spark.createDataFrame([(f"k{i:03d}", [1.0, 1.0]) for i in range(300)] + [("z", None)], "vector_id string, embedding array<float>").repartition(4)
    assert [r.vector_id for r in V.search_vectors(df, [1.0, 1.0], 3).collect()] == ["k000", "k001", "k002"]
    assert [r.vector_id for r in V.search_batch(df, ["q"], [[1.0, 1.0]], 3).orderBy("rank").collect()] == ["k000", "k001", "k002"]


def test_inverted_file_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    centroids = V.fit_lists(df, n_lists=32)
    indexed = V.assign_lists(df, centroids).cache()
    assert indexed.count() == df.count()
    sample = df.filter("vec_id % 50 = 0").collect()
    probes = V.probes_for(indexed, centroids, [q.vec_id for q in sample], [q.embedding for q in sample], 10, 0.95, "vec_id")
    assert probes < 32
    others = df.filter("vec_id % 50 = 25").limit(20).collect()
    exact = V.search_batch(df, [q.vec_id for q in others], [q.embedding for q in others], 10, "vec_id").collect()
    truth = {q.vec_id: {r.vec_id for r in exact if r.query_id == q.vec_id} for q in others}
    hits = sum(len(truth[q.vec_id] & {r.vec_id for r in V.search_lists(indexed, centroids, q.embedding, 10, probes, key="vec_id").collect()}) for q in others)
    assert hits / (10 * len(others)) >= 0.9


class Failing:
    """Fails for a batch that holds a given text."""

    def __call__(self, texts, model, input_type):
        if "bad" in texts:
            raise RuntimeError("no service")
        return [[float(len(t)), 1.0] for t in texts]


def test_failed_batches(spark):
    rows = [(str(i), t) for i, t in enumerate(["a", "bb", None, "bad", "dddd", "", "eeeee", "f"])]
    df = spark.createDataFrame(rows, "_id string, text string").coalesce(1)
    made = {r._id: r.embedding for r in E.with_embedding(df, Failing(), model="m", batch_size=2).collect()}
    assert {k for k, v in made.items() if v is None} == {"2", "3", "4", "5"} and list(made["6"]) == [5.0, 1.0]
    out = {r._id: r for r in E.embed_documents(df, Failing(), model="m", batch_size=1).collect()}
    assert set(out) == {"0", "1", "3", "4", "6", "7"}
    assert out["3"].embedding is None and out["3"].embedding_id is None and out["3"].embedding_model is None
    assert (out["6"].embedding_id, out["6"].embedding_model, list(out["6"].embedding)) == ("6_4", "m", [5.0, 1.0])
    kept = E.embed_documents(df, Failing(), batch_size=1, drop_failed=True).collect()
    assert sorted(r.embedding_id for r in kept) == ["emb_0", "emb_1", "emb_3", "emb_4", "emb_5"]
    assert E.generate_embeddings(["a", "bad", "c"], Failing(), batch_size=2) == [None, None, [1.0, 1.0]]
    assert E.generate_embedding("", Failing()) is None


def test_positions(spark):
    df = spark.createDataFrame([(i % 7 if i % 3 else None,) for i in range(500)], "k int").repartition(6)
    rows = with_position(df, ["k"]).collect()
    assert sorted(r.position for r in rows) == list(range(500))
    ordered = [r.k for r in sorted(rows, key=lambda r: r.position)]
    assert ordered == sorted(ordered, key=lambda k: (k is not None, k or 0))
    assert with_position(df.limit(0), ["k"]).collect() == []


def test_json_shapes(spark, tmp_path):
    def read(value, **options):
        path = tmp_path / "f.json"
        path.write_text(json.dumps(value))
        return sorted((r._id, r.text, r.title) for r in read_json_documents(spark, str(path), **options).collect())

    a, b = {"id": 7, "content": "one", "title": "A"}, {"_id": "own", "content": "", "id": None}
    assert read([a, b], id_field="id") == [("7", "one", "A"), ("own", "", "")]
    assert read({"items": [a], "_x": 1}, id_field="id") == [("7", "one", "A")]
    assert read({"k1": a, "k2": b}, id_field="id") == [("7", "one", "A"), ("own", "", "")]
    assert read({"_k": a, "k2": b}) == [] and len(read({"_k": a, "k2": b}, underscore_guard=False)) == 2
    (tmp_path / "l.jsonl").write_text(json.dumps(a) + "\n" + json.dumps(b))
    assert read_json_lines(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_index_and_search(spark, tmp_path):
    index = Indexer(spark, str(tmp_path), E.HashingProvider(64), dimension=64)
    assert index.setup() and index.vectors.exists("categories")
    docs = spark.createDataFrame([("1", "apples and pears\n" + "apples grow on trees " * 80, "Fruit", "x"), ("2", "engines and wheels " * 10, "Cars", None), ("3", None, None, None)], "_id string, text string, title string, type string")
    assert index.index(docs).count() == 3 and index.index(docs).count() == 0
    assert index.documents.count("documents") == 3 and index.vectors.read("documents").count() == 2
    chunks = index.documents.count("chunks")
    assert chunks == index.vectors.read("chunks").count() + 1
    rows = index.search("wheels engines", 2).collect()
    assert rows[0].document["_id"] == "2" and rows[0].chunk["parent_id"] == "2" and rows[0].score >= rows[1].score
    assert index.search("", 2).collect() == []
    meta = index.vectors.read("chunks").filter("metadata.parent_id = '1'").select("metadata.title").distinct().collect()
    assert [r.title for r in meta] == ["Fruit"]
    index.setup(recreate=True)
    assert index.documents.count("documents") == 0


def test_command_line(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "r"), "--dimension", "16"]
    assert main([], spark) == 1 and main([*root, "index", "--file", str(tmp_path / "none.json")], spark) == 1
    (tmp_path / "d.json").write_text(json.dumps([{"content": "some text about apples", "n": 1}]))
    assert main([*root, "setup"], spark) == 0 and main([*root, "index", "--file", str(tmp_path / "d.json"), "--id-field", "n"], spark) == 0
    assert "Indexed 1 documents" in capsys.readouterr().out
    assert main([*root, "search", "apples"], spark) == 0 and "apples" in capsys.readouterr().out
    lines = [{"id": i, "date": f"2023-01-01T12:0{i}:00+00:00", "sender_id": 1 + i % 2, "text": f"t{i}"} for i in range(1, 4)]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    assert main(["export", "--file", str(tmp_path / "m.json"), "--out", str(tmp_path / "o"), "--group-id", "5", "--group-name", "G"], spark) == 0
    assert spark.read.json(str(tmp_path / "o/conversation_chunks")).first()["content"] == "user0: t1\nuser1: t2\nuser0: t3"


def test_stream(spark, tmp_path):
    from lodestream.streaming import incremental as S

    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    rows = [{"id": i % 5, "group_id": 1, "date": f"2023-01-01T12:0{i % 5}:00Z", "sender_id": i % 3, "text": f"t{i}"} for i in range(8)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    clean = S.clean_stream(S.read_stream(spark, str(source)))
    S.run_into(clean, str(sink), str(tmp_path / "cp")).awaitTermination()
    (source / "b.json").write_text(json.dumps({"id": 2, "group_id": 1, "date": "2023-01-01T12:02:00Z", "sender_id": 2, "text": "again"}) + "\n" + json.dumps({"id": 9, "group_id": 1, "date": "2023-01-01T12:09:00Z", "sender_id": 2, "text": "new"}))
    S.run_into(S.clean_stream(S.read_stream(spark, str(source))), str(sink), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(str(sink)).collect())
    assert got == [0, 1, 2, 4, 9] or got == [0, 1, 2, 3, 4, 9]
    assert S.activity(clean).isStreaming


def test_rename_does_not_touch_numpy():
    assert np.allclose(V._unit(np.array([[3.0, 4.0], [0.0, 0.0]])), [[0.6, 0.8], [0.0, 0.0]])


def test_ivf_query_answers_the_whole_set_with_recall(spark, sf):
    from lodestream.plans import vector_queries as Q

    exact = Q.vec_topk_batched(spark, sf).collect()
    score = {(r.query_id, r.vec_id): r.score for r in Q.vec_topk(spark, sf).selectExpr("0L as query_id", "vec_id", "score").collect()}
    found = Q.vec_ivf_topk(spark, sf).collect()
    assert {r.query_id for r in found} == {r.query_id for r in exact} and len({r.query_id for r in found}) > 1
    assert all(r.rank == 1 for r in found if r.query_id == r.vec_id)
    assert all(r.score == score[0, r.vec_id] for r in found if r.query_id == 0 and (0, r.vec_id) in score)
    truth = {(r.query_id, r.vec_id) for r in exact}
    recall = len(truth & {(r.query_id, r.vec_id) for r in found}) / len(truth)
    assert recall >= 0.9 and abs(recall - Q.ivf_recall(spark, sf)) < 1e-9


def test_lists_of_a_table_agree_with_lists_of_a_query(spark):
    random = np.random.RandomState(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random.randn(600, 8))] + [(600, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    centroids = V.fit_lists(df, n_lists=20)
    indexed = V.assign_lists(df, centroids).cache()
    got = V.search_lists_table(indexed, centroids, df.filter("vec_id % 150 = 0"), 7, 4, "vec_id", "vec_id").collect()
    for q in (0, 150, 300, 450):
        want = [r.vec_id for r in V.search_lists(indexed, centroids, rows[q][1], 7, 4, key="vec_id").collect()]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == {0, 150, 300, 450}


def test_unequal_vectors_raise_wherever_they_meet(spark):
    mixed = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])], "vec_id long, embedding array<float>").coalesce(1)
    query = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    for search in (
        lambda: V.search_batch(mixed, ["q"], [[1.0, 0.0, 0.0, 0.0]], 2, "vec_id").collect(),
        lambda: V.search_table(mixed, query, 2, "vec_id", "vec_id").collect(),
        lambda: V.assign_lists(mixed, np.eye(4)).collect(),
    ):
        with pytest.raises(Exception, match="unequal length"):
            search()


def test_ties_stay_bounded():
    best = V._Best(["q", "r"], V._unit(np.ones((2, 3))), 10)
    for block in range(5):
        best.add([f"k{(block * 4096 + i) * 7919 % 20480:05d}" for i in range(4096)], np.ones((4096, 3)))
        assert best.scores.shape[1] == 10
    assert sorted(best.keys[0]) == sorted(best.keys[1]) == [f"k{i:05d}" for i in range(10)]
    mixed = V._Best(["q"], np.array([[1.0, 0.0]]), 3)
    mixed.add(["b", "a", None, "c"], np.array([[1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 0.0]]))
    mixed.add(["d"], np.array([[0.0, 1.0]]))
    assert set(mixed.keys[0]) == {"c", None, "a"}


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    """The result doesn't depend on how vectors and queries are cut."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    some = df.filter("vec_id % 50 = 0")
    rows = lambda found: sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    want = rows(V.search_table(df, some, 5, "vec_id", "vec_id"))
    column = pa.array([[1.0] * 4096] * 5000, pa.list_(pa.float32()))
    assert max(n for _, n in V._parts(column, V.VECTOR_BLOCK)) * 8 * 4096 <= V.BLOCK_BYTES
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    assert rows(V.search_table(df, some, 5, "vec_id", "vec_id")) == want


def test_index_of_a_collection(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create_vectors("v", 64)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("cast(vec_id as string) as vector_id", "embedding", "vec_id")
    store.insert("v", rows.filter("vec_id < 400").drop("vec_id"))
    store.build_index("v", 16)
    assert store.has_index("v") and store.read("v__lists").count() == store.read("v").count()
    query = rows.filter("vec_id = 3").first()["embedding"]
    probed = store.search("v", query, 10, n_probe=4)
    assert "list_id" not in probed.columns and probed.first()["vector_id"] == "3"
    exact = [r.vector_id for r in store.search("v", query, 10).collect()]
    assert [r.vector_id for r in store.search("v", query, 10, n_probe=16).collect()] == exact
    assert len(set(exact) & {r.vector_id for r in probed.collect()}) >= 5
    store.insert("v", spark.createDataFrame([("new", query)], "vector_id string, embedding array<float>"))
    assert {r.vector_id for r in store.search("v", query, 2, n_probe=1).collect()} == {"3", "new"}
    store.delete("v", ["3"])
    assert "3" not in {r.vector_id for r in store.search("v", query, 5, n_probe=16).collect()}
    store.create_vectors("v", 64, recreate=True)
    assert not store.has_index("v") and store.search("v", query, 5, n_probe=3).count() == 0


def test_one_document_of_each_id(spark):
    rows = [("a", f"text {i}") for i in range(20)] + [("b", "other")]
    found = {tuple(D.one_of_each(spark.createDataFrame(rows, "_id string, text string").repartition(n), "_id").orderBy("_id").collect()) for n in (1, 3, 7)}
    assert len(found) == 1 and len(next(iter(found))) == 2


class Unpicklable:
    def __init__(self):
        self.calls, self.lock = 0, __import__("threading").Lock()

    def __call__(self, texts, model, input_type):
        self.calls += 1
        return [[float(self.calls), float(len(t))] for t in texts]

    def count_tokens(self, texts, model):
        if "bad" in texts:
            raise RuntimeError("no service")
        return sum(len(t.split()) for t in texts)


def test_a_provider_is_made_once_a_worker(spark):
    df = spark.createDataFrame([(str(i), f"t {i}") for i in range(6)], "_id string, text string").coalesce(1)
    made = E.with_embedding(df, E.PerWorker(Unpicklable), batch_size=2).collect()
    assert [r.embedding[0] for r in made] == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]
    with pytest.raises(Exception):
        E.with_embedding(df, Unpicklable()).collect()


def test_tokens_of_batches(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", ""), ("c", "three"), ("d", "bad"), ("e", "four five six")], "_id string, text string").repartition(3)
    got = sorted(tuple(r) for r in E.batch_tokens(df, E.PerWorker(Unpicklable), batch_size=2).collect())
    assert got == [(0, 2, 3), (1, 2, None)]


def test_one_query_is_scored_as_by_the_expression(spark):
    """Zero, empty and null vectors, ties and numbers that are missing, in parts of any size; no expression walks the numbers."""
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 9)]) for i in range(400)] + [(400, None), (401, []), (402, [0.0] * 8), (403, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    query = [1.0, -2.0, 0.5, 0.0, 3.0, 1.0, -1.0, 2.0]
    score = cosine_similarity(F.col("embedding").cast("array<double>"), F.array(*[F.lit(x) for x in query]))
    want = {r.vec_id: r.s for r in df.select("vec_id", score.alias("s")).collect()}
    order = sorted(want, key=lambda k: (want[k] is None, -round(want[k] or 0, 9), k))
    for k in (1, 25, 403, 404, 1000):
        found = V.search_vectors(df, query, k, "vec_id")
        got = found.collect()
        assert found.columns == ["vec_id", "embedding", "score"]
        assert [r.vec_id for r in got] == order[:k] and all(r.score == pytest.approx(want[r.vec_id], abs=1e-12) for r in got if r.score is not None)
    assert {r.vec_id for r in got if r.score is None} == {403}
    plan = V.search_vectors(df, query, 5, "vec_id")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_offline_vectors_are_made_once(spark, tmp_path, monkeypatch):
    """A word is digested once, what is remembered is bounded, vectors are arrays, and the index writes them where they stay."""
    made, md5 = [], E.hashlib.md5
    monkeypatch.setattr(E.hashlib, "md5", lambda x: made.append(x) or md5(x))
    monkeypatch.setattr(E, "_numbers", E._Numbers())
    some = E.HashingProvider(16)(["one two One", "two  one", ""], "m", "document")
    assert made == [b"one", b"two"] and all(isinstance(v, np.ndarray) for v in some)
    assert sorted(some[0])[-2:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and not some[2].any()
    monkeypatch.setattr(E, "KNOWN_WORDS", 2)
    few = E._Numbers()
    for word in "a b c a d a e b".split():
        assert few[word] == int(md5(word.encode()).hexdigest()[:8], 16) and len(few) <= 2 >= len(few.older)
    texts = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    got = E.with_embedding(texts, E.HashingProvider(16)).collect()
    alone = E.HashingProvider(16)
    for r in got[::100]:
        assert r.embedding is None if r.text is None else r.embedding == pytest.approx(alone([r.text], "m", "document")[0].tolist(), abs=1e-6)
    assert sum(r.embedding is None for r in got) == 429
    before = set(os.listdir(scratch_root(spark).removeprefix("file://")))
    index = Indexer(spark, str(tmp_path), E.HashingProvider(16), dimension=16)
    index.setup()
    index.index(spark.createDataFrame([("1", "a b\n" * 40, "t", "x")], "_id string, text string, title string, type string"))
    written = set(os.listdir(scratch_root(spark).removeprefix("file://"))) - before
    assert not [x for x in written if "vectors" in x] and index.vectors.read("chunks").count() == 1


def test_scores_of_a_block_are_bounded(spark):
    """What a task holds beside the blocks doesn't grow with them, and an Arrow batch has few of them."""
    r = np.random.default_rng(1)
    queries, vectors = V._unit(r.normal(size=(1024, 16))), r.normal(size=(4096, 16))
    best = V._Best(list(range(1024)), queries, 10)
    tracemalloc.start()
    best.add(list(range(4096)), vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    want = np.argsort(-(queries @ V._unit(vectors).T), axis=1)[:, :10]
    assert all(set(a) == set(b) for a, b in zip(best.keys.tolist(), want.tolist()))
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    V.search_table(df, df, 1, "vec_id", "vec_id")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("16m", "16777216", "16777216b")


def test_equal_vectors_tie_wherever_they_stand():
    r = np.random.default_rng(3)
    queries, one = V._unit(r.normal(size=(61, 64))), r.normal(size=64)
    for n in (37, 501, 4099):
        best = V._Best(list(range(61)), queries, 10)
        keys = r.permutation(n).tolist()
        best.add(keys, np.tile(one, (n, 1)))
        assert all(sorted(k) == list(range(10)) for k in best.keys.tolist()) and (best.scores == best.scores[:, :1]).all()
