"""Operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import cluster, state
from matchloom.operators.documents import merged
from matchloom.operators.embed import HashingEmbedder, embedded
from matchloom.operators.vectors import fused, multi_vector_similarity, nearest, pooled


def test_pools(spark):
    rows = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.0, 1.0]), ("q", None)], "k string, vector array<double>")
    assert [r.vector for r in pooled(rows, ["k"]).collect()] == [pytest.approx([0.5**0.5, 0.5**0.5])]
    assert [r.vector for r in pooled(rows, ["k"], how="max").collect()] == [pytest.approx([0.5**0.5, 0.5**0.5])]


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_is_exact(spark, block):
    random = np.random.default_rng(1)
    corpus, asked = random.normal(size=(40, 8)), random.normal(size=(6, 8))
    corpus[3] = corpus[9]
    corpus[5] = 0
    found = nearest(spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "qid string, vector array<double>"), spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(corpus)], "id string, vector array<double>"), 5, block)
    got = {(r.qid, r.place): r.id for r in found.collect()}
    for i, q in enumerate(asked):
        norms = np.linalg.norm(corpus, axis=1) * np.linalg.norm(q)
        d = np.round(np.where(norms > 0, 1 - corpus @ q / np.where(norms > 0, norms, 1), 1.0), 9)
        order = sorted(range(40), key=lambda j: (d[j], f"c{j:02}"))[:5]
        assert [got[f"q{i}", p + 1] for p in range(5)] == [f"c{j:02}" for j in order]


def test_nearest_shuffles_no_copies_of_the_corpus(spark):
    """Many blocks, and more ties at the n-th place than are kept: the lower ids win, and nothing is copied to each pair of blocks."""
    random = np.random.default_rng(2)
    corpus, asked = random.normal(size=(600, 32)), random.normal(size=(300, 32))
    corpus[100:400] = corpus[100]
    asked[7] = corpus[100]
    asked[8] = asked[9]
    rows = spark.createDataFrame([(f"c{(7 * i) % 600:03}", v.tolist()) for i, v in enumerate(corpus)], "id string, vector array<double>").localCheckpoint()
    asking = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "qid string, vector array<double>").localCheckpoint()

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return sum(context.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(context.statusStore().executorList(False).size()))

    before = written()
    got = {(r.qid, r.place): r.id for r in nearest(asking, rows, 5, 16).collect()}
    assert written() - before < 4 * 32 * 8 * (600 + 300)
    d = np.round(1 - asked @ corpus.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(corpus, axis=1), 9)
    for i in range(300):
        order = sorted((d[i, j], f"c{(7 * j) % 600:03}") for j in range(600))[:5]
        assert [got[f"q{i}", p + 1] for p in range(5)] == [name for _, name in order]
    assert len(got) == 1500


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, vector array<double>")
    assert nearest(empty.withColumnRenamed("id", "qid"), empty, 3).count() == 0


def test_fusion_and_weights(spark):
    shape = "id string, score double"
    a, b = spark.createDataFrame([("doc1", 0.9), ("doc2", 0.8)], shape), spark.createDataFrame([("doc2", 0.85), ("doc3", 0.7)], shape)
    assert {r.id: r.score for r in fused(a, b, keys=["id"]).collect()} == {"doc1": 0.9, "doc2": 0.85, "doc3": 0.7}
    pairs = spark.createDataFrame([("p", 1.0), ("p", 0.5)], "p string, similarity double")
    assert {h: multi_vector_similarity(pairs, ["p"], h).first().similarity for h in ("max", "mean", "weighted", "other")} == pytest.approx({"max": 1.0, "mean": 0.75, "weighted": 0.9, "other": 1.0})


def test_kmeans():
    data = np.array([[0.0, 0], [0, 1], [10, 10], [10, 11]])
    _, labels = cluster.kmeans(data, 2)
    assert labels[0] == labels[1] != labels[2] == labels[3]
    assert cluster.kmeans(data, 9)[1].tolist() == [0, 1, 2, 3]


def test_representatives(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([[0.0, 0.0], [0.0, 1.0], [9.0, 9.0], [9.0, 10.0]])] + [("b", 0, [1.0, 1.0]), ("c", 0, None)], "owner string, chunk_index int, vector array<double>")
    found = cluster.representatives(rows, 2).collect()
    assert {r.owner for r in found} == {"a", "b"} and len([r for r in found if r.owner == "a"]) == 2


def test_embedder(spark):
    v = HashingEmbedder(8).embed(["alpha beta", "alpha beta", "?"])
    assert v[0] == v[1] and np.linalg.norm(v[0]) == pytest.approx(1) and v[2] == [0.0] * 8
    rows = spark.createDataFrame([("x y",), (None,), ("  ",)], "t string").select(embedded(F.col("t")).alias("v")).collect()
    assert len(rows[0].v) == 64 and rows[1].v is None and rows[2].v is None


def test_upsert_keeps_the_first_expiry(spark):
    rows = spark.createDataFrame([("s", "r", 1, 10, "old"), ("s", "r", 2, 20, "new"), (None, "r", 1, 5, "apart")], "source string, ref string, updated int, expires int, title string")
    found = {r.source: r for r in state.upserted(rows, ["source", "ref"], "updated", ["expires"]).collect()}
    assert (found["s"].title, found["s"].expires, found["s"].updated) == ("new", 10, 2) and found[None].title == "apart"


def test_latest_pending_and_replace(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "w")], "k string, at int, v string")
    assert {r.k: r.v for r in state.latest(rows, ["k"], "at").collect()} == {"a": "y", "b": "w"}
    flags = spark.createDataFrame([(None,), (False,), (True,)], "indexed boolean")
    assert flags.where(state.pending()).count() == 2
    old, new = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "d string, i int"), spark.createDataFrame([("a", 0)], "d string, i int")
    assert sorted(map(tuple, state.replaced(old, new, "d").collect())) == [("a", 0), ("b", 0)]


def test_merge(spark):
    shape = "profile string, pos int, success boolean, text string, relevant_text string, tables array<string>, file_hash string"
    rows = spark.createDataFrame([("p", 2, True, "second", "", ["t"], "h2"), ("p", 1, True, "first", "short", None, "h1"), ("p", 3, False, "bad", None, None, "h3"), ("q", 1, False, None, None, None, None)], shape)
    found = {r.profile: r for r in merged(rows, "profile").collect()}
    assert found["p"].text == "short\n\n---\n\nsecond" and found["p"].document_count == 2 and found["p"].file_hashes == "h1,h2" and found["p"].n_tables == 1
    assert not found["q"].success and found["q"].text == ""


def test_owners_of_owners_are_resolved(spark):
    rows = [("e", "t1", "n1", None, None), ("d", "t1", "n1", "s", "r1"), ("c", None, None, "s", "r1"), ("b", "t2", "n2", "s", "r1"), ("a", "t2", "n2", None, None), ("x", None, "n2", "s", None), ("y", "t3", "n3", "s", "r3")]
    rows += [(f"k{i:02}", f"t{i // 2}k", "n", "s", f"r{(i + 1) // 2}k") for i in range(30)]
    table = spark.createDataFrame(rows, "_id string, tender_id string, document_name string, source string, tender_ref_no string")
    found = {r._id: r.owner for r in state.matched_by_either(table, "_id", ["tender_id", "document_name"], ["source", "tender_ref_no"]).collect()}
    assert found == {x: "a" for x in "abcde"} | {"x": "x", "y": "y"} | {f"k{i:02}": "k00" for i in range(30)}
    assert state.matched_by_either(table.limit(0), "_id", ["tender_id", "document_name"], ["source", "tender_ref_no"]).count() == 0


def test_latest_rows_are_always_the_same(spark):
    rows = [("a", 1, f"v{i}") for i in range(20)] + [("b", None, "x"), ("b", 0, "y")]
    table = spark.createDataFrame(rows, "key string, at int, value string")
    found = [{r.key: r.value for r in state.latest(table.repartition(n), ["key"], "at").collect()} for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and found[0]["b"] == "y"


def test_caches(spark):
    cache = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    cache = state.cache_set(cache, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"))
    assert {tuple(r) for r in cache.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {r.key for r in state.cache_delete(cache, spark.createDataFrame([("a",), ("a",), ("z",)], "key string")).collect()} == {"b", "c"}
    left, gone = state.cache_clear(cache)
    assert left.count() == 0 and gone.first().removed == 3


def test_mean_vector_stands_in(spark):
    pairs = spark.createDataFrame([("p", 0.5), ("p", 0.9)], "profile string, similarity double")
    means = spark.createDataFrame([("p", 0.1), ("q", 0.2)], "profile string, similarity double")
    assert {tuple(r) for r in multi_vector_similarity(pairs, ["profile"], "max", means).collect()} == {("p", 0.9), ("q", 0.2)}


def test_profile_snippet_keeps_no_step_longer_than_needed(spark, sf, monkeypatch):
    # what is on disk when the profiles' own chunks are searched, and what the texts of the hits are joined to
    from pathlib import Path

    from matchloom import session
    from matchloom.operators import search, vectors
    from matchloom.plans import tables, vector_queries

    made, seen, plans = [], [], []

    def stored(df):
        made.append(session.stored(df))
        return made[-1]

    def nearest(queries, chunks, n):
        seen.append([Path(x._stored_at.removeprefix("file:")).exists() for x in made])
        return vectors.nearest(queries, chunks, n)

    def materialise(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return session.materialise(df)

    monkeypatch.setattr(tables, "stored", stored)
    monkeypatch.setattr(search, "nearest", nearest)
    monkeypatch.setattr(vector_queries, "materialise", materialise)
    vector_queries.profile_snippet(spark, sf)
    assert seen == [[True], [True], [False]]
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
