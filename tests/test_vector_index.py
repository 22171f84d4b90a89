import numpy as np
import pytest
from pyspark.sql import functions as F

from claravoz.operators import embedding, neighbors
from claravoz.operators.vector_index import Quantiser, VectorIndex, learn
from claravoz.scratch import scratch_path


def rows(spark, n=1500, d=30, seed=1):
    """Vectors around 40 centres, a third of them around the first."""
    rnd = np.random.RandomState(seed)
    centres = rnd.standard_normal((40, d))
    own = np.where(rnd.rand(n) < 1 / 3, 0, rnd.randint(0, 40, n))
    m = centres[own] + 0.5 * rnd.standard_normal((n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").repartition(4)


def asked(df, step=25):
    return df.where(F.col("id") % step == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))


def test_recall_and_blocks(spark):
    v = rows(spark)
    index = VectorIndex.build(v, scratch_path(spark, "index"), cells=40, parts=10, rounds=6)
    assert index.rows().count() == 1500
    truth = neighbors.exact_knn(asked(v), v, 10, exclude_self=True)
    found = index.search(asked(v), 10, probes=8, candidates=100, exclude_self=True)
    assert neighbors.recall(found, truth).first()["recall"] >= 0.95
    cut = index.search(asked(v), 10, probes=8, candidates=100, exclude_self=True, block_rows=60)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, found.collect()))
    again = VectorIndex.load(spark, index.path).search(asked(v), 10, probes=8, candidates=100, exclude_self=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_all_cells_and_candidates_are_exact(spark):
    v = rows(spark, 300, 7)
    index = VectorIndex.build(v, scratch_path(spark, "index"), cells=9, parts=3, entries=16, rounds=2)
    truth = neighbors.exact_knn(asked(v), v, 5)
    found = index.search(asked(v), 5, probes=9, candidates=300)
    # stored vectors are floats: ranks and ids agree, distances to five digits
    key = lambda df: {(r["query_id"], r["position"]): (r["id"], round(r["distance"], 4)) for r in df.collect()}
    a, b = key(truth), key(found)
    assert a.keys() == b.keys() and sum(a[x] == b[x] for x in a) >= 0.98 * len(a)


def test_append_and_among(spark):
    v = rows(spark, 400, 12)
    path = scratch_path(spark, "index")
    index = VectorIndex.build(v.where("id < 300"), path, cells=10, parts=4, entries=32, rounds=3)
    VectorIndex.load(spark, path).add(v.where("id >= 300"))
    hits = index.search(asked(v), 1, probes=10, candidates=50).collect()
    assert len(hits) == 16 and all(r["query_id"] == r["id"] and r["distance"] < 1e-5 for r in hits)
    few = index.search(asked(v), 3, probes=10, candidates=50, among=v.where("id % 7 = 0").select("id"))
    assert {r["id"] % 7 for r in few.collect()} == {0} and few.count() == 48


def test_calibration_holds_for_vectors_no_centroid_started_from(spark):
    """As many cells as queries, so that those first in the order of the seeds would all be seeds."""
    m = np.random.RandomState(9).standard_normal((3000, 32))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>").repartition(4)
    index = VectorIndex.build(v, scratch_path(spark, "index"), cells=150, parts=8, entries=32, rounds=2)
    assert index.calibrate(0.95, queries=37) >= 0.95
    truth = neighbors.exact_knn(asked(v, 5), v, 10, exclude_self=True)
    assert neighbors.recall(index.search(asked(v, 5), 10, exclude_self=True), truth).first()["recall"] >= 0.94


def test_calibrated_settings_are_kept(spark):
    v = rows(spark, 900, 40, seed=3)
    index = VectorIndex.build(v, scratch_path(spark, "index"), cells=30, parts=5, entries=16, rounds=3)
    assert index.calibrate(0.9, k=5, queries=30) >= 0.9
    again = VectorIndex.load(spark, index.path)
    assert (again.probes, again.candidates) == (index.probes, index.candidates) and index.probes < 30
    truth = neighbors.exact_knn(asked(v), v, 5, exclude_self=True)
    assert neighbors.recall(again.search(asked(v), 5, exclude_self=True), truth).first()["recall"] >= 0.85


def test_learning_lowers_the_error(spark):
    v = rows(spark, 800, 16)
    m = neighbors._matrix([r["vec"] for r in v.collect()])

    def error(q: Quantiser) -> float:
        cell, codes = q.encode(m)
        back = q.centroids[cell] + np.concatenate([b[codes[:, p]] for p, b in enumerate(q.books)], 1)
        return float(((m - back) ** 2).sum(1).mean())

    before, after = (error(learn(v, cells=20, parts=4, entries=32, rounds=r)) for r in (0, 6))
    assert after < 0.8 * before


def test_odd_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 2.0])],
                              "id long, vec array<double>")
    index = VectorIndex.build(v, scratch_path(spark, "index"), cells=3, parts=2, rounds=2)
    assert index.rows().count() == 4
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, None)], "query_id long, query_vec array<double>")
    found = index.search(q, 5, probes=3, candidates=9).collect()
    assert {(r["query_id"], r["id"], r["distance"]) for r in found} == {(1, 2, 0.0), (1, 1, 2.0), (1, 4, 2.0)}
    assert index.search(q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        learn(v.where("id = 3"))


def test_semantic_search_by_index(spark):
    words = ["apple", "pear", "plum", "fig", "lime", "quince", "melon"]
    docs = spark.createDataFrame([(i, f"{words[i % 7]} {words[i % 5]} number {i}", "ab"[i % 2]) for i in range(60)],
                                 "record_id long, text string, task_id string")
    texts = spark.createDataFrame([(1, "plum number 16"), (2, "quince")], "query_id long, query string")
    vectors = embedding.hashed_vectors(docs, "text")
    index = VectorIndex.build(vectors, scratch_path(spark, "index"), "record_id", "embedding", cells=4, rounds=2)
    index_hits = neighbors.semantic_search(texts, docs, k=3, task_id="a", index=index).collect()
    exact = neighbors.semantic_search(texts, docs, k=3, task_id="a").collect()
    key = lambda rows: sorted((r["query_id"], r["position"], r["record_id"], round(r["distance"], 4), r["text"]) for r in rows)
    assert key(index_hits) == key(exact)


def test_near_copies_do_not_decide_the_calibration(spark):
    rng = np.random.RandomState(3)
    one = rng.standard_normal(64)
    rows = [(i, (one + 0.01 * rng.standard_normal(64) if i % 10 > 2 else rng.standard_normal(64)).tolist()) for i in range(4000)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    index = VectorIndex.build(v, scratch_path(spark, "near-copies"), rounds=3)
    index.calibrate()
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    truth = neighbors.exact_knn(asked, v, 10, exclude_self=True)
    assert neighbors.recall(index.search(asked, 10, exclude_self=True), truth).first()["recall"] >= 0.9


def test_one_vector_has_no_neighbours_to_find(spark):
    index = VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>"), scratch_path(spark, "one"))
    assert index.calibrate() == 1.0
