"""Exact block search against all pairs, and the index against the exact search."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from corpusloom.operators import retrieval, vector_index, vectors
from corpusloom.plans import search_queries

SF = "/root/testdata/sf0.01"


def brute(questions, rows, allowed, k):
    may = set(allowed)
    out = {}
    for q, sub, model, v in questions:
        scored = []
        for c, coll, m, w in rows:
            if m != model or (sub, coll) not in may or w is None or len(w) != len(v) or any(x is None or not math.isfinite(x) for x in w) or not any(w):
                continue
            a, b = np.array(v, "f4").astype(float), np.array(w, "f4").astype(float)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), c))
        for rank, (s, c) in enumerate(sorted(scored)[:k], 1):
            out[q, rank] = (c, -s)
    return out


def frames(spark, questions, rows, allowed):
    return (
        spark.createDataFrame(questions, "query_id long, sub string, model int, embedding array<float>"),
        spark.createDataFrame(rows, "chunk_id string, collection_id string, model int, embedding array<float>").repartition(5),
        spark.createDataFrame(allowed, "sub string, collection_id string"),
    )


def many(n, dims=8):
    rng = np.random.default_rng(4)
    rows = [(f"c{k:04d}", f"s{k % 7}", k % 2, rng.normal(size=dims).round(2).tolist()) for k in range(n)]
    rows += [(f"d{k:04d}", "s1", 1, [0.5] * dims) for k in range(200)]  # equal vectors: ties go to the smaller id
    rows += [("e0", "s1", 1, None), ("e1", "s1", 1, [None] * dims), ("e2", "s1", 1, [float("nan")] * dims), ("e3", "s1", 1, [0.0] * dims), ("e4", "s1", 1, [1.0] * (dims + 1)), ("e5", None, 1, [1.0] * dims)]
    questions = [(q, f"u{q % 4}", q % 2, (rng.normal(size=dims) if q % 5 else np.full(dims, 0.5)).round(2).tolist()) for q in range(40)]
    allowed = [("u0", "s1"), ("u0", "s1"), ("u1", "s1"), ("u1", "s2"), ("u2", "s6"), ("u0", None)]
    return questions, rows, allowed


@pytest.mark.parametrize("size", [vectors.QUESTIONS, 7])
def test_nearest_equals_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "QUESTIONS", size)
    monkeypatch.setattr(vectors, "ROWS", 64)
    data = many(900)
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in vectors.nearest(*frames(spark, *data), k=15).collect()}
    assert got == brute(*data, 15)
    assert vectors.nearest(*frames(spark, [], *data[1:])).count() == 0 and vectors.nearest(*frames(spark, data[0], [], data[2])).count() == 0


def test_vectors_are_neither_shuffled_nor_joined(spark):
    plan = vectors.nearest(*frames(spark, *many(50)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")
def test_index_recall_on_a_whole_table(spark, tmp_path):
    rows, questions, may = search_queries.vectors(spark, SF), search_queries.vector_questions(spark, SF), search_queries.readable(spark)
    path = str(tmp_path / "index")
    vector_index.build(rows, path)
    want = {(r.query_id, r.chunk_id): round(r.score, 9) for r in retrieval.vector(questions, rows, may).collect()}
    got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in vector_index.search(path, questions, may).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(want[k] == got[k] for k in got.keys() & want.keys())
    every = vector_index.search(path, questions, may, probes=10_000).collect()
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in every} == want


def test_filters_cost_lists_not_results(spark, tmp_path):
    """Each user reads one vector in forty, and still gets all k of them from one list at first."""
    rng = np.random.default_rng(5)
    rows = [(f"c{k:04d}", f"s{k % 40}", 0, rng.normal(size=8).tolist()) for k in range(2000)]
    questions = [(q, "u", 0, rng.normal(size=8).tolist()) for q in range(10)]
    q, v, may = frames(spark, questions, rows, [("u", "s3")])
    vector_index.build(v, str(tmp_path / "i"), lists=30)
    got = vector_index.search(str(tmp_path / "i"), q, may, k=40, probes=1).collect()
    assert len(got) == 400 and {r.rank for r in got} == set(range(1, 41))


def test_clustered_vectors_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(f"c{k:04d}", "s", 0, (centres[k % 40] + rng.normal(size=16) * 0.05).tolist()) for k in range(2000)]
    q, v, may = frames(spark, [(k, "u", 0, rows[k * 31][3]) for k in range(20)], rows, [("u", "s")])
    path = str(tmp_path / "i")
    vector_index.build(v, path)
    centroids = vector_index.read_centroids(spark, path)
    for blocks in vectors.question_blocks(q, may):
        assert all((n <= 4).all() for n in vector_index.wanted_lists(spark, path, blocks, 10).values()) and len(centroids["0"]) == 45
        for b in blocks.values():
            b.probes = np.zeros((20, 45), bool)
            b.probes[:, [3, 8]] = True
        read = vector_index.read_vectors(spark, path).where(vector_index.lists_of(blocks)).select("code")
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "IN (3,8)" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "struct<code:binary>" in plan.split("ReadSchema")[1]
    want = {(r.query_id, r.chunk_id) for r in vectors.nearest(q, v, may, 10).collect()}
    got = {(r.query_id, r.chunk_id) for r in vector_index.search(path, q, may, 10).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_index_of_odd_rows_and_later_ones(spark, tmp_path):
    questions, rows, allowed = many(300)
    q, v, may = frames(spark, questions, rows[:250], allowed)
    path = str(tmp_path / "i")
    vector_index.build(v, path)
    vector_index.add(frames(spark, questions, rows[250:], allowed)[1], path)
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in vector_index.search(path, q, may, 15, probes=1000).collect()}
    assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in brute(questions, rows, allowed, 15).items()}
    nothing = frames(spark, [], [], [])
    vector_index.build(nothing[1], str(tmp_path / "none"))
    assert vector_index.search(str(tmp_path / "none"), q, may).count() == 0


def test_hashed_vectors_of_a_whole_table(spark):
    """Signed hashed counts of stems and neighbouring pairs, against a plain loop over the features."""
    docs = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(-1, ""), (-2, None), (-3, "the of")], "item_id long, text string"))
    rows = retrieval.hashed_vectors(docs.withColumn("terms", T.content_terms(F.coalesce("text", F.lit("")))), size=64).collect()
    assert len(rows) == docs.count()
    for r in rows:
        pairs = [f"{a}_{b}" for a, b in zip(r.terms, r.terms[1:])]
        want = np.zeros(64)
        for f in {*r.terms, *pairs}:
            digest = hashlib.blake2b(f.encode(), digest_size=8).digest()
            size = (1 + math.log([*r.terms, *pairs].count(f))) * (0.5 if f in pairs and "_" in f else 1)
            want[int.from_bytes(digest[:4], "little") % 64] += size * (1 if digest[4] % 2 else -1)
        want = want / np.linalg.norm(want) if want.any() else np.eye(64)[0]
        assert np.allclose(r.embedding, want, atol=1e-6)
