import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval
from corpusloom.plans import domain, search_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")
def test_no_pair_and_no_document_is_shuffled(spark, monkeypatch):
    """Benchmark questions match most chunks: lists come by blocks, and the documents that were hit stay where they are."""
    made = []
    plain = retrieval.lexical
    monkeypatch.setattr(retrieval, "lexical", lambda *a: made.append(plain(*a)) or made[-1])
    found = search_queries.hydrated(spark, SF)
    assert "MapInArrow" in made[0]._jdf.queryExecution().toString()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert 0 < found.count() <= 20 * domain.questions(spark, SF).count()


def test_chunks_of_hits(spark, tmp_path):
    """Negative ids, several hits of a document, documents without hits, copies of an id."""
    docs = [(-5, "a\n\nb", "s"), (5, "c\nd", "s"), (6, "e", "s"), (7, "f", "s"), (7, "g", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = spark.createDataFrame([(1, "-5-2"), (1, "5-0"), (2, "5-1"), (2, "5-0"), (3, "7-0")], "query_id int, chunk_id string")
    rows = search_queries.with_chunks(spark, str(tmp_path), hits, "document_id", "text").collect()
    assert sorted((r.query_id, r.document_id, r.text) for r in rows) == [(1, -5, "b"), (1, 5, "c"), (2, 5, "c"), (2, 5, "d"), (3, 7, "f"), (3, 7, "g")]


def test_overlap_makes_no_array_for_each_term(spark):
    rows = spark.createDataFrame([(["a", "b", "a"], ["b", "b", "c", "d"]), ([], ["a"]), (["a"], [])], "q array<string>, p array<string>")
    got = rows.select(retrieval.overlap_score(F.col("q"), F.col("p")).alias("score"))
    assert [r.score for r in got.collect()] == [round(0.8 * 0.5 + 0.2 * (2 / 2 / 3), 6), 0.0, 0.0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(array_distinct" not in plan


def test_hashed_vectors_add_features_in_order(spark, monkeypatch):
    """Each distinct feature is hashed once; sums are those of a plain loop, to the last bit."""
    texts = [None, "", "a", "no the of", "red red red fox", *(" ".join(f"w{k * k % 7}" for k in range(n)) for n in range(2, 40))]
    monkeypatch.setattr(retrieval, "HASHED", 5)

    def plain(terms, size=16):
        counts, out = {}, np.zeros(size)
        for f in [*terms, *map("_".join, zip(terms, terms[1:]))]:
            counts[f] = counts.get(f, 0) + 1
        for f, n in counts.items():
            h = hashlib.blake2b(f.encode(), digest_size=8).digest()
            weight = (1 + np.log(n)) * (0.5 if "_" in f else 1.0)
            out[int.from_bytes(h[:4], "little") % size] += weight if h[4] & 1 else -weight
        if not out.any():
            out[0] = 1.0
        return (out / np.linalg.norm(out)).astype(np.float32).tolist()

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("terms", T.content_terms(F.coalesce("text", F.lit(""))))
    for r in retrieval.hashed_vectors(rows, size=16).collect():
        assert r.embedding == plain(r.terms), r.text
    calls = []
    plain_hash = hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda b, **k: calls.append(b) or plain_hash(b, **k))
    retrieval.hashed(pa.array([["a", "b"]] * 50), 16)
    assert sorted(calls) == [b"a", b"a_b", b"b"]
