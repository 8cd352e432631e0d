import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lifecycle
from corpusloom.sources import sinks, snapshots, tables

OLD = [(1, 0, "a", "m", 1.0), (1, 2, "a", "m", 2.0), (1, 3, "b", "x", 3.0), (1, 4, "c", "m", None), (2, 0, "a", "m", 4.0), (None, 0, "a", "m", 5.0), (3, 0, None, "m", 6.0)]
NEW = [(1, 7, "a"), (1, 5, "a"), (1, 1, "b"), (1, 2, "c"), (2, 3, "z"), (2, 1, "a"), (None, 0, "a"), (3, 0, None)]


def sides(spark):
    old = spark.createDataFrame([(d, o, h, f"t{d}-{o}", m, e and [e]) for d, o, h, m, e in OLD], "doc_id long, ordinal int, content_hash string, text string, model string, embedding array<double>")
    return old, spark.createDataFrame([(d, o, h, f"n{d}-{o}") for d, o, h in NEW], "doc_id long, ordinal int, content_hash string, text string")


def test_staged_takes_one_shuffle(spark):
    """Of equal hashes the first takes over, chunks of another model and null keys don't; texts and hashes are shuffled once."""
    rows = lifecycle.staged(*sides(spark), "m")
    assert sorted((str(r.doc_id), r.ordinal, r.text, r.embedding, r.state) for r in rows.collect()) == [
        ("1", 1, "n1-1", None, "pending"), ("1", 2, "n1-2", None, "reused"), ("1", 5, "n1-5", [1.0], "reused"), ("1", 7, "n1-7", None, "pending"),
        ("2", 1, "n2-1", [4.0], "reused"), ("2", 3, "n2-3", None, "pending"), ("3", 0, "n3-0", None, "pending"), ("None", 0, "nNone-0", None, "pending"),
    ]
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


@pytest.mark.parametrize("most", [0, 5_000_000])
def test_swap_with_many_and_few_documents(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(tables, "NUMBERS", most)
    old, drafts = sides(spark)
    path = f"{tmp_path}/t"
    snapshots.create(old, path, buckets=3)
    rows = lifecycle.staged(old, drafts.where("doc_id = 2"), "m")
    embedded = lifecycle.embedded(rows, F.array(F.lit(9.0)))
    got = snapshots.read(spark, path, sinks.swap_documents(embedded, path, "m")).collect()
    assert sorted((str(r.doc_id), r.ordinal, r.text) for r in got) == sorted([(str(d), o, f"t{d}-{o}") for d, o, *_ in OLD if d != 2] + [("2", 1, "n2-1"), ("2", 3, "n2-3")])
    assert ("broadcast" in tables.as_set(drafts.select("doc_id"))._jdf.queryExecution().toString().lower()) == (most > 0)
