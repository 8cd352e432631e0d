"""Stateful streams over files, a few rows at a time and with a restart between, against their batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chat
from corpusloom.streaming import answers
from corpusloom.streaming.limits import running_budget


def streamed(spark, tmp_path, pieces, schema, plan):
    """Rows of a stream over pieces of input, a file and a micro-batch each; the query is stopped and started again after each."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part={k:03d}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        query = plan(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append")
        query.trigger(availableNow=True).start(str(out)).awaitTermination()
    return spark.read.parquet(str(out)).collect()


def cut(rng, n, most):
    at = sorted({0, n, *(rng.randrange(n) for _ in range(most))})
    return list(zip(at, at[1:]))


def test_citations_cut_between_batches(spark, tmp_path):
    rng = random.Random(9)
    schema, rows = "query_id int, place int, text string, n_sources int", []
    for q in range(6):
        text = "".join(rng.choice(["word ", "[1]", "[2][3]", "[12]", "[ 1]", "[99]", "[", "]", "[[4]]", "x" * 70]) for _ in range(40))
        rows += [(q, k, text[a:b], 12) for k, (a, b) in enumerate(cut(rng, len(text), 60))]
    rows.append((7, 0, None, 3))
    pieces = [[r for r in rows if r[1] % 60 in range(a, b)] for a, b in ((0, 9), (9, 10), (10, 33), (33, 60))]
    got = sorted((r.query_id, r.n, r.place) for r in streamed(spark, tmp_path, pieces, schema, answers.stream_citations))
    want = sorted((r.query_id, r.n, r.place) for r in chat.citations_seen(spark.createDataFrame([r for r in rows if r[2]], schema)).collect())
    assert got == want and len({q for q, _, _ in got}) == 6


def test_pings_of_idle_users(spark, tmp_path):
    at = lambda s: f"2024-05-01 10:{s // 60:02d}:{s % 60:02d}"
    schema = "sub string, at string, event string, document_id int"
    pieces = [[("a", at(0), "status", 1), ("b", at(2), "status", 2), ("a", at(10), "ready", 1)], [("a", at(40), "status", 3)], [("c", at(100), "status", 4)], [("c", at(101), "ready", 4)]]
    got = streamed(spark, tmp_path, pieces, schema, lambda s: answers.with_pings(s.withColumn("ts", F.to_timestamp("at"))))
    said = sorted((r.sub, str(r.ts)[14:19], r.event) for r in got)
    assert said == sorted([
        ("a", "00:00", "status"), ("a", "00:10", "ready"), ("a", "00:25", "ping"), ("a", "00:40", "status"), ("a", "00:55", "ping"),
        ("b", "00:02", "status"), ("b", "00:17", "ping"), ("c", "01:40", "status"), ("c", "01:41", "ready"),
    ])


def test_budgets_refuse_from_the_row_that_finds_them_used_up(spark, tmp_path):
    rng = random.Random(10)
    rows = [(rng.randrange(3), k, f"2024-05-0{1 + k // 60} {k % 60 // 3:02d}:{k % 3 * 20:02d}:00", rng.choice([None, 5.0, 20.0, 0.25])) for k in range(170)]
    schema = "user_id int, event_id int, at string, value double"
    timed = lambda s: s.withColumn("ts", F.to_timestamp("at"))
    got = {r.event_id: (r.user_id, r.used, r.refused) for r in streamed(spark, tmp_path, [rows[:50], rows[50:61], rows[61:130], rows[130:]], schema, lambda s: answers.stream_budget(timed(s), 100.0))}
    batch = running_budget(timed(spark.createDataFrame(rows, schema)).withColumn("value", F.coalesce("value", F.lit(0.0))))
    want = {r.event_id: (r.user_id, pytest.approx(r.used), r.used - r.value >= 100.0) for r in batch.collect()}
    assert got == want and any(x[2] for x in got.values())
