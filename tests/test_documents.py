import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import documents


def test_hyphens_close_up_before_small_letters(spark):
    rows = spark.createDataFrame([(["exam-", "ple of", "A-", "Z", " "],), ([],)], "p array<string>")
    assert [r[0] for r in rows.select(documents.dehyphenated(F.col("p"))).collect()] == ["example of A- Z", ""]


def test_two_clusters_of_questions(spark):
    rows = [
        (1, "a", "vacation days policy abroad", 1, ["vacation", "day", "policy", "abroad"]), (2, "b", "vacation days policy", 2, ["vacation", "day", "policy"]),
        (3, "a", "printer jam", 3, ["printer", "jam"]),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "id int, user string, question string, at int, terms array<string>, embedding array<float>")
    got = documents.clusters(df.withColumn("at", F.timestamp_seconds("at"))).collect()
    assert [(r.label, r.n, r.users) for r in got] == [("vacation days policy", 2, 2), ("printer jam", 1, 1)]


@pytest.mark.parametrize(
    ("schedule", "last", "fires"),
    [
        ("0 * * * *", "2024-01-01 09:30", True), ("0 11 * * *", "2024-01-01 09:30", False), ("*/15 * * * *", "2024-01-01 09:59", True), ("bad", "2023-01-01", False),
        ("0 0 * * 1", None, True), ("0 0 * * 0", "2023-12-31 01:00", False), ("61 * * * *", None, False), (None, None, False),
    ],
)
def test_schedules(schedule, last, fires):
    assert documents.is_due(schedule, last and pd.Timestamp(last), pd.Timestamp("2024-01-01 10:00")) is fires


def test_deleted_documents_stay_deleted(spark):
    df = spark.createDataFrame([(1, "deleted", 1, 1), (1, "ready", 2, 2), (2, "queued", 1, 3), (2, "ready", 1, 4)], "doc_id int, status string, at int, id int")
    assert {r.doc_id: r.status for r in documents.status_now(df).collect()} == {1: "deleted", 2: "ready"}


def test_quantile_inside_a_bucket(spark):
    df = spark.createDataFrame([([10, 20, 40],), ([0, 0, 0],), ([40, 40, 40],)], "c array<long>")
    got = [r[0] for r in df.select(documents.histogram_quantile(F.col("c"), [1.0, 2.0, 4.0], 0.5)).collect()]
    assert got == [2.0, None, 0.5]
