"""Swaps in one commit: pinned readers, writers that die, and several writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lifecycle
from corpusloom.sources import sinks, snapshots

KIND = "doc_id long, ordinal int, text string"


def rows(spark, *docs):
    """Two chunks for each (doc, version)."""
    return spark.createDataFrame([(d, k, f"{d}.{k} v{v}") for d, v in docs for k in range(2)], KIND)


def ids(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "doc_id long")


def state(spark, path, version=None):
    out = {}
    for r in snapshots.read(spark, path, version).collect():
        out.setdefault(r.doc_id, set()).add((r.ordinal, r.text))
    assert all(len(v) == 2 and len({t.split()[1] for _, t in v}) == 1 for v in out.values())
    return {d: int(min(v)[1].split("v")[1]) for d, v in out.items()}


def test_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.create(rows(spark, *((d, 1) for d in range(10))), path, buckets=4) == 1
    pinned = snapshots.read(spark, path)
    assert snapshots.replace(spark, path, ids(spark, 1, 2, 3, 77, None), rows(spark, (1, 2), (2, 2), (77, 2), (5, 9))) == 2
    # 3 has no rows any more, 5 wasn't named
    assert state(spark, path) == {0: 1, 1: 2, 2: 2, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 77: 2}
    assert state(spark, path, 1) == dict.fromkeys(range(10), 1) and pinned.count() == 20
    # rows that are computed from the table itself
    now = snapshots.read(spark, path)
    snapshots.replace(spark, path, now.select("doc_id"), now.withColumn("text", F.regexp_replace("text", "v.*", "v5")))
    assert set(state(spark, path).values()) == {5}


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.create(rows(spark, (1, 1), (2, 1)), path)

    def dies(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "committed", dies)
        with pytest.raises(RuntimeError):
            snapshots.replace(spark, path, ids(spark, 1), rows(spark, (1, 2)))
    assert state(spark, path) == {1: 1, 2: 1} and snapshots.versions(spark, path) == [1]
    assert len(snapshots.listed(spark, f"{path}/data")) == 2
    assert snapshots.vacuum(spark, path) == []  # too young: someone may be writing it
    assert len(snapshots.vacuum(spark, path, hours=-1)) == 1
    snapshots.replace(spark, path, ids(spark, 1), rows(spark, (1, 3)))
    assert state(spark, path) == {1: 3, 2: 1}


@pytest.mark.parametrize("buckets", [1, 16])
def test_two_writers_both_win(spark, tmp_path, monkeypatch, buckets):
    """The second writer commits between the first one's reading and its commit, in the same buckets or others."""
    path = str(tmp_path / "t")
    snapshots.create(rows(spark, *((d, 1) for d in range(6))), path, buckets=buckets)
    real, calls = snapshots.committed, []

    def late(*args):
        calls.append(args[2])
        if len(calls) == 1:
            snapshots.replace(spark, path, ids(spark, 2, 3), rows(spark, (2, 7), (3, 7)))
        real(*args)

    monkeypatch.setattr(snapshots, "committed", late)
    assert snapshots.replace(spark, path, ids(spark, 1, 2), rows(spark, (1, 4), (2, 4))) == 3
    assert calls == [2, 2, 3]
    assert state(spark, path) == {0: 1, 1: 4, 2: 4, 3: 7, 4: 1, 5: 1} and state(spark, path, 2) == {0: 1, 1: 1, 2: 7, 3: 7, 4: 1, 5: 1}


def test_many_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []
    snapshots.create(rows(spark, *((d, 1) for d in range(6))), path, buckets=3)

    def work(d):
        try:
            snapshots.replace(spark, path, ids(spark, d, 100 + d), rows(spark, (d, 10 + d), (100 + d, 10 + d)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(d,)) for d in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and snapshots.versions(spark, path) == [1, 2, 3, 4, 5, 6]
    assert state(spark, path) == {5: 1} | {d: 10 + d for d in range(5)} | {100 + d: 10 + d for d in range(5)}


def test_staged_documents_swap_when_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(d, k, f"h{d}{k}", "t", "m", [1.0]) for d in (1, 2) for k in range(3)]
    existing = spark.createDataFrame(old, "doc_id int, ordinal int, content_hash string, text string, model string, embedding array<double>")
    snapshots.create(existing, path)
    drafts = spark.createDataFrame([(1, 0, "h10", "t"), (1, 1, "new", "t"), (2, 0, "new", "t")], "doc_id int, ordinal int, content_hash string, text string")
    embed = F.when(F.col("doc_id") == 1, F.array(F.lit(2.0)))
    version = sinks.swap_documents(lifecycle.embedded(lifecycle.staged(snapshots.read(spark, path), drafts, "m"), embed), path, "m")
    got = sorted((r.doc_id, r.content_hash) for r in snapshots.read(spark, path, version).collect())
    assert got == [(1, "h10"), (1, "new"), (2, "h20"), (2, "h21"), (2, "h22")]


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.create(rows(spark, (1, 1)).limit(0), path)
    assert snapshots.read(spark, path).count() == 0
    snapshots.replace(spark, path, ids(spark, 4), rows(spark, (4, 1)))
    assert state(spark, path) == {4: 1}
    snapshots.replace(spark, path, ids(spark, 4), rows(spark, (4, 1)).limit(0))
    assert snapshots.read(spark, path).count() == 0
