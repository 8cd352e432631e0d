"""Mixing, vector codes and fill-in-the-middle: edge cases, brute force and the parts of the methods."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, fill_middle, kd_tree, source_mix, vector_codes

WORDS = "doc_id long, text string, source string, rank int, size string, n int, form string, shard string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "y", "z") for i, t, s in rows], WORDS).repartition(3)


# mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """The excess over a limit is shared again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        stopped = {s for s in open_ if weight[s] * left / total > most * sizes[s]}
        if not stopped:
            return out | {s: weight[s] * left / total for s in open_}
        out |= {s: most * sizes[s] for s in stopped}
        left, open_ = left - sum(most * sizes[s] for s in stopped), open_ - stopped
    return out


def checked_mix(spark, rows):
    found = source_mix.mixed(documents(spark, rows))
    got = found.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.laps * r.size + sum(x.end - x.begin for x in r.spans) and 0 <= r.taken <= 3 * r.size
        assert all(0 <= x.begin < x.end <= r.size for x in r.spans)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return sizes, want, taken, sorted((r.doc_id or 0, r.size, r.taken) for r in got), found


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(1, 900), rng.choice(["a", "b", "b", "b", "b", "ß", "日本", "z"])) for k in range(300)]
    rows += [(1000, "tail words " * 40, "tiny"), (None, "no name " * 9, None), (None, None, None), (1001, "", "b"), (1001, None, "b"), (1002, " \n\t ", "empty"), (5000, "long " * 60_000, "b")]
    rows += [(2000, "the same text again " * 12, "b")] * 40
    sizes, want, taken, first, _ = checked_mix(spark, rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * source_mix.BLOCK, (s, t, taken[s])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert checked_mix(spark, rows[::-1])[3] == first


def test_mix_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 2000)
    monkeypatch.setattr(source_mix, "SHARD_ROWS", 30)
    monkeypatch.setattr(common, "FACTS", 1)
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(200), rng.choice("aabbbbbbbbc")) for k in range(600)]
    sizes, want, taken, _, found = checked_mix(spark, rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix_of_nothing(spark):
    assert checked_mix(spark, [])[2] == {}
    assert checked_mix(spark, [(1, None, "a"), (2, " ", None)])[2] == {"a": 0, None: 0}
    assert checked_mix(spark, [(1, "only one here", "a")])[2] == {"a": 3}


def test_targets_of_many_words(spark):
    """A weight times the words of all sources passes 2 ** 31 here, the words themselves don't; and they do in the second case."""
    for sizes in ({"a": 700_000_000, "b": 300_000_000, "c": 20_000_000, None: 5}, {"a": 7_000_000_000, "b": 3_000_000_000, None: 5}):
        rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, copies long")
        got = {r.source: r for r in source_mix.targets(rows).collect()}
        assert {s: r.source_size for s, r in got.items()} == sizes
        assert {s: r.target for s, r in got.items()} == pytest.approx(plain_targets(sizes))


def test_highest_quotients(spark, monkeypatch):
    """Equal to the sorted list of all quotients, with many ties, however few seats are ranked one by one."""
    rng = random.Random(7)
    cells = [(k // 5, k % 5, n := rng.randrange(1, 30), rng.choice([0, n * 500_000, rng.randrange(3_000_000 * n)])) for k in range(80)]
    cells += [(100 + k, 0, 4, 1_500_000) for k in range(50)]
    seats = sorted((-v / (i - 0.5), r, s, i) for r, s, n, v in cells for i in range(1, 3 * n + 1))
    want = {}
    for _, r, s, _ in seats[: (sum(c[3] for c in cells) + 500_000) // 1_000_000]:
        want[r, s] = want.get((r, s), 0) + 1
    for few in (source_mix.FEW, 1):
        monkeypatch.setattr(source_mix, "FEW", few)
        got = source_mix.quotas(spark.createDataFrame(cells, "rank long, shard long, n long, votes long").repartition(3)).collect()
        assert {(x.rank, x.shard): x.quota for x in got if x.quota} == want and len(got) == len(cells)


# vector codes


def brute_codes(rows):
    """Plain rounds over all pairs in Python integers."""
    kept = sorted((i, [int(np.floor(np.float32(x).astype(float) * 4096)) for x in v]) for i, v in rows)
    part = {k: [v[p * len(v) // 8 : (p + 1) * len(v) // 8] for p in range(8)] for k, (_, v) in enumerate(kept)}
    books = [[part[k][p] for k in range(min(16, len(kept)))] for p in range(8)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p in range(8):
            mine = {}
            for k in part:
                mine.setdefault(near(part[k][p], books[p])[0], []).append(part[k][p])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else b for e, b in enumerate(books[p])]
    out = []
    for k, (i, _) in enumerate(kept):
        each = [near(part[k][p], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for e, _ in each), sum(d for _, d in each)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, code string, total long, width int"


def checked_codes(spark, rows):
    made = vector_codes.compressed(spark.createDataFrame([(i, v, n, "c", 1, 2) for i, v, n in rows], VECTORS).repartition(3)).collect()
    want, digest = brute_codes([(i, v) for i, v, _ in rows if v and not any(x is None or not np.isfinite(x) for x in v)])
    assert sorted((r.vec_id, r.code, r.error) for r in made) == want and {r.codebooks_sha256 for r in made} == {digest}
    sums = {}
    for r in made:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in made)


def test_codes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=16) * 0.2).astype("f4").tolist(), None if k % 7 == 0 else k % 3) for k in range(200)]
    rows += [(300 + k, [0.25] * 16, 1) for k in range(40)] + [(500, [-0.0001] * 16, 2)] * 3  # ties, repeated rows, floors of negatives
    rows += [(600, None, 1), (601, [None] + [0.5] * 15, 1), (602, [float("nan")] * 16, 1), (603, [float("inf")] * 16, 1), (604, [], 1)]
    checked_codes(spark, rows)
    monkeypatch.setattr(vector_codes, "BLOCK", 16 * 33)
    monkeypatch.setattr(common, "FACTS", 1)
    checked_codes(spark, rows)


def test_codes_of_little(spark):
    checked_codes(spark, [(k, [0.5 * k] * 8, None) for k in range(5)])
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compressed(empty).count() == 0
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1), (3, [0.5] * 9, 1), (4, [3e38] * 8, 1), (None, [0.25] * 8, None)]
    made = vector_codes.compressed(spark.createDataFrame([(*r, "", 1, 2) for r in rows], VECTORS)).collect()
    assert sorted(str(r.vec_id) for r in made) == ["1", "4", "None"] and all(r.error == 0 for r in made)


def test_filtering_equals_all_pairs():
    """Random, clustered and tied vectors: the same entries and sums as comparing all pairs."""
    rng = np.random.default_rng(2)
    for n, scale in ((1, 5), (7, 3), (100, 2), (3000, 4), (3000, 2000)):
        for points in (rng.integers(-scale, scale + 1, (n, 4)), rng.integers(-9, 9, (16, 4))[rng.integers(0, 16, n)] * 1000 + rng.integers(0, 9, (n, 4))):
            entries = points[rng.integers(0, n, 16)].astype(np.int64)
            tree = kd_tree.build(points.astype(np.int64))
            found = kd_tree.assign(tree, entries)
            want = kd_tree.distances(points, entries).argmin(axis=1)
            got = np.empty(n, np.int64)
            got[tree.order] = found.entry
            assert (got == want).all() and (found.count == np.bincount(want, minlength=16)).all()
            assert all((found.sums[e] == points[want == e].sum(axis=0)).all() for e in range(16))


def test_clusters_go_as_whole_subtrees():
    """With one entry in each of 16 separate clusters nearly all vectors are assigned with their subtree."""
    rng = np.random.default_rng(3)
    centres = np.stack(np.meshgrid(*[[0, 1000]] * 4), axis=-1).reshape(16, 4)
    points = centres[rng.integers(0, 16, 3000)] + rng.integers(0, 9, (3000, 4))
    assert kd_tree.assign(kd_tree.build(points), centres).whole > 0.9 * 3000


# fill in the middle


def test_fill_middle(spark):
    texts = ["", None, "a", "one two  three\n", "x<P>y", "<S", "<M", "< P>", "İ Σ ß 日本 😀 don't 12.5", "x" * 30_000, "ab \t" * 20_000, "\x00\x85 ", "<P", "M>", "ends with <"]
    rows = [(k * 20 + j, t, "s") for k, t in enumerate(texts) for j in range(20)] + [(None, "nameless text here", None)] * 2
    made = fill_middle.transformed(documents(spark, rows))
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"} and {r.rank for r in got} == {1}
    for r in got:
        text = r.text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            want = ("plain", None, None, text)
        else:
            form = "spm" if h4 % 100 < 20 else "psm"
            want = (form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == want and r.n == len(units) and r.back == text
    assert fill_middle.transformed(documents(spark, [])).count() == 0


def test_matcher_stops_at_the_second_rank():
    seen = []

    class Unit:
        def finditer(self, text):
            for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text):
                seen.append(m)
                yield m

    old, fill_middle.UNIT = fill_middle.UNIT, Unit()
    try:
        assert fill_middle.ends("a b c d e f", 2, 5) == (2, 5) and len(seen) == 5
    finally:
        fill_middle.UNIT = old
