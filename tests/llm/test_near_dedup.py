"""Near-duplicates against all pairs: borderline groups, recall near the threshold, and ids of any size."""

import numpy as np
import pytest

from corpusloom.llm import near_dedup

SCHEMA = "doc_id long, text string"


def sets_of(rows):
    words = {i: t.lower().split() for i, t in rows}
    return {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}


def similarity(a, b):
    return len(a & b) / len(a | b)


def by_all_pairs(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(draw, words, n, pool):
    """A copy with n words replaced."""
    out = list(words)
    for k in draw.choice(len(words), n, replace=False):
        out[k] = pool[draw.integers(len(pool))]
    return " ".join(out)


@pytest.mark.parametrize("most", [1 << 21, 2000])
def test_borderline_group(spark, monkeypatch, most):
    """One group of copies of one text whose pairs lie around the threshold, some with edits in common."""
    monkeypatch.setattr(near_dedup, "LIST", most)
    draw = np.random.default_rng(5)
    base, pool = [f"b{k}" for k in range(140)], [f"p{k}" for k in range(40)]
    some = [edited(draw, base, 5, pool).split() for _ in range(6)]
    rows = [(k, edited(draw, some[k % 6] if k % 2 else base, int(draw.integers(1, 9)), pool)) for k in range(150)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_all_pairs(sets_of(rows))


def test_recall_near_the_threshold(spark):
    """400 separate pairs with similarities from 0.74 to 0.80: those of 0.75 or more are found, the others aren't."""
    draw = np.random.default_rng(8)
    rows, want = [], {}
    while len(want) < 400:
        k = len(want)
        words = [f"w{k}_{j}" for j in range(int(draw.integers(60, 160)))]
        other = edited(draw, words, max(1, round(len(words) * draw.uniform(0.02, 0.035))), [f"x{k}_{j}" for j in range(99)])
        pair = sets_of([(0, " ".join(words)), (1, other)])
        if 0.74 <= (s := similarity(pair[0], pair[1])) <= 0.80:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, other)]
            want[k] = s >= 0.75
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {k: got[2 * k + 1] == 2 * k for k in want}
    linked = [k for k in want if want[k]]
    recall = sum(found[k] for k in linked) / len(linked)
    print(f"recall of {len(linked)} pairs at 0.75 to 0.80: {recall:.4f}")
    assert recall == 1.0 and not any(found[k] for k in want if not want[k])


def test_ids_of_any_size(spark):
    top = (1 << 63) - 1
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(top, text), (top - 1, text + " more"), (-5, "alone " * 3 + "and short text"), (None, text + " end"), (None, "nameless one of its own kind here"), (None, "nameless one of its own kind here")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    low = str(top - 1)
    assert got == sorted([(str(top), low, False), (low, low, True), ("-5", "-5", True), ("None", low, False), ("None", "None", True), ("None", "None", True)])


def test_ids_with_several_texts(spark):
    """Every text of an id keeps its own links, whichever of them represents its class."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (0, c), (5, c + " z"), (5, text("d")), (6, text("d") + " w"), (7, text("e")), (7, text("e")), (8, None), (8, text("f")), (9, text("f"))]
    rows += [(20, text(f"g{k}")) for k in range(30)] + [(100 + k, text(f"g{k}") + " q") for k in range(30)]
    got = {}
    for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    want = {1: {1}, 2: {1}, 3: {1}, 0: {0}, 5: {0}, 6: {0}, 7: {7}, 9: {8}, 20: {20}, **{100 + k: {20} for k in range(30)}}
    assert got.pop(8) == {8} and got == want
