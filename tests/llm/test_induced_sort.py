import tracemalloc
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import induced_sort, substring_dedup
from corpusloom.llm.merging import PairMerger


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.integers(0, 3), st.integers(1, 900), st.sampled_from([4, 200]), st.sampled_from([16, 64, 1 << 20]))
def test_suffixes_and_common_prefixes(part, copies, factor, depth, bound):
    """With room for all, and with so little that stores lie in files and names are sorted by recursion; few symbols and many."""
    text = [factor * x for x in part] * (copies + 1) + [0]
    order = sorted(range(len(text)), key=lambda k: text[k:])
    blocks = list(induced_sort.sorted_suffixes(np.array(text), depth, induced_sort.Room(bound)))
    got, common = (np.concatenate(c) for c in zip(*blocks))
    assert [text[k : k + depth] for k in got] == [text[k : k + depth] for k in order]
    want = [0]
    for a, b in zip(order, order[1:]):
        want.append(next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1]), 0))
    assert common.tolist() == [min(depth, w) for w in want]


def test_rows_in_order_through_the_disk():
    room = induced_sort.Room(bound=64)
    keys = np.random.default_rng(1).permutation(5000)
    got = list(induced_sort.in_order(((k, 2 * k) for k in np.array_split(keys, 70)), room))
    assert np.concatenate([b[0] for b in got]).tolist() == list(range(5000)) and all((b[1] == 2 * b[0]).all() for b in got)
    assert room.file is not None and max(len(b[0]) for b in got) <= room.block


def test_shard_of_twenty_times_the_memory():
    """Repeats of a shard with 20 times as many signs as the room has entries equal those by hashing; the memory taken stays
    a fraction of what the shard's arrays would need (171 bytes a sign when all were held)."""
    draw, bound = np.random.default_rng(4), 50_000
    words = [draw.integers(97, 123, n, np.uint8).tobytes() for n in draw.integers(2, 9, 500)]
    passage = [b" ".join(words[k] for k in draw.integers(0, 500, 80)) for _ in range(30)]
    pieces = []
    for k in range(900):
        text = b" ".join(words[j] for j in draw.integers(0, 500, int(draw.integers(60, 320))))
        pieces.append(text + passage[k % 30][: int(draw.integers(150, 400))] + text[:90] if k % 3 == 0 else text)
    pieces = list(dict.fromkeys(pieces))
    total = sum(map(len, pieces))
    assert total > 20 * bound
    seen = Counter(p[k : k + 200] for p in pieces for k in range(len(p) - 199))
    want = {(i, k) for i, p in enumerate(pieces) for k in range(len(p) - 199) if seen[p[k : k + 200]] > 1}
    del seen
    shard = substring_dedup.Shard(bound)
    for k, p in enumerate(pieces):
        shard.add(7, k, len(p) - 199, p)
    tracemalloc.start()
    piece, first, last = shard.repeats()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {(i, k) for i, a, b in zip(piece.tolist(), first.tolist(), last.tolist()) for k in range(a, b + 1)}
    print(f"{total} signs, room for {bound}: peak {peak / 1e6:.1f} MB, {peak / total:.1f} bytes a sign")
    assert got == want and want and peak < 25 * total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=6), st.randoms(use_true_random=False))
def test_merging_in_step_equals_one_pair_at_a_time(words, draw):
    table, n = {}, 4
    for _ in range(12):
        pair = (draw.randrange(n), draw.randrange(n))
        if pair not in table:
            table[pair] = (draw.randrange(30), n)
            n += 1
    rows = np.array([(a, b, r, c) for (a, b), (r, c) in table.items()])
    merger = PairMerger(*rows.T)
    flat, sizes = merger.run(np.array([s for w in words for s in w], np.int64), np.array([len(w) for w in words], np.int64))
    got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if words else []
    for word, out in zip(words, got):
        w = list(word)
        while options := [(table[p][0], k) for k, p in enumerate(zip(w, w[1:])) if p in table]:
            _, k = min(options)
            w[k : k + 2] = [table[(w[k], w[k + 1])][1]]
        assert out == w and (len(word) < 2 or merger.by_heap(list(word)) == w)
