"""External induced sorting of suffixes with their common prefixes.

Suffixes are of type S or L as they are smaller or larger than the one that follows; S* ones follow an L.
The substrings between S* positions are named by rank; if names repeat, the string of names, at most half as long, is
sorted by the same procedure, until it is short enough to be sorted in memory by doubling. From the sorted S* suffixes
one ascending pass induces the L suffixes and one descending pass the S ones: a suffix that leaves the queue puts
the one before it into the queue under that one's first symbol.

A queue holds tuples (position, common prefix with the tuple before) by ranges of symbols. What goes in under a symbol
arrives in order, so a range of one symbol is read block by block, first in first out; a range of several symbols is
sorted as it is reached. A batch of tuples leaves at once if nothing that it puts in belongs before its end.
Common prefixes are carried along: that of two tuples is one more than the least of those between the
suffixes that induced them. All are cut off at `depth`; the order of suffixes that agree that far is left
open, which is all that a search for repeats of `depth` symbols needs.

Whatever grows with the text is in a Room: stores of blocks and arrays, in memory up to `bound` entries and in an unlinked
scratch file of the task beyond. In memory there are blocks of bound / 8 entries at most, the tuples of one range of
symbols, and the strings that doubling sorts, of bound / 4 names at most. Types, names, seeds, queues and the order itself
are written and read in blocks; the text is read at random places through a map of its file.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Symbols that comparisons read at a time.
WIDTH = 16
BOUND = 1 << 23
Block = tuple[np.ndarray, ...]


class Room:
    """Where the stores and arrays of a sort are: up to `bound` entries in memory, the others in a file."""

    def __init__(self, bound: int = BOUND):
        self.bound, self.held, self.file = bound, 0, None
        self.block = max(16, bound // 8)

    def put(self, block: Block) -> tuple:
        n = len(block[0])
        if self.held + n <= self.bound:
            self.held += n
            return n, block
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for column in block:
            self.file.write(np.ascontiguousarray(column).data)
        return n, at, [c.dtype for c in block]

    def get(self, handle: tuple, free: bool = True) -> Block:
        if len(handle) == 2:
            self.held -= handle[0] if free else 0
            return handle[1]
        n, at, kinds = handle
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)

    def array(self, kind: type | str, n: int) -> np.ndarray:
        """An array of zeros, mapped from a file of its own if it has more than bound / 4 entries."""
        if n <= self.bound // 4:
            return np.zeros(n, kind)
        spool = tempfile.TemporaryFile()
        spool.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(spool, kind, "r+", shape=(n,))


class Store:
    """Blocks in order."""

    def __init__(self, room: Room):
        self.room, self.handles, self.n = room, [], 0

    def put(self, *block: np.ndarray) -> None:
        n, most = len(block[0]), self.room.block
        for a in range(0, n, most):
            self.handles.append(self.room.put(tuple(c[a : a + most] for c in block)))
        self.n += n

    def take(self) -> Iterator[Block]:
        """The blocks, first to last, including those put in meanwhile."""
        while self.handles:
            yield self.room.get(self.handles.pop(0))

    def backwards(self) -> Iterator[Block]:
        """Positions and common prefixes from the last to the first: a prefix is shared with the one before it in that order."""
        common = 0
        while self.handles:
            position, prefix = self.room.get(self.handles.pop())
            yield position[::-1], np.concatenate([[common], prefix[:0:-1]]).astype(prefix.dtype)
            common = int(prefix[0])


def merged_runs(runs: list[Iterator[Block]], most: int) -> Iterator[Block]:
    """The rows of runs, each in order of its first column, in order of it."""
    heads = [[b, r] for r in runs if (b := next(r, None)) is not None]
    while heads:
        # what lies beyond a head's last key may still come, so keys up to the least of these are final
        least = min(h[0][0][-1] for h in heads)
        parts, left = [], []
        for head, run in heads:
            k = int(np.searchsorted(head[0], least, "right"))
            parts.append(tuple(c[:k] for c in head))
            rest = tuple(c[k:] for c in head) if k < len(head[0]) else next(run, None)
            if rest is not None:
                left.append([rest, run])
        heads = left
        joined = tuple(map(np.concatenate, zip(*parts)))
        order = np.argsort(joined[0], kind="stable")
        for a in range(0, len(order), most):
            yield tuple(c[order[a : a + most]] for c in joined)


def in_order(blocks: Iterable[Block], room: Room) -> Iterator[Block]:
    """The rows of blocks in order of their first column: sorted runs, merged."""
    runs: list[Store] = []
    held: list[Block] = []
    size = 0

    def run() -> None:
        joined = tuple(map(np.concatenate, zip(*held)))
        order = np.argsort(joined[0], kind="stable")
        runs.append(Store(room))
        runs[-1].put(*(c[order] for c in joined))

    for block in blocks:
        held.append(block)
        size += len(block[0])
        if size > room.bound // 4:
            run()
            held, size = [], 0
    if held:
        run()
    while len(runs) > 32:  # so that the heads of all runs fit in memory
        some, runs = runs[:32], runs[32:]
        runs.append(Store(room))
        for block in merged_runs([s.take() for s in some], room.block):
            runs[-1].put(*block)
    yield from merged_runs([s.take() for s in runs], room.block)


def spans(n: int, block: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, block):
        yield a, min(n, a + block)


def types(text: np.ndarray, room: Room) -> np.ndarray:
    """Whether each suffix is of type S, from the last block to the first. The last symbol is the smallest and occurs once."""
    n = len(text)
    out = room.array(bool, n)
    out[n - 1] = True
    for a, b in reversed(list(spans(n - 1, room.block))):
        step = np.diff(np.asarray(text[a : b + 1]).astype(np.int64))
        m = b - a
        # equal symbols have the type of what follows
        place = np.where(step != 0, np.arange(m), m)
        after = np.minimum.accumulate(place[::-1])[::-1]
        out[a:b] = np.append(step > 0, out[b])[after]
    return out


def stars(small: np.ndarray, room: Room) -> np.ndarray:
    """The S* positions."""
    found = Store(room)
    for a, b in spans(len(small) - 1, room.block):
        found.put(np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1)
    out = room.array(np.int64, found.n)
    at = 0
    for (part,) in found.take():
        out[at : at + len(part)] = part
        at += len(part)
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to depth. Symbols are read a window of WIDTH at a time, as one item."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    whole = max(0, n - WIDTH + 1)
    windows = np.ndarray((whole,), f"V{WIDTH * text.itemsize}", text, strides=text.strides) if whole else None
    for at in range(0, depth, WIDTH):
        if not len(live):
            break
        i, j = a[live] + at, b[live] + at
        first = np.zeros(len(live), np.int64)
        inside = np.maximum(i, j) < whole
        if inside.any():
            x, y = (windows[k[inside]].view(text.dtype).reshape(-1, WIDTH) for k in (i, j))
            differ = x != y
            place = differ.argmax(axis=1)
            first[inside] = np.where((place > 0) | differ[:, 0], place, WIDTH)
        rest = np.flatnonzero(~inside)  # these reach the end of the text
        if len(rest):
            grid = np.arange(WIDTH)
            x, y = i[rest, None] + grid, j[rest, None] + grid
            differ = (text[np.minimum(x, n - 1)] != text[np.minimum(y, n - 1)]) | (x >= n) | (y >= n)
            first[rest] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        out[live] += first
        live = live[first == WIDTH]
    return np.minimum(out, depth)


def names(text: np.ndarray, star: np.ndarray, top: int, room: Room) -> tuple[np.ndarray, bool]:
    """For the substring from each S* position to the next one, both included, the number of smaller ones; and whether all
    differ. Each round sorts what is still undecided by its rank so far and the next few symbols."""
    n, m = len(text), len(star)
    bits, pad = (top + 1).bit_length(), (1 << (top + 1).bit_length()) - 1
    rank = room.array(np.int64, m)
    undecided = Store(room)
    for a, b in spans(m, room.block):
        undecided.put(np.arange(a, b))
    at, known, distinct = 0, 0, True
    while undecided.n:
        width = max(1, (63 - known) // bits)

        def keys(live: Store, at: int = at, width: int = width) -> Iterator[Block]:
            for (index,) in live.take():
                begin = star[index]
                end = np.where(index + 1 < m, star[np.minimum(index + 1, m - 1)] + 1, n)
                key = rank[index].copy()
                for k in range(at, at + width):
                    key = (key << bits) | np.where(begin + k < end, text[np.minimum(begin + k, n - 1)], pad)
                # a substring is done once its end has shown, as a sign beyond all others
                yield key, index, begin + at + width <= end

        left = Store(room)
        place, last, base, fresh = 0, None, 0, 0  # of the row before: key, place of its old rank's and of its key's first row
        held: tuple | None = None  # its index, whether it has more symbols, and whether its key is the one before it

        def settle(index: np.ndarray, more: np.ndarray, several: np.ndarray, left: Store = left) -> bool:
            left.put(index[several & more])
            return bool((several & ~more).any())

        twice = False
        for key, index, more in in_order(keys(undecided), room):
            old = key >> (bits * width)
            here = np.arange(place, place + len(key))
            before = np.concatenate([[-1 if last is None else last], key[:-1]])
            new = key != before
            first = old != before >> (bits * width) if last is not None else np.concatenate([[True], old[1:] != old[:-1]])
            if last is None:
                new[0] = True
            firsts = np.maximum.accumulate(np.where(first, here, base))
            news = np.maximum.accumulate(np.where(new, here, fresh))
            rank[index] = old + news - firsts
            if held is not None:
                twice |= settle(*held[:2], held[2] | ~new[:1])
            followed = np.append(~new[1:], False)
            several = ~new | followed
            twice |= settle(index[:-1], more[:-1], several[:-1])
            held = (index[-1:], more[-1:], ~new[-1:])
            place, last, base, fresh = place + len(key), int(key[-1]), int(firsts[-1]), int(news[-1])
        if held is not None:
            twice |= settle(*held)
        distinct &= not twice
        undecided, at, known = left, at + width, m.bit_length()
    return rank, distinct


def doubled(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a string that fits in memory, sorted by their first `depth` symbols at least."""
    rank, step, n = symbols.astype(np.int64), 1, len(symbols)
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + after + 1 if step > 1 or rank.max(initial=0) < (1 << 31) else None
        order = np.argsort(key, kind="stable") if key is not None else np.lexsort((after, rank))
        if step >= depth:
            return order
        changed = (key[order][1:] != key[order][:-1]) if key is not None else ((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        if n and rank[order[-1]] == n - 1:
            return order
        step *= 2


class Queue:
    """Tuples (position, common prefix) by ranges of symbols. Symbols are those of a pass, ascending."""

    def __init__(self, edges: np.ndarray, room: Room):
        """edges: the last symbol of each range."""
        self.edges, self.room = edges, room
        self.ranges: dict[int, Store] = {}

    def put(self, symbol: np.ndarray, position: np.ndarray, common: np.ndarray) -> None:
        """Of each symbol the tuples are in order; symbols ascend."""
        owner = np.searchsorted(self.edges, symbol)
        cut = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(owner)]):
            self.ranges.setdefault(int(owner[a]), Store(self.room)).put(position[a:b], common[a:b])

    def blocks(self, k: int) -> Iterator[Block]:
        """The range's tuples, in blocks as large as may be, including those that are put in while it is read."""
        while (store := self.ranges.pop(k, None)) is not None:
            for _, some in itertools.groupby(self.sized(store.handles), lambda x: x[0]):
                yield tuple(map(np.concatenate, zip(*(self.room.get(h) for _, h in some))))

    def sized(self, handles: list[tuple]) -> Iterator[tuple[int, tuple]]:
        """Handles with numbers of batches of about a block."""
        size = 0
        for h in handles:
            yield size // self.room.block, h
            size += h[0]


class Pass:
    """One pass: up induces the L suffixes in ascending order, down the S ones in descending order."""

    def __init__(self, text: np.ndarray, small: np.ndarray, top: int, depth: int, up: bool, room: Room):
        self.text, self.small, self.top, self.depth, self.up, self.room = text, small, top, depth, up, room
        self.kind = np.int16 if depth < 1 << 15 else np.int32
        self.seen = room.array(np.int64, top + 1)  # the batch, from 1, that fed a symbol last
        self.rest = room.array(self.kind, top + 1)  # the least prefix behind its last feeder in that batch
        self.batch, self.minima, self.since = 0, [], []  # least prefixes of all batches from one on, ascending
        self.out = Store(room)
        self.last: tuple[int, int, bool] | None = None  # the tuple before: position, symbol and whether it was a seed

    def symbols(self, position: np.ndarray) -> np.ndarray:
        found = self.text[position].astype(np.int64)
        return found if self.up else self.top - found

    def feeds(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of suffixes, which ones induce another, and the symbols of these."""
        before = position - 1
        fits = np.flatnonzero((position > 0) & (self.small[before] != self.up))
        return fits, self.symbols(before[fits])

    def feed(self, position: np.ndarray, prefix: np.ndarray, queue: Queue, own: int = -1) -> Block:
        """Puts the suffixes before a batch into the queue; those of the range `own` are returned: symbols, positions and prefixes."""
        fits, symbol = self.feeds(position)
        order = np.argsort(symbol, kind="stable")
        fits, symbol = fits[order], symbol[order]
        out = (symbol, position[fits] - 1, np.zeros(0, self.kind))
        self.batch += 1
        if len(fits):
            cut = np.flatnonzero(np.diff(symbol, prepend=-1))
            fed = symbol[cut]
            # the least prefix behind the last place that fed the same symbol, up to this place
            padded = np.append(prefix, self.depth).astype(np.int64)
            begin = np.concatenate([[0], fits[:-1] + 1])
            begin[cut] = 0
            between = np.minimum.reduceat(padded, np.stack([begin, fits + 1], 1).reshape(-1))[::2]
            seen = self.seen[fed]
            at = np.searchsorted(np.array(self.since, np.int64), seen, "right")
            least = np.append(np.array(self.minima, np.int64), self.depth)[at]
            between[cut] = np.minimum(between[cut], np.minimum(least, np.where(seen > 0, self.rest[fed], 0)))
            between = np.minimum(between + 1, self.depth)
            between[cut[seen == 0]] = 0  # the first of its symbol
            last = fits[np.append(cut[1:], len(fits)) - 1]
            self.rest[fed] = np.minimum.accumulate(padded[::-1])[::-1][last + 1]
            self.seen[fed] = self.batch
            out = (symbol, out[1], between.astype(self.kind))
        low = int(prefix.min())
        while self.minima and self.minima[-1] >= low:
            self.minima.pop()
            self.since.pop()
        self.minima.append(low)
        self.since.append(self.batch)
        if own >= 0 and len(fits):
            a = 0 if own == 0 else int(np.searchsorted(symbol, queue.edges[own - 1], "right"))
            b = int(np.searchsorted(symbol, queue.edges[own], "right"))
            queue.put(*(c[:a] for c in out))
            queue.put(*(c[b:] for c in out))
            return tuple(c[a:b] for c in out)
        queue.put(*out)
        return tuple(c[:0] for c in out)

    def through(self, position: np.ndarray, prefix: np.ndarray, symbol: np.ndarray, seed: np.ndarray, queue: Queue, own: int = -1) -> Block:
        """A batch leaves the queue: what isn't a seed is part of the result. A seed's prefix is shared with the seed
        before it; behind an induced tuple of its symbol it is found in the text."""
        prefix = prefix.astype(np.int64)
        ahead = self.last or (-1, -1, True)
        before, was, seeded = np.append(ahead[0], position[:-1]), np.append(ahead[1], symbol[:-1]), np.append(ahead[2], seed[:-1])
        prefix[seed & (was != symbol)] = 0
        turn = np.flatnonzero(seed & ~seeded & (was == symbol))
        prefix[turn] = common_prefix(self.text, before[turn], position[turn], self.depth)
        self.last = int(position[-1]), int(symbol[-1]), bool(seed[-1])
        if not seed.all():
            self.out.put(position[~seed], prefix[~seed].astype(self.kind))
        return self.feed(position, prefix, queue, own)

    def run(self, seeds: Iterator[Block], edges: np.ndarray) -> Store:
        """seeds: positions and prefixes in the order of the pass; they follow the induced suffixes of their symbol."""
        queue, waiting = Queue(edges, self.room), next(seeds, None)

        def up_to(symbol: int) -> Iterator[Block]:
            nonlocal waiting
            while waiting is not None:
                k = int(np.searchsorted(self.symbols(waiting[0]), symbol, "right"))
                if k:
                    yield tuple(c[:k] for c in waiting)
                if k < len(waiting[0]):
                    waiting = tuple(c[k:] for c in waiting)
                    return
                waiting = next(seeds, None)

        for k, high in enumerate(edges.tolist()):
            if high - (int(edges[k - 1]) if k else -1) == 1:
                for position, prefix in queue.blocks(k):
                    self.through(position, prefix, np.full(len(position), high), np.zeros(len(position), bool), queue)
                for position, prefix in up_to(high):
                    self.through(position, prefix, np.full(len(position), high), np.ones(len(position), bool), queue)
            else:
                self.mixed(k, [*queue.blocks(k)], [*up_to(high)], queue)
        return self.out

    def mixed(self, k: int, induced: list[Block], seeds: list[Block], queue: Queue) -> None:
        """A range of several symbols: sorted by symbol, seeds last. Of the sorted tuples those leave at once that
        nothing which they put in comes before."""
        if not induced and not seeds:
            return
        position, prefix = (np.concatenate(c) for c in zip(*induced, *seeds))
        seed = np.arange(len(position)) >= sum(len(b[0]) for b in induced)
        symbol = self.symbols(position)
        order = np.argsort(2 * symbol + seed, kind="stable")
        rows = [c[order] for c in (position, prefix, symbol, seed)]
        while len(rows[0]):
            step = [c[:4096] for c in rows]
            key = 2 * step[2] + step[3]
            fits, puts = self.feeds(step[0])
            lowest = np.full(len(key), np.iinfo(np.int64).max)
            lowest[fits] = 2 * puts
            late = np.flatnonzero(key[1:] > np.minimum.accumulate(lowest)[:-1])
            n = int(late[0]) + 1 if len(late) else len(key)
            new = self.through(*(c[:n] for c in step), queue, k)
            rest = [c[n:] for c in rows]
            if len(new[0]):
                rest = [np.concatenate([a, b]) for a, b in zip(rest, (new[1], new[2], new[0], np.zeros(len(new[0]), bool)))]
                order = np.argsort(2 * rest[2] + rest[3], kind="stable")
                rest = [c[order] for c in rest]
            rows = rest


def edges_of(text: np.ndarray, top: int, room: Room) -> np.ndarray:
    """The last symbols of ranges that hold about bound / 16 suffixes at most, or one symbol."""
    if top < 1 << 10:
        return np.arange(top + 1)
    step = max(1, len(text) // (1 << 16))
    drawn = np.sort(np.asarray(text[::step]).astype(np.int64))
    wanted = max(2, 16 * len(text) // room.bound + 1)
    cut = drawn[np.linspace(0, len(drawn) - 1, wanted).astype(np.int64)]
    # a symbol that fills a range has one of its own
    often = np.unique(cut[1:][cut[1:] == cut[:-1]])
    found = np.concatenate([cut, often - 1, often, [top]])
    return np.unique(found[found >= 0])


def sorted_suffixes(text: np.ndarray, depth: int, room: Room | None = None) -> Iterator[Block]:
    """Positions of all suffixes in order, and each one's common prefix with the one before it, in blocks.

    text: non-negative symbols; the last is the smallest and occurs once. Both depth and prefixes count symbols."""
    room = room or Room()
    n = len(text)
    if n < 3:
        yield np.arange(n)[::-1].astype(np.int64), np.zeros(n, np.int64)
        return
    top = max(int(text[a:b].max()) for a, b in spans(n, room.block))
    small = types(text, room)
    star = stars(small, room)
    edges = edges_of(text, top, room)
    large = Pass(text, small, top, depth, True, room).run(seeds_of(text, star, top, depth, room), edges)
    # the S pass reads what it sorts by as the L pass has left it, from the end
    kept = Store(room)
    again = Store(room)
    for block in large.take():
        kept.put(*block)
        again.put(*block)
    down = np.unique(np.append(top - edges[:-1] - 1, top))
    final = Pass(text, small, top, depth, False, room).run(again.backwards(), down)

    def keyed(blocks: Iterator[Block]) -> Iterator[Block]:
        for position, prefix in blocks:
            yield text[position].astype(np.int64) * 2 + small[position], position.astype(np.int64), prefix.astype(np.int64)

    before, was = n - 1, -1
    yield np.array([n - 1]), np.zeros(1, np.int64)
    for key, position, prefix in merged_runs([keyed(kept.take()), keyed(final.backwards())], room.block):
        keys = np.append(was, key[:-1])
        change = np.flatnonzero(keys != key)
        behind = np.append(before, position[:-1])
        prefix[change] = common_prefix(text, behind[change], position[change], depth)
        before, was = int(position[-1]), int(key[-1])
        yield position, prefix


def seeds_of(text: np.ndarray, star: np.ndarray, top: int, depth: int, room: Room) -> Iterator[Block]:
    """The S* suffixes in order, with their common prefixes."""
    rank, distinct = names(text, star, top, room)
    inner = depth // 2 + 1
    if distinct:
        place = room.array(np.int64, len(star))
        for a, b in spans(len(star), room.block):
            place[rank[a:b]] = np.arange(a, b)
        orders: Iterator[np.ndarray] = (np.asarray(place[a:b]) for a, b in spans(len(star), room.block))
    elif len(star) <= room.bound // 4 or len(star) < 3:
        place = doubled(np.asarray(rank), inner)
        orders = (place[a:b] for a, b in spans(len(star), room.block))
    else:
        # the last name is the smallest and occurs once, as the last symbol does
        orders = (block[0] for block in sorted_suffixes(rank, inner, room))
    last = None
    for order in itertools.filterfalse(lambda o: not len(o), orders):
        position = np.asarray(star[order])
        behind = np.append(position[0] if last is None else last, position[:-1])
        prefix = common_prefix(text, behind, position, depth)
        if last is None:
            prefix[0] = 0
        last = int(position[-1])
        yield position, prefix
