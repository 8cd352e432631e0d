"""Texts of an Arrow batch as flat arrays: code points, pieces of text, and values per piece.

Each function handles all texts of a batch with numpy or Arrow kernels; there is no loop over
characters, words or texts.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of large_string in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = 1 << 20) -> list[pa.Array]:
    """The large_string column in consecutive slices of about `most` bytes, or one text if it is longer,
    so that the arrays made from a slice stay small whatever the size of Spark's batch."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // most
    cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)]
    return [column.slice(a, b - a) for a, b in zip(cut, cut[1:]) if b > a]


class Texts:
    """All texts of a batch, one after the other."""

    def __init__(self, column: pa.Array):
        """column: large_string without nulls."""
        data = "".join(column.to_pylist())
        self.points = np.frombuffer(data.encode("utf-32-le"), "<u4")
        self.data = data.encode()
        if len(self.data) == len(self.points):
            self.byte_at = np.arange(len(self.points) + 1, dtype=np.int64)
        else:
            width = 1 + (self.points >= 0x80).view(np.uint8) + (self.points >= 0x800) + (self.points >= 0x10000)
            self.byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False)
        self.begin = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    @property
    def n(self) -> int:
        return len(self.begin) - 1

    def starts_of_texts(self) -> np.ndarray:
        """Whether each code point is the first of its text."""
        first = np.zeros(len(self.points) + 1, bool)
        first[self.begin] = True
        return first[:-1]

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
        """The pieces [start, end) in code points, dictionary-encoded. They may leave gaps, but not overlap."""
        return encoded(self.data, self.byte_at[starts], self.byte_at[ends])

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ascending starts lie in each text."""
        return np.diff(np.searchsorted(starts, self.begin))


def encoded(data: bytes, begin: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The byte ranges of data as a dictionary-encoded array of large_binary."""
    if not len(begin):
        return pa.array([], pa.large_binary()).dictionary_encode()
    if np.array_equal(begin[1:], end[:-1]):
        offsets, values = np.append(begin, end[-1]), data
    else:
        size = end - begin
        offsets = np.concatenate([[0], np.cumsum(size)])
        values = np.frombuffer(data, np.uint8)[spread(begin, size)].tobytes()
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(values)]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), buffers).dictionary_encode()


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0] values, then those of start[1], and so on."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, size)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: sizes[0] values in the first list, and so on."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def apostrophes(points: np.ndarray, kind: np.ndarray, first: np.ndarray, change: np.ndarray, after_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where English short forms ('s 't 'm 'd 're 've 'll) begin, and their lengths. The
    apostrophe stands alone between other kinds; after_space: it may follow a space."""
    n = len(points)
    at = np.flatnonzero((points == ord("'")) & change)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    if not after_space:
        before = at > 0
        before &= ~first[at]
        at = at[~(before & (points[at - 1] == 32))]
    one = points[at + 1]
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, np.where(long, 3, 0))
    return at[size > 0], size[size > 0]


def byte_level_starts(texts: Texts) -> np.ndarray:
    """Where the pieces of byte-level BPE begin: a run of letters, numbers or other signs, each
    with a space before it, a short form, or white space. The pieces cover the texts."""
    points, first = texts.points, texts.starts_of_texts()
    if not len(points):
        return np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | first
    start = change.copy()
    space = kind == SPACE
    follows = np.concatenate([~change[1:] | False, [False]])
    goes_on = np.concatenate([~first[1:], [False]])
    start |= space & ~follows & goes_on
    before_space = np.concatenate([[False], points[:-1] == 32]) & ~first
    start &= ~(before_space & ~space)
    at, size = apostrophes(points, kind, first, change, after_space=False)
    start[at + 1] = False
    over = at + size
    inside = over < len(points)
    start[at[size == 3] + 2] = False
    start[over[inside]] = True
    # what follows a short form keeps a start of its own unless a space before it takes that place
    return np.flatnonzero(start)


def word_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, single numbers, short forms and runs of other signs;
    white space lies in the gaps."""
    points, first = texts.points, texts.starts_of_texts()
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | first
    start = change | (kind == NUMBER)
    at, size = apostrophes(points, kind, first, change, after_space=True)
    start[at + 1] = False
    start[at[size == 3] + 2] = False
    over = at + size
    start[over[over < len(points)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(points))
    solid = kind[starts] != SPACE
    return starts[solid], ends[solid]


def runs(points: np.ndarray, first: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of code points that are not apart, within one text each."""
    inside = ~apart
    start = inside & (np.concatenate([[True], apart[:-1]]) | first)
    stop = inside & np.concatenate([apart[1:] | first[1:], [True]])
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


class Memory:
    """Values of pieces seen before in this Python worker: for each piece a run of integers.

    Bounded: beyond `most` pieces it forgets all of them, which costs time and changes no result."""

    def __init__(self, fill, most: int = 1_000_000):
        """fill: gets the list of new pieces (bytes), returns their values, flat, and their sizes."""
        self.fill, self.most = fill, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        if self.n > self.most:
            self.clear()
        found = list(map(self.slot.get, pieces))
        missing = [p for p, k in zip(pieces, found) if k is None]
        if missing:
            flat, size = self.fill(missing)
            n, used = self.n + len(missing), self.used + len(flat)
            while used > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.flat[self.used : used] = flat
            self.size[self.n : n] = size
            self.start[self.n : n] = self.used + np.cumsum(size) - size
            self.slot.update(zip(missing, range(self.n, n)))
            self.n, self.used = n, used
            found = list(map(self.slot.__getitem__, pieces))
        return np.fromiter(found, np.int64, len(found))

    def values(self, pieces: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pieces, flat, and how many each piece has."""
        slots = self.slots(pieces.dictionary.to_pylist())
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        at = slots[pieces.indices.to_numpy()]
        size = self.size[at]
        return self.flat[spread(self.start[at], size.astype(np.int64))], size

    def sizes(self, pieces: pa.DictionaryArray) -> np.ndarray:
        """How many values each piece has."""
        slots = self.slots(pieces.dictionary.to_pylist())
        return self.size[slots[pieces.indices.to_numpy()]] if len(pieces) else np.zeros(0, np.int32)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values by text: the first counts[0] values belong to the first text, and so on."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]
