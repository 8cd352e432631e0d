"""Word shingles of whole texts as sets of 64-bit hashes.

Words are runs of anything but the six ASCII white-space signs, with A-Z in lower case. A shingle is five
words in a row; a text of one to four words has its whole sequence as its only shingle, and a text
without words (or a null) has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from . import ragged

WIDTH = 5
APART = np.zeros(0x110000, bool)
APART[[9, 10, 11, 12, 13, 32]] = True
FACTOR = np.uint64(0x9FB21C651E98DF25)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts (large_string without nulls), and the words of each text."""
    parts = ragged.Texts(texts)
    starts, ends = ragged.runs(parts.points, parts.starts_of_texts(), APART[parts.points])
    parts.data = parts.data.lower()  # of bytes: A-Z only
    pieces = parts.pieces(starts, ends)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces.dictionary.to_pylist()), np.uint64, len(pieces.dictionary))
    return hashes[pieces.indices.to_numpy()] if len(pieces) else hashes, parts.counts(starts)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text in order, flat, and how many each text has."""
    word, counts = words(texts)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    if not len(word):
        return np.zeros(0, np.uint64), sizes
    begin = np.cumsum(counts) - counts
    at = ragged.spread(begin, sizes)
    length = np.repeat(np.minimum(counts, WIDTH), sizes)
    out = length.astype(np.uint64)
    for k in range(WIDTH):
        here = np.minimum(at + k, len(word) - 1)
        out = np.where(k < length, out * FACTOR + word[here], out)
    return mixed(out), sizes


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    flat, sizes = sequences(texts)
    end = np.cumsum(sizes)
    return [np.unique(flat[a:b]) for a, b in zip((end - sizes).tolist(), end.tolist())]
