"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if at least NEAR percent of the item's distinct shingles (shingles.py)
are among the document's. Items are partitioned by size: class c holds those of 2**c to 2**(c+1) - 1
shingles. For each class a document is read as stretches of its shingle sequence, 2**(c+2) long and
2**(c+1) apart, so that a passage of the class's size lies whole in one of them. An item that is found in a
stretch has with it a similarity of 0.17 at least, against a share near zero with the whole of a long
document; with one minhash a band, BANDS bands miss it with probability 0.83**BANDS, under 2e-5.

A stretch's minhashes are tested against the items' (class, band, value) keys, a sorted array sent to
the executors for a block of ITEMS items at a time: its size is bounded by that, and larger
benchmarks take more passes over the documents. Stretches with a key in common are joined to the items
that have it, and the pairs are verified by exact containment of shingles in the whole document.

Defined results: an item or document without words matches nothing; an item of fewer than five words has
its whole sequence as its only shingle and so is found only in a document of just these words; repeated
items or documents give repeated pairs once. Null ids match like others. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged, shingles
from .common import done_with, lean, settled

BANDS = 60
ITEMS = 50_000
NEAR = 75


def factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240301)
    return draw.integers(0, 1 << 32, BANDS, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, BANDS, np.uint32)


def one_key(size_class: int, band: np.ndarray, least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each class, band and minhash."""
    place = band.astype(np.uint64) | np.uint64(size_class << 8)
    return shingles.mixed((least.astype(np.uint64) << np.uint64(32)) ^ (place + np.uint64(1)) * shingles.FACTOR)


def values(sequence: np.ndarray) -> np.ndarray:
    """Rows of BANDS hash values of each shingle."""
    a, b = factors()
    return (sequence >> np.uint64(32)).astype(np.uint32)[:, None] * a + b


def item_table(items: DataFrame) -> DataFrame:
    """item_id, size_class, shingles (bytes), minhashes and keys of each item with words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, s in zip(batch.column(0).to_pylist(), shingles.sets(ragged.strings(batch.column(1)))):
                if len(s):
                    c = len(s).bit_length() - 1
                    least = values(s).min(axis=0)
                    rows.append((i, c, s.tobytes(), least.tolist(), one_key(c, np.arange(BANDS), least).view(np.int64).tolist()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "size_class", "item_set", "least", "keys"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(lean(each), "item_id long, size_class int, item_set binary, least array<long>, keys array<long>")


class Wanted:
    """The items' keys by class, with a table of bits that passes every one of them and few others."""

    def __init__(self, known: dict[int, np.ndarray]):
        self.known = known
        self.band = (np.arange(BANDS, dtype=np.uint32) * np.uint32(0x9E3779B1)).astype(np.uint32)
        self.bits = {c: np.zeros(1 << 20, bool) for c in known}

    def add(self, size_class: int, least: np.ndarray) -> None:
        """least: rows of BANDS minhashes of items."""
        self.bits[size_class][((least ^ self.band) >> np.uint32(12)).reshape(-1)] = True

    def hits(self, size_class: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of minhashes that share a key with an item, and the keys."""
        row, band = np.nonzero(self.bits[size_class][(least ^ self.band) >> np.uint32(12)])
        have = one_key(size_class, band, least[row, band])
        wanted = self.known[size_class]
        good = wanted[np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)] == have
        return row[good], have[good]


def block_minima(flat: np.ndarray, begin: np.ndarray, width: int = 1 << 14) -> np.ndarray:
    """Minhashes of consecutive blocks of shingles that start at `begin`, about `width` shingles at a time."""
    out = np.empty((len(begin), BANDS), np.uint32)
    ends = np.append(begin[1:], len(flat))
    k = 0
    while k < len(begin):
        j = max(k + 1, int(np.searchsorted(ends, begin[k] + width, "right")))
        out[k:j] = np.minimum.reduceat(values(flat[begin[k] : ends[j - 1]]), begin[k:j] - begin[k], axis=0)
        k = j
    return out


def stretch_hits(flat: np.ndarray, sizes: np.ndarray, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of the keys that the stretches of texts share with items. flat: the shingles of all texts."""
    texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if not wanted.known or not len(flat):
        return texts[0], found[0]
    size_class = min(wanted.known)
    step = 2 << size_class
    count = -(-sizes // step)
    owner = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    blocks = block_minima(flat, np.repeat(np.cumsum(sizes) - sizes, count) + inside * step)
    while True:
        # a stretch is a block with the next one of its text; a text of one block is one stretch
        if size_class in wanted.known:
            paired = np.append(owner[1:] == owner[:-1], False)
            whole = np.minimum(blocks, np.where(paired[:, None], np.roll(blocks, -1, axis=0), np.uint32(0xFFFFFFFF)))
            row, key = wanted.hits(size_class, whole[paired | (inside == 0)])
            texts.append(owner[paired | (inside == 0)][row])
            found.append(key)
        size_class += 1
        if size_class > max(wanted.known):
            return np.concatenate(texts), np.concatenate(found)
        # blocks of the next class are two of this one
        first = np.flatnonzero(inside % 2 == 0)
        blocks, owner, inside = np.minimum.reduceat(blocks, first, axis=0), owner[first], inside[first] // 2


def candidates(docs: DataFrame, item_keys: DataFrame) -> DataFrame:
    """doc_id, key, doc_set (bytes): for each document the keys that its stretches share with items; the
    set only on its first row. item_keys: size_class, key and least, for at most ITEMS items."""
    known: dict[int, np.ndarray] = {}
    least: dict[int, np.ndarray] = {}
    for r in item_keys.groupBy("size_class").agg(F.collect_set("key").alias("keys"), F.collect_set("least").alias("least")).collect():
        known[r["size_class"]] = np.sort(np.array(r["keys"], np.int64).view(np.uint64))
        least[r["size_class"]] = np.array(r["least"], np.int64).astype(np.uint32).reshape(-1, BANDS)
    sent = docs.sparkSession.sparkContext.broadcast((known, least))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(sent.value[0])
        for c, rows_ in sent.value[1].items():
            wanted.add(c, rows_)
        for batch in batches:
            at = 0
            for part in ragged.slices(ragged.strings(batch.column(1))):
                flat, sizes = shingles.sequences(part)
                text, key = stretch_hits(flat, sizes, wanted)
                end = np.cumsum(sizes)
                rows = []
                for k in np.unique(text).tolist():
                    whole = np.unique(flat[end[k] - sizes[k] : end[k]])
                    rows.append((batch.column(0)[at + k].as_py(), np.unique(key[text == k]).view(np.int64).tolist(), whole.tobytes()))
                at += len(part)
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "keys", "doc_set"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(each), "doc_id long, keys array<long>, doc_set binary")


def contaminated(docs: DataFrame, items: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: each document and item of which the document holds at least
    `near` percent. docs: doc_id, text; items: item_id, text."""
    table = settled(item_table(items), "items")
    n = table.count()
    out = None
    for k in range(max(1, -(-n // ITEMS))):
        block = table if n <= ITEMS else table.where(F.pmod(F.xxhash64("item_set"), F.lit(-(-n // ITEMS))) == k)
        by_key = block.select("item_id", "item_set", "least", F.explode("keys").alias("key"), "size_class")
        hits = settled(candidates(docs, by_key), "hits")
        pairs = hits.select("doc_id", F.explode("keys").alias("key")).join(by_key.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
        whole = hits.select(F.col("doc_id").alias("d"), "doc_set").distinct()
        sets = block.select(F.col("item_id").alias("i"), "item_set").distinct()
        both = pairs.join(sets, F.col("item_id").eqNullSafe(F.col("i"))).join(whole, F.col("doc_id").eqNullSafe(F.col("d")))
        counted = both.withColumn("n", overlap("item_set", "doc_set")).select("doc_id", "item_id", F.col("n.shared").alias("n_shared"), F.col("n.item").alias("n_item"))
        good = counted.where(F.col("n_shared") * 100 >= F.col("n_item") * near).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
        good = settled(good, "found")
        done_with(hits)
        out = good if out is None else out.unionByName(good)
    done_with(table)
    return out.select("doc_id", "item_id", "n_shared", "n_item")


@F.pandas_udf(T.StructType([T.StructField("shared", T.LongType()), T.StructField("item", T.LongType())]))
def overlap(item: pd.Series, doc: pd.Series) -> pd.DataFrame:
    def one(x: bytes, y: bytes) -> tuple[int, int]:
        p = np.frombuffer(x, np.uint64)
        return len(np.intersect1d(p, np.frombuffer(y, np.uint64), assume_unique=True)), len(p)

    return pd.DataFrame([one(x, y) for x, y in zip(item, doc)], columns=["shared", "item"])
