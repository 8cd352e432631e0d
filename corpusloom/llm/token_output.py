"""Token ids as ORC files in document order.

Rows are dealt to files by ranges of doc_id and sorted inside each, so that every file, stripe and row
group covers a narrow range of ids. ORC stores the id lists with its integer run-length encoding; row
indexes hold the range of doc_id of every `row_index_stride` rows, and Bloom filters answer for single
ids, so a reader skips stripes from metadata alone. Stripes are small enough for several tasks to read
one file. Each row keeps its offset within its range; range totals, one row a file, give global starts.

A null or empty text is a document of the end id alone. Rows of equal doc_id stay together, ordered by
text; a null doc_id comes first. Only the three named columns of the input are read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ragged
from .common import lean

SCHEMA = "doc_id long, part int, begin long, n_tokens long, ids array<int>"


class ByteEncoder:
    """The tokenizers library for a byte-level BPE vocabulary. It encodes each distinct piece of text
    once while a worker remembers it: the pieces are those the vocabulary's own rule splits a text into,
    and they are encoded independently of each other. Texts with special strings go to it whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.memory = ragged.Memory(self.fill)

    def fill(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for e in self.lib.encode_batch_fast([str(p, "utf-8") for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large_string without nulls), flat, and how many each has."""
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts).cast(pa.large_string()) if special.any() else texts
        parts = ragged.Texts(plain)
        start = ragged.byte_level_starts(parts)
        ids, sizes = self.memory.values(parts.pieces(start, np.append(start[1:], len(parts.points))))
        counts = ragged.sums(sizes, parts.counts(start))
        if special.any():
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(special).tolist():
                lists[k] = np.array(self.lib.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
            ids, counts = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        return ids, counts


@functools.lru_cache(1)
def encoder(vocabulary: str) -> ByteEncoder:
    return ByteEncoder(vocabulary)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    """Writes the ids of docs (doc_id, text), with end_id after each document, to ORC files at path."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, tool = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            at = 0
            for texts in ragged.slices(ragged.strings(batch.column(1))):
                ids, sizes = tool.encode(texts)
                end = np.cumsum(sizes + 1)
                out = np.full(len(ids) + len(sizes), end_id, np.int32)
                out[ragged.spread(end - sizes - 1, sizes)] = ids
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(np.full(len(texts), part), pa.int32()),
                    pa.array(total + end - sizes - 1, pa.int64()),
                    pa.array(sizes + 1, pa.int64()),
                    ragged.list_array(out, sizes + 1, pa.int32()),
                ]
                at += len(texts)
                total += len(out)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "begin", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": row_index_stride,
        "orc.create.index": "true", "orc.stripe.size": stripe_bytes, "compression": "zstd",
    }
    ordered.mapInArrow(lean(tokens), SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids only theirs, the predicate being pushed to stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def starts(rows: DataFrame) -> DataFrame:
    """For each file range its number and the count of ids in all ranges before it. The window is over
    one row a range, which is what the first aggregation leaves."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the ids as read."""

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offset, values = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())]
            sizes = pa.array(np.diff(offset), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, pa.array(crc, pa.int64())], ["doc_id", "part", "begin", "n_tokens", "ids_crc32"])

    sums = rows.select("doc_id", "part", "begin", "ids").mapInArrow(lean(checksum), "doc_id long, part int, begin long, n_tokens long, ids_crc32 long")
    return sums.join(starts(rows), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
