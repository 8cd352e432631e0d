"""Removal of byte strings that occur elsewhere in the corpus, by suffix arrays of shards.

A byte goes if some string of LENGTH bytes that covers it starts at another place too, in any document.

Each LENGTH-byte string has an anchor: of its GRAM-byte substrings the one with the least hash, the
leftmost of equals. Equal strings have equal anchors at equal offsets. The neighbouring strings with one
anchor are a piece of text. So strings can only be equal if their pieces have an anchor hash in
common, and all pieces of one hash go to one shard:

1. Pieces whose anchor hash occurs once are dropped; counting precedes the join.
2. Equal pieces of a hash count as one; if there are two or more, all their strings are repeats.
3. Where a hash has different pieces, one of each goes to the hash's shard. The shard's suffixes are sorted by
   induced sorting (induced_sort.py); strings that share LENGTH bytes with a neighbour in that order are repeats.
   If the different pieces of a hash have more than HOT bytes, they are halved first, by the offset of the anchor in
   their strings: the strings of a half have more bytes around the anchor in common if they are equal, and a hash of
   these is the half's anchor. Halves are counted and dealt anew; those still beyond HOT are halved again, at most
   until a part is one string. So no shard has more than SHARD + HOT bytes and a piece. The halves keep tasks even; a shard
   of any size could be sorted, as it is written to a file of the task as it comes and sorted with bounded memory.
4. The repeats of all pieces are gathered per text, merged and cut out.

Documents with the same text share a key, the text's MD5, so exact copies of any number need one
list of repeats. Hashes only choose what is compared, apart from piece equality: pieces of an anchor are equal if a hash of 128 bits is.
Rows meet facts about their anchor or piece under salted keys, so that a passage in a third of all documents has many tasks.

Null and empty texts have nothing removed and the digest of nothing. Only doc_id and text are read; repeated rows
are copies of each other, and null ids are kept.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import induced_sort, ragged
from .common import done_with, lean, settled
from .shingles import FACTOR, mixed

LENGTH, GRAM = 200, 32
CHUNK = 1 << 22
SHARD = 1 << 21
#: As much as a task sorts in half a minute: larger groups would hold it up, smaller ones cost more to split than to sort.
HOT = 8 * SHARD
OFFSETS = LENGTH - GRAM + 1
#: Tasks over which the rows of an anchor or a piece are dealt.
SALTS = 32


def byte_values() -> np.ndarray:
    return np.random.default_rng(20240305).integers(0, 1 << 63, 256, np.uint64)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Of FACTOR and of its inverse modulo 2**64, for the places of a chunk."""
    inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
    n = CHUNK + 2 * LENGTH
    with np.errstate(over="ignore"):
        return (np.concatenate([[np.uint64(1)], np.full(n, f, np.uint64)]).cumprod(dtype=np.uint64) for f in (FACTOR, inverse))


class Anchors:
    """Finds the pieces of texts; made once in each task."""

    def __init__(self) -> None:
        self.values, (self.up, self.down) = byte_values(), powers()

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A hash of the GRAM bytes from each place on."""
        n = len(data)
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.values[data] * self.up[:n], dtype=np.uint64)])
        return mixed((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])

    def pieces(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, number of starts and anchor hash of each piece. valid: whether a string may start there."""
        hashes = self.grams(data)
        low = np.uint64((1 << 24) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width, wide = 1, LENGTH - GRAM + 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(data) - LENGTH + 1], least[wide - width :])
        anchor = (least & low).astype(np.int64)
        valid = valid[: len(anchor)]
        begin = valid & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
        stop = valid & np.concatenate([(anchor[1:] != anchor[:-1]) | ~valid[1:], [True]])
        first, last = np.flatnonzero(begin), np.flatnonzero(stop)
        return first, last - first + 1, hashes[anchor[first]]


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of at most CHUNK bytes, or one text if it is longer."""
    for part in ragged.slices(column, CHUNK // 2):
        # the last text of a slice begins within CHUNK // 2 bytes, but may end anywhere
        n = len(part)
        if n > 1 and len(part[n - 1].as_buffer()) > CHUNK // 2:
            yield part.slice(0, n - 1)
            yield part.slice(n - 1)
        else:
            yield part


def piece_table(docs: DataFrame) -> DataFrame:
    """key (of the text), doc_id, place, n, anchor, body and twin (hashes) of all pieces of docs (key, doc_id, text). body and twin
    are the halves of one hash of 128 bits: pieces of an anchor with equal ones are equal."""
    names = ["key", "doc_id", "place", "n", "anchor", "body", "twin"]

    def one(tool: Anchors, data: bytes, begin: np.ndarray, shift: int, limit: int) -> tuple[np.ndarray, ...]:
        """Texts that begin at `begin`, as one array; starts before `limit` count."""
        flat = np.frombuffer(data, np.uint8)
        room = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(flat))
        first, n, anchor = tool.pieces(flat, (room >= LENGTH) & (np.arange(len(flat)) < limit))
        owner = np.searchsorted(begin, first, "right") - 1
        digests = b"".join(xxhash.xxh3_128_digest(data[a : a + m + LENGTH - 1]) for a, m in zip(first.tolist(), n.tolist()))
        body, twin = np.frombuffer(digests, np.int64).reshape(-1, 2).T
        return owner, first - begin[owner] + shift, n, anchor, body, twin

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Anchors()
        for batch in batches:
            at = 0
            for part in slices(ragged.strings(batch.column(2))):
                texts = part.cast(pa.large_binary()).to_pylist()
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                if len(part) == 1 and size[0] > CHUNK:
                    data = texts[0]
                    found = []
                    for k in range(0, int(size[0]), CHUNK):
                        piece = data[k : k + CHUNK + LENGTH - 1]
                        if len(piece) >= LENGTH:
                            found.append(one(tool, piece, np.array([0, len(piece)]), k, CHUNK))
                else:
                    begin = np.concatenate([[0], np.cumsum(size)])
                    found = [one(tool, b"".join(texts), begin, 0, int(begin[-1]))] if begin[-1] >= LENGTH else []
                for owner, place, n, anchor, body, twin in found:
                    rows = pa.array(owner + at)
                    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place, pa.int64()), pa.array(n, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(anchor.view(np.int64)), pa.array(body), pa.array(twin)], names)
                at += len(part)

    return docs.select("key", "doc_id", "text").mapInArrow(lean(each), "key binary, doc_id long, place long, n int, anchor long, body long, twin long")


def cut_pieces(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """anchor, body, twin, n and the bytes of pieces (key, doc_id, place, n, anchor, body, twin)."""
    names = ["anchor", "body", "twin", "n", "bytes"]
    lists = pieces.groupBy(F.col("key").alias("k"), F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("place", "n", "anchor", "body", "twin")).alias("cuts"))
    joined = docs.join(lists, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "cuts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(0).cast(pa.large_binary()), batch.column(1)
            for k in range(len(batch)):
                data, rows = texts[k].as_py(), cuts[k].values
                place, n = rows.field("place").to_numpy(), rows.field("n").to_numpy()
                body = [data[a : a + m + LENGTH - 1] for a, m in zip(place.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names[:4]), pa.array(body, pa.binary())], names)

    return joined.mapInArrow(lean(each), "anchor long, body long, twin long, n int, bytes binary")


class Shard:
    """Different pieces and the suffixes of all of them. The bytes go to a scratch file as they come; what is in memory
    is bounded by the room, but for five numbers a piece."""

    def __init__(self, bound: int = induced_sort.BOUND) -> None:
        self.bound, self.file, self.size = bound, tempfile.TemporaryFile(), 0
        self.columns = [array("q") for _ in range(5)]  # anchor, body, twin, number of starts, first sign

    def add(self, anchor: int, body: int, n: int, data: bytes, twin: int = 0) -> None:
        for column, value in zip(self.columns, (anchor, body, twin, n, self.size)):
            column.append(value)
        # 1 parts the pieces, 0 ends the text
        self.file.write(np.append(np.frombuffer(data, np.uint8) + np.uint16(2), np.uint16(1)).data)
        self.size += len(data) + 1

    def text(self) -> np.ndarray:
        self.file.write(np.zeros(1, np.uint16).data)
        self.file.flush()
        if self.size < self.bound // 2:
            self.file.seek(0)
            return np.frombuffer(self.file.read(), np.uint16)
        return np.memmap(self.file, np.uint16, "r", shape=(self.size + 1,))

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, first and last start of each run of repeats: starts whose LENGTH bytes are those of a neighbour in the
        order of suffixes, ends of pieces left out."""
        room, text = induced_sort.Room(self.bound), self.text()
        counts, begin = (np.frombuffer(c, np.int64) for c in self.columns[3:])
        mark = room.array(bool, self.size + 1)
        least, before = LENGTH, -1
        for position, prefix in induced_sort.sorted_suffixes(text, LENGTH, room):
            piece = np.searchsorted(begin, position, "right") - 1
            wanted = np.flatnonzero((position < self.size) & (position - begin[piece] < counts[piece]))
            if not len(wanted):
                least = min(least, int(prefix.min()))
                continue
            # between two wanted suffixes the least prefix counts
            between = np.minimum.reduceat(prefix[: wanted[-1] + 1], np.concatenate([[0], wanted[:-1] + 1]))
            between[0] = min(between[0], least) if before >= 0 else 0
            least = int(prefix[wanted[-1] + 1 :].min(initial=LENGTH))
            place, hit = position[wanted], between >= LENGTH
            mark[place[hit]] = True
            mark[np.append(before, place[:-1])[hit]] = True
            before = int(place[-1])
        edges, last = [], np.zeros(1, bool)
        for a, b in induced_sort.spans(self.size + 1, room.block):
            here = np.concatenate([last, mark[a:b]])
            edges.append(np.flatnonzero(here[1:] != here[:-1]) + a)
            last = here[-1:]
        edge = np.concatenate(edges)
        first, last_ = edge[::2], edge[1::2] - 1
        piece = np.searchsorted(begin, first, "right") - 1
        return piece, first - begin[piece], last_ - begin[piece]


def sorted_shards(pieces: DataFrame) -> DataFrame:
    """anchor, body, twin, first, last: runs of repeated starts in pieces (anchor, body, twin, n, bytes), found by
    sorting the suffixes of whole anchor groups together, about SHARD bytes at a time."""
    names = ["anchor", "body", "twin", "first", "last"]

    def solved(shard: Shard) -> pa.RecordBatch:
        piece, first, last = shard.repeats()
        keys = [pa.array(np.frombuffer(c, np.int64)[piece]) for c in shard.columns[:3]]
        return pa.RecordBatch.from_arrays([*keys, pa.array(first, pa.int64()), pa.array(last, pa.int64())], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(), (None, None, None)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] == last:
                    continue
                if shard.size > SHARD and row[0] != last[0]:
                    yield solved(shard)
                    shard = Shard()
                anchor, body, twin, n, data = row
                shard.add(anchor, body, n, data, twin)
                last = row[:3]
        if shard.size:
            yield solved(shard)

    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "body", "twin").select("anchor", "body", "twin", "n", "bytes")
    return dealt.mapInArrow(lean(each), "anchor long, body long, twin long, first long, last long")


def halved(pieces: DataFrame, level: int) -> DataFrame:
    """anchor, body, twin, part, kind, other, shift, n, at and bytes: pieces (anchor, body, twin, n, at, bytes) cut by the offset of the
    anchor in their strings, at the edges of level + 1 halvings of all offsets. part: a hash of the bytes that strings
    with such offsets have in common if they are equal; kind and other: of all bytes; shift: the first start in the
    piece; at: the place of the anchor, if known."""
    edges = [0, OFFSETS]
    for _ in range(level + 1):
        edges = sorted({*edges, *((a + b) // 2 for a, b in zip(edges, edges[1:]))})
    names = ["anchor", "body", "twin", "part", "kind", "other", "shift", "n", "at", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.uint64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, low = Anchors(), np.uint64((1 << 24) - 1)
        for batch in batches:
            rows = []
            for anchor, body, twin, n, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None:
                    at = int(np.argmin(tool.grams(np.frombuffer(data[:LENGTH], np.uint8)) & ~low))
                for a, b in zip(edges, edges[1:]):
                    first, last = max(0, at - b + 1), min(n - 1, at - a)
                    if first <= last:
                        core, whole = data[at - a : at - b + 1 + LENGTH], data[first : last + LENGTH]
                        part = xxhash.xxh3_64_intdigest(core, a * LENGTH + b)
                        kind, other = np.frombuffer(xxhash.xxh3_128_digest(whole), np.int64).tolist()
                        rows.append((anchor, body, twin, part, kind, other, first, last - first + 1, at - first, whole))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in columns], names)

    return pieces.select("anchor", "body", "twin", "n", "at", "bytes").mapInArrow(lean(each), "anchor long, body long, twin long, part long, kind long, other long, shift int, n int, at int, bytes binary")


def crowded(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of kinds (anchor, body, n and more) those whose anchor has two different pieces or more, with `held`, the bytes of all of them;
    and these anchors with `held`."""
    dealt = kinds.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)).cast("int"))
    held = F.sum(F.col("n") + F.lit(LENGTH - 1).cast("long")).alias("held")
    several = dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), held, met_salts()).where("different > 1")
    several = settled(several.drop("different"), "groups")
    return dealt.join(salted(several), ["anchor", "salt"]).drop("salt"), several


def repeats_in_halves(pieces: DataFrame, level: int = 0) -> DataFrame:
    """anchor, body, twin, first, last: runs of repeated starts in different pieces (anchor, body, twin, n, at, bytes) of anchors with
    more than HOT bytes."""
    halves = settled(halved(pieces, level), "halves")
    one = [F.first(c).alias(c) for c in ("n", "at", "bytes")]
    kinds = settled(halves.groupBy(F.col("part").alias("anchor"), F.col("kind").alias("body"), F.col("other").alias("twin")).agg(F.count(F.lit(1)).alias("m"), *one), "half-kinds")
    differ, several = crowded(kinds)
    whole = kinds.where("m > 1").select("anchor", "body", "twin", F.lit(0).cast("long").alias("first"), (F.col("n") - 1).cast("long").alias("last"))
    found = whole.unionByName(sorted_shards(differ.where(F.col("held") <= HOT)))
    if not several.where(F.col("held") > HOT).isEmpty():
        found = found.unionByName(repeats_in_halves(differ.where(F.col("held") > HOT), level + 1))
    found = found.withColumnsRenamed({"anchor": "part", "body": "kind", "twin": "other"})
    return halves.drop("bytes").join(found, ["part", "kind", "other"]).select(halves["anchor"], halves["body"], halves["twin"], (F.col("shift") + F.col("first")).alias("first"), (F.col("shift") + F.col("last")).alias("last"))


def met_salts() -> Column:
    """The salts of a group's rows, as bits."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def salted(facts: DataFrame) -> DataFrame:
    """facts about keys once for each salt of the key's rows: never more rows than the key has, and rows of a frequent key
    meet them in SALTS tasks."""
    numbers = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return facts.withColumn("salt", F.explode(F.filter(numbers, lambda k: F.getbit("salts", k) == 1))).drop("salts")


def repeats(docs: DataFrame) -> DataFrame:
    """key, spans: for each text with repeats the byte spans to remove, as begin, end, begin, end, ..."""
    pieces = settled(piece_table(docs).withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)).cast("int")), "pieces")
    often = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), met_salts()).where("m > 1")
    shared = settled(pieces.join(salted(often.select("anchor", "salts")), ["anchor", "salt"]), "shared-pieces")
    done_with(pieces)
    piece = ["anchor", "body", "twin"]
    kinds = settled(shared.groupBy(piece).agg(F.count(F.lit(1)).alias("m"), met_salts(), F.min(F.struct("key", "doc_id", "place", "n")).alias("one")), "piece-kinds")
    differ, several = crowded(kinds.select("one.*", *piece))
    found = sorted_shards(cut_pieces(docs, differ.where(F.col("held") <= HOT)))
    if not several.where(F.col("held") > HOT).isEmpty():
        hot = cut_pieces(docs, differ.where(F.col("held") > HOT)).withColumn("at", F.lit(None).cast("int"))
        found = found.unionByName(repeats_in_halves(hot))
    found = settled(found, "repeats")
    twice = salted(kinds.where("m > 1").select(*piece, "salts"))
    whole = shared.join(twice, [*piece, "salt"]).select("key", F.col("place").alias("begin"), (F.col("place") + F.col("n") + LENGTH - 1).alias("end"))
    # of a piece that occurs once, the row is known; those that occur twice go whole
    runs = found.join(kinds.where("m = 1").select(*piece, "one.key", "one.place"), piece)
    part = runs.select("key", (F.col("place") + F.col("first")).alias("begin"), (F.col("place") + F.col("last") + LENGTH).alias("end"))
    spans = whole.unionByName(part).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    return spans.select("key", F.flatten(F.transform("spans", lambda s: F.array(s["begin"], s["end"]))).alias("spans"))


def joined_spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of spans in order of their begins; touching ones become one."""
    begin, end = flat[::2], np.maximum.accumulate(flat[1::2])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each row of docs (doc_id, text)."""
    rows = keyed(docs)

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, spans):
            data = t.encode()
            if s is None or not len(s):
                out.append((0, 0, data))
                continue
            begin, end = joined_spans(np.asarray(s, np.int64))
            kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
            out.append((len(data) - len(kept), len(begin), kept))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    found = rows.join(repeats(rows), "key", "left").withColumn("cut", cut("text", "spans"))
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", "cut.kept")
