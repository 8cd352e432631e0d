"""Near-duplicate documents by MinHash with tensored banding.

A document's sketch has two collections of BANDS values, each made of ROWS minhashes. A table key joins
one value of the first collection with one of the second, so BANDS * BANDS tables take the minhashes of
2 * BANDS bands. Two documents meet in a table exactly if they share a value of each collection; with
similarity s that has the probability (1 - (1 - s**ROWS)**BANDS)**2, 0.9998 at 0.75. A table key can
only be shared where its first value is, so keys are formed for the documents that share one.

1. Documents with the same shingle set form a class, represented by its smallest key; aggregation
   before the shuffle keeps a class of any size cheap.
2. In ROUNDS rounds each bucket of a table names a pivot, the member with the least hash of itself and the bucket, so
   that a document has other pivots in other tables. Members are paired with the PIVOTS pivots that they meet most
   often, pairs are confirmed on full sets, and what is linked is one component from then on. A round is linear work,
   and the next one takes only buckets that still hold several components.
3. What meets in those buckets and isn't linked yet is settled on full sets, by exact rules (rare_shingles, rivals): a
   shingle is live if documents of two components have it; a document with fewer live shingles than a link needs has no
   further link; two linked ones share one of their rarest shingles, and places in the order of rarity, sizes and
   numbers of live shingles bound what a pair can share. The few documents that this leaves are compared by lists of
   such a shingle, and a comparison returns the links that join components, fewer than it has members.

So each pair that meets in a table is either linked through others or ruled out on its full sets: the tables' miss rate
is the only one. No pairs of a group are listed. A list of more than LIST shingles is dealt to several tasks: members of
its largest component go to one block each, the others to all, as only pairs across components matter.

Defined results: a document without words links with nothing; rows of one doc_id are one vertex: each of its texts is
compared by its own set, and all of them are one component; documents
with a null doc_id are told apart by their texts, and a component of such documents only has a null component_id, of which
one text is kept; repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged, shingles
from .common import document_key, done_with, lean, settled, with_facts
from .components import components

BANDS, ROWS = 24, 4
HASHES = 2 * BANDS * ROWS
ROUNDS, PIVOTS = 2, 2
LIST = 1 << 21
NEAR = 75


def factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, HASHES, np.uint32)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """2 * BANDS values of 64 bits; each holds 16 bits of ROWS minhashes."""
    a, b = factors()
    key = (shingle_set >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(key), 4096):
        least = np.minimum(least, (key[i : i + 4096] * a + b).min(axis=0))
    # of the least value the low bits: its high ones are nearly all zero
    return (least & np.uint32(0xFFFF)).astype("<u2").view("<u8")


def class_of(shingle_set: bytes) -> bytes:
    """The name of all documents with this set."""
    return hashlib.blake2b(shingle_set, digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles, class (null without words) and sketch of each row of docs (key, doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in ragged.slices(ragged.strings(batch.column(2))):
                found = shingles.sets(part)
                names = [class_of(s.tobytes()) if len(s) else None for s in found]
                values = np.concatenate([np.zeros(0, "<u8"), *(sketch(s) for s in found if len(s))]).view(np.int64)
                sizes = np.where([len(s) > 0 for s in found], 2 * BANDS, 0)
                ids = [batch.column(k).slice(at, len(part)) for k in (0, 1)]
                columns = [*ids, pa.array(map(len, found), pa.int64()), pa.array(names, pa.binary()), ragged.list_array(values, sizes, pa.int64())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_shingles", "class", "sketch"])

    return docs.select("key", "doc_id", "text").mapInArrow(lean(each), "key long, doc_id long, n_shingles long, class binary, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """key, class and the whole shingle set, as bytes, of each row of docs (key, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in ragged.slices(ragged.strings(batch.column(1))):
                found = [s.tobytes() for s in shingles.sets(part)]
                names = [class_of(s) for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(names, pa.binary()), pa.array(found, pa.binary())], ["key", "class", "shingles"])
                at += len(part)

    return docs.select("key", "text").mapInArrow(lean(each), "key long, class binary, shingles binary")


def shared(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key occurs in two rows or more. Counting comes before the join."""
    often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(often, list(key))


def buckets(classes: DataFrame) -> DataFrame:
    """doc, bucket: the members of all table buckets that hold several classes (doc, sketch)."""
    firsts = classes.select("doc", F.posexplode(F.slice("sketch", 1, BANDS)).alias("i", "u"))
    met = shared(firsts, "i", "u")
    seconds = classes.select("doc", F.slice("sketch", BANDS + 1, BANDS).alias("second"))
    keyed = met.join(seconds, "doc").select("doc", "i", "u", F.posexplode("second").alias("j", "v"))
    return shared(keyed.select("doc", F.xxhash64("i", "u", "j", "v").alias("bucket")), "bucket")


def alike(x: bytes, y: bytes, near: int) -> bool:
    """Whether 100 * intersection >= near * union of two sets."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(p), len(q)) < near * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= near * (len(p) + len(q) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Of pairs a, b those whose full sets are alike."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, near) for x, y in zip(left, right)], dtype=bool)

    a = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    b = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(a, "a").join(b, "b").where(linked("left", "right")).select("a", "b")


def with_pivots(members: DataFrame, turn: int) -> DataFrame:
    """a, b: each document with the PIVOTS pivots that it meets most often, of members (bucket, doc, component)
    in different components."""
    order = F.xxhash64("doc", "bucket", F.lit(turn))
    pivots = members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "doc", "component")).alias("least")).select("bucket", F.col("least.doc").alias("pivot"), F.col("least.component").alias("its"))
    met = members.join(pivots, "bucket").where("component <> its").groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "pivot"))), 1, PIVOTS)
    # a document meets at most one pivot a table: the list is short
    return met.groupBy("doc").agg(best.alias("best")).select(F.col("doc").alias("a"), F.explode("best.pivot").alias("b"))


def several(rows: DataFrame, key: str) -> DataFrame:
    """The rows (with component) whose key occurs in two components or more."""
    mixed = rows.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(key)
    return rows.join(mixed, key)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc) with the component of each document; one that no link has reached is its own."""
    return rows.join(labels, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc")).drop("node")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component: labels after further links (a, b). Only the components that these join are worked on."""
    ends = links.select(F.col("a").alias("doc"), "b")
    ends = labelled(ends, labels).select(F.col("component").alias("a"), F.col("b").alias("doc"))
    between = labelled(ends, labels).select("a", F.col("component").alias("b"))
    new = components(between).withColumnsRenamed({"node": "was", "component": "now"})
    moved = labels.join(new, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    out = settled(moved.unionByName(new.where("was <> now").select(F.col("was").alias("node"), F.col("now").alias("component"))).distinct(), "labels")
    done_with(labels, new)
    return out


def tokens(sets: DataFrame) -> DataFrame:
    """token, doc, component, n: the shingles of sets (doc, component, shingles) as rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(2)):
                values = np.frombuffer(data.as_buffer(), np.int64)
                same = [pa.repeat(batch.column(c)[k], len(values)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(values), *same, pa.repeat(pa.scalar(len(values), pa.int64()), len(values))], ["token", "doc", "component", "n"])

    return sets.select("doc", "component", "shingles").mapInArrow(lean(each), "token long, doc long, component long, n long")


def rare_shingles(sets: DataFrame, near: int) -> DataFrame:
    """token, doc, component, n (size of the set), live (number of live shingles) and place, from sets (doc, component,
    shingles).

    Shingles are ordered by rarity, those that aren't live first. Of two sets with a similarity of `near` percent each
    shares that part of its shingles, so one of the n - ceil(near * n / 100) + 1 rarest is common to both; of these the
    live ones are returned."""
    rows = tokens(sets)
    use = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("df")).where("low < high").select("token", "df")
    of = rows.join(use, "token").groupBy("doc", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    live = F.size("found").cast("long")
    enough = of.withColumn("live", live).where(100 * F.col("live") >= near * F.col("n"))
    first = F.slice("found", F.lit(1), (F.col("live") - F.ceil(near * F.col("n") / 100) + 1).cast("int"))
    exploded = enough.select("doc", "component", "n", "live", F.posexplode(first).alias("at", "pair"))
    return exploded.select("pair.token", "doc", "component", "n", "live", (F.col("n") - F.col("live") + F.col("at")).alias("place"))


NUMBERS = ["token", "block", "away", "doc", "component", "n", "live", "place"]


def dealt(rows: DataFrame) -> DataFrame:
    """The lists of rows (of rare_shingles) with several components, with block and away (false in a row's own block).

    A list of more than LIST shingles has several blocks; documents outside its largest component go to all of them."""
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    lists = parts.groupBy("token").agg(F.count(F.lit(1)).alias("different"), F.sum("size").alias("size"), F.max_by("component", "m").alias("main")).where("different > 1")
    blocks = F.ceil(F.col("size") / LIST).cast("int")
    placed = rows.join(lists.select("token", blocks.alias("blocks"), "main"), "token").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    to: Column = F.when(F.col("component") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("block", F.explode(to)).withColumn("away", F.col("block") != F.col("own")).select(*NUMBERS)


class Block:
    """The rows of one block of a list: its own ones first, then those that come from other blocks, in parts.

    Columns are doc, component, n, live, place and, to compare, the sets as one array."""

    def __init__(self, own: list[np.ndarray], near: int):
        self.own, self.near = own, near
        self.useful = np.zeros(len(own[0]), bool)
        self.root = own[1].copy()
        self.leader: dict[int, int] = {}
        if len(own) > 5:
            self.sizes, self.starts = own[2], np.cumsum(own[2]) - own[2]
            self.known, self.where = np.unique(own[5], return_inverse=True)

    def rivals(self, part: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Of rows the place in the part, and whether each own row is in another component and may share enough with it.
        A pair's first common shingle bounds what it shares by the rest of both; at later ones the rule may fail."""
        _, component, n, live, place = (c[:, None] for c in part[:5])
        _, component_, n_, live_, place_ = self.own[:5]
        step = max(1, (1 << 20) // max(1, len(n_)))
        for a in range(0, len(n), step):
            at = slice(a, a + step)
            most = np.minimum(np.minimum(live[at], live_), np.minimum(n[at] - place[at], n_ - place_))
            fits = (100 + self.near) * most >= self.near * (n[at] + n_)
            fits &= component[at] != component_
            for k in np.flatnonzero(fits.any(axis=1)).tolist():
                yield a + k, fits[k]

    def marked(self, part: list[np.ndarray]) -> np.ndarray:
        """Which rows of the part have a rival here; own rows with one are noted."""
        out = np.zeros(len(part[0]), bool)
        for k, fits in self.rivals(part):
            out[k] = True
            self.useful |= fits
        return out

    def find(self, component: int) -> int:
        while (up := self.leader.get(component, component)) != component:
            component = up
        return component

    def links(self, part: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links of the part's rows with own ones that join two components."""
        found = []
        starts = np.cumsum(part[2]) - part[2]
        mark = np.zeros(len(self.known) + 1, bool)
        for k, fits in self.rivals(part):
            mine = self.find(int(part[1][k]))
            values = part[5][starts[k] : starts[k] + part[2][k]]
            place = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
            place = place[self.known[place] == values]
            mark[place] = True
            others = np.flatnonzero(fits)
            for a in range(0, len(others), 256):
                some = others[a : a + 256]
                some = some[self.root[some] != mine]
                if not len(some):
                    continue
                both = np.add.reduceat(mark[self.where[ragged.spread(self.starts[some], self.sizes[some])]], np.cumsum(self.sizes[some]) - self.sizes[some], dtype=np.int64)
                for j in some[(100 + self.near) * both >= self.near * (part[2][k] + self.sizes[some])].tolist():
                    other = int(self.root[j])
                    if other != mine:
                        found.append((int(part[0][k]), int(self.own[0][j])))
                        least = min(mine, other)
                        self.leader[max(mine, other)] = least
                        self.root[(self.root == other) | (self.root == mine)] = mine = least
            mark[place] = False
        return found


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list[np.ndarray]]]:
    """Of rows in the order of NUMBERS, with the sets as a last column or without: token and block, away, and the other
    columns of each run of rows that agree in these."""
    for batch in batches:
        flat = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: len(NUMBERS)]]
        token, block, away = flat[:3]
        new = (token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (away[1:] != away[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(token)] if len(token) else [0]
        if batch.num_columns > len(NUMBERS):
            sets = batch.column(len(NUMBERS))
            edges = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1]
            data = np.frombuffer(sets.buffers()[2] or b"", np.uint8)
        for a, b in zip(cuts, cuts[1:]):
            part = [c[a:b] for c in flat[3:]]
            if batch.num_columns > len(NUMBERS):
                part.append(data[edges[a] : edges[b]].view(np.int64))
            yield (int(token[a]), int(block[a])), bool(away[a]), part


def walked(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[tuple[tuple, Block, list[np.ndarray] | None, bool]]:
    """Key, block, part and away of each part of each block; the first part is the block's own rows, None its end."""
    key: tuple = ()
    own: list[list[np.ndarray]] = []
    block: Block | None = None
    for now, away, part in itertools.chain(runs(batches), [((), False, [])]):
        if now != key:
            if own and block is None:
                block = Block([np.concatenate(c) for c in zip(*own)], near)
                yield key, block, block.own, False
            if block is not None:
                yield key, block, None, False
            key, own, block = now, [], None
        if not away:
            own.append(part)
        elif own or block is not None:
            if block is None:
                block = Block([np.concatenate(c) for c in zip(*own)], near)
                yield key, block, block.own, False
            yield key, block, part, True


def in_lists(rows: DataFrame) -> DataFrame:
    """Rows of a block in one task, its own ones first."""
    return rows.repartition("token", "block").sortWithinPartitions("token", "block", "away")


def rivals(lists: DataFrame, near: int) -> DataFrame:
    """The rows of lists (of dealt()) that have a rival: a row of their block with which they may still be linked."""
    kinds = dict(zip(NUMBERS, ("long", "int", "boolean", *["long"] * 5)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            columns[1] = columns[1].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NUMBERS)

        for (token, number), block, part, away in walked(batches, near):
            if part is None:
                part, keep = block.own, block.useful
            else:
                keep = block.marked(part)
                if not away:
                    continue
            n = int(keep.sum())
            if n:
                held.append([np.full(n, token), np.full(n, number), np.full(n, away), *(c[keep] for c in part)])
                size += n
            if size > 20_000:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    return in_lists(lists).select(*NUMBERS).mapInArrow(lean(each), ", ".join(f"{n} {k}" for n, k in kinds.items()))


def links_of_rivals(rows: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """a, b: links that join the components of rows (of rivals()), by their full sets; of each block a spanning set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, part, _ in walked(batches, near):
            if part is not None and (found := block.links(part)):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_lists(rows.join(sets, "doc")).select(*NUMBERS, "shingles").mapInArrow(lean(each), "a long, b long")


def near_duplicates(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of `near` percent
    similarity or more) and kept (doc_id = component_id) for each row of docs (doc_id, text)."""
    return grouped(docs, near).select("doc_id", "n_shingles", "component_id", "kept")


def with_several_texts(rows: DataFrame) -> DataFrame | None:
    """key and low, the least class, of the keys that rows (key, class) have under several classes; None without such."""
    span = rows.where("class IS NOT NULL").groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    found = settled(span.where("low <> high").select("key", "low"), "several-texts")
    return None if found.isEmpty() else found


def vertices(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows (key, class) with `doc`, the vertex of a class that is represented by this key: the key, or, for all classes but one
    of a key with several, a negative number made from the class."""
    if repeated is None:
        return rows.withColumn("doc", F.col("key"))
    other = -F.shiftrightunsigned(F.xxhash64("class"), 1) - 1
    met = with_facts(rows, repeated, "key", F.col("class"), "left")
    return met.withColumn("doc", F.when(F.col("low").isNull() | (F.col("low") == F.col("class")), F.col("key")).otherwise(other)).drop("low")


def one_document(rows: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """a, b: links between the classes that one document has."""
    own = with_facts(rows.select("key", "class").distinct(), repeated, "key", F.col("class")).select("key", "class")
    of = settled(own.join(classes.select("class", "doc"), "class").select("key", "doc"), "own")
    least = of.groupBy("key").agg(F.min("doc").alias("least"))
    return with_facts(of, least, "key", F.col("doc")).where("doc <> least").select(F.col("doc").alias("a"), F.col("least").alias("b"))


def grouped(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """near_duplicates() with document keys: key, doc_id, n_shingles, component_id and kept."""
    docs = docs.select(document_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settled(sketches(docs), "sketches")
    least = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("key", "sketch")).alias("least"), F.min("doc_id").alias("id"))
    repeated = with_several_texts(rows)
    named = vertices(least.select("class", "id", F.col("least.key").alias("key"), F.col("least.sketch").alias("sketch")), repeated)
    classes = settled(named.select("class", "id", "key", "doc", "sketch"), "classes")
    members = settled(buckets(classes), "buckets")
    met = members.select("doc").distinct()
    met = met.withColumnRenamed("doc", "key") if repeated is None else classes.join(met, "doc", "left_semi").select("key").distinct()
    candidates = vertices(full_sets(docs.join(met, "key", "left_semi")), repeated)
    sets = settled(candidates.groupBy("doc").agg(F.max("shingles").alias("shingles")), "sets")

    opened = members.withColumn("component", F.col("doc"))
    labels = docs.sparkSession.createDataFrame([], "node long, component long")
    if repeated is not None:
        labels = merged(labels, settled(one_document(rows, classes, repeated), "own"))
        opened = settled(several(labelled(members, labels), "bucket"), "open")
    for turn in range(ROUNDS):
        links = settled(confirmed(with_pivots(opened, turn), sets, near), "links")
        labels = merged(labels, links)
        left = settled(several(labelled(opened.drop("component"), labels), "bucket"), "open")
        done_with(links, opened)
        opened = left
    unsettled = labelled(opened.select("doc").distinct(), labels)
    lists = settled(rare_shingles(unsettled.join(sets, "doc"), near), "rare")
    close = settled(rivals(dealt(lists), near), "rivals")
    links = settled(links_of_rivals(close, sets, near), "links")
    labels = merged(labels, links)

    reach = labelled(classes.select("class", "doc", "id"), labels)
    ids = reach.groupBy("component").agg(F.min("id").alias("component_id"))
    reach = settled(reach.join(ids, "component").select("class", "component", "component_id"), "reach")
    done_with(classes, opened, sets, lists, close, links, labels)
    # without words a document is its own component
    found = rows.join(reach, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    nameless = F.col("key") == F.coalesce("component", "key")
    kept = F.when(F.col("component_id").isNull(), nameless).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.select("key", "doc_id", "n_shingles", "component_id", kept.alias("kept"))
