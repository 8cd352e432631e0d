"""Vector code compression: product codes by Lloyd's method with filtering over kd-trees.

Vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES integer vectors. Tasks
cut their rows into blocks of bounded size and build, once, a kd-tree for each part of a block, with the box,
sum and count of every node cached; the trees are written to the shared folder. In each round a task runs
down its trees: boxes rule codebook entries out, and a subtree with one entry left is counted whole. A
task returns sums and counts for each entry whatever it reads, which Spark adds up; so the driver gets
PARTS * ENTRIES rows a round, and the codebooks are all that travels to the tasks.

All is in integers, so results don't depend on how rows are dealt, and retried tasks agree.

Defined results: rows whose vector is null, or holds a null, NaN or infinite component, are dropped; so are
those whose length isn't that of the kept vector with the smallest id, or which can't be cut into PARTS
equal parts (lengths of 0 too). Repeated rows count as often as they occur; among equal ids vectors are ordered
by their components; null ids come last. Components beyond 2 ** 30 / sqrt(length) after scaling count as that bound,
so that distances fit 64 bits (for 64 components: values beyond 32,768). With fewer than ENTRIES
vectors the codebooks have as many entries as there are vectors. A sum of errors beyond 64 bits is
null. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kd_tree
from .common import done_with, lean, settled, with_facts

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a block's vectors, at most (8 MB as integers).
BLOCK = 1 << 20

RESULT = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
TREES = "vec_ids array<long>, labels array<string>, width int, orders array<binary>, points array<binary>, low array<binary>, high array<binary>, sums array<binary>"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector is complete and finite."""
    values = F.col("embedding").cast("array<double>")
    broken = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull()).where(~broken & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    return kept.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), values.alias("embedding"))


def floored(values: np.ndarray, bound: int) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -bound, bound).astype(np.int64)


def limit(length: int) -> int:
    return math.isqrt((1 << 60) // length)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Integers of all levels, one after the other, as bytes."""
    return np.concatenate([a.ravel() for a in arrays]).astype("<i8").tobytes()


def trees(vectors: DataFrame, length: int) -> DataFrame:
    """A row for each block of vectors of this length: ids, labels, and for each part its tree."""
    width, bound = length // PARTS, limit(length)
    most = max(1, BLOCK // length)

    def block(ids: pa.Array, labels: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        parts = floored(values, bound).reshape(len(values), PARTS, width)
        made = [kd_tree.build(np.ascontiguousarray(parts[:, p])) for p in range(PARTS)]
        columns = [
            pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(pa.string())), pa.array([width], pa.int32()),
            *(pa.array([cells], pa.list_(pa.binary())) for cells in (
                [t.order.astype("<i4").tobytes() for t in made], [t.points.astype("<i4").tobytes() for t in made],
                [packed(t.low) for t in made], [packed(t.high) for t in made], [packed(t.sums) for t in made],
            )),
        ]
        return pa.RecordBatch.from_arrays(columns, ["vec_ids", "labels", "width", "orders", "points", "low", "high", "sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while rows + batch.num_rows >= most:
                waiting.append(batch.slice(0, most - rows))
                batch = batch.slice(most - rows)
                yield block(*together(waiting, length))
                waiting, rows = [], 0
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
        if rows:
            yield block(*together(waiting, length))

    return vectors.where(F.size("embedding") == length).select("vec_id", "label", "embedding").mapInArrow(lean(each), TREES)


def together(batches: list[pa.RecordBatch], length: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, labels, vectors = (c.chunk(0) for c in table.columns)
    return ids, labels, vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def read(row: dict) -> list[kd_tree.Tree]:
    """The trees of a block."""
    width, out = row["width"], []
    for order, points, *nodes in zip(row["orders"], row["points"], row["low"], row["high"], row["sums"]):
        levels = []
        for cell in nodes:
            flat = np.frombuffer(cell, "<i8").reshape(-1, width)
            depth = (len(flat) + 1).bit_length() - 1
            levels.append([flat[(1 << d) - 1 : (2 << d) - 1] for d in range(depth)])
        out.append(kd_tree.Tree(np.frombuffer(order, "<i4"), np.frombuffer(points, "<i4").reshape(-1, width).astype(np.int64), *levels))
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[kd_tree.Tree]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, read(row)


def totals(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: for each part and entry the sum of its vectors and, last, their number, as Python integers."""
    parts, entries, width = books.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), object)  # of any size, whatever a task reads
        for _, made in blocks(batches):
            for p, tree in enumerate(made):
                found = kd_tree.assign(tree, books[p])
                sums[p] += np.concatenate([found.sums, found.count[:, None]], axis=1)
        flat = [pa.array([int(v)], pa.decimal128(38, 0)) for v in sums.ravel()]
        place = pa.array(np.arange(sums.size), pa.int32())
        yield pa.RecordBatch.from_arrays([place, pa.concat_arrays(flat)], ["place", "total"])

    rows = stored.mapInArrow(lean(each), "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((parts, entries, width + 1), object)
    for row in rows:
        out.flat[row.place] = int(row.total)
    return out


def replaced(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means rounded down; unused entries stay."""
    out = books.copy()
    for p, e in np.argwhere(sums[:, :, -1] > 0):
        out[p, e] = [v // sums[p, e, -1] for v in sums[p, e, :-1]]
    return out


def codes(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each vector."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, made in blocks(batches):
            found = np.zeros((len(row["vec_ids"]), len(made)), np.uint8)
            error = np.zeros(len(found), np.int64)
            for p, tree in enumerate(made):
                entry = kd_tree.assign(tree, books[p]).entry
                found[tree.order, p] = entry
                error[tree.order] += ((tree.points - books[p][entry]) ** 2).sum(axis=1)
            text = [code.tobytes().hex() for code in found]
            columns = [pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(text), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(lean(each), "vec_id long, label string, code string, error long")


def first_books(vectors: DataFrame) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids, as codebooks; None without vectors."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    least = vectors.orderBy(*order).limit(1).collect()
    if not least:
        return None
    length = len(least[0].embedding)
    rows = vectors.where(F.size("embedding") == length).orderBy(*order).limit(ENTRIES).collect()
    values = floored(np.array([r.embedding for r in rows]), limit(length))
    return np.ascontiguousarray(values.reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """The written trees and the codebooks after all rounds; None without vectors."""
    kept = whole_vectors(vectors)
    books = first_books(kept)
    if books is None:
        return None
    stored = settled(trees(kept, books.shape[0] * books.shape[2]), "trees")
    for _ in range(rounds):
        books = replaced(books, totals(stored, books))
    return stored, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of errors over equal labels, nulls together. Sums are made before rows meet them."""
    total = F.sum(F.col("error").cast("decimal(38,0)")).alias("total")
    sums = settled(coded.groupBy("label").agg(total), "label-errors")
    met = with_facts(coded, sums, "label", F.struct("vec_id", "code"))
    return met.withColumn("label_error", F.expr("try_cast(total AS long)")).drop("total")


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each kept row of vectors (vec_id, embedding, label)."""
    made = fitted(vectors, rounds)
    if made is None:
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in RESULT.items()]
        return vectors.limit(0).select("vec_id", "label", *nothing)
    stored, books = made
    coded = settled(codes(stored, books), "codes")
    done_with(stored)
    named = with_label_errors(coded).withColumn("label", F.col("label").cast(vectors.schema["label"].dataType))
    return named.withColumn("codebooks_sha256", F.lit(digest(books)))
