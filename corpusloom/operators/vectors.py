"""Exact vector search by blocks: questions go to the vectors, not the other way round.

Questions come to the tasks in blocks of about QUESTIONS rows with the collections that their users may read. A task
multiplies a block with its vectors, a few thousand at a time, masks what may not be read before anything is ranked, and
keeps the k best of each question; so vectors are neither shuffled nor paired up, whatever a collection holds.
Matrix products only choose: what comes within SLACK of the k best is scored again pair by pair, so that equal
vectors have equal scores wherever they stand, and ties go to the smaller id.

Defined results: vectors that are null, hold a null, NaN or infinite value, are all zeros, or have another length than
the question's are no candidates; questions of users without collections have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.sources import tables

#: Rows of a block of questions, about; pairs of question and collection in a block; vectors multiplied at once.
QUESTIONS, PAIRS, ROWS = 1024, 1 << 20, 2048
SLACK = 1e-9
HELD = ["q", "score", "chunk_id"]


def best(rows: DataFrame, k: int, score: str = "score", group: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each group with their rank; ties by id. Plans as a group limit before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Block:
    """Questions for one model and length of vectors. allowed: whether each question may see each collection."""

    query_ids: list
    matrix: np.ndarray
    collections: list[str]
    allowed: np.ndarray
    probes: np.ndarray | None = None
    least: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.matrix = self.matrix / np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.least = np.full(len(self.query_ids), -np.inf)


def block(rows: list) -> dict[tuple[str, int], Block]:
    """Blocks of question rows (query_id, model, embedding, collections) by model and length."""
    kinds: dict[tuple[str, int], list] = {}
    for r in rows:
        if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding):
            kinds.setdefault((r.model, len(r.embedding)), []).append(r)
    out = {}
    for kind, own in kinds.items():
        names = sorted({c for r in own for c in r.collections})
        at = {c: k for k, c in enumerate(names)}
        allowed = np.zeros((len(own), len(names)), bool)
        for k, r in enumerate(own):
            allowed[k, [at[c] for c in r.collections]] = True
        out[kind] = Block([r.query_id for r in own], np.array([r.embedding for r in own], float), names, allowed)
    return out


def question_blocks(questions: DataFrame, allowed: DataFrame) -> Iterator[dict[tuple[str, int], Block]]:
    """questions (query_id, sub, model, embedding) in blocks of bounded size, with what their users (allowed: sub, collection_id) may read."""
    users = allowed.where("collection_id IS NOT NULL").groupBy("sub").agg(F.collect_set("collection_id").alias("collections"))
    asked = questions.join(users, "sub").select("query_id", F.col("model").cast("string"), F.col("embedding").cast("array<double>"), "collections")
    asked = tables.settled(asked, "questions")
    n, pairs = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("collections")), F.lit(0))).first()
    parts = max(math.ceil(n / QUESTIONS), math.ceil(pairs / PAIRS))
    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "model"), F.lit(parts)) == k).collect()
        if found := block(rows):
            yield found


def firsts(held: pa.Table, k: int) -> tuple[pa.Table, np.ndarray]:
    """The k best rows of each question, and the place of each among them."""
    held = held.take(pc.sort_indices(held, [("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
    q = held.column("q").to_numpy()
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return held.filter(pa.array(place < k)), place[place < k]


def pair_scores(matrix: np.ndarray, q: np.ndarray, unit: np.ndarray, r: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 21) // matrix.shape[1])
    parts = [(matrix[q[a : a + step]] * unit[r[a : a + step]]).sum(axis=1) for a in range(0, len(q), step)]
    return np.concatenate([np.zeros(0), *parts])


def unit_vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length, and which are such."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    with np.errstate(all="ignore"):
        norm = np.sqrt((values * values).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    values[~good], norm[~good] = 0.0, 1.0
    return values / norm[:, None], good


def offered(b: Block, part: pa.RecordBatch, unit: np.ndarray, may: np.ndarray, k: int) -> pa.Table:
    """Candidates among the rows of part (chunk_id and others), with exact scores. may: whether each question may take each row."""
    with np.errstate(invalid="ignore"):
        score = np.where(may, b.matrix @ unit.T, -np.inf)
    n = score.shape[1]
    kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    q, r = np.nonzero(may & (score >= np.maximum(b.least, kth)[:, None] - SLACK))
    return pa.table([pa.array(q), pa.array(pair_scores(b.matrix, q, unit, r)), part.column("chunk_id").take(pa.array(r))], HELD)


def scan(blocks: dict[tuple[str, int], Block], k: int, query_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over chunk_id, collection_id, model, embedding: the k best rows of each question in each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], pa.Table] = {}
        for batch in batches:
            length = pc.list_value_length(batch.column("embedding"))
            for kind, b in blocks.items():
                own = batch.filter(pc.and_(pc.equal(batch.column("model"), kind[0]), pc.equal(length, kind[1])))
                for a in range(0, own.num_rows, ROWS):
                    part = own.slice(a, ROWS)
                    unit, good = unit_vectors(part.column("embedding"), kind[1])
                    code = pc.fill_null(pc.index_in(part.column("collection_id"), value_set=pa.array(b.collections, pa.string())), -1).to_numpy(zero_copy_only=False)
                    found = offered(b, part, unit, b.allowed[:, code] & ((code >= 0) & good), k)
                    together = pa.concat_tables([held[kind], found]) if kind in held else found
                    if together.num_rows > 4 * k * len(b.query_ids):
                        together = kept(b, together, k)
                    held[kind] = together
        for kind, found in held.items():
            rows = kept(blocks[kind], found, k).combine_chunks()
            if rows.num_rows:
                ids = pa.array(blocks[kind].query_ids, query_type).take(rows.column("q").chunk(0))
                yield pa.RecordBatch.from_arrays([ids, rows.column("chunk_id").chunk(0), rows.column("score").chunk(0)], ["query_id", "chunk_id", "score"])

    return each


def kept(b: Block, held: pa.Table, k: int) -> pa.Table:
    """The k best of each question; what is worse than a full list is no candidate any more."""
    rows, place = firsts(held, k)
    full = place == k - 1
    b.least[rows.column("q").to_numpy()[full]] = rows.column("score").to_numpy()[full]
    return rows


def nearest(questions: DataFrame, vectors: DataFrame, allowed: DataFrame, k: int = 40) -> DataFrame:
    """query_id, chunk_id, score, rank: the k nearest chunks by cosine, of the same model, in collections that the user may read.

    questions: query_id, sub, model, embedding, a row for each model; vectors: chunk_id, collection_id, model, embedding."""
    ids, chunk = questions.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType
    result = f"query_id {ids.simpleString()}, chunk_id {chunk.simpleString()}, score double"
    rows = vectors.select("chunk_id", F.col("collection_id").cast("string"), F.col("model").cast("string"), "embedding")
    out = None
    for blocks in question_blocks(questions, allowed):
        found = rows.mapInArrow(scan(blocks, k, to_arrow_type(ids)), result)
        out = found if out is None else out.unionByName(found)
    return best(questions.sparkSession.createDataFrame([], result) if out is None else out, k)
