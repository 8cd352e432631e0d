"""Approximate vector search over a stored index of inverted lists, with the access filter inside.

An index is a folder: `centroids` (model, list, centroid), `reach` (see below), `sizes` (vectors of each model and collection)
and `vectors`, partitioned by model and list, with the id, the collection, a code and the vector itself. Centroids are fitted on SAMPLE vectors of a model, those with the smallest
hashes of their ids; every vector is then dealt to the list of its nearest centroid, and its code is what remains
beyond the centroid, a byte a component. Lists are written by a rebalancing shuffle, so that a list of any size becomes
files of even size.

A search reads the lists that its questions probe, by partition pruning, and of them ids, collections and codes only; the
OVER * k best of each question, after the access filter, are scored again on the vectors themselves.

How many lists a question probes follows from the data: when an index is built, each of TRIALS sample vectors looks for its
nearest ones in the sample, and `reach` notes how many lists hold the share RECALL of the first 16, 32, 64, ... of
them. Where a filter leaves the share f of a model's vectors, the k nearest allowed ones are about the k / f nearest of
all, and the lists for so many are probed. A question that still has fewer than k hits probes twice as many, until it
has k or no list is left: so a narrow filter costs lists, not results.

Vectors that aren't whole (see vectors.py) aren't indexed. An index takes new vectors by add(); centroids stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.sources import tables

from .vectors import Block, best, question_blocks, unit_vectors

SAMPLE, ROUNDS, LISTS = 20_000, 10, 4096
OVER, TRIALS, RECALL = 4, 256, 0.98


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by Lloyd's rounds on cosine; a list that loses all its vectors keeps its centroid."""
    different = np.unique(sample, axis=0)
    centroids = different[np.random.default_rng(1).permutation(len(different))[:lists]]
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1)[:, None], centroids)
    return centroids


def dealt(vectors: DataFrame, centroids: dict[str, np.ndarray]) -> DataFrame:
    """vectors with list and code (components in steps of `step`)."""
    kinds = vectors.schema["chunk_id"].dataType.simpleString()
    names = ["chunk_id", "collection_id", "model", "embedding", "list", "step", "code"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column("embedding"))
            for model, own in centroids.items():
                rows = batch.filter(pc.and_(pc.equal(batch.column("model"), model), pc.equal(length, own.shape[1])))
                if not rows.num_rows:
                    continue
                unit, good = unit_vectors(rows.column("embedding"), own.shape[1])
                rows, unit = rows.filter(pa.array(good)), unit[good]
                place = (unit @ own.T).argmax(axis=1)
                rest = unit - own[place]
                step = np.maximum(np.abs(rest).max(axis=1, initial=0) / 127, 1e-12)
                codes = np.round(rest / step[:, None]).astype(np.int8)
                columns = [*rows.columns, pa.array(place, pa.int32()), pa.array(step, pa.float32()), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = vectors.select("chunk_id", F.col("collection_id").cast("string"), F.col("model").cast("string"), F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(each, f"chunk_id {kinds}, collection_id string, model string, embedding array<float>, list int, step float, code binary")


def reach(sample: np.ndarray, centroids: np.ndarray) -> list[tuple[int, int]]:
    """depth, lists: how many of the lists in a vector's own order hold the share RECALL of its `depth` nearest ones."""
    own = (sample @ centroids.T).argmax(axis=1)
    trials = sample[np.random.default_rng(2).permutation(len(sample))[:TRIALS]]
    place = np.argsort(np.argsort(-(trials @ centroids.T), axis=1), axis=1)
    near = np.argsort(-(trials @ sample.T), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1) + 1
    depths = [d for d in (16 << j for j in range(20)) if d < len(sample)] + [len(sample)]
    return [(d, int(np.quantile(needed[:, :d], RECALL, method="higher"))) for d in depths]


def add(vectors: DataFrame, path: str) -> None:
    """Appends vectors (chunk_id, collection_id, model, embedding) of the index's models."""
    rows = dealt(vectors, read_centroids(vectors.sparkSession, path)).hint("rebalance", "model", "list")
    rows.write.mode("append").partitionBy("model", "list").parquet(f"{path}/vectors")
    whole = vectors.where(F.col("embedding").isNotNull()).groupBy(F.col("model").cast("string"), F.col("collection_id").cast("string"))
    whole.agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{path}/sizes")


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Writes an index of vectors (chunk_id, collection_id, model, embedding) to a new folder. lists: of each model; the square root of
    its number of vectors, LISTS at most, where none is given."""
    spark = vectors.sparkSession
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("model").cast("string"), "chunk_id", F.col("embedding").cast("array<double>"))
    made, reached = [], []
    for row in whole.groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy("model").collect():
        own = whole.where(F.col("model").eqNullSafe(row.model))
        taken = own.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        length = pc.mode(pc.list_value_length(taken))[0]["mode"].as_py()
        unit, good = unit_vectors(taken.filter(pc.equal(pc.list_value_length(taken), length)), length)
        if row.model is not None and good.any():
            centroids = fitted(unit[good], lists or min(LISTS, max(1, round(math.sqrt(row.n)))))
            made += [(row.model, k, c.tolist()) for k, c in enumerate(centroids)]
            reached += [(row.model, float(d), n, row.n / len(unit)) for d, n in reach(unit[good], centroids)]
    spark.createDataFrame(made, "model string, list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame(reached, "model string, depth double, lists int, per_sample double").coalesce(1).write.parquet(f"{path}/reach")
    add(vectors, path)


def read_centroids(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    rows: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/centroids").orderBy("model", "list").collect():
        rows.setdefault(r.model, []).append(r.centroid)
    return {m: np.array(c) for m, c in rows.items()}


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All lists; names of models are text, whatever they look like."""
    names = spark.read.parquet(f"{path}/vectors").schema
    kinds = [f"{f.name} {'string' if f.name == 'model' else f.dataType.simpleString()}" for f in names]
    return spark.read.schema(", ".join(kinds)).parquet(f"{path}/vectors")


def probing(blocks: dict[tuple[str, int], Block], centroids: dict[str, np.ndarray], k: int, query_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over chunk_id, collection_id, model, list, step, code: candidates by code of the questions that probe a row's
    list, the k best of each batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (model, length), b in blocks.items():
                rows = batch.filter(pc.equal(batch.column("model"), model))
                number = rows.column("list").to_numpy()
                order = np.argsort(number, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
                    asking = np.flatnonzero(b.probes[:, number[some[0]]])
                    if not len(asking):
                        continue
                    part = rows.take(pa.array(some))
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(-1, length)
                    near = centroids[model][number[some[0]]] + codes * part.column("step").to_numpy()[:, None]
                    code = pc.fill_null(pc.index_in(part.column("collection_id"), value_set=pa.array(b.collections, pa.string())), -1).to_numpy(zero_copy_only=False)
                    may = b.allowed[asking][:, code] & (code >= 0)
                    score = np.where(may, b.matrix[asking] @ near.T, -np.inf)
                    n = score.shape[1]
                    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
                    q, r = np.nonzero(may & (score >= least[:, None]))
                    ids = pa.array(b.query_ids, query_type).take(pa.array(asking[q]))
                    own = part.take(pa.array(r))
                    columns = [ids, own.column("model"), own.column("list"), own.column("chunk_id"), pa.array(score[q, r])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "model", "list", "chunk_id", "score"])

    return each


def wanted_lists(spark: SparkSession, path: str, blocks: dict[tuple[str, int], Block], k: int) -> dict[tuple[str, int], np.ndarray]:
    """How many lists each question of the blocks should probe at first."""
    curves: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/reach").orderBy("model", "depth").collect():
        curves.setdefault(r.model, []).append(r)
    names = spark.createDataFrame([(c,) for c in sorted({c for b in blocks.values() for c in b.collections})], "collection_id string")
    sizes = spark.read.parquet(f"{path}/sizes")
    total = {r.model: r.n for r in sizes.groupBy("model").agg(F.sum("n").alias("n")).collect()}
    rows = sizes.join(F.broadcast(names), "collection_id").groupBy("model", "collection_id").agg(F.sum("n").alias("n")).collect()
    own = {(r.model, r.collection_id): r.n for r in rows}
    out = {}
    for (model, length), b in blocks.items():
        n = np.array([own.get((model, c), 0) for c in b.collections], float)
        share = np.maximum(b.allowed @ n, 1.0) / max(1, total.get(model, 1))
        depth = np.maximum(k, k / share / curves[model][0].per_sample)
        place = np.searchsorted([r.depth for r in curves[model]], depth)
        out[model, length] = np.array([r.lists for r in curves[model]])[np.minimum(place, len(curves[model]) - 1)]
    return out


def lists_of(blocks: dict[tuple[str, int], Block]) -> Column:
    """The partitions that the blocks' questions probe."""
    out = F.lit(False)
    for (model, _), b in blocks.items():
        out |= (F.col("model") == model) & F.col("list").isin(np.flatnonzero(b.probes.any(axis=0)).tolist())
    return out


def search(path: str, questions: DataFrame, allowed: DataFrame, k: int = 40, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k nearest chunks among the lists probed: see vectors.nearest() for the arguments.
    probes: lists of each question at first, in place of the number that the index suggests."""
    spark = questions.sparkSession
    centroids = read_centroids(spark, path)
    ids = questions.schema["query_id"].dataType
    if not centroids:
        return spark.createDataFrame([], f"query_id {ids.simpleString()}, chunk_id string, score double, rank int")
    stored = read_vectors(spark, path)
    nothing = f"query_id {ids.simpleString()}, chunk_id {stored.schema['chunk_id'].dataType.simpleString()}, score double"
    found = [spark.createDataFrame([], nothing)]
    for blocks in question_blocks(questions, allowed):
        blocks = {kind: b for kind, b in blocks.items() if kind[0] in centroids and centroids[kind[0]].shape[1] == kind[1]}
        place = {kind: np.argsort(np.argsort(-(b.matrix @ centroids[kind[0]].T), axis=1, kind="stable"), axis=1) for kind, b in blocks.items()}
        end = wanted_lists(spark, path, blocks, k) if probes is None else {kind: np.full(len(b.query_ids), probes) for kind, b in blocks.items()}
        begin = {kind: np.zeros(len(b.query_ids), int) for kind, b in blocks.items()}
        while blocks:
            for kind, b in blocks.items():
                b.probes = (place[kind] >= begin[kind][:, None]) & (place[kind] < end[kind][:, None])
            found.append(tables.settled(rescored(stored, blocks, centroids, k, ids), "hits"))
            enough = {r.query_id: r.n for r in best(union(found), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            left = {}
            for kind, b in blocks.items():
                open_ = [i for i, q in enumerate(b.query_ids) if enough.get(q, 0) < k and end[kind][i] < place[kind].shape[1]]
                if open_:
                    left[kind] = Block([b.query_ids[i] for i in open_], b.matrix[open_], b.collections, b.allowed[open_])
                    place[kind], begin[kind], end[kind] = place[kind][open_], end[kind][open_], 2 * end[kind][open_]
            blocks = left
    return best(union(found), k)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rescored(stored: DataFrame, blocks: dict[tuple[str, int], Block], centroids: dict[str, np.ndarray], k: int, ids) -> DataFrame:  # type: ignore[no-untyped-def]
    """query_id, chunk_id, score: the k best of the lists probed, by their vectors. Candidates are OVER * k rows a question of a block
    at most, so they can be broadcast."""
    kinds = f"query_id {ids.simpleString()}, model string, list int, chunk_id {stored.schema['chunk_id'].dataType.simpleString()}, score double"
    read = stored.where(lists_of(blocks))
    codes = read.select("chunk_id", "collection_id", F.col("model").cast("string"), "list", "step", "code")
    some = best(codes.mapInArrow(probing(blocks, centroids, OVER * k, to_arrow_type(ids)), kinds), OVER * k).drop("rank", "score")
    asked = [(q, model, v.tolist()) for (model, _), b in blocks.items() for q, v in zip(b.query_ids, b.matrix)]
    q = stored.sparkSession.createDataFrame(asked, f"query_id {ids.simpleString()}, model string, q array<double>")
    some = some.join(F.broadcast(q), ["query_id", "model"])
    whole = read.select("chunk_id", F.col("model").cast("string"), "list", F.col("embedding").cast("array<double>").alias("v"))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = product(F.col("q"), F.col("v")) / F.sqrt(product(F.col("v"), F.col("v")))
    hits = whole.join(F.broadcast(some), ["model", "list", "chunk_id"]).select("query_id", "chunk_id", cosine.alias("score"))
    return best(hits, k).drop("rank")
