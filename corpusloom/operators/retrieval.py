"""Batch hybrid retrieval: many questions at once, filtered by access before ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources import tables

from . import term_blocks
from .vectors import best, nearest

RRF_K = 60


def query_terms(question: Column) -> Column:
    """Distinct words of two signs or more that aren't stop words, in order."""
    return F.array_distinct(F.filter(T.tokens(question), lambda t: ~t.isin(T.STOPWORDS) & (F.length(t) >= 2)))


def asked_terms(questions: DataFrame) -> DataFrame:
    """query_id, sub, term: the stems of each question."""
    return questions.select("query_id", "sub", F.explode(F.array_distinct(F.transform(query_terms(F.col("question")), T.stem))).alias("term"))


def lexical(questions: DataFrame, chunks: DataFrame, allowed: DataFrame, k: int = 40) -> DataFrame:
    """query_id, chunk_id, score, rank. questions: query_id, sub, question; chunks: chunk_id, collection_id, text;
    allowed: sub, collection_id.

    With n matching positions a chunk scores 0.1 n / (1 + 0.1 n). Questions go to the chunks in blocks and the access filter comes
    before any ranking, so k is filled from what may be read: see term_blocks."""
    terms = chunks.select("chunk_id", "collection_id", T.content_terms(F.col("text")).alias("terms"))
    first = best(term_blocks.candidates(asked_terms(questions), terms, allowed, k), k, "n")
    return first.select("query_id", "chunk_id", (0.1 * F.col("n") / (1 + 0.1 * F.col("n"))).alias("score"), "rank")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(questions: DataFrame, vectors: DataFrame, allowed: DataFrame, k: int = 40) -> DataFrame:
    """query_id, chunk_id, score, rank: exact nearest chunks by cosine, of the same model, in allowed collections: see vectors.nearest()."""
    return nearest(questions, vectors, allowed, k)


def fused(by_vector: DataFrame, by_terms: DataFrame, keep: int = 20, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: query_id, chunk_id, the rank and score of each list, rrf, rank."""
    a = by_vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = by_terms.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return best(both.withColumn("rrf", part("vector_rank") + part("lexical_rank")), keep, "rrf")


def overlap_score(question_terms: Column, passage_terms: Column) -> Column:
    """0.8 of the share of the question's terms found plus 0.2 of their density, capped, to six places."""
    q = F.array_distinct(question_terms)
    coverage = F.size(F.array_intersect(q, passage_terms)) / F.size(q)
    hits = F.size(F.filter(passage_terms, lambda t: F.array_contains(question_terms, t)))  # q would be made anew for each term
    density = hits / F.sqrt(F.size(passage_terms))
    score = F.round(F.least(F.lit(1.0), 0.8 * coverage + 0.2 * F.least(F.lit(1.0), density / 3)), 6)
    return F.when((F.size(q) == 0) | (F.size(passage_terms) == 0), 0.0).otherwise(score)


def reranked(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, chunk_id, rank, question_terms, passage_terms) with rerank_score and the new
    rank; ties keep the fused order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    scored = candidates.withColumn("rerank_score", overlap_score(F.col("question_terms"), F.col("passage_terms")))
    return scored.withColumn("rerank_rank", F.row_number().over(order))


def rescored(candidates: DataFrame, logit: Column) -> DataFrame:
    """candidates (query_id, rank) with rerank_score and rerank_rank by a model's logits, as reranked() has them by overlap. `logit` is
    evaluated in Arrow batches if it is a Pandas UDF over a model."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return candidates.withColumn("rerank_score", 1 / (1 + F.exp(-logit))).withColumn("rerank_rank", F.row_number().over(order))


# Fixed value: what queries of the models with this word in their names begin with.
QUERY_PREFIX = {"bge": "Represent this sentence for searching relevant passages: "}


def query_input(question: Column, model: str) -> Column:
    """A question as its embedding model wants it."""
    prefix = next((p for name, p in QUERY_PREFIX.items() if name in model.lower()), "")
    return F.concat(F.lit(prefix), question)


def checked_vectors(embedding: Column, size: int) -> Column:
    """Vectors of a model; the query fails if one hasn't `size` values."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector should have {size} values, not "), F.size(embedding).cast("string"))).cast("array<float>")
    return F.when(F.size(embedding) == size, embedding).otherwise(wrong)


def diversified(ranked: DataFrame, k: int = 8, per_document: int = 3, weight: float = 0.75) -> DataFrame:
    """Maximal marginal relevance: query_id, chunk_id, place. ranked: query_id, chunk_id, document_id,
    place_in, relevance (0 to 1), terms. Each pick weighs relevance against the greatest likeness to the picks
    so far; a document gives `per_document` chunks at most, and the first in order wins ties.

    One query's candidates, cut to a few dozen before, are one group."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place_in")
        sets = [set(t) for t in rows["terms"]]
        relevance, document = rows["relevance"].tolist(), rows["document_id"].tolist()
        like, left = [0.0] * len(sets), list(range(len(sets)))
        used: dict[object, int] = {}
        chosen: list[int] = []
        while left and len(chosen) < k:
            open_ = [i for i in left if used.get(document[i], 0) < per_document]
            if not open_:
                break
            top = max(open_, key=lambda i: weight * relevance[i] - (1 - weight) * like[i])
            left.remove(top)
            used[document[top]] = used.get(document[top], 0) + 1
            chosen.append(top)
            for i in left:
                union = len(sets[i] | sets[top])
                if sets[i] and sets[top]:
                    like[i] = max(like[i], len(sets[i] & sets[top]) / union)
        out = rows.iloc[chosen][["query_id", "chunk_id"]].copy()
        out["place"] = range(1, len(chosen) + 1)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, place int")


def capped(ranked: DataFrame, per_document: int = 3, order: str = "rank") -> DataFrame:
    """At most so many chunks of a document in each query's list."""
    nth = Window.partitionBy("query_id", "document_id").orderBy(order)
    return ranked.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= per_document)


def low_relevance(n: Column, reranked_: Column, best_score: Column, best_vector: Column, least: float = 0.10, least_vector: float = 0.6) -> Column:
    """Whether a question should be refused: nothing found, or the best score below its bound."""
    return F.when(n == 0, True).when(reranked_, best_score < least).when(best_vector.isNotNull(), best_vector < least_vector).otherwise(False)


#: Rows whose vectors a task holds at once.
HASHED = 2048


def hashed(terms: pa.ListArray, size: int) -> pa.ListArray:
    """Vectors of lists of terms. Terms and pairs are numbered, counted and weighed as arrays, and each distinct one is hashed once.
    A vector adds its features up in the order in which they first occur, terms first."""
    n_rows, words = len(terms), terms.flatten().dictionary_encode()
    names, code = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
    next_ = np.flatnonzero(row[:-1] == row[1:])
    pairs, of_pair = np.unique(code[next_] * len(names) + code[next_ + 1], return_inverse=True)
    texts = [*names, *(f"{names[a]}_{names[b]}" for a, b in zip((pairs // max(1, len(names))).tolist(), (pairs % max(1, len(names))).tolist()))]
    digests = np.frombuffer(b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in texts), np.uint8).reshape(-1, 8)
    place, positive = digests[:, :4].copy().view("<u4")[:, 0].astype(np.int64) % size, digests[:, 4] & 1 == 1
    key = np.concatenate([row, row[next_]]) * max(1, len(texts)) + np.concatenate([code, len(names) + of_pair])
    key, first, n = np.unique(key, return_index=True, return_counts=True)
    order = np.lexsort((first, key // max(1, len(texts))))
    key, n = key[order], n[order]
    own, feature = key // max(1, len(texts)), key % max(1, len(texts))
    logs = np.array([0.0, *(1 + np.log(k) for k in range(1, int(n.max(initial=0)) + 1))])
    weight = logs[n] * np.where(feature < len(names), 1.0, 0.5)
    out = np.bincount(own * size + place[feature], np.where(positive[feature], weight, -weight), n_rows * size).reshape(n_rows, size)
    norm = np.array([np.linalg.norm(v) for v in out])
    out[norm == 0, 0], norm[norm == 0] = 1.0, 1.0
    values = pa.array((out / norm[:, None]).astype(np.float32).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1, dtype=np.int32) * size), values)


def hashed_vectors(rows: DataFrame, text: str = "text", size: int = 384) -> DataFrame:
    """rows with `embedding`: signed hashed counts of terms and neighbouring pairs, of unit length."""
    tables.bounded_batches(rows.sparkSession)

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for terms in batches:
            parts = [hashed(terms.slice(a, HASHED), size) for a in range(0, len(terms), HASHED)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return rows.withColumn("embedding", embed(T.content_terms(F.coalesce(F.col(text), F.lit("")))))
