"""A search request as a plan: which lists are made, what is fused, checked again, ranked and returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval
from corpusloom.sources import tables

MODES = ("vector", "lexical", "hybrid")
# Names of what a request had to do without.
NO_EMBEDDING, NO_RERANK = "embedding_unavailable", "rerank_unavailable"


def by_models(questions: DataFrame, vectors: DataFrame, allowed: DataFrame, models: DataFrame, k: int = 40) -> DataFrame:
    """The k best chunks over collections with different embedding models: query_id, chunk_id, score, rank.

    questions: query_id, sub, model, embedding, a row for each model; models: collection_id, model. A vector counts only under
    the model that its collection has now. Scores of all models are ranked together."""
    current = vectors.join(models.select("collection_id", "model"), ["collection_id", "model"], "left_semi")
    return retrieval.vector(questions, current, allowed, k)


def lists(mode: str, by_vector: DataFrame, by_terms: DataFrame, embedding: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """The lists that a mode uses, the others without rows, and what the request has to do without. Without question vectors
    the vector list is empty and a vector request searches by terms."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    degraded = [] if embedding or mode == "lexical" else [NO_EMBEDDING]
    use_vector = mode != "lexical" and embedding
    use_terms = mode != "vector" or not embedding
    return by_vector if use_vector else by_vector.limit(0), by_terms if use_terms else by_terms.limit(0), degraded


def hydrated(candidates: DataFrame, chunks: DataFrame, documents: DataFrame, questions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Fused candidates (query_id, chunk_id, ...) with what is shown of them, without those of deleted documents, and, as a second
    guard behind the access filter, without those of collections that the user may not read. The cut to the fused number came
    before, so fewer may be left. chunks: chunk_id, document_id, collection_id, text; documents: document_id, title, status;
    questions: query_id, sub, question; allowed: sub, collection_id."""
    wanted = chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi")
    there = documents.where("status <> 'deleted'").select("document_id", "title")
    rows = candidates.join(wanted.select("chunk_id", "document_id", "collection_id", "text"), "chunk_id").join(there, "document_id").join(questions.select("query_id", "sub", "question"), "query_id")
    return rows.join(allowed.select("sub", "collection_id").distinct(), ["sub", "collection_id"], "left_semi")


def response(rows: DataFrame, degraded: list[str], rerank: bool = True, k: int = 8) -> DataFrame:
    """The first k hits of each query: query_id, rank (from 1), chunk_id, document_id, title, snippet, the rank and score of each list,
    rrf, rerank_score (null without a reranker, which leaves the fused order), candidates (their number) and degraded."""
    found = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    if rerank:
        terms = rows.withColumns({"question_terms": T.content_terms(F.col("question")), "passage_terms": T.content_terms(F.col("text"))})
        ranked = retrieval.reranked(terms).withColumn("place", F.col("rerank_rank"))
    else:
        ranked = rows.withColumns({"rerank_score": F.lit(None).cast("double"), "place": F.col("rank")})
    named: Column = F.array(*map(F.lit, degraded + ([] if rerank else [NO_RERANK]))).cast("array<string>")
    # documents may have gone: places are counted anew
    first = retrieval.best(ranked.withColumn("__minus", -F.col("place")).drop("rank"), k, "__minus").join(found, "query_id")
    question_terms = F.array_distinct(T.tokens(F.col("question")))
    return first.select(
        "query_id", "rank", "chunk_id", "document_id", "title", T.highlight(F.col("text"), question_terms).alias("snippet"), "vector_rank", "vector_score", "lexical_rank", "lexical_score",
        "rrf", "rerank_score", "candidates", named.alias("degraded"),
    )


def searched(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, allowed: DataFrame, mode: str = "hybrid", embedding: bool = True, rerank: bool = True, k: int = 8) -> DataFrame:
    """The whole request for a set of questions (query_id, sub, question, model, embedding): see response()."""
    by_vector = retrieval.vector(questions, vectors, allowed)
    by_terms = retrieval.lexical(questions, chunks, allowed)
    a, b, degraded = lists(mode, by_vector, by_terms, embedding)
    first = tables.settled(retrieval.fused(a, b), "fused")  # read for texts, counts and places
    return response(hydrated(first, chunks, documents, questions, allowed), degraded, rerank, k)
