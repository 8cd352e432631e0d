"""Listings: keyset pages, lookups and counts over documents, chunks, conversations, sources and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def visible_chunk(chunks: DataFrame, documents: DataFrame, allowed: DataFrame) -> DataFrame:
    """Chunks with their documents' titles, for each user (sub) that may read the collection, without deleted documents. chunks:
    chunk_id, document_id, text; documents: document_id, collection_id, title, status; allowed: sub, collection_id."""
    there = documents.where("status <> 'deleted'").select("document_id", "collection_id", "title")
    return chunks.join(there, "document_id").join(allowed.select("sub", "collection_id").distinct(), "collection_id").select("sub", "chunk_id", "document_id", "title", "text")


def own_page(rows: DataFrame, owner: str, search: str | None, after: tuple | None, size: int, at: str = "updated_at") -> DataFrame:
    """A page of an owner's rows (owner, title, id and a time), newest first: those whose title holds `search` in whatever case,
    wildcards of LIKE left out, behind the cursor (time, id), and one more to tell whether there is a next page."""
    mine = rows.where(F.col("owner") == owner)
    if search is not None:
        mine = mine.where(F.lower("title").contains(F.lower(T.like_free(F.lit(search)))))
    if after is not None:
        mine = mine.where((F.col(at) < F.lit(after[0])) | ((F.col(at) == F.lit(after[0])) & (F.col("id") < F.lit(after[1]))))
    return mine.orderBy(F.desc(at), F.desc("id")).limit(size + 1)


def with_own_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """messages (message_id) with the rating that the user gave, or null. feedback: message_id, user_sub, rating, for the
    user of the messages (user_sub); of several the last by created_at counts."""
    last = feedback.groupBy("message_id", "user_sub").agg(F.max_by("rating", "created_at").alias("rating"))
    return messages.join(last, ["message_id", "user_sub"], "left")


def source_counts(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """source_id, documents: how many documents, deleted ones aside, each source has; sources without any have 0."""
    n = documents.where("status <> 'deleted'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return sources.select("source_id").join(n, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("documents"))


def totals(documents: DataFrame) -> DataFrame:
    """One row: all documents, and how many are ready, failed and pending."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return documents.agg(F.count(F.lit(1)).alias("total"), n("ready").alias("ready"), n("failed").alias("failed"), n("queued", "parsing", "chunking", "embedding").alias("pending"))


def named_in_order(rows: DataFrame, ids: str, names: DataFrame, out: str = "names") -> DataFrame:
    """rows with the names of an array of ids, in its order; '' for an unknown id. names: id, name. rows need the key `log_id`."""
    each = rows.select("log_id", F.posexplode(ids).alias("place", "id")).join(names.select("id", "name"), "id", "left")
    again = each.groupBy("log_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("name", F.lit("")).alias("name")))), lambda x: x["name"]).alias(out))
    return rows.join(again, "log_id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def trace(logs: DataFrame, messages: DataFrame, collections: DataFrame) -> DataFrame:
    """Query logs (log_id, message_id, allowed array of collection ids) with the answer's text, if there is one, and the names of the
    collections. messages: message_id, content; collections: id, name."""
    said = logs.join(messages.select("message_id", F.col("content").alias("answer")), "message_id", "left")
    return named_in_order(said, "allowed", collections, "collections")


def names_of(allowed: DataFrame, collections: DataFrame) -> DataFrame:
    """sub, names: the names of the collections that each user may read, sorted. allowed: sub, collection_id; collections: id, name."""
    named = allowed.join(collections.select(F.col("id").alias("collection_id"), "name"), "collection_id")
    return named.groupBy("sub").agg(F.array_sort(F.collect_set("name")).alias("names"))


def too_soon(requests: DataFrame, rate: float, by: str = "host") -> DataFrame:
    """requests (at in seconds, id) with `too_soon`: whether a request comes sooner than 1 / rate seconds after the one
    before to the same host."""
    before = F.lag("at").over(Window.partitionBy(by).orderBy("at", "id"))
    return requests.withColumn("too_soon", F.coalesce(F.col("at") - before < 1.0 / rate, F.lit(False)))


def refused_beyond(usage: DataFrame, budget: float, used: Column) -> DataFrame:
    """usage with `refused`: whether the budget was used up before this row. used: what is used with it."""
    return usage.withColumn("refused", used - F.col("value") >= budget)
