"""The life of documents: registration, what to skip, staged chunks, swaps, jobs and removal, as joins of snapshots.

A table's next state is built as a whole from its present one and what has changed, and written by partition; readers see
one state or the other. Rows without a key (null) match nothing and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registered(known: DataFrame, given: DataFrame) -> DataFrame:
    """Documents (external_id, metadata map) after an upload: a known external id keeps its row, and of its metadata
    what the new ones name is theirs. status: created, updated or kept."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = known.select("external_id", F.col("metadata").alias("old"), F.lit(True).alias("was")).join(given.select("external_id", F.col("metadata").alias("new"), F.lit(True).alias("now")), "external_id", "full_outer")
    before, after = F.coalesce("old", none), F.coalesce("new", none)
    merged = F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k)), after)
    status = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "kept").otherwise("updated")
    return both.select("external_id", merged.alias("metadata"), status.alias("status"))


def to_ingest(documents: DataFrame, done: DataFrame, forced: bool = False) -> DataFrame:
    """documents (doc_id, content_identity) that need work: those whose identity isn't that of their last run, or whose last
    run failed. done: doc_id, content_identity, status. With `forced` all do."""
    good = done.where("status <> 'failed'").select("doc_id", "content_identity")
    return documents if forced else documents.join(good, ["doc_id", "content_identity"], "left_anti")


def to_reindex(documents: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """documents (collection_id) of collections whose chunking profile or embedding model has changed; before and after:
    collection_id, profile, model. Collections are few, documents many: the join keeps the documents where they are."""
    old = before.select("collection_id", F.struct("profile", "model").alias("old"))
    changed = after.join(old, "collection_id").where(~F.struct("profile", "model").eqNullSafe(F.col("old"))).select("collection_id")
    return documents.join(changed, "collection_id", "left_semi")


def staged(existing: DataFrame, drafts: DataFrame, model: str) -> DataFrame:
    """The next chunks of the documents in drafts: doc_id, ordinal, content_hash, text, embedding and state.

    existing: doc_id, ordinal, content_hash, model, embedding; drafts: doc_id, ordinal, content_hash, text. A chunk whose
    hash the document had under the same model takes over its embedding (`reused`); the others are `pending`."""
    text, embedding = F.lit(None).cast(drafts.schema["text"].dataType), F.lit(None).cast(existing.schema["embedding"].dataType)
    own = existing.where((F.col("model") == model) & F.col("doc_id").isNotNull() & F.col("content_hash").isNotNull())
    old = own.select("doc_id", "ordinal", "content_hash", text.alias("text"), "embedding", F.lit(True).alias("old"))
    new = drafts.select("doc_id", "ordinal", "content_hash", "text", embedding.alias("embedding"), F.lit(False).alias("old"))
    # one shuffle for both: the first old chunk of a hash comes before its drafts, of which the first takes over
    hash_ = Window.partitionBy("doc_id", "content_hash").orderBy(F.desc("old"), "ordinal")
    so_far = hash_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when(F.col("old"), F.struct("embedding"))).over(so_far)
    met = old.unionByName(new).withColumns({"first": first, "drafts": F.sum(F.when(F.col("old"), 0).otherwise(1)).over(so_far)})
    reused = F.col("first").isNotNull() & (F.col("drafts") == 1)
    state = F.when(reused, "reused").otherwise("pending")
    return met.where(~F.col("old")).select("doc_id", "ordinal", "content_hash", "text", F.when(reused, F.col("first.embedding")).alias("embedding"), state.alias("state"))


def embedded(rows: DataFrame, embed: Column) -> DataFrame:
    """staged() rows with an embedding for each pending one: `embed` is evaluated for these only, in Arrow batches if it is
    a Pandas UDF. Rows that have one keep it."""
    pending = F.col("state") == "pending"
    with_new = rows.where(pending).withColumn("embedding", embed).withColumn("state", F.when(F.col("embedding").isNotNull(), "new").otherwise("pending"))
    return rows.where(~pending).unionByName(with_new)


def remaining(rows: DataFrame) -> DataFrame:
    """doc_id, total, remaining: chunks of each document, and those neither reused nor embedded yet."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("state") != "reused") & F.col("embedding").isNull()).alias("remaining"))


def swapped(existing: DataFrame, rows: DataFrame, model: str) -> DataFrame:
    """All chunks after a swap: of documents with staged rows and none remaining the staged ones, of all others the
    existing ones. existing: doc_id, ordinal, content_hash, text, model, embedding. A document changes as a whole or not at all."""
    ready = remaining(rows).where("remaining = 0").select("doc_id")
    new = rows.join(ready, "doc_id", "left_semi").select("doc_id", "ordinal", "content_hash", "text", F.lit(model).alias("model"), "embedding")
    return existing.join(ready, "doc_id", "left_anti").select(*new.columns).unionByName(new)


def latest_job(jobs: DataFrame) -> DataFrame:
    """doc_id, job_id: the job of each document that started last; of equals the larger id."""
    return jobs.groupBy("doc_id").agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("job_id"))


def without_stale(rows: DataFrame, now: Column, age: str = "1 DAY") -> DataFrame:
    """Staged rows (created_at) but those older than `age`."""
    return rows.where(~(F.col("created_at") < now - F.expr(f"INTERVAL {age}")))


def with_timeouts(jobs: DataFrame, now: Column, age: str = "2 HOURS") -> DataFrame:
    """Jobs (status, started_at); running ones that began more than `age` ago have failed."""
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {age}"))
    return jobs.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def soft_deleted(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, external_id, status) and chunks (doc_id) once the documents in gone (doc_id) are deleted: their rows
    stay, under an external id that frees the old one, and their chunks go."""
    marked = documents.join(gone.select("doc_id", F.lit(True).alias("gone")).distinct(), "doc_id", "left")
    prefixed = F.concat(F.lit("deleted:"), F.col("doc_id").cast("string"), F.lit(":"), "external_id")
    kept = marked.withColumn("external_id", F.when(F.col("gone"), prefixed).otherwise(F.col("external_id"))).withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status")))
    return kept.drop("gone"), chunks.join(gone, "doc_id", "left_anti")


def cascaded(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def snapshot_plan(known: DataFrame, found: DataFrame) -> DataFrame:
    """url, action of a source that lists all its pages: known: url, etag, status (of the last fetch); found: url, etag, archived.

    A page is unchanged if its etag is the known one and the last fetch was good; an archived one is deleted, as is a page that
    was good and isn't listed any more; everything else is fetched. Pages that were bad and are gone need nothing (skipped)."""
    new = found.select("url", F.col("etag").alias("new_etag"), F.coalesce("archived", F.lit(False)).alias("archived"), F.lit(True).alias("listed"))
    both = known.join(new, "url", "full_outer")
    good = F.coalesce(F.col("status") == 200, F.lit(False))
    action = (
        F.when(F.col("listed").isNull(), F.when(good, "deleted").otherwise("skipped")).when(F.col("archived"), F.when(good, "deleted").otherwise("skipped"))
        .when(good & F.col("etag").eqNullSafe(F.col("new_etag")), "unchanged").otherwise("upsert")
    )
    return both.select("url", action.alias("action"))


def newest(rows: DataFrame, by: str, order: list[Column], most: int = 20) -> DataFrame:
    """The first `most` rows of each group, such as the last jobs of each source."""
    nth = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most).drop("nth")
