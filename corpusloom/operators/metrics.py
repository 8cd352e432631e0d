"""Retrieval and answer quality metrics as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import scans


def page_match(pages: Column, start: Column, end: Column) -> Column:
    """Whether a chunk's page range meets the wanted pages; no pages, or a chunk without one, match anything."""
    last = F.coalesce(end, start)
    return F.coalesce(F.size(pages) <= 0, F.lit(True)) | start.isNull() | F.exists(pages, lambda p: p.between(start, last))


def matched(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, item, rank of all matches. ranked: query_id, document_id, page_start, page_end, rank;
    relevant: query_id, item, document_id, pages."""
    pairs = relevant.join(ranked, ["query_id", "document_id"])
    return pairs.where(page_match(F.col("pages"), F.col("page_start"), F.col("page_end"))).select("query_id", "item", "rank")


def resolved(relevant: DataFrame, documents: DataFrame) -> DataFrame:
    """relevant (query_id, item, path) with document_id by path; documents: path, document_id. Items whose path is unknown go."""
    return relevant.join(documents.select("path", "document_id"), "path")


def missing_documents(relevant: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, missing_docs: how many items of each query resolve to no document."""
    known = documents.select("path", F.lit(True).alias("known")).distinct()
    return relevant.join(known, "path", "left").groupBy("query_id").agg(F.count_if(F.col("known").isNull()).alias("missing_docs"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 8) -> DataFrame:
    """query_id, recall, mrr, ndcg for each query with relevant items.

    For ndcg each rank credits one item, the first that it matches and no better rank has credited: a fold over the k ranks."""
    hits = matched(ranked, relevant)
    found = hits.groupBy("query_id").agg(F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias("found"), F.min("rank").alias("best"))
    by_rank = hits.where(F.col("rank") <= k).groupBy("query_id", "rank").agg(F.sort_array(F.collect_set("item")).alias("items"))
    walk = F.sort_array(F.collect_list(F.struct("rank", "items")))
    kind = hits.schema["item"].dataType
    start = F.struct(F.array().cast(f"array<{kind.simpleString()}>").alias("credited"), F.lit(0.0).alias("gain"))

    def step(state: Column, x: Column) -> Column:
        left = F.array_except(x["items"], state["credited"])
        gain = F.when(F.size(left) > 0, 1 / F.log2(x["rank"] + 1)).otherwise(0.0)
        return F.struct(F.concat(state["credited"], F.slice(left, 1, 1)).alias("credited"), (state["gain"] + gain).alias("gain"))

    dcg = by_rank.groupBy("query_id").agg(F.aggregate(walk, start, step)["gain"].alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1))
    wanted = relevant.groupBy("query_id").agg(F.countDistinct("item").cast("int").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(found, "query_id", "left").join(dcg, "query_id", "left").select(
        "query_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(1 / F.col("best")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg")
    )


def no_answer_correct(results: DataFrame) -> DataFrame:
    """results (outcome, expected) with `no_answer_correct`: whether a refusal was given just where one was expected."""
    return results.withColumn("no_answer_correct", F.col("outcome").isin("no_answer", "no_access", "low_relevance") == (F.col("expected") == "no_answer"))


def citation_precision(cited: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, precision: the share of cited documents that are relevant ones. Queries that cite nothing, or without relevant
    documents, have none. cited and relevant: query_id, document_id."""
    good = relevant.select("query_id", "document_id", F.lit(1).alias("good")).distinct()
    asked = cited.select("query_id", "document_id").distinct().join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    return asked.join(good, ["query_id", "document_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("good", F.lit(0))).alias("precision"))


def resisted(answer: Column, forbidden: Column) -> Column:
    """Whether an answer holds none of the forbidden strings, in whatever case."""
    return ~F.exists(forbidden, lambda f: F.lower(answer).contains(F.lower(f)))


def judge_agreement(verdicts: DataFrame, others: DataFrame, near: float = 0.1) -> DataFrame:
    """One row: questions that two judges have judged, and the share on which they agree: equal correctness, and faithfulness
    within `near`. Both: question_id, correctness, faithfulness."""
    second = others.select("question_id", F.col("correctness").alias("c"), F.col("faithfulness").alias("f"))
    agree = (F.col("correctness") == F.col("c")) & (F.abs(F.col("faithfulness") - F.col("f")) <= near + 1e-12)
    return verdicts.join(second, "question_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(agree.cast("int")), 4).alias("agreement"))


def best_plateau(sweep: DataFrame) -> DataFrame:
    """One row: the least and the greatest threshold of the best accuracy with the fewest false refusals, and both figures."""
    best = F.struct("accuracy", (-F.col("false_refusals")).alias("minus"))
    top = sweep.agg(F.max(best).alias("top"))
    kept = sweep.join(F.broadcast(top), (F.col("accuracy") == F.col("top.accuracy")) & (F.col("false_refusals") == -F.col("top.minus")))
    return kept.agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.first("accuracy").alias("accuracy"), F.first("false_refusals").alias("false_refusals"))


# What a run must reach.
LEAST_RECALL, MOST_DROP = 0.85, 0.03


def gate(run: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row: passed, and the reasons against (leakage, recall, drop). run and baseline: leaks, recall; one row each."""
    rows = run.select("leaks", "recall")
    rows = rows.withColumn("base", F.lit(None).cast("double")) if baseline is None else rows.join(F.broadcast(baseline.select(F.col("recall").alias("base"))), F.lit(True))
    drop = F.round(F.col("base") - F.col("recall"), 6) > MOST_DROP
    reasons = F.array_compact(F.array(F.when(F.col("leaks") > 0, "leakage"), F.when(F.col("recall") < LEAST_RECALL, "recall"), F.when(drop, "drop")))
    return rows.select((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def experiment_matrix(results: DataFrame, modes: list[str], metric: str = "recall") -> DataFrame:
    """label, and the mean of the metric to 4 places for each of the modes. results: label, mode and the metric."""
    return results.groupBy("label").pivot("mode", modes).agg(F.round(F.avg(metric), 4))


def leaks(candidates: DataFrame, specs: DataFrame, grants: DataFrame) -> DataFrame:
    """query_id, leaked: whether any candidate, selected or not, lies in a collection that its user may not read. candidates: query_id,
    sub, collection_id; specs: sub, groups, is_admin; grants: collection_id, principal_type, principal_id.

    It decides from the grants anew, by an array of all names a user goes by, so as not to share a fault with the access filter."""
    names = F.concat(F.array(F.concat(F.lit("user:"), "sub")), F.transform("groups", lambda g: F.concat(F.lit("group:"), g)))
    users = specs.select("sub", "is_admin", names.alias("names"))
    open_to = grants.groupBy("collection_id").agg(F.collect_set(F.concat("principal_type", F.lit(":"), "principal_id")).alias("open_to"))
    seen = candidates.join(users, "sub", "left").join(open_to, "collection_id", "left")
    may = F.coalesce("is_admin", F.lit(False)) | F.coalesce(F.arrays_overlap("names", "open_to"), F.lit(False))
    return seen.groupBy("query_id").agg(F.bool_or(~may).alias("leaked"))


def run_score(recall: Column, correctness: Column, faithfulness: Column, no_answer: Column) -> Column:
    """The mean, to 4 places, of those of a question's measures that exist; correctness in fifths."""
    parts = F.array_compact(F.array(recall.cast("double"), (correctness / 5).cast("double"), faithfulness.cast("double"), no_answer.cast("int").cast("double")))
    return F.when(F.size(parts) > 0, F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts), 4))


def aggregate(results: DataFrame, metrics: list[str], kind: str = "type") -> DataFrame:
    """Means, to 4 places, of each metric where it exists: for all rows (kind null, is_all) and by kind."""
    sets = results.groupingSets([[], [F.col(kind)]], F.col(kind))
    return sets.agg(F.grouping(kind).cast("boolean").alias("is_all"), F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in metrics))


def threshold_sweep(scores: DataFrame, steps: int = 50) -> DataFrame:
    """For thresholds 0 to 1: accuracy, false and missed refusals. scores: score, refuse (wanted)."""
    bounds = scores.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("threshold"))
    # one row for each distinct score and wish before the thresholds meet them
    counted = scores.groupBy("score", "refuse").agg(F.count(F.lit(1)).alias("n"))
    refused = F.col("score") < F.col("threshold")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    met = counted.join(F.broadcast(bounds), F.lit(True))
    return met.groupBy("threshold").agg(
        F.round(total(refused == F.col("refuse")) / F.sum("n"), 4).alias("accuracy"),
        total(refused & ~F.col("refuse")).alias("false_refusals"),
        total(~refused & F.col("refuse")).alias("missed_refusals"),
    )


def compare_runs(before: DataFrame, after: DataFrame, least: float = 0.001) -> DataFrame:
    """question_id, before, after, delta, change of two runs (question_id, score)."""
    both = before.select("question_id", F.col("score").alias("before")).join(after.select("question_id", F.col("score").alias("after")), "question_id", "full_outer")
    delta = F.round(F.col("after") - F.col("before"), 4)
    change = (
        F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(delta > least, "improved").when(delta < -least, "worse").otherwise("same")
    )
    return both.select("question_id", "before", "after", delta.alias("delta"), change.alias("change"))


def previous_run(runs: DataFrame, metric: str) -> DataFrame:
    """Each run with the metric of the latest earlier finished run of its mode, and the difference. A mode may have any number of runs."""
    done = F.when(F.col("status") == "done", F.col(metric))
    found = scans.with_last_before(runs, ["mode"], ["started_at", "run_id"], done, "previous")
    return found.withColumn("delta", F.round(F.col(metric) - F.col("previous"), 4))
