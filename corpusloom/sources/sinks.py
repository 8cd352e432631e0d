"""What is written: chunks, query logs with their answers, and reports, by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import lifecycle
from corpusloom.sources import snapshots


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows in place of the partitions that they have values of; other partitions stay. Spark writes to a staging folder
    first and moves whole partitions, so that a lost executor leaves nothing half written."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def swap_chunks(rows: DataFrame, path: str) -> None:
    """The chunks of whole collections (collection_id), in place of those collections' former ones. rows must not be read from path
    itself, and there is one writer: swap_documents() is for all else."""
    replace_partitions(rows.repartition("collection_id", "doc_id"), path, "collection_id")


def swap_documents(rows: DataFrame, path: str, model: str) -> int:
    """Swaps the chunks of a table of snapshots (see snapshots.py): documents whose staged rows (of lifecycle.staged(), embedded) are
    complete get these in one commit, all others keep what they have. The new version."""
    ready = lifecycle.remaining(rows).where("remaining = 0").select("doc_id")
    new = rows.select("doc_id", "ordinal", "content_hash", "text", F.lit(model).alias("model"), "embedding")
    return snapshots.replace(rows.sparkSession, path, ready, new)


def append_logs(logs: DataFrame, path: str) -> None:
    """Query logs (created_at and whatever else), appended by day."""
    logs.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def log_rows(answers: DataFrame, allowed: DataFrame, candidates: DataFrame) -> DataFrame:
    """What is logged of answers (query_id, sub, question, outcome, input_tokens, output_tokens, cost, created_at): with all
    collections that the user may read, whatever the request was narrowed to, and the trace of candidates (query_id,
    rank, chunk_id, rrf, selected) in order."""
    may = allowed.groupBy("sub").agg(F.array_sort(F.collect_set("collection_id")).alias("allowed_collections"))
    shown = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "rrf", "selected"))).alias("retrieved"))
    return answers.join(may, "sub", "left").join(shown, "query_id", "left")


def store_report(results: DataFrame, path: str) -> None:
    """A run's results (run_id, ...) in place of that run's former ones."""
    replace_partitions(results, path, "run_id")


def markdown_report(metrics: dict[str, float | None], baseline: dict[str, float | None] | None = None, percent: tuple[str, ...] = ()) -> str:
    """A table of a run's figures, with the difference to a baseline where both exist: points for percentages."""
    head = ["metric", "value", *(["change"] if baseline is not None else [])]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for name, value in metrics.items():
        shown = "-" if value is None else f"{value * 100:.1f} %" if name in percent else f"{value:.3f}"
        before = (baseline or {}).get(name)
        change = "-" if value is None or before is None else f"{(value - before) * 100:+.1f} pp" if name in percent else f"{value - before:+.3f}"
        lines.append("| " + " | ".join([name, shown, *([change] if baseline is not None else [])]) + " |")
    return "\n".join(lines) + "\n"
