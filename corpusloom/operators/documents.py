"""Layout, schedules, clusters and views of documents, chunks and chat turns."""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def heading_levels(lines: DataFrame, factor: float = 1.15) -> DataFrame:
    """lines (doc_id, ordinal, size, text) with `level`: 1 to 3 for lines in a size well above the body's, shorter
    than 120 signs; else 0. The body's size is the one with most signs, of equals the larger."""
    weight = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("signs"))
    body = weight.groupBy("doc_id").agg(F.max_by("size", F.struct("signs", "size")).alias("body"))
    large = weight.join(body, "doc_id").where(F.col("size") >= F.col("body") * factor)
    ranked = large.select("doc_id", "size", F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))), F.lit(3)).alias("level"))
    level = F.when(F.length(F.trim("text")) < 120, F.coalesce("level", F.lit(0))).otherwise(0)
    return lines.join(ranked, ["doc_id", "size"], "left").withColumn("level", level)


def dehyphenated(parts: Column) -> Column:
    """Lines joined by spaces; one that begins with a small letter closes up to a hyphen before it."""
    def step(out: Column, line: Column) -> Column:
        closes = out.endswith("-") & line.rlike("^[a-z]")
        return F.when(out == "", line).when(closes, F.concat(out.substr(F.lit(1), F.length(out) - 1), line)).otherwise(F.concat(out, F.lit(" "), line))

    return F.aggregate(T.filled(parts), F.lit(""), step)


def too_little_text(lines: DataFrame) -> DataFrame:
    """doc_id of documents with fewer than 20 signs a page."""
    per = lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("signs"), F.max("page").alias("pages"))
    return per.where(F.col("signs") < 20 * F.col("pages")).select("doc_id")


def seeds(terms: list[list[str]], vectors: list[np.ndarray | None], likeness: float, similarity: float) -> list[int]:
    """For texts in order the place of the text that began each one's cluster.

    Term overlaps of all pairs are one matrix product. Clusters are rows of two arrays: the place of their first text, whose
    terms stand for them, and the running mean direction of their vectors, kept at unit length."""
    n = len(terms)
    number = {t: k for k, t in enumerate(dict.fromkeys(t for ts in terms for t in ts))}
    has = np.zeros((n, len(number)), np.float32)
    for i, ts in enumerate(terms):
        has[i, [number[t] for t in ts]] = 1
    shared, size = has @ has.T, has.sum(axis=1)
    alike = shared >= likeness * np.maximum(size[:, None] + size - shared, 1e-9)
    width = max((len(v) for v in vectors if v is not None), default=0)
    unit = np.zeros((n, width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            unit[i] = np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    placed = unit.any(axis=1)
    first, mean, members = np.zeros(n, np.int64), np.zeros((n, width)), np.zeros(n)
    out, k = [], 0
    for i in range(n):
        by_terms = np.flatnonzero(alike[i, first[:k]] & (shared[i, first[:k]] > 0))
        angles = mean[:k] @ unit[i] if placed[i] else np.zeros(0)
        if len(by_terms):
            c = int(by_terms[0])
        elif len(angles) and angles.max() >= similarity:
            c = int(angles.argmax())
        else:
            c, k = k, k + 1
            first[c], mean[c] = i, unit[i]
        if members[c] and placed[i] and mean[c].any():
            moved = mean[c] * members[c] + unit[i]
            mean[c] = moved / np.linalg.norm(moved)
        members[c] += 1
        out.append(int(first[c]))
    return out


def clusters(questions: DataFrame, likeness: float = 0.5, similarity: float = 0.72, most: int = 2000) -> DataFrame:
    """Unanswered questions in clusters: the newest `most`, newest first, each to the first cluster whose seed shares
    half of its terms, else to the one with the nearest mean vector, else to a new one. The order matters, so this
    assignment, of a bounded report, is one task; counts are Spark's. questions: id, user, question, at, terms, embedding
    (null: none)."""
    newest = questions.orderBy(F.desc("at"), F.desc("id")).limit(most)

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "id"], ascending=[False, False])
        place = seeds([list(t) for t in rows["terms"]], list(rows["embedding"]), likeness, similarity)
        label = rows["question"].to_numpy()[place]
        ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, " ".join(x.lower().split()))) for x in label]
        return pd.DataFrame({"cluster_id": ids, "seed": place, "label": label, "user": rows["user"].astype(str), "at": rows["at"]})

    found = newest.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(assign, "cluster_id string, seed int, label string, user string, at timestamp")
    return found.groupBy("cluster_id", "seed", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"), F.max("at").alias("last_seen")).drop("seed").orderBy(F.desc("n"), "label")


def source_block(sources: Column) -> Column:
    """Numbered, escaped sources (array of title, section, page, text) as one block."""
    page = lambda s: F.when(s["page"].isNotNull(), F.concat(F.lit(' page="'), s["page"].cast("string"), F.lit('"'))).otherwise("")
    one = lambda s, k: F.concat(
        F.lit('<source n="'), (k + 1).cast("string"), F.lit('" title="'), T.escape(s["title"]), F.lit('" section="'), T.escape(s["section"]), F.lit('"'), page(s),
        F.lit(">"), T.escape(s["text"]), F.lit("</source>"),
    )
    return F.array_join(F.concat(F.array(F.lit("<sources>")), F.transform(sources, one), F.array(F.lit("</sources>"))), "\n")


def document_view(chunks: DataFrame, longest: int = 20_000) -> DataFrame:
    """document_id, text, truncated: the chunks in order with blank lines between, cut off. A document is told to be
    truncated from `longest` signs of chunks on."""
    whole = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("c"), F.sum(F.length("text")).alias("size"))
    text = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    return whole.select("document_id", F.substring(text, 1, longest).alias("text"), ((F.col("size") >= longest) | (F.length(text) > longest)).alias("truncated"))


def highlight_phrase(text: Column, words: int = 8) -> Column:
    """The first words of the longest line's first sentence, Markdown signs and citations taken off; '' without a line."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s+", ""), "[*_`>|]", " "), r"\[\d+\]", " ")
    lines = F.filter(T.filled(F.transform(F.split(text, r"\n+"), lambda x: F.regexp_replace(bare(x), r"\s+", " "))), lambda x: ~x.rlike(r"^[-:\s]+$"))
    # the first of the longest
    longest = F.get(F.array_sort(F.transform(lines, lambda x, k: F.struct((-F.length(x)).alias("minus"), k.alias("k"), x.alias("x")))), F.lit(0))["x"]
    first = F.get(T.loose_sentences(longest), F.lit(0))
    return F.coalesce(F.regexp_replace(F.array_join(F.slice(F.split(first, " "), 1, words), " "), "[.,;:]+$", ""), F.lit(""))


def status_now(events: DataFrame) -> DataFrame:
    """doc_id, status: the latest status of each document; a deleted one stays deleted. events: doc_id, status, at, id."""
    last = F.max_by("status", F.struct("at", "id"))
    return events.groupBy("doc_id").agg(F.when(F.bool_or(F.col("status") == "deleted"), "deleted").otherwise(last).alias("status"))


CRON = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def cron_field(field: str, low: int, high: int) -> set[int] | None:
    """The values of one cron field; None if it isn't valid."""
    out: set[int] = set()
    for part in field.split(","):
        m = re.fullmatch(r"(\*|\d+)(?:-(\d+))?(?:/(\d+))?", part)
        if not m or (m[3] and int(m[3]) == 0):
            return None
        first = low if m[1] == "*" else int(m[1])
        last = high if m[1] == "*" or (m[3] and not m[2]) else int(m[2] or m[1])
        if not low <= first <= last <= high:
            return None
        out.update(range(first, last + 1, int(m[3] or 1)))
    return out


def is_due(schedule: str | None, last: pd.Timestamp | None, now: pd.Timestamp) -> bool:
    """Whether a valid five-field schedule fires after `last` and not after now; at once if never run."""
    fields = (schedule or "").split()
    sets = [cron_field(f, *r) for f, r in zip(fields, CRON)] if len(fields) == 5 else [None]
    if any(s is None for s in sets):
        return False
    if last is None or pd.isna(last):
        return True
    minute, hour, day, month, weekday = sets
    weekday = {d % 7 for d in weekday}
    either = fields[2] != "*" and fields[4] != "*"
    t = last.floor("min") + pd.Timedelta(minutes=1)
    for k in range(math.ceil((now - t) / pd.Timedelta(days=1)) + 1 if now >= t else 0):
        d = (t + pd.Timedelta(days=k)).normalize()
        on_day, on_week = d.day in day, (d.dayofweek + 1) % 7 in weekday
        if d.month in month and ((on_day or on_week) if either else (on_day and on_week)):
            if any(t <= d + pd.Timedelta(hours=h, minutes=m) <= now for h in hour for m in minute):
                return True
    return False


def due(sources: DataFrame, now: str) -> DataFrame:
    """Sources (id, kind, status, schedule, last) to sync now: not uploads, not under way, and due."""

    @F.pandas_udf("boolean")
    def fires(schedule: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([is_due(s, t, pd.Timestamp(now)) for s, t in zip(schedule, last)], dtype=bool)

    return sources.where((F.col("kind") != "upload") & (F.col("status") != "syncing")).where(fires("schedule", "last"))


def histogram_quantile(counts: Column, edges: list[float], q: float) -> Column:
    """The q-quantile from cumulative counts (array, one for each edge) by linear interpolation inside the bucket."""
    total = F.element_at(counts, -1)
    k = F.size(F.filter(counts, lambda c: c < q * total))
    low = F.when(k == 0, 0.0).otherwise(F.element_at(F.array(*map(F.lit, edges)), F.greatest(k, F.lit(1))))
    high = F.element_at(F.array(*map(F.lit, edges)), F.least(k + 1, F.lit(len(edges))))
    below = F.when(k == 0, F.lit(0).cast("long")).otherwise(F.element_at(counts, F.greatest(k, F.lit(1))))
    inside = F.element_at(counts, F.least(k + 1, F.lit(len(edges)))) - below
    return F.when(total > 0, low + (high - low) * F.when(inside > 0, (q * total - below) / inside).otherwise(0.0))
