"""Analytics, limits and evaluation over domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import analytics, listings, metrics

from . import domain as D
from .search_queries import VECTOR_SQL, readable, vector_questions, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def put(f):  # type: ignore[no-untyped-def]
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts BETWEEN (SELECT max(ts) - INTERVAL 7 DAY FROM events) AND (SELECT max(ts) FROM events)")
def r1_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = D.logs(spark, sf_dir)
    end = logs.agg(F.max("created_at").alias("end"))
    inside = logs.join(F.broadcast(end), analytics.in_window(F.col("created_at"), F.col("end") - F.expr("INTERVAL 7 DAYS"), F.col("end")))
    return inside.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").cast("timestamp_ntz").alias("first"), F.max("created_at").cast("timestamp_ntz").alias("last"))


@query(f"""
WITH {D.LOGS_SQL}
SELECT count(*) AS questions, count(DISTINCT user_sub) AS users, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'no_answer') AS no_answer,
  count(*) FILTER (outcome = 'error') AS errors, CAST(round(CAST(count(*) FILTER (outcome = 'no_answer') / count(*) AS DECIMAL(18,6)), 4) AS DOUBLE) AS no_answer_rate, CAST(round(CAST(sum(cost_usd) AS DECIMAL(18,6)), 4) AS DOUBLE) AS cost_usd,
  CAST(round(CAST(sum(cost_usd) / count(*) AS DECIMAL(18,6)), 6) AS DOUBLE) AS cost_per_question, CAST(round(CAST(quantile_cont(total, 0.5) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p50_total, CAST(round(CAST(quantile_cont(total, 0.95) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p95_total,
  CAST(round(CAST(quantile_cont(first_token, 0.5) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p50_first_token, CAST(round(CAST(quantile_cont(first_token, 0.95) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p95_first_token FROM logs
""")
def r2_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overview(D.logs(spark, sf_dir))


@query("SELECT count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality = 0) AS down FROM labels")
def r3_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("up"), F.count_if(F.col("quality") == 0).alias("down"))


@query(f"""
WITH {D.LOGS_SQL}
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS questions, count(DISTINCT user_sub) AS users, count(*) FILTER (outcome = 'no_answer') AS no_answer,
  CAST(round(CAST(quantile_cont(total, 0.95) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p95_total, CAST(round(CAST(sum(cost_usd) AS DECIMAL(18,6)), 4) AS DOUBLE) AS cost_usd FROM logs GROUP BY 1
""")
def r4_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily(D.logs(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""
WITH {D.LOGS_SQL}, steps AS (SELECT 'total' AS step, total AS ms FROM logs UNION ALL SELECT 'first_token', first_token FROM logs)
SELECT step, count(*) AS n, CAST(round(CAST(quantile_cont(ms, 0.5) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p50, CAST(round(CAST(quantile_cont(ms, 0.95) AS DECIMAL(18,6)), 2) AS DOUBLE) AS p95 FROM steps GROUP BY step
""")
def r5_step_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.steps(D.logs(spark, sf_dir))


@query("""
SELECT l.doc_id, d.source, d.lang, e.n FROM labels l JOIN documents d USING (doc_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = l.doc_id
WHERE l.quality = 0 AND l.doc_id < 500 ORDER BY l.doc_id DESC LIMIT 50
""")
def r7_negative_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, docs = D.table(spark, sf_dir, "labels"), D.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    logs = D.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    down = rated.where("quality = 0").select("doc_id").join(docs, "doc_id").join(logs, "doc_id", "left")
    return analytics.page(down, [F.desc("doc_id")], F.col("doc_id") < 500, 49)


@query("SELECT event_id, user_id AS user_sub FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 21")
def r8_query_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = D.logs(spark, sf_dir).where("outcome = 'error'")
    return analytics.page(errors, [F.desc("created_at"), F.desc("event_id")], None, 20).select("event_id", "user_sub")


@query("SELECT source AS collection_id, count(*) AS total, count(*) FILTER (lang = 'en') AS ready FROM documents GROUP BY 1")
def r13_collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("collection_id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("ready"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND source ILIKE '%C1%' AND (n_chars, doc_id) < (2000, 500) ORDER BY n_chars DESC, doc_id DESC LIMIT 26")
def r14_document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("source").ilike("%C1%"))
    after = (F.col("n_chars") < 2000) | ((F.col("n_chars") == 2000) & (F.col("doc_id") < 500))
    return analytics.page(docs, [F.desc("n_chars"), F.desc("doc_id")], after, 25).select("doc_id", "source")


@query(f"""
WITH {D.CHUNKS_SQL}
SELECT document_id, count(*) AS chunks, coalesce(sum(greatest(1, round_even(length(text) / 4.0, 0)::INTEGER)), 0)::BIGINT AS tokens FROM chunks GROUP BY 1
""")
def r15_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import approx_tokens

    c = D.chunks(spark, sf_dir)
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(approx_tokens(F.col("text"))), F.lit(0)).alias("tokens"))


@query("""
WITH c AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents WHERE doc_id = 7)
SELECT ordinal::INTEGER AS ordinal, text FROM c WHERE trim(text) <> '' AND ordinal > 2 ORDER BY ordinal LIMIT 11
""")
def r16_chunk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir).where("document_id = 7")
    return analytics.page(c, [F.col("ordinal")], F.col("ordinal") > 2, 10).select("ordinal", "text")


@query("""
SELECT user_id AS user_sub, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY 1, 2
""")
def r20_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("at"), "event_id")
    return analytics.latest(e, ["user_id", "event_type"], [F.desc("at"), F.desc("event_id")]).select(F.col("user_id").alias("user_sub"), "event_type", "value", "at")


@query("""
WITH t AS (SELECT conv_id, turn, role || ': ' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 600) AS line,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM t WHERE back <= 6 GROUP BY 1
""")
def g1_conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.last_turns(D.table(spark, sf_dir, "conversations"))


@query("""
SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) > 20 AS refused FROM events GROUP BY 1, 2
""")
def w3_minute_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.streaming.limits import minute_counts

    e = D.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return minute_counts(e).select("user_id", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n", "refused")


@query("""
SELECT event_id, user_id, round(used, 4) AS used, used - value >= 150 AS refused FROM (
  SELECT event_id, user_id, value, sum(value) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS used FROM events)
""")
def w4_daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.streaming.limits import running_budget

    e = D.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    used = listings.refused_beyond(running_budget(e), 150, F.col("used"))
    return used.select("event_id", "user_id", F.round("used", 4).alias("used"), "refused")


@query("""
SELECT event_type, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1
""")
def w5_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram(D.table(spark, sf_dir, "events"), "value", [1, 10, 100], "event_type")


# a counter of each event type that begins again after five hundred events of all types
@query("""
WITH s AS (SELECT event_type, event_id, ts, CAST(event_id % 500 AS DOUBLE) AS value FROM events),
p AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM s),
i AS (SELECT event_type, ts, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS increase FROM p),
w AS (SELECT event_type, increase, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM i, range(4) r(k))
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, round(sum(increase), 6) AS increase, round(sum(increase) / 3600, 9) AS rate FROM w GROUP BY ALL
""")
def w6_counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counters gain in an hour, every quarter of an hour, over resets."""
    e = D.table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("sample_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 500).cast("double").alias("value"))
    found = analytics.counter_rates(e, ["event_type"], "1 hour", "15 minutes", 3600)
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("increase", 6).alias("increase"), F.round("rate", 9).alias("rate"))


EDGES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query("""
WITH e AS (SELECT event_type AS step, user_id % 3 AS route, value, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM events, range(4) r(k)),
b AS (SELECT step, route, start, unnest([1.0, 5, 10, 25, 50, 100, 'inf'::DOUBLE]::DOUBLE[]) AS le, value FROM e),
c AS (SELECT step, route, start, le, CAST(count(*) FILTER (value <= le) AS DOUBLE) / 86400 AS rate FROM b GROUP BY ALL),
n AS (SELECT *, max(rate) OVER g AS total, lag(le, 1, 0) OVER (g ORDER BY le) AS low, lag(rate, 1, 0) OVER (g ORDER BY le) AS below FROM c WINDOW g AS (PARTITION BY step, route, start)),
h AS (SELECT step, route, start, first(low ORDER BY le) AS low, first(le ORDER BY le) AS le, first(below ORDER BY le) AS below, first(rate ORDER BY le) AS rate, first(total) AS total FROM n WHERE rate >= 0.95::DOUBLE * total GROUP BY ALL)
SELECT step, route, strftime(start, '%Y-%m-%d %H:%M') AS start, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - below) / (rate - below) END, 6) AS quantile FROM h
""")
def w6_step_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.95 quantile of a day's values by step and route, every six hours, from bucket rates."""
    e = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), (F.col("user_id") % 3).alias("route"), F.col("ts").cast("timestamp").alias("ts"), "value")
    counted = e.groupBy("step", "route", F.window("ts", "1 day", "6 hours").start.alias("start")).agg(F.count_if(F.lit(True)).alias("n"), *(F.count_if(F.col("value") <= x).alias(f"le_{k}") for k, x in enumerate(EDGES)))
    rates = counted.select("step", "route", "start", F.explode(F.arrays_zip(F.array(*map(F.lit, [*EDGES, float("inf")])).alias("le"), F.array(*(F.col(f"le_{k}") for k in range(len(EDGES))), "n").alias("c"))).alias("x"))
    rows = rates.select("step", "route", "start", F.col("x.le").alias("le"), (F.col("x.c").cast("double") / 86400).alias("rate"))
    return analytics.bucket_quantile(rows, ["step", "route", "start"], 0.95).select("step", "route", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("quantile", 6).alias("quantile"))


# ranked vectors judged by their labels: an item is a label's first three vectors
EVAL_SQL = f"""{VECTOR_SQL},
relevant AS (SELECT q.query_id, v.chunk_id AS item, v.chunk_id AS document_id, CASE WHEN v.chunk_id % 3 = 0 THEN NULL ELSE [v.chunk_id % 5] END AS pages
             FROM q JOIN v ON v.collection_id = (SELECT collection_id FROM v w WHERE w.chunk_id = q.query_id) AND v.chunk_id % 7 = 0),
ranked AS (SELECT query_id, chunk_id AS document_id, CASE WHEN chunk_id % 11 = 0 THEN NULL ELSE chunk_id % 4 END AS page_start, chunk_id % 4 + 1 AS page_end, rank FROM vector),
hits AS (SELECT r.query_id, item, min(rank) AS rank FROM relevant r JOIN ranked k USING (query_id, document_id)
         WHERE pages IS NULL OR page_start IS NULL OR len(list_filter(pages, lambda p: p BETWEEN page_start AND page_end)) > 0 GROUP BY ALL)"""


@query(f"""
WITH {EVAL_SQL}, n AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1),
got AS (SELECT query_id, count(*) FILTER (rank <= 8) AS found, min(rank) AS best, sum(CASE WHEN rank <= 8 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY 1)
SELECT query_id, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / best, 0), 6) AS mrr,
       round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 8) + 1), lambda p: 1 / log2(p + 1))), 0), 6) AS ndcg
FROM n LEFT JOIN got USING (query_id)
""")
def e3_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import retrieval

    q, v = vector_questions(spark, sf_dir), vectors(spark, sf_dir)
    found = retrieval.vector(q, v, readable(spark))
    i = F.col("chunk_id")
    ranked = found.select("query_id", i.alias("document_id"), F.when(i % 11 == 0, None).otherwise(i % 4).alias("page_start"), (i % 4 + 1).alias("page_end"), "rank")
    own = q.select("query_id").join(v.select(i.alias("query_id"), "collection_id"), "query_id")
    pages = F.when(i % 3 == 0, None).otherwise(F.array(i % 5))
    relevant = own.join(v.where("chunk_id % 7 = 0").select("chunk_id", "collection_id"), "collection_id").select("query_id", i.alias("item"), i.alias("document_id"), pages.alias("pages"))
    out = metrics.retrieval_metrics(ranked, relevant)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("""
SELECT CASE WHEN grouping(lang) = 1 THEN NULL ELSE lang END AS type, grouping(lang) = 1 AS is_all, count(*) AS n, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))
""")
def e18_aggregate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type")).join(D.table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.aggregate(rows, ["quality", "toxic"])


@query("""
WITH s AS (SELECT value / 1000 AS score, event_type = 'error' AS refuse FROM events), t AS (SELECT i / 50.0::DOUBLE AS threshold FROM range(51) r(i))
SELECT threshold, round(avg(CASE WHEN (score < threshold) = refuse THEN 1 ELSE 0 END), 4) AS accuracy, count(*) FILTER (score < threshold AND NOT refuse) AS false_refusals,
       count(*) FILTER (score >= threshold AND refuse) AS missed_refusals FROM s, t GROUP BY threshold
""")
def e19_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = D.table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("score"), (F.col("event_type") == "error").alias("refuse"))
    return metrics.threshold_sweep(scores)


RUNS = """a AS (SELECT doc_id AS question_id, quality / 2.0::DOUBLE AS score FROM labels WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id AS question_id, toxic / 2.0::DOUBLE AS score FROM labels WHERE doc_id % 4 <> 0)"""


@query(f"""
WITH {RUNS}
SELECT question_id, a.score AS before, b.score AS after, round(b.score - a.score, 4) AS delta,
  CASE WHEN a.score IS NULL THEN 'new' WHEN b.score IS NULL THEN 'removed' WHEN b.score - a.score > 0.001 THEN 'improved' WHEN b.score - a.score < -0.001 THEN 'worse' ELSE 'same' END AS change
FROM a FULL JOIN b USING (question_id)
""")
def e21_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "labels")
    a = rows.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("question_id"), (F.col("quality") / 2).alias("score"))
    b = rows.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("question_id"), (F.col("toxic") / 2).alias("score"))
    return metrics.compare_runs(a, b)


@query("""
WITH r AS (SELECT event_id AS run_id, event_type AS mode, ts AS started_at, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, value AS recall FROM events),
p AS (SELECT *, last_value(CASE WHEN status = 'done' THEN recall END IGNORE NULLS) OVER (PARTITION BY mode ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r)
SELECT run_id, previous, round(recall - previous, 4) AS delta FROM p
""")
def e22_previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "failed").otherwise("done")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("mode"), F.col("ts").alias("started_at"), status.alias("status"), F.col("value").alias("recall"))
    return metrics.previous_run(runs, "recall").select("run_id", "previous", "delta")


