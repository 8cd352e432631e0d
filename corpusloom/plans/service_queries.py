"""Requests, chat turns, document states, sources and evaluation over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import analytics, answers, chat, lifecycle, listings, metrics, retrieval, search
from corpusloom.sources import files, parsers, sinks, snapshots, tables, web

from . import domain as D
from . import sqltext as S
from .analytics_queries import EVAL_SQL
from .ingest_queries import LINKS_SQL, SHORTER, VERSIONS_SQL
from .search_queries import LISTS_SQL, both_lists, fused_sql, passage_questions, passages, readable, vector_questions, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CITE = r"\[\d+(?:\s*,\s*\d+)*\]"


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def put(f):  # type: ignore[no-untyped-def]
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents")


# --- search requests


@query(f"""
WITH {LISTS_SQL}, empty AS (SELECT * FROM by_vector WHERE false), {fused_sql()}, {fused_sql("by_vector", "empty", "only_vector")}, {fused_sql("empty", "by_terms", "only_terms")},
modes AS (SELECT 'hybrid' AS mode, false AS lost, * FROM fused UNION ALL SELECT 'vector', false, * FROM only_vector UNION ALL SELECT 'lexical', false, * FROM only_terms
  UNION ALL SELECT 'vector', true, * FROM only_terms UNION ALL SELECT 'hybrid', true, * FROM only_terms)
SELECT mode, CASE WHEN lost THEN 'embedding_unavailable' ELSE '' END AS degraded, query_id, chunk_id, row_number() OVER (PARTITION BY mode, lost, query_id ORDER BY rrf DESC, chunk_id) AS rank FROM modes QUALIFY rank <= 20
""")
def m1_search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode, with question vectors and without."""
    a, b = both_lists(spark, sf_dir)
    out = []
    for mode, embedding in (("hybrid", True), ("vector", True), ("lexical", True), ("vector", False), ("hybrid", False)):
        x, y, degraded = search.lists(mode, a, b, embedding)
        out.append(retrieval.fused(x, y).select(F.lit(mode).alias("mode"), F.lit(",".join(degraded)).alias("degraded"), "query_id", "chunk_id", "rank"))
    return reduce(DataFrame.unionByName, out)


STATUS_SQL = "CASE WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'ready' END"


@query(f"""
WITH {LISTS_SQL}, {fused_sql()}, cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS place FROM fused QUALIFY place <= 20),
there AS (SELECT c.* FROM cut c JOIN documents d ON d.doc_id = c.chunk_id WHERE {STATUS_SQL} <> 'deleted')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, chunk_id, vector_rank, lexical_rank, count(*) OVER (PARTITION BY query_id) AS candidates, ['rerank_unavailable'] AS degraded
FROM there QUALIFY rank <= 8
""")
def q1_search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid request without a reranker; every thirteenth document is deleted."""
    status = F.when(F.col("doc_id") % 13 == 0, "deleted").otherwise("ready")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), status.alias("status"))
    p = passages(spark, sf_dir)
    found = search.searched(passage_questions(spark, sf_dir), p, p, docs, readable(spark), rerank=False)
    return found.select("query_id", "rank", "chunk_id", "vector_rank", "lexical_rank", "candidates", "degraded")


@query(f"""
WITH {D.READABLE_SQL},
v AS (SELECT vec_id AS chunk_id, 'src' || label AS collection_id, label % 2 AS model, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT chunk_id AS query_id, {D.USERS_SQL}[CAST(floor(chunk_id / 50) AS BIGINT) % {D.USERS} + 1] AS sub, m AS model, e FROM v, (VALUES (0), (1)) x(m) WHERE chunk_id % 50 = 0)
SELECT query_id, v.chunk_id, round(list_cosine_similarity(q.e, v.e), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.chunk_id) AS rank
FROM q JOIN readable r USING (sub) JOIN v ON v.model = q.model AND v.collection_id = r.collection_id AND v.collection_id NOT IN ('src3', 'src4') QUALIFY rank <= 40
""")
def v2_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections have moved to a third model: their old vectors don't count."""
    q = vector_questions(spark, sf_dir).drop("model").withColumn("model", F.explode(F.array(F.lit(0), F.lit(1))))
    v = vectors(spark, sf_dir)
    now = spark.range(10).select(F.concat(F.lit("src"), "id").alias("collection_id"), F.when(F.col("id").isin(3, 4), 2).otherwise(F.col("id") % 2).cast("int").alias("model"))
    return search.by_models(q, v, readable(spark), now).withColumn("score", F.round("score", 6))


@query(f"""
WITH {D.READABLE_SQL},
v AS (SELECT vec_id AS chunk_id, 'src' || label AS collection_id FROM embeddings),
q AS (SELECT chunk_id AS query_id, {D.USERS_SQL}[CAST(floor(chunk_id / 50) AS BIGINT) % {D.USERS} + 1] AS sub FROM v WHERE chunk_id % 50 = 0)
SELECT query_id, bool_or(r.sub IS NULL) AS leaked FROM q JOIN v ON v.chunk_id % 47 = q.query_id % 47 LEFT JOIN readable r ON r.sub = q.sub AND r.collection_id = v.collection_id GROUP BY query_id
""")
def e6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no access filter has seen: some lie in collections that their user may not read."""
    q, v = vector_questions(spark, sf_dir).select("query_id", "sub", (F.col("query_id") % 47).alias("k")), vectors(spark, sf_dir).select("collection_id", (F.col("chunk_id") % 47).alias("k"))
    return metrics.leaks(q.join(v, "k").select("query_id", "sub", "collection_id"), D.principals(spark), D.grants(spark))


# --- answers and chat turns


@query(f"""
SELECT doc_id, list_filter({S.filled("string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))")},
  lambda s: regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '{CITE}')) AS claims FROM documents
""")
def g12_numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", answers.numeric_claims(F.col("text")).alias("claims"))


CITING_SQL = "text || ' see [' || (doc_id % 7) || ', 2] and [2][' || (doc_id % 3) || ']'"


@query(f"""
SELECT doc_id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all({CITING_SQL}, '{CITE}'), lambda c: list_transform(regexp_extract_all(c, '[0-9]+'), lambda n: CAST(n AS INTEGER)))))) AS cited FROM documents
""")
def g13_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.lit(" see ["), F.col("doc_id") % 7, F.lit(", 2] and [2]["), F.col("doc_id") % 3, F.lit("]"))
    return documents(spark, sf_dir).select("doc_id", answers.cited(said).alias("cited"))


@query("""
WITH o AS (SELECT event_id, CASE WHEN floor(value) = 0 THEN 'no_access' WHEN value < 60 THEN 'low_relevance' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'stopped' ELSE 'complete' END AS outcome FROM events)
SELECT event_id, outcome, CASE WHEN outcome IN ('no_access', 'low_relevance') THEN 'no_answer' WHEN outcome = 'error' THEN 'error' ELSE 'answered' END AS logged FROM o
""")
def g15_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    out = chat.outcome(F.floor("value"), F.col("value") < 60, kind == "error", kind == "view")
    return D.table(spark, sf_dir, "events").select("event_id", out.alias("outcome")).withColumn("logged", chat.logged(F.col("outcome")))


@query("""
WITH x AS (SELECT o_orderkey, o_custkey % 3 AS model, CAST(sum(l_quantity) AS DECIMAL(14,0)) AS tokens_in, count(*) AS tokens_out FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
price(model, i, o) AS (VALUES (0, 0.25, 1.25), (1, 3.0, 15.0)),
m AS (SELECT o_orderkey, CAST(coalesce(tokens_in * i + tokens_out * o, 0) AS DECIMAL(20,4)) AS micro FROM x LEFT JOIN price USING (model))
SELECT o_orderkey, CASE WHEN micro - floor(micro) = 0.5 AND CAST(floor(micro) AS BIGINT) % 2 = 0 THEN floor(micro)::DOUBLE ELSE round(micro)::DOUBLE END / 1e6 AS cost FROM m
""")
def g6_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("model"))
    used = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("tokens_in"), F.count(F.lit(1)).alias("tokens_out"))
    prices = spark.createDataFrame([(0, 0.25, 1.25), (1, 3.0, 15.0)], "model long, input double, output double")
    return chat.with_cost(o.join(used, "o_orderkey"), prices).select("o_orderkey", F.col("cost").cast("double").alias("cost"))


BARE_SQL = "regexp_replace(w, '^[,.;:]+|[,.;:]+$', '', 'g')"


@query(f"""
WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user'),
c AS (SELECT *, trim(regexp_replace(regexp_replace(trim(text, ' '), '(?i)^(and|what about|how about|and what about|also|ok,?|so)\\s+', ''), '\\?+$', ''), ' ') AS core,
  len({S.content_terms("text")}) >= 5 AND NOT list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), {chat.PRONOUNS}) AS complete FROM u),
n AS (SELECT *, regexp_extract_all(core, '\\b[A-Z][A-Za-z0-9_-]*\\b') AS named, {S.filled("string_split_regex(regexp_replace(previous, '\\?+$', ''), '\\s+')")} AS words FROM c),
k AS (SELECT *, array_to_string(list_filter(words, lambda w, i: i = 1 OR len(named) = 0 OR NOT (regexp_matches({BARE_SQL}, '^\\p{{Lu}}') AND NOT list_contains(named, {BARE_SQL}))), ' ') AS base FROM n)
SELECT conv_id, turn, CASE WHEN complete OR coalesce(previous, '') = '' THEN text
  ELSE trim(regexp_replace(trim(regexp_replace(base, '\\b(in|for|at|of) the$', ''), ' '), '\\b(in|for|at|of)$', ''), ' ') || ' - ' || core || '?' END AS standalone FROM k
""")
def g2_standalone_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.with_previous(D.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "standalone")


PARTS_SQL = """parts AS (SELECT conv_id AS query_id, turn AS place, role || ' [' || (turn % 4) || '] says [1' || CASE WHEN turn % 2 = 0 THEN '' ELSE '] and' END AS text FROM conversations)"""


@query(f"""
WITH {PARTS_SQL}, ends AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY place) AS e FROM parts),
whole AS (SELECT query_id, string_agg(text, '' ORDER BY place) AS t FROM parts GROUP BY 1),
hits AS (SELECT query_id, CAST(n AS INTEGER) AS n, min(position('[' || n || ']' IN t) + length(n) + 1) AS e FROM whole, (SELECT unnest(['1', '2', '3']) AS n) WHERE contains(t, '[' || n || ']') GROUP BY ALL)
SELECT h.query_id, min(place) AS place, n FROM hits h JOIN ends p ON p.query_id = h.query_id AND p.e >= h.e GROUP BY ALL
""")
def g7_streamed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three sources in parts; some citations are cut between two parts."""
    end = F.when(F.col("turn") % 2 == 0, "").otherwise("] and")
    said = F.concat("role", F.lit(" ["), F.col("turn") % 4, F.lit("] says [1"), end)
    rows = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), said.alias("text"), F.lit(3).alias("n_sources"))
    return chat.citations_seen(rows)


@query("""
SELECT doc_id % 50 AS query_id, CAST(doc_id // 50 + 1 AS INTEGER) AS n, CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS document_id, 'Doc ' || doc_id AS title, source AS section, CAST(doc_id % 5 AS INTEGER) AS page,
  round(1.0::DOUBLE / (doc_id + 3), 6) AS score, left(text, 400) AS snippet FROM documents WHERE doc_id // 50 + 1 IN (1, 3, 4)
""")
def g8_citation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("doc_id")
    n = (F.floor(i / 50) + 1).cast("int")
    sources = d.select((i % 50).alias("query_id"), n.alias("n"), i.cast("string").alias("chunk_id"), i.alias("document_id"), F.concat(F.lit("Doc "), i).alias("title"), F.col("source").alias("section"), (i % 5).cast("int").alias("page"), (1.0 / (i + 3)).alias("score"), "text")
    return chat.citation_payload(sources, spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit(3), F.lit(1), F.lit(4), F.lit(1)).alias("cited")))


@query(f"""
WITH a AS (SELECT doc_id AS query_id, CASE doc_id % 5 WHEN 0 THEN 'low_relevance' WHEN 1 THEN 'error' WHEN 2 THEN 'stopped' ELSE 'complete' END AS outcome, text, doc_id FROM documents)
SELECT query_id, CASE WHEN outcome IN ('low_relevance', 'error') THEN '' ELSE text END AS text, CASE WHEN outcome IN ('low_relevance', 'error') THEN []::INTEGER[] ELSE [2, 1] END AS citations,
  CASE outcome WHEN 'low_relevance' THEN 'no_answer' WHEN 'error' THEN 'error' ELSE 'complete' END AS status FROM a
""")
def x5_answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers told as events and folded back into messages."""
    kind = F.element_at(F.array(*map(F.lit, ("low_relevance", "error", "stopped", "complete", "complete"))), (F.col("doc_id") % 5 + 1).cast("int"))
    parts = F.split(F.regexp_replace("text", "([ \n])", "$1\u0001"), "\u0001", -1)
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), kind.alias("outcome"), parts.alias("parts"), F.array(F.lit(2), F.lit(1), F.lit(2)).alias("cited"))
    return chat.messages(chat.answer_events(rows))


@query("SELECT doc_id, CASE WHEN doc_id % 40 < 20 + doc_id % 30 THEN substring(text, CAST(doc_id % 40 + 1 AS BIGINT), CAST(20 + doc_id % 30 - doc_id % 40 AS BIGINT)) ELSE '' END AS span FROM documents")
def x2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", chat.span(F.col("text"), (i % 40).cast("int"), (20 + i % 30).cast("int")).alias("span"))


@query("SELECT DISTINCT event_type, coalesce(list_position(['view', 'click', 'purchase'], event_type), 99)::INTEGER AS place FROM events")
def x6_step_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select("event_type", chat.step_place(F.col("event_type"), ("view", "click", "purchase")).alias("place")).distinct()


@query("""
WITH a AS (SELECT doc_id AS question_id, quality / 2.0::DOUBLE AS score FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS question_id, toxic / 2.0::DOUBLE AS score FROM labels WHERE doc_id % 4 <> 0)
SELECT question_id, lang AS type FROM a JOIN b USING (question_id) JOIN documents ON doc_id = question_id WHERE b.score - a.score < -0.001 AND lang = 'en'
""")
def x7_worse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .analytics_queries import e21_run_comparison

    types = documents(spark, sf_dir).select(F.col("doc_id").alias("question_id"), F.col("lang").alias("type"))
    return chat.compared(e21_run_comparison(spark, sf_dir).join(types, "question_id"), "en", "worse").select("question_id", "type")


# --- documents and chunks


IDENTITY_SQL = "sha256(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END)"


@query(f"SELECT doc_id FROM documents WHERE NOT (doc_id % 5 <> 0 AND {IDENTITY_SQL} = sha256(text) AND doc_id % 9 <> 0)")
def i1_documents_to_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    changed = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "!").otherwise(""))
    done = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("content_identity"), F.when(F.col("doc_id") % 9 == 0, "failed").otherwise("ready").alias("status"))
    return lifecycle.to_ingest(d.select("doc_id", F.sha2(changed, 256).alias("content_identity")), done).select("doc_id")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing chunks, of two embedding models, and the drafts of the next version."""
    c = D.chunks(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "ordinal", F.sha2("text", 256).alias("content_hash"), "text")
    model = F.when(F.col("doc_id") % 4 == 0, "old").otherwise("m")
    existing = c.where("ordinal % 5 <> 3").withColumns({"model": model, "embedding": F.array(F.length("text").cast("double"))})
    return existing, c.where("ordinal % 7 <> 2")


def staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing chunks, and drafts whose pending chunks are embedded but in every tenth document."""
    existing, drafts = versions(spark, sf_dir)
    rows = tables.settled(lifecycle.staged(existing, drafts, "m"), "staged")  # read for what is pending, reused and ready
    return existing, lifecycle.embedded(rows, F.when(F.col("doc_id") % 10 != 0, F.array(F.length("text").cast("double"))))


STAGED_SQL = f"""{VERSIONS_SQL},
staged AS (SELECT n.doc_id, n.ordinal, n.content_hash, o.doc_id IS NOT NULL AS reused FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id AND o.content_hash = n.content_hash AND o.nth = 1 AND n.nth = 1 AND o.doc_id % 4 <> 0),
left_over AS (SELECT doc_id, count(*) AS total, count(*) FILTER (NOT reused AND doc_id % 10 = 0) AS remaining FROM staged GROUP BY 1)"""


@query(f"WITH {STAGED_SQL} SELECT * FROM left_over")
def i6_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.remaining(staged(spark, sf_dir)[1])


@query(f"""
WITH {STAGED_SQL}
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, content_hash, 'm' AS model FROM staged WHERE doc_id IN (SELECT doc_id FROM left_over WHERE remaining = 0)
UNION ALL SELECT doc_id, CAST(old_ordinal AS INTEGER), content_hash, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'm' END FROM old WHERE doc_id NOT IN (SELECT doc_id FROM left_over WHERE remaining = 0)
""")
def i8_swapped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, rows = staged(spark, sf_dir)
    return lifecycle.swapped(existing, rows, "m").select("doc_id", "ordinal", "content_hash", "model")


@query(SQL["i8_swapped_chunks"])
def i8_committed_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same swap as a commit to a table of snapshots, read back."""
    existing, rows = staged(spark, sf_dir)
    path = tables.shared_path(spark, "chunks")
    snapshots.create(existing.select("doc_id", "ordinal", "content_hash", "text", "model", "embedding"), path)
    return snapshots.read(spark, path, sinks.swap_documents(rows, path, "m")).select("doc_id", "ordinal", "content_hash", "model")


@query("SELECT user_id AS doc_id, arg_max(event_id, (ts, event_id)) AS job_id FROM events GROUP BY 1")
def i7_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("started_at"))
    return lifecycle.latest_job(jobs)


@query("SELECT doc_id, source AS collection_id FROM documents WHERE source IN ('src1', 'src4', 'src9')")
def i10_to_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = D.collections(spark).select("collection_id", F.lit("default").alias("profile"), F.lit("m").alias("model"))
    profile, model = F.when(F.col("collection_id") == "src1", "small").otherwise("default"), F.when(F.col("collection_id").isin("src4", "src9"), "n").otherwise("m")
    return lifecycle.to_reindex(documents(spark, sf_dir).select("doc_id", F.col("source").alias("collection_id")), before, before.select("collection_id", profile.alias("profile"), model.alias("model"))).select("doc_id", "collection_id")


@query("""
SELECT event_id, CASE WHEN event_type = 'view' AND ts < m - INTERVAL 2 HOUR THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status
FROM events, (SELECT max(ts) AS m FROM events) WHERE NOT (ts < m - INTERVAL 1 DAY)
""")
def i11_stale_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"))
    rows = e.join(F.broadcast(e.agg(F.max("created_at").alias("now"))), F.lit(True))
    return lifecycle.with_timeouts(lifecycle.without_stale(rows, F.col("now")), F.col("now")).select("event_id", "status")


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'deleted:' || doc_id || ':' || lang || '/' || doc_id ELSE lang || '/' || doc_id END AS external_id, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'ready' END AS status,
  CASE WHEN toxic = 1 THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) END AS chunks
FROM documents LEFT JOIN labels USING (doc_id)
""")
def r25_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("external_id"), F.lit("ready").alias("status"))
    gone = D.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    kept, chunks = lifecycle.soft_deleted(d, D.chunks(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "chunk_id"), gone)
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return kept.join(n, "doc_id", "left").select("doc_id", "external_id", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT l.doc_id, quality FROM labels l JOIN documents d USING (doc_id) WHERE source <> 'src0'")
def r24_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cascaded(documents(spark, sf_dir).where("source <> 'src0'"), D.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


@query("""
WITH a AS (SELECT doc_id, lang AS old_lang, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, upper(lang) AS new_lang FROM documents WHERE doc_id % 3 = 0)
SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS external_id, coalesce(new_lang, old_lang) AS lang, source, CASE WHEN a.doc_id IS NULL THEN 'created' WHEN b.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS status
FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def r28_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, key = documents(spark, sf_dir), F.col("doc_id").cast("string").alias("external_id")
    old = d.where("doc_id % 2 = 0").select(key, F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    new = d.where("doc_id % 3 = 0").select(key, F.create_map(F.lit("lang"), F.upper("lang")).alias("metadata"))
    return lifecycle.registered(old, new).select("external_id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"), "status")


@query(f"""
WITH {D.GRANTS_SQL} SELECT doc_id, source AS collection_id FROM documents WHERE source IN (SELECT collection_id FROM grants WHERE principal_id = 'g0') AND doc_id % 2 = 0
""")
def a10_visible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of documents, a third of which don't name their collection, as user u0 sees them."""
    from corpusloom.streaming.limits import document_events

    d = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"))
    events = d.where("document_id % 2 = 0").withColumn("collection_id", F.when(F.col("document_id") % 3 != 0, F.col("collection_id")))
    seen = document_events(events, d, readable(spark).where("sub = 'u0'"))
    return seen.select(F.col("document_id").alias("doc_id"), "collection_id")


@query("""
WITH g AS (SELECT doc_id % 40 AS collection_id, CASE doc_id % 7 WHEN 0 THEN 'owner' WHEN 1 THEN 'editor' ELSE 'viewer' END AS role FROM documents WHERE doc_id % 40 < 25 OR doc_id % 7 <> 0)
SELECT collection_id, bool_or(role = 'owner') AS has_owner FROM g GROUP BY 1
""")
def a9_owners_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import access

    i = F.col("doc_id")
    role = F.when(i % 7 == 0, "owner").when(i % 7 == 1, "editor").otherwise("viewer")
    return access.owners_left(documents(spark, sf_dir).where("doc_id % 40 < 25 OR doc_id % 7 <> 0").select((i % 40).alias("collection_id"), role.alias("role")))


@query("""
WITH w AS (SELECT event_type, date_trunc('minute', ts) - to_minutes(CAST(k AS INTEGER)) AS start FROM events, range(5) r(k))
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM w GROUP BY 1, 2
""")
def w6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests a second in each five minutes, every minute."""
    e = D.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    rates = analytics.rates(e, "event_type")
    return rates.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("rate", 6).alias("rate"))


# --- listings


CHAT_SQL = "CAST(min(turn) AS VARCHAR) || ' ' || arg_min(text, turn) AS title, max(turn) * 100 + conv_id % 100 AS updated_at FROM conversations GROUP BY conv_id"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with an owner, their first turn as title, and a time."""
    c = D.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.min_by("text", "turn").alias("text"), F.max("turn").alias("last"))
    return c.select(F.col("conv_id").alias("id"), F.concat(F.lit("u"), F.col("conv_id") % 6).alias("owner"), F.concat_ws(" ", F.col("first").cast("string"), "text").alias("title"), (F.col("last") * 100 + F.col("conv_id") % 100).alias("updated_at"))


@query(f"""
WITH c AS (SELECT conv_id AS id, 'u' || (conv_id % 6) AS owner, {CHAT_SQL})
SELECT id, updated_at FROM c WHERE owner = 'u1' AND contains(lower(title), 'e') AND (updated_at < 700 OR (updated_at = 700 AND id < 50)) ORDER BY updated_at DESC, id DESC LIMIT 11
""")
def r18_conversations_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.own_page(conversations(spark, sf_dir), "u1", "%E_", (700, 50), 10).select("id", "updated_at")


@query(f"""
WITH {D.READABLE_SQL}, {D.CHUNKS_SQL} SELECT r.sub, chunk_id, document_id, 'Doc ' || document_id AS title, text FROM chunks JOIN readable r USING (collection_id) WHERE document_id % 13 <> 0 AND ordinal = 0 AND r.sub <> 'root'
""")
def r17_visible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each document, for each user that may read it."""
    i = F.col("doc_id")
    docs = documents(spark, sf_dir).select(i.alias("document_id"), F.col("source").alias("collection_id"), F.concat(F.lit("Doc "), i).alias("title"), F.when(i % 13 == 0, "deleted").otherwise("ready").alias("status"))
    return listings.visible_chunk(D.chunks(spark, sf_dir).where("ordinal = 0").select("chunk_id", "document_id", "text"), docs, readable(spark).where("sub <> 'root'"))


@query("""
WITH f AS (SELECT doc_id % 97 AS message_id, 'u' || (doc_id % 3) AS user_sub, arg_max(quality, doc_id) AS rating FROM labels GROUP BY 1, 2)
SELECT conv_id, turn, role, rating FROM conversations LEFT JOIN f ON message_id = conv_id AND user_sub = 'u' || (turn % 3)
""")
def r19_messages_with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    m = D.table(spark, sf_dir, "conversations").withColumns({"message_id": F.col("conv_id"), "user_sub": F.concat(F.lit("u"), F.col("turn") % 3)})
    f = D.table(spark, sf_dir, "labels").select((i % 97).alias("message_id"), F.concat(F.lit("u"), i % 3).alias("user_sub"), F.col("quality").alias("rating"), i.alias("created_at"))
    return listings.with_own_feedback(m, f).select("conv_id", "turn", "role", "rating")


@query("SELECT 'src' || i AS source_id, count(doc_id) AS documents FROM range(20) r(i) LEFT JOIN documents ON source = 'src' || i AND doc_id % 13 <> 0 GROUP BY 1")
def r22_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("source").alias("source_id"), F.when(F.col("doc_id") % 13 == 0, "deleted").otherwise("ready").alias("status"))
    return listings.source_counts(D.collections(spark).select(F.col("collection_id").alias("source_id")), docs)


@query("SELECT user_id AS source_id, event_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 20")
def r22_source_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("job_id"), "ts")
    kept = lifecycle.newest(jobs, "source_id", [F.desc("ts"), F.desc("job_id")])
    from pyspark.sql import Window

    return kept.select("source_id", "job_id", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("job_id"))).alias("nth"))


@query("""
SELECT count(*) AS total, count(*) FILTER (doc_id % 4 = 0) AS ready, count(*) FILTER (doc_id % 4 = 1) AS failed, count(*) FILTER (doc_id % 4 = 2) AS pending FROM documents
""")
def r23_seed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("ready", "failed", "parsing", "deleted"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return listings.totals(documents(spark, sf_dir).select(status.alias("status")))


@query(f"WITH {D.READABLE_SQL} SELECT sub, list_sort(list('Name of ' || collection_id)) AS names FROM readable GROUP BY 1")
def r27_searched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = D.collections(spark).select(F.col("collection_id").alias("id"), F.concat(F.lit("Name of "), "collection_id").alias("name"))
    return listings.names_of(readable(spark), names)


@query("""
SELECT event_id AS log_id, c.text AS answer, CASE WHEN event_id % 3 = 0 THEN ['N' || user_id % 20, '', 'N1'] ELSE []::VARCHAR[] END AS collections
FROM events LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1) c ON c.conv_id = event_id % 200
""")
def r9_query_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    allowed = F.when(i % 3 == 0, F.array((F.col("user_id") % 20).cast("string"), F.lit("unknown"), F.lit("1"))).otherwise(F.array().cast("array<string>"))
    logs = D.table(spark, sf_dir, "events").select(i.alias("log_id"), (i % 200).alias("message_id"), allowed.alias("allowed"))
    said = D.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("message_id")).agg(F.min_by("text", "turn").alias("content"))
    names = spark.range(20).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("N"), "id").alias("name"))
    return listings.trace(logs, said, names).select("log_id", "answer", "collections")


@query("""
SELECT user_id % 10 AS source_id, event_type AS url, arg_max(value, (ts, event_id)) AS etag FROM events GROUP BY 1, 2
""")
def r21_page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("event_type").alias("url"), F.col("value").alias("etag"), "ts", "event_id")
    return analytics.latest(e, ["source_id", "url"], [F.desc("ts"), F.desc("event_id")]).select("source_id", "url", "etag")


@query("""
SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 60, false) AS too_soon FROM events
""")
def s19_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("host"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return listings.too_soon(e, 1 / 60).select(F.col("id").alias("event_id"), "too_soon")


@query("SELECT doc_id, rtrim(replace(replace(base64(encode('[\"' || doc_id || '\",\"' || source || '\"]')), '+', '-'), '/', '_'), '=') AS cursor, [CAST(doc_id AS VARCHAR), source] AS back FROM documents")
def t25_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).select("doc_id", T.cursor(F.col("doc_id"), F.col("source")).alias("cursor"))
    return made.withColumn("back", T.from_cursor(F.col("cursor")))


@query("SELECT doc_id, regexp_replace(text, '[%_]', '', 'g') AS searched, regexp_matches(source, '^[A-Za-z0-9._/-]+$') AS safe FROM documents")
def t24_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.like_free(F.col("text")).alias("searched"), T.is_safe_model(F.col("source")).alias("safe"))


# --- sources


@query("SELECT page_id, 'text/html' AS mime, NULL::VARCHAR AS refusal FROM pages")
def s1_mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages by their first bytes; their addresses tell no type."""
    mime = parsers.mime_type(F.col("url"), F.substring(F.encode("html", "UTF-8"), 1, 8192))
    return D.table(spark, sf_dir, "pages").select("page_id", mime.alias("mime")).withColumn("refusal", parsers.refusal(F.col("mime")))


@query(f"""
WITH s AS (SELECT source, string_agg(text, '<<<PAGE>>>' ORDER BY doc_id) AS t FROM (SELECT doc_id % 40 AS source, doc_id, text FROM documents) GROUP BY 1),
p AS (SELECT source AS doc_id, unnest(string_split(t, '<<<PAGE>>>')) AS text, unnest(range(len(string_split(t, '<<<PAGE>>>')))) + 1 AS page FROM s)
SELECT doc_id, CAST(page AS INTEGER) AS page, trim(text, ' ') AS text FROM p
""")
def s27_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus files of several pages, with front matter."""
    d = documents(spark, sf_dir).select((F.col("doc_id") % 40).alias("source"), "doc_id", "text")
    whole = d.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), files.PAGE).alias("t"))
    return files.pages(whole.select(F.col("source").alias("doc_id"), F.concat(F.lit("---\ntitle: \"A: b\"\nformat: md\n---\n"), "t").alias("text")))


@query("SELECT doc_id, lang AS title, source AS format FROM documents")
def s27_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\ntitle: \""), "lang", F.lit("\"\nformat: "), "source", F.lit("\n---\n"), "text")
    return documents(spark, sf_dir).select("doc_id", files.front_matter(text).alias("m")).select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["format"].alias("format"))


@query("SELECT count(*) AS n, 'golden-' || count(*) || 'q-' || left(sha256(string_agg(sha256(text), chr(10) ORDER BY item_id)), 10) AS version FROM benchmark")
def s26_dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dataset_version(D.table(spark, sf_dir, "benchmark"), F.sha2("text", 256))


@query("""
SELECT doc_id, [upper(w[1]) || lower(w[2:]) FOR w IN string_split(trim(regexp_replace(source || '_' || lang || '-' || doc_id, '[-_]+', ' ', 'g')), ' ')] AS words FROM documents
""")
def s14_titles_from_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("files/"), "source", F.lit("_"), "lang", F.lit("-"), "doc_id", F.lit(".tar.md"))
    name = F.regexp_replace(name, r"\.tar", "")
    return documents(spark, sf_dir).select("doc_id", F.split(T.title_from_filename(name), " ").alias("words"))


@query(f"""
WITH {D.CHUNKS_SQL},
c AS (SELECT chunk_id, {S.filled("string_split(regexp_replace('| ' || replace(text, ' ', ' | ') || ' |', '^\\|+|\\|+$', '', 'g'), '|')")} AS cells, text FROM chunks)
SELECT chunk_id, array_to_string(list_filter(cells, lambda x: NOT regexp_matches(x, '^[-: ]*$')), ', ') AS row FROM c
""")
def t27_readable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a table row with a cell for each word."""
    row = F.concat(F.lit("| "), F.replace("text", F.lit(" "), F.lit(" | ")), F.lit(" |"))
    return D.chunks(spark, sf_dir).select("chunk_id", T.readable(row).alias("row"))


@query("""
WITH h AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' ') AS title, url FROM pages),
p AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN chr(9) || translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || chr(10) ELSE title || ' x' END AS first FROM h)
SELECT page_id, CASE WHEN lower(regexp_replace(first, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) THEN 'Part > ' || url ELSE first || ' > Part > ' || url END AS label FROM p
""")
def t16_section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that begin with the page's title, in capitals and with white space around it, or with something else."""
    title = web.page_title(F.col("html"))
    capitals = F.translate(title, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    first = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\t"), capitals, F.lit("\n"))).otherwise(F.concat(title, F.lit(" x")))
    return D.table(spark, sf_dir, "pages").select("page_id", T.section_label(F.array(first, F.lit("Part"), F.col("url")), title).alias("label"))


@query("""
WITH k AS (SELECT doc_id, doc_id % 3 AS etag, CASE WHEN doc_id % 7 = 0 THEN 500 ELSE 200 END AS status FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT doc_id, doc_id % 3 + (doc_id % 4 = 0)::INT AS etag, doc_id % 11 = 0 AS archived FROM documents WHERE doc_id % 6 <> 0)
SELECT CAST(coalesce(k.doc_id, f.doc_id) AS VARCHAR) AS url, CASE WHEN f.doc_id IS NULL OR archived THEN CASE WHEN status = 200 THEN 'deleted' ELSE 'skipped' END WHEN status = 200 AND k.etag = f.etag THEN 'unchanged' ELSE 'upsert' END AS action
FROM k FULL JOIN f ON k.doc_id = f.doc_id
""")
def s21_snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("doc_id")
    known = d.where("doc_id % 5 <> 0").select(i.cast("string").alias("url"), (i % 3).cast("string").alias("etag"), F.when(i % 7 == 0, 500).otherwise(200).alias("status"))
    found = d.where("doc_id % 6 <> 0").select(i.cast("string").alias("url"), (i % 3 + (i % 4 == 0).cast("int")).cast("string").alias("etag"), (i % 11 == 0).alias("archived"))
    return lifecycle.snapshot_plan(known, found)


@query(f"""
WITH p AS (SELECT DISTINCT {SHORTER.format('url')} AS url FROM pages), x AS (SELECT url, regexp_replace(url, '^[A-Za-z]+://[^/?#]*', '') AS path FROM p)
SELECT url, NOT (starts_with(path, '/p') AND NOT starts_with(path, '/page')) AND NOT contains(path, 'zzz') AS allowed FROM x
""")
def s20_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.table(spark, sf_dir, "pages").select(web.normalized_url(F.col("url")).alias("url")).distinct()
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /p  # all\nAllow: /page\n"
    origin = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    robots = pages.select(origin.alias("origin")).distinct().select("origin", F.lit(200).alias("status"), F.lit(text).alias("text"))
    return web.with_permission(pages, robots).select("url", "allowed")


@query(f"""
WITH RECURSIVE {LINKS_SQL},
r AS (SELECT {SHORTER.format('url')} AS url, 0 AS depth FROM pages WHERE page_id % 10 = 0 UNION SELECT link, depth + 1 FROM r JOIN e ON e.url = r.url WHERE depth < 2),
d AS (SELECT url, min(depth) AS depth FROM r GROUP BY url)
SELECT url, depth FROM d WHERE depth = 0 OR (regexp_matches(url, '[0-9]') AND NOT regexp_matches(url, '7')) ORDER BY depth, url LIMIT 60
""")
def s15_crawl_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.table(spark, sf_dir, "pages")
    start = pages.where("page_id % 10 = 0")
    return web.within(web.crawled(pages, start), start, "[0-9]", "7", 60)


SITES_SQL = """p AS (SELECT page_id, page_id % 2 AS source, 'http://h' || page_id % 2 || '.example' || regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''#]+)', 1)[(page_id // 2) % 4 + 1] AS url, html FROM pages),
l AS (SELECT source, url, x.raw, x.k FROM (SELECT source, url, unnest(list_zip(r, range(len(r)))) AS z, struct_pack(raw := z[1], k := z[2]) AS x
      FROM (SELECT source, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''#]+)', 1) AS r FROM p)) WHERE x.raw LIKE '/%'),
e AS (SELECT source, url, 'http://h' || source || '.example' || raw AS link, min(k) AS k FROM l GROUP BY ALL)"""


def crawl_level(depth: int) -> str:
    """Names and places of a level in SQL; the pages seen before are those of the levels below."""
    before = " UNION ALL ".join(f"SELECT source, url FROM w{d}" for d in range(depth))
    return f"""
n{depth} AS (SELECT w.source, e.link AS url, min((w.place, e.k)) AS o FROM w{depth - 1} w JOIN e ON e.source = w.source AND e.url = w.url WHERE w.fetched GROUP BY ALL),
c{depth} AS (SELECT source, count(*) AS had FROM ({before}) GROUP BY ALL),
a{depth} AS (SELECT source, url, {depth} AS depth, had + row_number() OVER (PARTITION BY source ORDER BY o, url) - 1 AS place,
             regexp_matches(url, 'e') AND NOT regexp_matches(url, 'z$') AS fetched FROM n{depth} JOIN c{depth} USING (source) WHERE (source, url) NOT IN ({before})),
w{depth} AS (SELECT * FROM a{depth} WHERE place < 24)"""


@query(f"""
WITH {SITES_SQL},
a0 AS (SELECT source, url, 0 AS depth, row_number() OVER (PARTITION BY source ORDER BY min(page_id), url) - 1 AS place, true AS fetched FROM p WHERE (page_id // 2) % 10 = 0 GROUP BY source, url),
w0 AS (SELECT * FROM a0 WHERE place < 24),
{crawl_level(1)}, {crawl_level(2)}, {crawl_level(3)}, {crawl_level(4)}
SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4
""")
def s15_crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sites, in which a page's address is one of those that its menu names: from a tenth of the pages up to four links deep, 24 pages each."""
    p = D.table(spark, sf_dir, "pages").withColumn("source", F.col("page_id") % 2)
    path = F.get(F.regexp_extract_all("html", F.lit(web.LINK), F.lit(1)), (F.floor(F.col("page_id") / 2) % 4).cast("int"))
    sites = p.select("page_id", "source", F.concat(F.lit("http://h"), "source", F.lit(".example"), path).alias("url"), "html")
    start = sites.where("floor(page_id / 2) % 10 = 0").select("source", "url", F.col("page_id").alias("position"))
    return web.crawl(sites, start, include="e", exclude="z$", max_depth=4, max_pages=24)


# --- evaluation


@query("""
SELECT doc_id % 50 AS query_id, count(*) FILTER (doc_id % 3 = 0) AS missing_docs FROM labels GROUP BY 1
""")
def e1_missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    wanted = D.table(spark, sf_dir, "labels").select((i % 50).alias("query_id"), i.alias("item"), F.concat(F.lit("a/"), i, F.lit(".md")).alias("path"))
    there = documents(spark, sf_dir).where("doc_id % 3 <> 0").select(F.concat(F.lit("a/"), i, F.lit(".md")).alias("path"), i.alias("document_id"))
    return metrics.missing_documents(wanted, there)


@query("""
WITH r AS (SELECT event_id, CASE WHEN value < 60 THEN 'no_answer' WHEN event_type = 'error' THEN 'error' ELSE 'answered' END AS outcome, CASE WHEN event_type = 'view' THEN 'no_answer' ELSE 'answer' END AS expected FROM events)
SELECT event_id, (outcome = 'no_answer') = (expected = 'no_answer') AS no_answer_correct FROM r
""")
def e9_no_answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = D.table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 60, "no_answer").when(kind == "error", "error").otherwise("answered").alias("outcome"), F.when(kind == "view", "no_answer").otherwise("answer").alias("expected"))
    return metrics.no_answer_correct(rows).select("event_id", "no_answer_correct")


@query("""
WITH a AS (SELECT doc_id, quality * 3 + 1 AS c, toxic * 0.3 + 0.2 AS f FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 1 END AS c, 0.3 AS f FROM documents)
SELECT count(*) AS n, round(avg(CASE WHEN a.c = b.c AND abs(a.f - b.f) <= 0.1 + 1e-12 THEN 1 ELSE 0 END), 4) AS agreement FROM a JOIN b USING (doc_id)
""")
def e15_judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").alias("question_id")
    a = D.table(spark, sf_dir, "labels").select(i, (F.col("quality") * 3 + 1).alias("correctness"), (F.col("toxic") * 0.3 + 0.2).alias("faithfulness"))
    b = documents(spark, sf_dir).select(i, F.when(F.col("doc_id") % 4 == 0, 4).otherwise(1).alias("correctness"), F.lit(0.3).alias("faithfulness"))
    return metrics.judge_agreement(a, b)


@query(f"""
WITH {EVAL_SQL}, c AS (SELECT DISTINCT query_id, document_id FROM ranked WHERE rank <= 10)
SELECT query_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM relevant r WHERE r.query_id = c.query_id AND r.document_id = c.document_id) THEN 1 ELSE 0 END), 6) AS precision
FROM c WHERE query_id IN (SELECT query_id FROM relevant) GROUP BY 1
""")
def e16_citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = vector_questions(spark, sf_dir), vectors(spark, sf_dir)
    cited = retrieval.vector(q, v, readable(spark)).where("rank <= 10").select("query_id", F.col("chunk_id").alias("document_id"))
    own = q.select("query_id").join(v.select(F.col("chunk_id").alias("query_id"), "collection_id"), "query_id")
    relevant = own.join(v.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("document_id"), "collection_id"), "collection_id")
    return metrics.citation_precision(cited, relevant).select("query_id", F.round("precision", 6).alias("precision"))


@query("SELECT doc_id, NOT (contains(lower(text), 'token =') OR contains(lower(text), 'password')) AS resisted FROM documents")
def e17_injection_resisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", metrics.resisted(F.col("text"), F.array(F.lit("TOKEN ="), F.lit("password"))).alias("resisted"))


@query("""
WITH s AS (SELECT value / 1000 AS score, event_type = 'error' AS refuse FROM events), t AS (SELECT i / 50.0::DOUBLE AS threshold FROM range(51) r(i)),
w AS (SELECT threshold, round(avg(CASE WHEN (score < threshold) = refuse THEN 1 ELSE 0 END), 4) AS accuracy, count(*) FILTER (score < threshold AND NOT refuse) AS false_refusals FROM s, t GROUP BY threshold)
SELECT min(threshold) AS low, max(threshold) AS high, any_value(accuracy) AS accuracy, any_value(false_refusals) AS false_refusals FROM w
WHERE (accuracy, -false_refusals) = (SELECT max((accuracy, -false_refusals)) FROM w)
""")
def e19_best_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .analytics_queries import e19_threshold_sweep

    return metrics.best_plateau(e19_threshold_sweep(spark, sf_dir))


@query("""
WITH g AS (SELECT count(*) FILTER (toxic = 1) AS leaks, round(avg(quality), 4) AS recall FROM labels)
SELECT len(r) = 0 AS passed, r AS reasons FROM (SELECT list_filter([CASE WHEN leaks > 0 THEN 'leakage' END, CASE WHEN recall < 0.85 THEN 'recall' END, CASE WHEN round(0.9 - recall, 6) > 0.03 THEN 'drop' END], lambda x: x IS NOT NULL) AS r FROM g)
""")
def e20_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = D.table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("leaks"), F.round(F.avg("quality"), 4).alias("recall"))
    return metrics.gate(run, spark.createDataFrame([(0.9,)], "recall double"))


@query("SELECT lang AS label, round(avg(CASE WHEN source = 'src1' THEN n_chars END), 4) AS src1, round(avg(CASE WHEN source = 'src2' THEN n_chars END), 4) AS src2 FROM documents GROUP BY 1")
def e23_experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("lang").alias("label"), F.col("source").alias("mode"), F.col("n_chars").alias("recall"))
    return metrics.experiment_matrix(rows, ["src1", "src2"])


@query("""
SELECT doc_id AS question_id, round(list_sum(p) / len(p), 4) AS score FROM (
  SELECT doc_id, list_filter([CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END::DOUBLE, (toxic * 2 + 1) / 5.0::DOUBLE, 0.7::DOUBLE, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE END], lambda x: x IS NOT NULL) AS p FROM labels)
""")
def e21_run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    score = metrics.run_score(F.when(i % 3 != 0, F.col("quality")), F.col("toxic") * 2 + 1, F.lit(0.7), F.when(i % 2 == 0, F.lit(True)))
    return D.table(spark, sf_dir, "labels").select(i.alias("question_id"), score.alias("score"))
