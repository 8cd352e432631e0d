"""Parsing, chunking, snapshots, crawling, guardrails and judging over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, ingest
from corpusloom.sources import parsers, web

from . import domain as D
from . import sqltext as S

# without a final slash of the path, unless that is all of it
SHORTER = "regexp_replace(regexp_replace({}, '#.*$', ''), '(://[^/?]*/[^?]*[^/?])/(\\?|$)', '\\1\\2')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def put(f):  # type: ignore[no-untyped-def]
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"SELECT page_id, {SHORTER.format('url')} AS url FROM pages")
def s16_normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", web.normalized_url(F.concat("url", F.lit("#top"))).alias("url"))


LINKS_SQL = f"""l AS (SELECT DISTINCT {SHORTER.format('url')} AS url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''#]+)', 1)) AS raw FROM pages),
e AS (SELECT DISTINCT url, {SHORTER.format("regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || raw")} AS link FROM l WHERE raw LIKE '/%')"""


@query(f"WITH {LINKS_SQL} SELECT * FROM e")
def s17_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(D.table(spark, sf_dir, "pages"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def s17_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


@query(f"""
WITH RECURSIVE {LINKS_SQL},
r AS (SELECT {SHORTER.format('url')} AS url, 0 AS depth FROM pages WHERE page_id % 10 = 0 UNION SELECT link, depth + 1 FROM r JOIN e ON e.url = r.url WHERE depth < 2)
SELECT url, min(depth) AS depth FROM r GROUP BY url
""")
def s15_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.table(spark, sf_dir, "pages")
    return web.crawled(pages, pages.where("page_id % 10 = 0"))


@query("""
WITH s AS (SELECT page_id, [200, 304, 404, 500, 410][page_id % 5 + 1] AS status FROM pages)
SELECT CASE WHEN status = 304 THEN 'unchanged' WHEN status IN (404, 410) THEN 'deleted' WHEN status <> 200 THEN 'error' ELSE 'upsert' END AS outcome, count(*) AS n FROM s GROUP BY 1
""")
def s18_fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 304, 404, 500, 410))), (F.col("page_id") % 5 + 1).cast("int"))
    pages = D.table(spark, sf_dir, "pages").select(web.fetch_outcome(status, F.lit("text/html")).alias("outcome"))
    return pages.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query()
def s6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parsed(D.table(spark, sf_dir, "pages"), "html", "html").select("page_id", "title", "blocks")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents").withColumn("md", F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), "text"))
    return parsers.parsed(docs, "md", "markdown").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "blocks")


@query()
def s5_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir)


@query()
def c1_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunked(blocks(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir)
    return c.select(F.col("document_id").alias("doc_id"), "ordinal", F.sha2("text", 256).alias("content_hash"))


VERSIONS_SQL = f"""{D.CHUNKS_SQL},
lines AS (SELECT document_id AS doc_id, ordinal, sha256(text) AS content_hash FROM chunks),
old AS (SELECT doc_id, content_hash, ordinal AS old_ordinal, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY ordinal) AS nth FROM lines WHERE ordinal % 5 <> 3),
new AS (SELECT doc_id, content_hash, ordinal, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY ordinal) AS nth FROM lines WHERE ordinal % 7 <> 2),
matches AS (
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.content_hash, n.content_hash) AS content_hash, old_ordinal::INTEGER AS old_ordinal, ordinal::INTEGER AS ordinal,
         CASE WHEN old_ordinal IS NULL THEN 'new' WHEN ordinal IS NULL THEN 'deleted' ELSE 'reused' END AS state
  FROM old o FULL JOIN new n ON o.doc_id = n.doc_id AND o.content_hash = n.content_hash AND o.nth = 1 AND n.nth = 1)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = lines(spark, sf_dir)
    return ingest.matched(all_.where("ordinal % 5 <> 3"), all_.where("ordinal % 7 <> 2"))


@query(f"WITH {VERSIONS_SQL} SELECT * FROM matches")
def i2_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir)


@query(f"""
WITH {VERSIONS_SQL}
SELECT doc_id, count(*) FILTER (state <> 'deleted') AS total, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'reused') AS unchanged,
       count(*) FILTER (state = 'deleted') AS deleted FROM matches GROUP BY doc_id
""")
def i3_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.diff_stats(matches(spark, sf_dir))


@query(f"""
WITH {D.CHUNKS_SQL} SELECT document_id AS doc_id, ordinal, CAST((row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1) // 64 AS INTEGER) AS batch FROM chunks
""")
def i4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.batches(lines(spark, sf_dir).select("doc_id", "ordinal"))


@query("""
WITH k AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 6 <> 0)
SELECT coalesce(k.doc_id, f.doc_id) AS external_id, CASE WHEN k.doc_id IS NULL THEN 'created' WHEN f.doc_id IS NULL THEN 'deleted'
  WHEN k.text = f.text AND status NOT IN ('failed', 'deleted') THEN 'unchanged' ELSE 'updated' END AS action
FROM k FULL JOIN f ON k.doc_id = f.doc_id
""")
def s23_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 9 == 0, "failed").otherwise("ready").alias("status"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    fetched = docs.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("external_id"), F.sha2(changed, 256).alias("sha256"))
    return ingest.sync_plan(known, fetched)


@query(f"""
WITH {D.CHUNKS_SQL},
l AS (SELECT document_id AS doc_id, ordinal // 4 AS page, ordinal % 4 AS y, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS sig, text, ordinal FROM chunks),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
o AS (SELECT doc_id, sig, count(DISTINCT page) AS n FROM l WHERE y < 0.48 OR y > 3.52 GROUP BY ALL)
SELECT doc_id, ordinal::INTEGER AS ordinal, text FROM l WHERE NOT ((y < 0.48 OR y > 3.52) AND EXISTS (
  SELECT 1 FROM o JOIN p USING (doc_id) WHERE o.doc_id = l.doc_id AND o.sig = l.sig AND pages >= 2 AND n * 2 > pages))
""")
def s10_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir)
    page = F.floor(F.col("ordinal") / 4)
    l = c.select(F.col("document_id").alias("doc_id"), page.alias("page"), (F.col("ordinal") % 4).alias("y"), F.lit(4.0).alias("height"), "text", "ordinal")  # noqa: E741
    return ingest.running_lines(l).select("doc_id", "ordinal", "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question, n, source: each question with the texts of documents of its own number."""
    q = D.questions(spark, sf_dir).select("query_id", "question")
    s = D.table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.col("item_id"), F.col("item_id") + 1)).alias("query_id"), "item_id", F.col("text").alias("source"))
    return q.join(s, "query_id").select("query_id", "question", (F.col("query_id") - F.col("item_id") + 1).cast("int").alias("n"), "source")


@query(f"""
WITH {D.QUESTIONS_SQL},
s AS (SELECT unnest([item_id, item_id + 1]) AS query_id, item_id, text AS source FROM benchmark),
a AS (SELECT query_id, list_distinct({S.content_terms("question")}) AS q, CAST(query_id - item_id + 1 AS INTEGER) AS n, {S.sentences("source")} AS ss FROM questions JOIN s USING (query_id)),
e AS (SELECT query_id, n, q, unnest(ss) AS sentence, unnest(range(len(ss))) AS place FROM a),
c AS (SELECT *, CAST(len(list_intersect(q, list_distinct({S.content_terms("sentence")}))) AS DOUBLE) / len(q) + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.05 ELSE 0 END AS score
      FROM e WHERE len(q) > 0 AND len({S.content_terms("sentence")}) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, place) AS nth FROM c)
SELECT query_id, n, regexp_replace(sentence, '^[-*# ]+', '') AS sentence, round(score, 6) AS score FROM t WHERE nth = 1 AND score >= 0.2
""")
def g4_best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = answers.best_sentences(asked(spark, sf_dir)).select("query_id", F.explode("picks").alias("p"))
    return picks.select("query_id", F.col("p.n").alias("n"), F.col("p.sentence").alias("sentence"), F.round(-F.col("p.minus"), 6).alias("score"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir)
    sources = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda x: x["source"]).alias("sources"))
    return sources.join(answers.best_sentences(rows), "query_id", "left").select("query_id", "sources", answers.answer_text(F.col("picks")).alias("answer"))


@query()
def g17_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answered(spark, sf_dir).withColumn("answer", F.concat("answer", F.lit(" See [9] and http://elsewhere.example/x.")))
    return answers.guard(rows).select("query_id", "guarded.*")


@query()
def e12_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, s = F.col("answer"), F.col("sources")
    facts = F.array().cast("array<string>")
    return answered(spark, sf_dir).select("query_id", answers.correctness(a, s[0], facts).alias("correctness"), answers.faithfulness(a, s).alias("faithfulness"))


@query("SELECT doc_id, contains(lower(text), 'could not find') OR contains(lower(text), 'couldn''t find') AS refusal FROM documents")
def e10_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", answers.is_refusal(F.col("text")).alias("refusal"))


@query(f"SELECT doc_id, {S.suspicious('text')} AS suspicious, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: true)) AS numbers FROM documents")
def g10_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long")
    return D.table(spark, sf_dir, "documents").select("doc_id", T.is_suspicious(F.col("text")).alias("suspicious"), n.alias("numbers"))
