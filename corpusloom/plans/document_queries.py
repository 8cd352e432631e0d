"""Layout, views, clusters and remaining reports over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import analytics, answers, documents, layout, retrieval
from corpusloom.sources import parsers

from . import domain as D
from . import sqltext as S
from .search_queries import FUSED_SQL, LEXICAL_SQL, RERANK_SQL, fused, hydrated, lexical, readable, with_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def put(f):  # type: ignore[no-untyped-def]
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a made-up font size and page."""
    c = D.chunks(spark, sf_dir)
    size = F.when(F.col("ordinal") % 9 == 0, 18.0).when(F.col("ordinal") % 7 == 0, 14.0).when(F.col("ordinal") % 5 == 0, 12.0).otherwise(10.0)
    return c.select(F.col("document_id").alias("doc_id"), "ordinal", size.alias("size"), "text", (F.floor(F.col("ordinal") / 30) + 1).alias("page"))


LINES_SQL = f"""{D.CHUNKS_SQL},
lines AS (SELECT document_id AS doc_id, ordinal, CASE WHEN ordinal % 9 = 0 THEN 18.0 WHEN ordinal % 7 = 0 THEN 14.0 WHEN ordinal % 5 = 0 THEN 12.0 ELSE 10.0 END AS size,
                 text, ordinal // 30 + 1 AS page FROM chunks)"""


@query(f"""
WITH {LINES_SQL}, w AS (SELECT doc_id, size, sum(length(text)) AS signs FROM lines GROUP BY ALL),
b AS (SELECT doc_id, arg_max(size, (signs, size)) AS body FROM w GROUP BY 1),
r AS (SELECT doc_id, size, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 3) AS level FROM w JOIN b USING (doc_id) WHERE size >= body * 1.15)
SELECT l.doc_id, l.ordinal, CAST(CASE WHEN length(trim(text)) < 120 THEN coalesce(level, 0) ELSE 0 END AS INTEGER) AS level FROM lines l LEFT JOIN r USING (doc_id, size)
""")
def s11_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.heading_levels(lines(spark, sf_dir)).select("doc_id", "ordinal", "level")


@query(f"WITH {LINES_SQL} SELECT doc_id FROM lines GROUP BY 1 HAVING sum(length(text)) < 20 * max(page)")
def s13_too_little_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.too_little_text(lines(spark, sf_dir))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents set in two columns of pages."""
    i = F.col("ordinal")
    x0, y0 = i % 2 * 300.0, F.floor(i % 30) * 28.0
    placed = lines(spark, sf_dir).withColumns({"x0": x0, "y0": y0, "x1": x0 + 250.0, "y1": y0 + 12.0, "height": F.lit(842.0), "block": F.floor(i / 3)})
    return placed.select("doc_id", "ordinal", "page", "x0", "y0", "x1", "y1", "height", "block", "size", "text")


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the pages: a table in the left column of every third, one across every fifth, and one that is no table."""
    pages = lines(spark, sf_dir).select("doc_id", "page").distinct()
    turn = F.col("doc_id") + F.col("page")
    table = F.concat(F.lit("| n | page |\n|---|---|\n| "), "doc_id", F.lit(" | "), "page", F.lit(" |"))
    box = lambda when, x0, y0, x1, y1, text: F.when(when, F.struct(*(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))), text.alias("markdown")))
    boxes = F.array(box(turn % 3 == 0, 0.0, 50.0, 260.0, 118.0, table), box(turn % 5 == 0, -9.0, 330.0, 700.0, 520.0, table), box(turn % 2 == 0, 0.0, 0.0, 700.0, 842.0, F.lit("| no |")))
    return pages.select("doc_id", "page", F.explode(F.array_compact(boxes)).alias("b")).select("doc_id", "page", "b.*")


@query(f"""
WITH {LINES_SQL},
p AS (SELECT *, ordinal % 2 * 300.0 + 125 AS cx, ordinal % 30 * 28.0 + 6 AS cy, (doc_id + page) % 3 = 0 AS small, (doc_id + page) % 5 = 0 AS large FROM lines)
SELECT doc_id, ordinal, page FROM p
WHERE NOT (small AND cx BETWEEN -1 AND 261 AND cy BETWEEN 49 AND 119) AND NOT (large AND cx BETWEEN -10 AND 701 AND cy BETWEEN 329 AND 521)
""")
def s9_lines_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.outside(page_lines(spark, sf_dir), layout.regions(page_boxes(spark, sf_dir))).select("doc_id", "ordinal", "page")


@query()
def s9_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: against a plain loop in tests/test_layout.py."""
    return layout.blocks(page_lines(spark, sf_dir), page_boxes(spark, sf_dir))


@query(f"SELECT item_id, list_reduce({S.filled("string_split(regexp_replace(text, 'e', 'e' || chr(30), 'g'), chr(30))")}, lambda a, x: CASE WHEN suffix(a, '-') AND regexp_matches(x, '^[a-z]') THEN a[:-2] || x ELSE a || ' ' || x END) AS out FROM benchmark")
def s12_dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "benchmark").select("item_id", documents.dehyphenated(F.split("text", "(?<=e)")).alias("out"))


@query(f"SELECT doc_id, {S.normalized('text')} AS out FROM documents")
def t1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", parsers.normalized(F.col("text")).alias("out"))


@query("""
SELECT user_id AS doc_id, CASE WHEN bool_or(event_type = 'error' AND value > 140) THEN 'deleted' ELSE arg_max(CASE WHEN event_type = 'error' AND value > 140 THEN 'deleted' ELSE event_type END, (ts, event_id)) END AS status
FROM events GROUP BY 1
""")
def i9_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 140), "deleted").otherwise(F.col("event_type"))
    return documents.status_now(e.select(F.col("user_id").alias("doc_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query(f"""
WITH {LEXICAL_SQL}
SELECT l.query_id, l.rank::INTEGER AS rank, l.chunk_id, left(c.text, 1200) AS snippet, round(score, 6) AS score FROM lexical l JOIN chunks c USING (chunk_id) WHERE l.rank <= 5
""")
def u1_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_chunks(spark, sf_dir, lexical(spark, sf_dir).where("rank <= 5"), "text")
    return hits.select("query_id", "rank", "chunk_id", F.substring("text", 1, 1200).alias("snippet"), F.round("score", 6).alias("score"))


@query(f"""
WITH {D.CHUNKS_SQL}, w AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS t, sum(length(text)) AS n FROM chunks GROUP BY 1)
SELECT document_id, left(t, 20000) AS text, n >= 20000 OR length(t) > 20000 AS truncated FROM w
""")
def u2_document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_view(D.chunks(spark, sf_dir))


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""
SELECT doc_id, '<sources>' || chr(10) || '<source n="1" title="d' || doc_id || '" section="' || source || '" page="2">' || {esc('text')} || '</source>' || chr(10) || '</sources>' AS block FROM documents
""")
def g3_source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.array(F.struct(F.concat(F.lit("d"), "doc_id").alias("title"), F.col("source").alias("section"), F.lit(2).alias("page"), F.col("text").alias("text")))
    return D.table(spark, sf_dir, "documents").select("doc_id", documents.source_block(s).alias("block"))


@query(f"""
WITH {FUSED_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 20)
SELECT query_id, list(chunk_id ORDER BY rank) AS trace, count(*) FILTER (rank <= 8) AS selected FROM f GROUP BY 1
""")
def g16_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fused(spark, sf_dir)
    trace = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    return f.groupBy("query_id").agg(trace.alias("trace"), F.count_if(F.col("rank") <= 8).alias("selected"))


@query(f"""
WITH {RERANK_SQL} SELECT query_id, round(max(rerank_score), 6) AS best, count(*) AS n, max(rerank_score) < 0.10 AS refuse FROM reranked GROUP BY 1
""")
def n1_reranked_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.reranked(hydrated(spark, sf_dir)).groupBy("query_id").agg(F.max("rerank_score").alias("best"), F.count(F.lit(1)).alias("n"))
    refuse = retrieval.low_relevance(F.col("n"), F.lit(True), F.col("best"), F.lit(None).cast("double"))
    return top.select("query_id", F.round("best", 6).alias("best"), "n", refuse.alias("refuse"))


@query()
def r10_unanswered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = D.table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = q.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 7).alias("user"), F.col("text").alias("question"), F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return documents.clusters(retrieval.hashed_vectors(rows.withColumn("terms", T.content_terms(F.col("question"))), "question"))


@query("SELECT source AS name, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4') AND source > 'src1' GROUP BY 1 ORDER BY 1 LIMIT 3")
def r12_collections_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2", "src3", "src4")).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return analytics.page(c, [F.col("name")], F.col("name") > "src1", 2)


@query(f"SELECT doc_id, list_filter(list_transform({S.sentences('text')}, lambda s: regexp_replace(regexp_replace(regexp_replace(s, '\\[\\d+\\]', '', 'g'), '^(?i)(according to the sources:?|based on the sources,?)\\s*', ''), '^[ .]+|[ .]+$', '', 'g')), lambda s: len({S.content_terms('s')}) >= 2) AS claims FROM documents")
def e11_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", answers.claims(F.col("text")).alias("claims"))


CLEAN_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^#{1,6}\\s+', ''), '[*_`>|]', ' ', 'g'), '\\[\\d+\\]', ' ', 'g'), '\\s+', ' ', 'g')"
X1_SQL = f"""
WITH l AS (SELECT doc_id, list_filter({S.filled(f"list_transform(string_split_regex(text, '\\n+'), lambda x: {CLEAN_SQL})")}, lambda x: NOT regexp_matches(x, '^[-:\\s]+$')) AS lines FROM documents),
b AS (SELECT doc_id, lines[list_position(list_transform(lines, lambda x: length(x)), list_max(list_transform(lines, lambda x: length(x))))] AS best FROM l)
SELECT doc_id, coalesce(regexp_replace(array_to_string(string_split(string_split(regexp_replace(best, '([.!?])\\s+', '\\1' || chr(30)), chr(30))[1], ' ')[1:8], ' '), '[.,;:]+$', ''), '') AS phrase FROM b
"""


@query(X1_SQL)
def x1_highlight_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", documents.highlight_phrase(F.col("text")).alias("phrase"))


EDGES = [10.0, 50.0, 100.0, 200.0, 1e9]


@query("""
WITH c AS (SELECT event_type, [count(*) FILTER (value <= 10), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100), count(*) FILTER (value <= 200), count(*)] AS n FROM events GROUP BY 1),
k AS (SELECT *, 0.5 * n[5] AS want, len(list_filter(n, lambda c: c < 0.5 * n[5])) AS k, [10.0, 50.0, 100.0, 200.0, 1e9]::DOUBLE[] AS e FROM c)
SELECT event_type, round(CASE WHEN k = 0 THEN e[1] * want / n[1] ELSE e[k] + (e[k + 1] - e[k]) * (want - n[k]) / (n[k + 1] - n[k]) END, 6) AS p50 FROM k
""")
def w6_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    counts = e.groupBy("event_type").agg(F.array(*(F.count_if(F.col("value") <= x) for x in EDGES)).alias("counts"))
    return counts.select("event_type", F.round(documents.histogram_quantile(F.col("counts"), EDGES, 0.5), 6).alias("p50"))
