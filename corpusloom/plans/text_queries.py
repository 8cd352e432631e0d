"""Text functions applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources import parsers

from . import sqltext as S
from .domain import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def over_documents(name: str, column: Callable[[Column], Column], sql: str) -> None:
    """Registers a column made from the text; it is made when the query runs, as columns need a session."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias("out"))
    SQL[name] = f"SELECT doc_id, {sql} AS out FROM documents"


TITLE_SQL = "'doc ' || doc_id"


def path() -> Column:
    return F.array(F.concat(F.lit("Doc "), "doc_id"), F.col("source"), F.col("lang"))


def title() -> Column:
    return F.concat(F.lit("doc "), "doc_id")



over_documents("t2_tokens", lambda x: T.tokens(x), S.tokens("text"))
over_documents("t3_stems", lambda x: F.transform(T.tokens(x), T.stem), f"list_transform({S.tokens('text')}, lambda t: {S.stem('t')})")
over_documents("t5_content_terms", lambda x: T.content_terms(x), S.content_terms("text"))
over_documents("t6_sentences", lambda x: T.sentences(x), S.sentences("text"))
over_documents("t7_loose_sentences", lambda x: T.loose_sentences(x), "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))")
over_documents(
    "t8_simple_token_count", lambda x: T.simple_token_count(x),
    "list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]'), "
    "lambda p: CASE WHEN regexp_matches(p, '^[\\p{L}\\p{N}]') THEN greatest(1, (length(p) + 5) // 6) ELSE 1 END))",
)
over_documents("t10_approx_tokens", lambda x: T.approx_tokens(x), "greatest(1, round_even(length(text) / 4.0, 0)::INTEGER)")
over_documents("t11_sha256", lambda x: F.sha2(x, 256), "sha256(text)")
over_documents("t15_escape", lambda x: T.escape(x), "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
over_documents("t17_rerank_input", lambda x: T.rerank_input(title(), path(), x), f"{TITLE_SQL} || ' > ' || source || ' > ' || lang || chr(10) || text")
over_documents("t18_embed_text", lambda x: T.embed_text(title(), path(), x), f"{TITLE_SQL} || ' > ' || source || ' > ' || lang || chr(10) || chr(10) || text")
over_documents("t20_suspicious", lambda x: T.is_suspicious(x), S.suspicious("text"))
over_documents("t21_urls", lambda x: T.urls(x), "regexp_extract_all(text, '(?i)https?://[^\\s<>\"'')\\]]+')")
over_documents("t22_payloads", lambda x: T.payloads(x), "regexp_extract_all(text, '\\b[A-Z]{2,}(?:\\s+[A-Z]{2,})+\\b')")
over_documents("t23_clean_spaces", lambda x: T.clean_spaces(x), "trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' +([.,;:])', '\\1', 'g'), ' ')")
over_documents("t24_safe_filename", lambda x: T.safe_filename(F.concat(F.lit("dir/"), x)), "regexp_replace(regexp_extract('dir/' || text, '[^/\\\\]*$'), '[^A-Za-z0-9._-]+', '_', 'g')")
over_documents("c6_normalized_text", lambda x: F.array_join(T.filled(F.split(x, "\n")), "\n\n"), f"array_to_string({S.filled('string_split(text, chr(10))')}, chr(10) || chr(10))")
over_documents(
    "t12_document_hash",
    lambda x: T.document_hash(title(), F.array(F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("page"), x.alias("text")))),
    f"sha256({TITLE_SQL} || chr(10) || 'paragraph:0:None:' || text)",
)
over_documents("t13_content_identity", lambda x: T.content_identity(F.sha2(x, 256), "default", 450, True, "m"), "sha256(sha256(text) || '|default:450:True|m')")


def t14_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of a benchmark item's terms to those of the next item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.content_terms(F.col("text")).alias("a"))
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return items.join(following, "item_id").select("item_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("likeness"))


QUERIES["t14_jaccard"] = t14_jaccard
SQL["t14_jaccard"] = f"""
WITH items AS (SELECT item_id, {S.content_terms("text")} AS terms FROM benchmark)
SELECT x.item_id, round({S.jaccard("x.terms", "y.terms")}, 6) AS likeness FROM items x JOIN items y ON y.item_id = x.item_id + 1
"""


def s4_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of plain text: cut at blank lines, normalised, without empty ones."""
    return parsers.text_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["s4_text_blocks"] = s4_text_blocks
SQL["s4_text_blocks"] = f"""
WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {S.normalized("p")}), lambda p: p <> '') AS b FROM documents)
SELECT doc_id, CAST(unnest(range(len(b))) AS INTEGER) AS ordinal, unnest(b) AS text FROM b
"""
