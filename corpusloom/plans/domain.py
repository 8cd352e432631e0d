"""Domain tables made from the given ones, as DataFrames and as the same in DuckDB SQL.

Collections are document sources; principals and grants are literals; chunks are the lines of documents;
questions are benchmark items; query logs are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# literal principals: sub, groups, is_admin
PRINCIPALS = [("u0", ["g0"], False), ("u1", ["g1", "g2"], False), ("u2", ["g3"], False), ("u3", [], False), ("u4", ["g0", "g1", "g2", "g3"], False), ("root", [], True)]
N_COLLECTIONS = 20
# literal grants: type, id, collection, role, place of entry
GRANTS = [("group", f"g{i % 4}", f"src{i}", ("viewer", "editor", "owner")[i % 3], i) for i in range(N_COLLECTIONS)] + [
    ("group", "g0", "src1", "viewer", 100), ("user", "u1", "src3", "owner", 101), ("user", "u3", "src7", "viewer", 102),
    ("user", "u2", "src3", "viewer", 103), ("group", "g1", "src5", "viewer", 104),
]
USERS = len(PRINCIPALS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def principals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRINCIPALS, "sub string, groups array<string>, is_admin boolean")


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, "principal_type string, principal_id string, collection_id string, role string, place int")


def collections(spark: SparkSession) -> DataFrame:
    return spark.range(N_COLLECTIONS).select(F.concat(F.lit("src"), "id").alias("collection_id"))


def chunks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """chunk_id, document_id, collection_id, ordinal, text: the non-empty lines of each document, or of those with a
    doc_id in `of`."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if of is None else docs.join(of, "doc_id", "left_semi")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where("trim(text) <> ''")
    chunk_id = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"))
    return lines.select(chunk_id.alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), "ordinal", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, sub, question: the benchmark items, asked by the users in turn."""
    users = F.array(*(F.lit(p[0]) for p in PRINCIPALS))
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("query_id"), F.element_at(users, (F.col("item_id") % USERS + 1).cast("int")).alias("sub"), F.col("text").alias("question")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_logs of events: user_sub, outcome, timings_ms, cost_usd, created_at."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "no_answer").otherwise("answered")
    timings = F.map_from_arrays(F.array(F.lit("total"), F.lit("first_token")), F.array(F.col("value"), F.col("value") * 0.4))
    cost = F.round(F.col("value") / 1000, 6).cast("decimal(10,6)")
    return e.select("event_id", F.col("user_id").alias("user_sub"), outcome.alias("outcome"), timings.alias("timings_ms"), cost.alias("cost_usd"), F.col("ts").cast("timestamp").alias("created_at"))


def values(rows: list[tuple]) -> str:
    def one(x: object) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "CAST([" + ", ".join(map(one, x)) + "] AS VARCHAR[])"
        return f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


PRINCIPALS_SQL = f"principals(sub, groups, is_admin) AS (VALUES {values(PRINCIPALS)})"
GRANTS_SQL = f"grants(principal_type, principal_id, collection_id, role, place) AS (VALUES {values(GRANTS)})"
COLLECTIONS_SQL = f"collections AS (SELECT 'src' || i AS collection_id FROM range({N_COLLECTIONS}) r(i))"
RANK_SQL = "CASE role WHEN 'viewer' THEN 1 WHEN 'editor' THEN 2 WHEN 'owner' THEN 3 ELSE 0 END"
READABLE_SQL = f"""{PRINCIPALS_SQL}, {GRANTS_SQL}, {COLLECTIONS_SQL},
readable AS (
  SELECT sub, collection_id, arg_max(role, {RANK_SQL}) AS role FROM (
    SELECT sub, g.collection_id, g.role FROM principals p JOIN grants g
      ON (g.principal_type = 'user' AND g.principal_id = p.sub) OR (g.principal_type = 'group' AND list_contains(p.groups, g.principal_id))
    UNION ALL SELECT sub, collection_id, 'owner' FROM principals, collections WHERE is_admin)
  GROUP BY ALL)"""
CHUNKS_SQL = """chunks AS (
  SELECT doc_id || '-' || ordinal AS chunk_id, doc_id AS document_id, source AS collection_id, ordinal, text FROM (
    SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents)
  WHERE trim(text) <> '')"""
USERS_SQL = "[" + ", ".join(f"'{p[0]}'" for p in PRINCIPALS) + "]"
QUESTIONS_SQL = f"""questions AS (
  SELECT item_id AS query_id, {USERS_SQL}[item_id % {USERS} + 1] AS sub, text AS question FROM benchmark)"""
LOGS_SQL = """logs AS (
  SELECT event_id, user_id AS user_sub, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'no_answer' ELSE 'answered' END AS outcome,
         value AS total, value * 0.4 AS first_token, CAST(round(value / 1000, 6) AS DECIMAL(10,6)) AS cost_usd, ts AS created_at FROM events)"""
