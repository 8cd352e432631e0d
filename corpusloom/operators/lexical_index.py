"""A stored index for lexical search: postings by term, with access codes, read for asked terms only.

An index is a folder:

* `chunks` (chunk, chunk_id, rows): a number for each chunk, in the order of ids, so that sums and ranks are made on numbers;
* `collections` (access, collection_id, rows): the same for collections;
* `postings` (term, chunk, access, n), partitioned by buckets of terms and sorted by term within files, so that a search
  reads the buckets of its terms and, by the files' statistics, little else of them. Buckets are written by a rebalancing
  shuffle: a frequent term becomes files of even size;
* `terms` (term, df, total, most): chunks with it, occurrences, and most in one chunk.

Words are stemmed once each: the distinct words of a table go through the stemmer, and postings meet their stems by
tables.matched(), where a word may hold any share of the rows.

Defined results: null texts have no terms; chunks with the same id and collection are one; rows with a null id or collection
aren't indexed. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stemming
from corpusloom.functions import text as T
from corpusloom.sources import tables

from .vectors import best

BUCKETS = 64
POSTINGS = "term string, chunk long, access long, n long, bucket int"
STEMMERS = {"light": T.stem, "english": stemming.english_stem}
#: Terms that are named in a filter; more are joined.
NAMED = 5000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def stems(words: DataFrame, stemmer: str) -> DataFrame:
    """word, term of distinct words; written, as stemming costs more than reading."""
    return tables.settled(words.select("word").distinct().withColumn("term", STEMMERS[stemmer](F.col("word"))), "stems")


def numbered(rows: DataFrame, column: str, name: str, path: str) -> DataFrame:
    """The distinct values of a column, numbered in their order, and how many rows have each (`rows`); written to path and read back."""
    ordered = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(column)
    ordered.select(F.monotonically_increasing_id().alias(name), column, "rows").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, chunk, access, n of rows (chunk, access, held): how often each value occurs in each array."""
    for batch in batches:
        held = batch.column("held")
        words = held.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
        size = max(1, len(words.dictionary))
        key, n = np.unique(row * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        own = pa.array(key // size)
        columns = [words.dictionary.take(pa.array(key % size)), batch.column("chunk").take(own), batch.column("access").take(own), pa.array(n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "chunk", "access", "n"])


def counted(texts: DataFrame, column: Column, term: str) -> DataFrame:
    """The distinct values of an array over texts (chunk, access, rows) with their number in each chunk: term, chunk, access, n.
    A chunk of one row is counted where it lies; only chunks of several rows are grouped."""
    tables.bounded_batches(texts.sparkSession)
    one = texts.where("rows = 1").select("chunk", "access", column.alias("held"))
    single = one.mapInArrow(occurrences, "term string, chunk long, access long, n long").withColumnRenamed("term", term)
    several = texts.where("rows > 1").select(F.explode(column).alias(term), "chunk", "access")
    return single.unionByName(several.groupBy(term, "chunk", "access").agg(F.count(F.lit(1)).alias("n")))


def postings(texts: DataFrame, stemmer: str) -> DataFrame:
    """term, chunk, access, n of texts (text, chunk, access, rows): how often each stem occurs in each chunk."""
    if stemmer == "light":  # cheaper than a join
        return counted(texts, T.content_terms(F.col("text")), "term")
    words = F.filter(T.tokens(F.col("text")), lambda w: ~w.isin(T.STOPWORDS))
    held = tables.settled(counted(texts, words, "word"), "words")
    met = tables.matched(held, stems(held, stemmer), "word", F.col("chunk"))
    return met.groupBy("term", "chunk", "access").agg(F.sum("n").alias("n"))


def build(chunks: DataFrame, path: str, stemmer: str = "light") -> None:
    """Writes an index of chunks (chunk_id, collection_id, text) to a new folder."""
    ids = numbered(chunks, "chunk_id", "chunk", f"{path}/chunks")
    codes = numbered(chunks, "collection_id", "access", f"{path}/collections")
    coded = tables.matched(chunks.select("chunk_id", "collection_id", "text"), codes.select("collection_id", "access"), "collection_id", F.col("chunk_id")).join(ids, "chunk_id")
    rows = postings(coded.select("chunk", "access", "rows", "text"), stemmer).withColumn("bucket", bucket(F.col("term")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk").write.partitionBy("bucket").parquet(f"{path}/postings")
    terms(chunks.sparkSession, path, stored=False).write.parquet(f"{path}/terms")


def terms(spark: SparkSession, path: str, stored: bool = True) -> DataFrame:
    """term, df, total, most of an index."""
    if stored:
        return spark.read.parquet(f"{path}/terms")
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"), F.max("n").alias("most"))


def asked_terms(questions: DataFrame, stemmer: str = "light") -> DataFrame:
    """query_id, sub, term: the stems of each question (query_id, sub, question)."""
    words = T.tokens(F.col("question"))
    kept = F.array_distinct(F.filter(words, lambda t: ~t.isin(T.STOPWORDS) & (F.length(t) >= 2)))
    rows = questions.select("query_id", "sub", F.explode(kept).alias("word"))
    if stemmer == "light":
        return rows.select("query_id", "sub", T.stem(F.col("word")).alias("term")).distinct()
    return tables.matched(rows, stems(rows, stemmer), "word", F.col("query_id")).select("query_id", "sub", "term").distinct()


def of_terms(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The postings of the wanted terms (term): by buckets and names where they are few, else by a join."""
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    named = wanted.select("term", bucket(F.col("term")).alias("bucket")).limit(NAMED + 1).collect()
    if len(named) > NAMED:
        return rows.join(wanted, "term", "left_semi")
    return rows.where(F.col("bucket").isin(sorted({r.bucket for r in named})) & F.col("term").isin(sorted({r.term for r in named})))


def search(path: str, questions: DataFrame, allowed: DataFrame, k: int = 40, stemmer: str = "light") -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks with most matching positions n, scored 0.1 n / (1 + 0.1 n); ties by id.

    questions: query_id, sub, question; allowed: sub, collection_id. The access filter comes before anything is added up or
    ranked; postings aren't shuffled, but sums of matches are."""
    spark = questions.sparkSession
    asked = tables.settled(asked_terms(questions, stemmer), "asked")
    codes = spark.read.parquet(f"{path}/collections").select("access", "collection_id")
    may = allowed.select("sub", "collection_id").distinct().join(codes, "collection_id").select("sub", "access")
    hits = tables.matched(of_terms(spark, path, asked.select("term").distinct()), asked, "term", F.col("chunk"))
    seen = hits.join(F.broadcast(may) if tables.few(may) else may, ["sub", "access"], "left_semi")
    counted = seen.groupBy("query_id", "chunk").agg(F.sum("n").alias("n"))
    first = tables.settled(best(counted, k, "n", tie="chunk"), "hits")
    named = spark.read.parquet(f"{path}/chunks").join(F.broadcast(first) if tables.few(first) else first, "chunk")
    return named.select("query_id", "chunk_id", (0.1 * F.col("n") / (1 + 0.1 * F.col("n"))).alias("score"), "rank")
