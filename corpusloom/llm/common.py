"""What the corpus operators share: the folder for intermediate tables, keys, and the size of batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write; taken from the session. Only a session of one machine needs to name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame, kind: str, by: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read back, so that later
    stages neither recompute them nor depend on the executors that made them. by: a column that later filters name, in
    folders of its own."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def done_with(*tables: DataFrame) -> None:
    """Removes tables that settled() wrote and nothing will read again. Tables of other origin stay."""
    for df in tables:
        spark = df.sparkSession
        for folder in {re.sub(r"/\w+=[^/]*$", "", f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
            if not re.search(r"/[a-z-]+-[0-9a-f]{32}$", folder):
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def below(wanted: int, among: int) -> int:
    """A bound on xxhash64 values under which some four times `wanted` of `among` distinct ones lie, so that a sample of the
    smallest hashes takes as many rows from each task as there are in the whole sample, not in each task."""
    low, high = -(1 << 63), (1 << 63) - 1
    return high if among <= 4 * wanted else low + (1 << 64) * 4 * wanted // among


#: Bytes of an Arrow batch on its way to a Python worker. A batch takes its size several times over, in the
#: executor and in the worker; a longer single row is a batch of its own.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches to BATCH_BYTES; a lower one, given in plain bytes, stays.
    Rows are unaffected."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that this Python worker has freed back to the system: workers serve one task after the other, and what one
    has taken would add to what the next one takes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that releases memory when it is through."""
    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        release()

    return run


#: Keys of documents without an id start here.
NAMELESS = 1 << 62


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The id, or for a null one a number made from the text, above all ids in use."""
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2) + F.lit(NAMELESS)
    return F.coalesce(F.col(doc_id).cast("long"), by_text)


#: Distinct keys whose facts are broadcast; with more, rows meet them under salted keys.
FACTS, SALTS = 100_000, 32


def with_facts(rows: DataFrame, facts: DataFrame, key: str, salt: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of facts, which holds one row for each value of key (null is a value) and is cheap to read
    again. A key may hold any share of the rows: facts of few keys are broadcast, else each is copied to SALTS
    keys and the rows of a key are dealt over them by `salt`."""
    other = facts.withColumnRenamed(key, "key_")
    same = F.col(key).eqNullSafe(F.col("key_"))
    if facts.limit(FACTS + 1).count() <= FACTS:
        return rows.join(F.broadcast(other), same, how).drop("key_")
    spread = other.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    return dealt.join(spread, same & (F.col("salt") == F.col("salt_")), how).drop("key_", "salt", "salt_")
