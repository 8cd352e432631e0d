"""Intermediate tables in the folder that all executors share, and joins with facts about keys of any size."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints"
#: Keys whose facts are broadcast; with more, rows meet them under salted keys.
FACTS, SALTS = 100_000, 32
#: Numbers that are broadcast as a set, so that texts stay where they are; with more, both sides are shuffled.
NUMBERS = 5_000_000
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 2 << 20


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that the session names in spark.checkpoint.dir; only a session of one machine needs to name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or LOCAL_SHARED).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame, kind: str) -> DataFrame:
    """The rows of df, written once and read back."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches to BATCH_BYTES, so that Python workers hold no more of long texts; a lower one, given in
    plain bytes, stays. Rows are unaffected."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def few(df: DataFrame, most: int = FACTS) -> bool:
    """Whether df has at most so many rows; reads no more than one above."""
    return df.limit(most + 1).count() <= most


def as_set(keys: DataFrame) -> DataFrame:
    """keys (one column, cheap to read again) as the right side of a semi or anti join: broadcast if they are few, or up to NUMBERS longs."""
    short = keys.schema[0].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.broadcast(keys) if keys.count() <= (NUMBERS if short else FACTS) else keys


def matched(rows: DataFrame, facts: DataFrame, key: str, salt: Column) -> DataFrame:
    """rows joined with facts on key, null being a value. A key may hold any share of the rows: a few facts are broadcast, else each
    is copied to SALTS keys over which `salt` deals the rows. facts should be cheap to read again."""
    other = facts.withColumnRenamed(key, "key_")
    same = F.col(key).eqNullSafe(F.col("key_"))
    if few(facts):
        return rows.join(F.broadcast(other), same).drop("key_")
    spread = other.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.withColumn("dealt_", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    return salted.join(spread, same & (F.col("dealt_") == F.col("salt_"))).drop("key_", "dealt_", "salt_")
