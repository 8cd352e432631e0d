"""Tables whose documents are swapped in one commit: versions, a manifest for each, and readers that stay with theirs.

A table is a folder. `data` holds folders that are written once and never changed; `versions` a manifest for each version, which
names the folders of each bucket of documents. A commit writes the next rows of the buckets that it touches beside the old ones
and then one manifest, by a rename that fails if that version exists already. So a reader sees all of a commit or nothing of
it, a writer that dies leaves only folders that no manifest names, and of two writers the second one finds its version
taken, takes the new rows of the buckets that the first has touched, and tries again: neither loses its documents.

The folder has to be in a store with an atomic rename that doesn't overwrite, such as HDFS or a local disk.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.sources import tables

BUCKETS = 64


class Taken(Exception):
    """Another writer has committed this version."""


def files(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    """The path for Hadoop, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    at, fs = files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in listed(spark, f"{path}/versions") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """key, buckets (their number), schema and folders: by bucket the folder that holds its rows."""
    at, fs = files(spark, f"{path}/versions/{version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def committed(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes a version, or raises Taken."""
    held, fs = files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    stream = fs.create(held, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), spark._jsc.hadoopConfiguration())
    final, _ = files(spark, f"{path}/versions/{version:012d}.json")
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(held, final, none)
    except Exception as e:
        fs.delete(held, False)
        if fs.exists(final):
            raise Taken(version) from e
        raise


def written(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """Writes rows to a new folder of data; by bucket the folder of its rows."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)))
    placed.hint("rebalance", "bucket_").write.partitionBy("bucket_").parquet(f"{path}/{name}")
    found = [n for n in listed(spark, f"{path}/{name}") if n.startswith("bucket_=")]
    return {n.removeprefix("bucket_="): f"{name}/{n}" for n in found}


def create(rows: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS) -> int:
    """A new table of these rows; its first version."""
    content = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": written(rows, path, key, buckets)}
    committed(rows.sparkSession, path, 1, content)
    return 1


def of_folders(spark: SparkSession, path: str, content: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    folders = [f"{path}/{f}" for b, f in sorted(content["folders"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named; later commits don't change them."""
    return of_folders(spark, path, manifest(spark, path, version or versions(spark, path)[-1]))


def replace(spark: SparkSession, path: str, documents: DataFrame, rows: DataFrame, tries: int = 20) -> int:
    """The version in which the documents (a column, the table's key) have these rows and no others, and all other documents theirs.
    A document without rows goes. rows may be computed from the table itself."""
    version = versions(spark, path)[-1]
    base = manifest(spark, path, version)
    key, buckets = base["key"], base["buckets"]
    wanted = tables.settled(documents.select(key).where(F.col(key).isNotNull()).distinct(), "wanted")
    named = tables.as_set(wanted)
    touched = {str(r.b) for r in wanted.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b")).distinct().collect()}
    new = rows.select(*StructType.fromJson(base["schema"]).names).join(named, key, "left_semi")
    made: dict[str, tuple[str | None, str | None]] = {}  # by bucket the folder that was read and the one that was made of it
    for turn in range(tries):
        stale = {b for b in touched if b not in made or made[b][0] != base["folders"].get(b)}
        if stale:
            here = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string").isin(sorted(stale))
            kept = of_folders(spark, path, base, stale).join(named, key, "left_anti")
            fresh = written(kept.unionByName(new.where(here)), path, key, buckets)
            made |= {b: (base["folders"].get(b), fresh.get(b)) for b in stale}
        folders = {b: f for b, f in base["folders"].items() if b not in touched} | {b: f for b, (_, f) in made.items() if f}
        try:
            committed(spark, path, version + 1, base | {"folders": folders})
            return version + 1
        except Taken:
            time.sleep(0.05 * turn)
            version = versions(spark, path)[-1]
            base = manifest(spark, path, version)
    raise Taken(f"no version was free in {tries} tries")


def vacuum(spark: SparkSession, path: str, keep: int = 2, hours: float = 24) -> list[str]:
    """Removes all versions but the last `keep`, and the folders that no version names and that are older than `hours`, in which a
    writer might still be at work; returns these folders."""
    old, last = versions(spark, path)[:-keep], versions(spark, path)[-keep:]
    used = {f.split("/")[1] for v in last for f in manifest(spark, path, v)["folders"].values()}
    for v in old:
        at, fs = files(spark, f"{path}/versions/{v:012d}.json")
        fs.delete(at, False)
    gone = []
    for name in listed(spark, f"{path}/data"):
        at, fs = files(spark, f"{path}/data/{name}")
        if name not in used and fs.getFileStatus(at).getModificationTime() < (time.time() - hours * 3600) * 1000:
            fs.delete(at, True)
            gone.append(name)
    return gone
