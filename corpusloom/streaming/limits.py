"""Rate and budget limits, for batches and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def minute_counts(events: DataFrame, most: int = 20) -> DataFrame:
    """user_id, minute, n, refused: requests of each user in each minute. events: user_id, ts. Works on a
    stream with a watermark as well as on a batch."""
    counted = events.groupBy("user_id", F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("window.start").alias("minute"), "n", (F.col("n") > most).alias("refused"))


def running_budget(events: DataFrame, amount: str = "value") -> DataFrame:
    """events with `used`: what the user has used up that day so far, this event included."""
    so_far = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("used", F.sum(amount).over(so_far))


def stream_minute_counts(stream: DataFrame, late: str = "10 minutes", most: int = 20) -> DataFrame:
    """minute_counts() of an event stream; minutes are emitted once the watermark passes them."""
    return minute_counts(stream.withWatermark("ts", late), most)


def visible_events(stream: DataFrame, readable: DataFrame) -> DataFrame:
    """Document events, a copy for each principal that may read the collection: a stream joined to a table."""
    return stream.join(readable.select("sub", "collection_id"), "collection_id")


def document_events(events: DataFrame, documents: DataFrame, readable: DataFrame) -> DataFrame:
    """visible_events() of events (document_id, collection_id) of which some don't name their collection: it is the document's
    (documents: document_id, collection_id). Works on a stream as on a batch."""
    of = documents.select("document_id", F.col("collection_id").alias("__of"))
    named = events.join(of, "document_id", "left").withColumn("collection_id", F.coalesce("collection_id", "__of")).drop("__of")
    return visible_events(named, readable)


def status_events(stream: DataFrame) -> DataFrame:
    """What a client is sent: an event `ready` for each status change (document_id, status, ts) to ready, `status` for the others;
    a repeated status within an hour is sent once."""
    once = stream.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["document_id", "status"])
    return once.withColumn("event", F.when(F.col("status") == "ready", "ready").otherwise("status"))
