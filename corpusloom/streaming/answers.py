"""Stateful streams of answers and documents: citations as they become known, idle pings, and budgets that refuse.

Each works on micro-batches with state by key in Spark's state store, so a restarted query goes on where it was, and what a
key holds is bounded: 64 signs and the numbers seen of an answer, a time of a channel, two numbers of a user and day.
Within a micro-batch the rows of a key are put in order; between batches they are expected in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Signs kept of what came before, so that a citation may be cut anywhere; seconds without an event before a ping.
TAIL, IDLE = 64, 15
CITATION = re.compile(r"\[(\d{1,9})\]")


def new_citations(tail: str, text: str, seen: set[int], most: int) -> tuple[str, list[int]]:
    """The tail to keep, and the numbers from 1 to most that a further part makes known for the first time."""
    whole, found = tail + text, []
    for m in CITATION.finditer(whole):
        n = int(m[1])
        if m.end() > len(tail) and 1 <= n <= most and n not in seen:
            seen.add(n)
            found.append(n)
    return whole[-TAIL:], found


def stream_citations(parts: DataFrame) -> DataFrame:
    """chat.citations_seen() of a stream of parts (query_id, place, text, n_sources): query_id, place, n, each source of an answer once,
    with the part at whose end it is known. State of an answer ends `late` after its last part (see the watermark of parts, if any)."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen = state.get if state.exists else ("", [])
        numbers, out = set(seen), []
        for row in pd.concat(list(batches)).sort_values("place").itertuples():
            tail, found = new_citations(tail, row.text or "", numbers, row.n_sources)
            out += [(key[0], row.place, n) for n in found]
        state.update((tail, sorted(numbers)))
        yield pd.DataFrame(out, columns=["query_id", "place", "n"])

    rows = parts.select("query_id", "place", "text", "n_sources").groupBy("query_id")
    result = f"query_id {kinds['query_id']}, place {kinds['place']}, n int"
    return rows.applyInPandasWithState(each, result, "tail string, seen array<int>", "append", GroupStateTimeout.NoTimeout)


def with_pings(events: DataFrame, late: str = "0 seconds", idle: int = IDLE) -> DataFrame:
    """sub, ts, event, document_id: a stream of events (sub, ts, event, document_id) and, for each user who has had none for `idle` seconds,
    an event `ping` at that time, once for each idle stretch. Times are those of the events: a timer fires once the
    watermark has passed it, so replays give the same rows."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["sub", "ts", "event", "document_id"]
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="us") + pd.Timedelta(seconds=idle), "ping", None)], columns=columns)
            return
        last, out = (state.get[0] if state.exists else None), []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            at = int(row.ts.value // 1000)
            if last is not None and at - last > idle * 1_000_000:
                out.append((key[0], pd.Timestamp(last, unit="us") + pd.Timedelta(seconds=idle), "ping", None))
            out.append((key[0], row.ts, row.event, row.document_id))
            last = at if last is None else max(last, at)
        state.update((last,))
        # beyond the time itself, as a timer fires when the watermark is later
        state.setTimeoutTimestamp(max(last // 1000 + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    result = f"sub {kinds['sub']}, ts timestamp, event string, document_id {kinds['document_id']}"
    rows = events.withWatermark("ts", late).select("sub", "ts", "event", "document_id").groupBy("sub")
    return rows.applyInPandasWithState(each, result, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_budget(usage: DataFrame, budget: float, late: str = "1 hour") -> DataFrame:
    """limits.running_budget() with its refusals, of a stream of usage (user_id, event_id, ts, value): user_id, event_id, ts, used (that day so
    far, this row included) and refused (the budget was used up before it). State of a day ends when the watermark passes its end."""
    kinds = {f.name: f.dataType.simpleString() for f in usage.schema}

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["user_id", "event_id", "ts", "used", "refused"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        used = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for row in rows.itertuples():
            before, used = used, used + (0.0 if pd.isna(row.value) else row.value)
            out.append((key[0], row.event_id, row.ts, used, before >= budget))
        state.update((used,))
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).value // 1_000_000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    days = usage.withWatermark("ts", late).select("user_id", F.date_trunc("day", "ts").alias("day"), "event_id", "ts", F.col("value").cast("double").alias("value"))
    result = f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, ts timestamp, used double, refused boolean"
    return days.groupBy("user_id", "day").applyInPandasWithState(each, result, "used double", "append", GroupStateTimeout.EventTimeTimeout)
