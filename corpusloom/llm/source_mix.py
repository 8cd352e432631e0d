"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Targets. Sources share the words of all documents by their weights; a target stops at MOST times its source's
   size, and the excess is shared again by weight until none is above. In order of MOST * size / weight the stopped
   sources come first, so prefix sums over the sources give the level of the others in one pass.
2. Shards. A source is dealt by hashes of its documents to as many shards as its words and rows need, so that a hot
   source is many shards and no task meets more than one of them at a time. In a shard, documents stand in
   seeded order and their words form blocks of BLOCK words, the last of them shorter.
3. Quotas. All shards compete for the blocks: shard c wants v = target / size of its source times its n blocks, and
   block i goes to it by the quotient v / (i - 1/2); the highest quotients win, MOST * n at most. The quotient that
   parts winners from losers is found by counting, for a grid of bounds at a time; only the seats within the
   last bracket are ranked one by one, by prefix sums over a range partitioning.
4. Selection. A shard with quota q takes all of its words q div n times and another q mod n blocks, spread evenly from a
   seeded start: block i is taken where (i * r + u) div n rises. So the words that a document gives follow from its place
   alone, and no blocks are made as rows.

Defined results: null texts have no words; null sources are one source, the last; repeated rows stand one after the
other and each gives its own words; documents without words give none, and their source's target is 0 where all its
texts are such; an empty table gives no rows. Extra columns aren't read. Hashes include id and text, so
documents under one id or none are dealt apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, with_facts

#: Words, weights by place of the source, and the most a document is repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK = 32
#: Words and rows of a shard, about.
SHARD_WORDS, SHARD_ROWS = 1 << 18, 1 << 12
#: Votes are counted in millionths of a block, as integers.
UNIT = 1_000_000
#: Bounds tried in one pass, seats that are ranked one by one, and passes at most.
GRID, FEW, PASSES = 64, 100_000, 9


def long_of(digest: Column) -> Column:
    """A number below 2 ** 32 from the first hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], kind: str) -> DataFrame:
    """rows with, under each name, the sum over all rows that come before in this (total) order: ranges are summed by
    themselves, and what lies before a range, a row for each, is broadcast."""
    dealt = settled(rows.repartitionByRange(*order).withColumn("deal", F.spark_partition_id()), kind)
    ahead = Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy("deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = dealt.groupBy("deal").agg(*(F.sum(c).cast("long").alias(f"{name}_") for name, c in sums.items()))
    starts = ranges.select("deal", *(F.coalesce(F.sum(f"{name}_").over(ahead), zero).alias(f"{name}_") for name in sums))
    inside = dealt.withColumns({name: F.coalesce(F.sum(c).over(local), zero) for name, c in sums.items()})
    met = inside.join(F.broadcast(starts), "deal")
    return met.withColumns({name: F.col(name) + F.col(f"{name}_") for name in sums}).drop("deal", *(f"{name}_" for name in sums))


def entries(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size (words), place (the seeded order) and copies of each different row of docs."""
    text = F.coalesce("text", F.lit(""))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    sized = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place.alias("place"))
    return sized.groupBy("doc_id", "source", "size", "place").agg(F.count(F.lit(1)).alias("copies"))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, rank (by code points, null last), source_size, target and shards of each source of the entries."""
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = with_sums_before(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "sources")
    # long, as a weight times the words of all sources passes 2 ** 31
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    cap, named = F.col("source_size") * most, ranked.withColumn("weight", weight)
    level = named.withColumn("level", cap / F.col("weight"))
    filled = settled(with_sums_before(level, [F.col("level"), F.col("rank")], {"stopped": cap, "weight_before": F.col("weight")}, "levels"), "levels")
    words, weight_sum = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weight = F.lit(words) - F.col("stopped"), F.lit(weight_sum) - F.col("weight_before")
    first = filled.where(F.col("level") >= left / open_weight).agg(F.min(F.struct("level", "rank", left.alias("left"), open_weight.alias("open"))).alias("at")).first().at
    share = F.col("weight") * F.lit(first.left if first else 0) / F.lit(first.open if first else 1)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_rows") / SHARD_ROWS))
    return settled(filled.select("source", "rank", "source_size", F.least(cap.cast("double"), share).alias("target"), shards.cast("long").alias("shards")), "targets")


def seats(bound: Column | float, most: int) -> Column:
    """Blocks of a shard whose quotients reach the bound."""
    return F.floor(F.least(F.col("n") * most * 1.0, F.col("votes") / bound + 0.5))


def quotas(cells: DataFrame, most: int = MOST) -> DataFrame:
    """cells (rank, shard, n, votes) with quota: the shares of round(sum of votes) blocks by highest quotients, ties to lower
    ranks and shards."""
    total, greatest = cells.agg(F.coalesce(F.sum("votes"), F.lit(0)), F.coalesce(F.max("votes"), F.lit(0))).first()
    wanted = (total + UNIT // 2) // UNIT
    if not wanted:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    # seats at `low` are enough, seats at `high` not too many
    low, high, above = 1e-9, 4.0 * greatest, 0
    for _ in range(PASSES):
        grid = [low * math.exp(math.log(high / low) * k / GRID) for k in range(1, GRID)]
        counts = [int(x or 0) for x in cells.agg(*(F.sum(seats(F.lit(x), most)).alias(f"at{k}") for k, x in enumerate(grid))).first()]
        enough = max((k for k, c in enumerate(counts) if c >= wanted), default=-1)
        within = (counts[enough] if enough >= 0 else None, counts[enough + 1] if enough + 1 < len(grid) else above)
        low, high, above = grid[enough] if enough >= 0 else low, grid[enough + 1] if enough + 1 < len(grid) else high, within[1]
        if within[0] is not None and within[0] - above <= FEW:
            break
    sure = cells.withColumns({"sure": seats(F.lit(high), most), "likely": seats(F.lit(low), most)})
    open_ = sure.where("likely > sure").select("rank", "shard", "votes", F.explode(F.sequence(F.col("sure") + 1, F.col("likely"))).alias("i"))
    quotient = open_.withColumn("quotient", F.col("votes") / (F.col("i") - 0.5))
    order = [F.col("quotient").desc(), F.col("rank"), F.col("shard"), F.col("i")]
    ranked = with_sums_before(quotient, order, {"better": F.lit(1)}, "seats")
    won = ranked.where(F.col("better") < wanted - above).groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("won"))
    return sure.join(won, ["rank", "shard"], "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "likely", "won")


def words_before(at: Column) -> Column:
    """Words that the blocks selected beyond whole laps take from the first `at` words of a shard."""
    block, rest = F.floor(at / BLOCK), at % BLOCK
    return BLOCK * chosen_before(block) + F.when(chosen_before(block + 1) > chosen_before(block), rest).otherwise(0)


def chosen_before(block: Column) -> Column:
    """Selected ones among the first `block` blocks of a shard."""
    return F.call_function("div", block * F.col("extra") + F.col("start"), F.greatest(F.col("n"), F.lit(1)))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, laps (times that the mix takes the whole text), spans (word ranges [begin, end) that
    it takes once more) and taken (words in all) of each row of docs (doc_id, source, text)."""
    rows = settled(entries(docs, seed), "entries")
    sources = targets(rows, weights, most)
    placed = with_facts(rows, sources, "source", F.col("place")).withColumn("shard", long_of(F.col("place")) % F.col("shards"))
    sums = placed.groupBy("rank", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("cell"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    n = F.ceil(F.col("cell") / BLOCK).cast("long")
    votes = F.when(F.col("cell") > 0, F.floor(F.col("target") / F.col("source_size") * F.col("n") * UNIT)).otherwise(0).cast("long")
    cells = settled(sums.withColumn("n", n).withColumn("votes", votes).select("rank", "shard", "n", "votes"), "cells")
    some = F.greatest(F.col("n"), F.lit(1))  # shards without words have no blocks and no quota
    start = long_of(F.md5(F.concat_ws(":", F.lit(seed), "rank", "shard"))) % some
    drawn = quotas(cells, most).select(
        "rank", "shard", "n", F.call_function("div", F.col("quota"), some).alias("laps"), (F.col("quota") % some).alias("extra"), start.alias("start")
    )
    cell = Window.partitionBy("rank", "shard").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(cell), F.lit(0))
    each = placed.join(drawn, ["rank", "shard"]).withColumn("before", before)
    copy = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    begin = F.col("before") + (F.col("copy") - 1) * F.col("size")
    at = copy.withColumns({"begin": begin, "end": begin + F.col("size")})
    more = F.when((F.col("size") > 0) & (F.col("extra") > 0), words_before(F.col("end")) - words_before(F.col("begin"))).otherwise(0)
    inside = F.filter(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)), lambda i: chosen_before(i + 1) > chosen_before(i))
    spans = F.transform(inside, lambda i: F.struct(
        (F.greatest(i * BLOCK, F.col("begin")) - F.col("begin")).alias("begin"), (F.least((i + 1) * BLOCK, F.col("end")) - F.col("begin")).alias("end")))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return at.select(
        "doc_id", "source", "size", "source_size", "target", "laps", F.when(more > 0, spans).otherwise(none).alias("spans"),
        (F.col("laps") * F.col("size") + more).cast("long").alias("taken"),
    )
