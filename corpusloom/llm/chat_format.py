"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as `assistant`
and the others as named users; system turns stay system turns. The masks are the spans, in code points,
of what the assistant says, with the mark that ends it: the part a model is trained on.

A rendering comes in parts of PART turns by turn number, so that a conversation of any length needs no
task to hold it whole; `part_start` is the part's offset in the whole rendering, and mask spans count from
there. Nearly all conversations are one part. Where turn numbers repeat, as under a null or reused conv_id, or are
null, a part can have more rows: then it comes in cuts of PART rows, one row of the result each, with the same `part`
and ascending `part_start`. Rows are numbered for that by prefix sums over a range partitioning, so
no task gets a conversation whole.

Defined results: turns are ordered by turn, role and text, nulls first; repeated rows are rendered as
often as they occur; a null text is an empty one; rows with a null role are spoken by `unknown`; rows with
a null conv_id form one conversation; a conversation of system turns only has no participant and no row.
Marks inside texts are spaced out so that they can't end a turn, and line feeds in names are spaces. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

PART = 256
#: First signs of a text that rows are dealt by; the rest of the order is local.
PREFIX = 64


def neutral(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")


def one_line(name: Column) -> Column:
    """A name that can't end the line it stands on."""
    return F.regexp_replace(name, r"[\r\n]+", " ")


def in_cuts(rows: DataFrame, most: int) -> DataFrame:
    """rows (conv_id, part, turn, role, said) once each with `cut`, the number of each run of `most` rows of the part,
    and `copies`, how often the row stands in it."""
    group, order = ["conv_id", "part"], ["turn", "role", "said"]
    once = rows.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("times"))
    ranges = once.repartitionByRange("conv_id", "turn", "role", F.substring("said", 1, PREFIX))
    dealt = settled(ranges.withColumn("deal", F.spark_partition_id()), "turns")
    total = dealt.groupBy(*group, "deal").agg(F.sum("times").alias("n"))
    before = Window.partitionBy(*group).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = total.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("deal").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy(*group, "deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("local", F.sum("times").over(here))
    placed = local.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("deal") == F.col("d")))
    end = F.col("before") + F.col("local")
    runs = placed.withColumns({"end": end, "begin": end - F.col("times")})
    first, last = F.floor(F.col("begin") / most), F.floor((F.col("end") - 1) / most)
    cut = runs.withColumn("cut", F.explode(F.sequence(first, last)))
    copies = F.least("end", (F.col("cut") + 1) * most) - F.greatest("begin", F.col("cut") * most)
    return cut.select(*group, *order, "cut", copies.cast("int").alias("copies"))


def render(turns: DataFrame, part_turns: int = PART) -> DataFrame:
    """turns: conv_id, turn, role, text. A row for each conversation, perspective and part (or cut of one): conv_id,
    perspective, part, part_start, n_turns, n_masked (code points), masks ("start:end" joined by
    commas), text."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("said"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
    )
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("id"), F.col("role").alias("perspective")).distinct()
    seen = in_cuts(rows, part_turns).join(speakers, F.col("conv_id").eqNullSafe(F.col("id")))
    own, system = F.col("role") == F.col("perspective"), F.col("role") == "system"
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(system, F.lit("<|im_start|>system\n"))
    head = head.otherwise(F.concat(F.lit("<|im_start|>user name="), one_line(neutral(F.col("role"))), F.lit("\n")))
    pieces = seen.withColumns({"head": head, "body": F.concat(neutral(F.col("said")), F.lit("<|im_end|>"))})
    keys = ["conv_id", "perspective", "part", "cut"]
    item = F.struct("turn", "role", "said", "head", "body", own.alias("own"), "copies")
    items = F.flatten(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.array_repeat(x, x["copies"])))
    parts = pieces.groupBy(*keys).agg(items.alias("items"))
    # spans: a left fold that carries the offset reached so far
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("masked"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            (acc["masked"] + F.when(x["own"], F.length(x["body"])).otherwise(0)).cast("long").alias("masked"),
        )

    folded = parts.select(
        *keys, F.size("items").cast("long").alias("n_turns"), F.aggregate("items", start, step).alias("fold"),
        F.array_join(F.transform("items", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
    )
    size = pieces.groupBy(*keys).agg(F.sum((F.length("head") + F.length("body") + 1) * F.col("copies")).alias("size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part", "cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = size.select(*(F.col(k).alias(f"{k}_") for k in keys), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("part_start"))
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_"))
    for k in keys[1:]:
        same &= F.col(k) == F.col(f"{k}_")
    return folded.join(starts, same).select(
        *keys[:3], "part_start", "n_turns",
        F.col("fold.masked").alias("n_masked"), F.array_join("fold.spans", ",").alias("masks"), "text",
    )
