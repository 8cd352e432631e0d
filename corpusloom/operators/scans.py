"""Running sums and carried values over a whole table, without a task that gets a group or the table whole.

Rows are dealt by range; each range is folded by itself, and what lies before a range, a row or two for each, is
broadcast: a range holds only one group that began before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources import tables


def dealt(rows: DataFrame, order: list[Column], kind: str) -> DataFrame:
    """rows, written, with the number `deal` of the range that each is in."""
    return tables.settled(rows.repartitionByRange(*order).withColumn("deal", F.spark_partition_id()), kind)


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], kind: str) -> DataFrame:
    """rows with, under each name, the sum of a column (long) over all rows that come before in this total order."""
    ranges = dealt(rows, order, kind)
    ahead = Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy("deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = ranges.groupBy("deal").agg(*(F.sum(c).cast("long").alias(f"{name}_") for name, c in sums.items()))
    starts = totals.select("deal", *(F.coalesce(F.sum(f"{name}_").over(ahead), zero).alias(f"{name}_") for name in sums))
    inside = ranges.withColumns({name: F.coalesce(F.sum(c).over(local), zero) for name, c in sums.items()})
    met = inside.join(F.broadcast(starts), "deal")
    return met.withColumns({name: F.col(name) + F.col(f"{name}_") for name in sums}).drop("deal", *(f"{name}_" for name in sums))


def with_last_before(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value that isn't null among the earlier rows of the same group (`by`, null is a group), in a total order."""
    ranges = dealt(rows.withColumn("value_", value), [F.col(c) for c in (*by, *order)], "runs")
    place = F.when(F.col("value_").isNotNull(), F.struct(*order))
    ends = ranges.groupBy(*by, "deal").agg(F.max_by("value_", place).alias("last_"))
    ahead = Window.partitionBy(*by).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry_", F.last("last_", ignorenulls=True).over(ahead)).where("carry_ IS NOT NULL")
    starts = carried.select(*(F.col(c).alias(f"{c}_") for c in by), F.col("deal").alias("deal_"), "carry_")
    same = F.col("deal") == F.col("deal_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    local = Window.partitionBy(*by, "deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranges.withColumn("local_", F.last("value_", ignorenulls=True).over(local)).join(F.broadcast(starts), same, "left")
    return met.withColumn(name, F.coalesce("local_", "carry_")).drop("deal", "deal_", "value_", "local_", "carry_", *(f"{c}_" for c in by))


#: Accuracy of the sketch that brackets a percentile, and how far, as a share of a group's rows, the bracket reaches.
ACCURACY, MARGIN = 10_000, 0.0005
#: Groups of so many rows are their own bracket: in larger ones MARGIN is several ranks more than the sketch can err.
SMALL = 10_000


def percentiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """by, share, percentile: exact interpolated percentiles of the values (nulls aside) of each group.

    A first pass counts groups and brackets each percentile by a mergeable sketch; a second one counts what lies below the
    bracket. Of the values inside, about 2 * MARGIN of a group, those at the two ranks next to the percentile are
    taken by running sums: no task holds the values of a group."""
    given = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("group"), F.col(value).cast("double").alias("x"))
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-MARGIN, MARGIN)]
    sketch = F.percentile_approx("x", ends, ACCURACY).alias("sketch")
    groups = tables.settled(given.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), sketch), "groups")
    small, n = F.col("n") <= SMALL, F.col("n")
    bracket = [
        F.struct(
            F.lit(s).alias("share"), (F.lit(s) * (n - 1)).alias("rank"),
            F.when(small | F.lit(s <= MARGIN), F.col("least")).otherwise(F.col("sketch")[2 * k]).alias("low"),
            F.when(small | F.lit(s >= 1 - MARGIN), F.col("most")).otherwise(F.col("sketch")[2 * k + 1]).alias("high"),
        ) for k, s in enumerate(shares)
    ]
    brackets = groups.select("group", F.explode(F.array(*bracket)).alias("b")).select("group", "b.*")
    placed = tables.matched(given, brackets, "group", F.col("x")).where("x <= high")
    below = placed.groupBy("group", "share", "rank").agg(F.count_if(F.col("x") < F.col("low")).alias("below"))
    inside = placed.where("x >= low").groupBy("group", "share", "x").agg(F.count(F.lit(1)).alias("times"))
    summed = tables.settled(with_sums_before(inside, [F.col("group"), F.col("share"), F.col("x")], {"before": F.col("times")}, "inside"), "summed")
    starts = summed.groupBy("group", "share").agg(F.min("before").alias("start")).withColumnsRenamed({"group": "g", "share": "s"})
    facts = below.join(starts, F.col("group").eqNullSafe(F.col("g")) & (F.col("share") == F.col("s"))).drop("g", "s")
    key = F.struct("group", "share")
    met = tables.matched(summed.withColumn("key", key), tables.settled(facts.select(key.alias("key"), "rank", "below", "start"), "ranks"), "key", F.col("x"))
    first = F.col("below") + F.col("before") - F.col("start")
    at = lambda r: F.max(F.when((r >= first) & (r < first + F.col("times")), F.col("x")))
    low, high = F.floor("rank"), F.ceil("rank")
    found = met.groupBy("key", "rank").agg(at(low).alias("a"), at(high).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return found.select(F.col("key.group").alias(by), F.col("key.share").alias("share"), value_at.alias("percentile"))
