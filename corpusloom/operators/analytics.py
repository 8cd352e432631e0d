"""Usage analytics over query logs, feedback and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import scans


def rounded(x: Column, places: int) -> Column:
    """Half up, of the value as a decimal of six places: what lies below is noise of the order of summation."""
    return F.round(x.cast("decimal(18,6)"), places).cast("double")


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Both ends belong to the window."""
    return at.between(start, end)


def wide(found: DataFrame, by: str, names: dict[float, str]) -> DataFrame:
    """scans.percentiles() with a column for each share."""
    return found.groupBy(F.col(by).alias("group")).agg(*(rounded(F.max(F.when(F.col("share") == s, F.col("percentile"))), 2).alias(name) for s, name in names.items()))


def timings(logs: DataFrame) -> DataFrame:
    """step, ms: the timings map of the logs as rows."""
    return logs.select(F.explode("timings_ms").alias("step", "ms"))


def overview(logs: DataFrame) -> DataFrame:
    """One row: questions, users, outcomes, costs, latency percentiles and derived ratios."""
    n, refused = F.count(F.lit(1)), F.count_if(F.col("outcome") == "no_answer")
    cost = F.coalesce(F.sum("cost_usd"), F.lit(0))
    ratio = lambda x, places: F.when(n > 0, rounded(x / n, places)).otherwise(0.0)
    counts = logs.agg(
        n.alias("questions"), F.countDistinct("user_sub").alias("users"), F.count_if(F.col("outcome") == "answered").alias("answered"),
        refused.alias("no_answer"), F.count_if(F.col("outcome") == "error").alias("errors"), ratio(refused, 4).alias("no_answer_rate"),
        rounded(cost, 4).alias("cost_usd"), ratio(cost, 6).alias("cost_per_question"),
    )
    found = scans.percentiles(timings(logs).where(F.col("step").isin("total", "first_token")), "step", "ms", [0.5, 0.95])
    at = lambda s, step: rounded(F.max(F.when((F.col("share") == s) & (F.col("step") == step), F.col("percentile"))), 2).alias(f"p{s * 100:.0f}_{step}")
    return counts.join(F.broadcast(found.agg(*(at(s, step) for step in ("total", "first_token") for s in (0.5, 0.95)))))


def daily(logs: DataFrame) -> DataFrame:
    """Days that have questions, in UTC."""
    dated = logs.withColumn("day", F.date_trunc("day", "created_at"))
    counts = dated.groupBy("day").agg(
        F.count(F.lit(1)).alias("questions"), F.countDistinct("user_sub").alias("users"), F.count_if(F.col("outcome") == "no_answer").alias("no_answer"),
        rounded(F.sum("cost_usd"), 4).alias("cost_usd"),
    )
    late = wide(scans.percentiles(dated.withColumn("ms", F.col("timings_ms")["total"]), "day", "ms", [0.95]), "day", {0.95: "p95_total"})
    return counts.join(late, F.col("day").eqNullSafe(F.col("group")), "left").select("day", "questions", "users", "no_answer", "p95_total", "cost_usd")


def steps(logs: DataFrame) -> DataFrame:
    """Latency percentiles of each step of the timings map."""
    rows = timings(logs)
    counts = rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    found = wide(scans.percentiles(rows, "step", "ms", [0.5, 0.95]), "step", {0.5: "p50", 0.95: "p95"})
    return counts.join(found, F.col("step") == F.col("group"), "left").select("step", "n", "p50", "p95")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert as last write wins: of each key the first row in `order`."""
    nth = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("nth")


def page(rows: DataFrame, order: list[Column], after: Column | None, size: int) -> DataFrame:
    """A keyset page: rows beyond the cursor, and one more than asked for to tell whether there is a next page."""
    return (rows if after is None else rows.where(after)).orderBy(*order).limit(size + 1)


def last_turns(turns: DataFrame, n: int = 6, longest: int = 600) -> DataFrame:
    """conv_id, history: the last n messages that aren't system ones, in order, each on one line and cut off."""
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat(F.col("role"), F.lit(": "), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, longest))
    kept = turns.where("role <> 'system'").withColumn("back", F.row_number().over(recent)).where(F.col("back") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return kept.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def rates(events: DataFrame, by: str, width: str = "5 minutes", step: str = "1 minute", seconds: int = 300) -> DataFrame:
    """by, start, rate: events (ts) a second in sliding windows; on a stream with a watermark as well."""
    counted = events.groupBy(by, F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(by, F.col("window.start").alias("start"), (F.col("n") / seconds).alias("rate"))


def increases(samples: DataFrame, by: list[str], tie: str = "sample_id") -> DataFrame:
    """samples (ts, value, tie) of cumulative counters, a series for each value of `by`, with `increase` since the series' sample before; a
    value below the one before means that the counter began again at 0. First samples and null values add nothing."""
    found = scans.with_last_before(samples, by, ["ts", tie], F.col("value"), "before")
    value, before = F.col("value"), F.col("before")
    return found.withColumn("increase", F.when(before.isNull() | value.isNull(), 0.0).when(value < before, value).otherwise(value - before).cast("double"))


def counter_rates(samples: DataFrame, by: list[str], width: str = "5 minutes", step: str = "1 minute", seconds: int = 300, tie: str = "sample_id") -> DataFrame:
    """by, start, increase, rate: what the counters of samples have gained in sliding windows, resets corrected, in all and a second."""
    summed = increases(samples, by, tie).groupBy(*by, F.window("ts", width, step)).agg(F.sum("increase").alias("increase"))
    return summed.select(*by, F.col("window.start").alias("start"), "increase", (F.col("increase") / seconds).alias("rate"))


def bucket_quantile(rates: DataFrame, by: list[str], share: float) -> DataFrame:
    """by, quantile: of cumulative bucket rates (le, infinity the last; rate), interpolated in the bucket that reaches the share; where
    that is the last one, the edge before it; null without observations. A group has a row for each edge."""
    sorted_ = F.sort_array(F.collect_list(F.struct("le", "rate")))
    b = rates.groupBy(*by).agg(sorted_.alias("b")).withColumn("wanted", F.element_at("b", -1)["rate"] * share)
    at = F.array_position(F.transform("b", lambda x: x["rate"] >= F.col("wanted")), True).cast("int")
    edge = lambda k, name: F.get(F.col("b"), k - 1)[name]
    low, below = F.when(at > 1, edge(at - 1, "le")).otherwise(F.least(F.lit(0.0), edge(at, "le"))), F.when(at > 1, edge(at - 1, "rate")).otherwise(0.0)
    inside = low + (edge(at, "le") - low) * (F.col("wanted") - below) / F.nullif(edge(at, "rate") - below, F.lit(0.0))
    value = F.when(F.col("wanted") <= 0, None).when(edge(at, "le") == float("inf"), F.get(F.col("b"), F.size("b") - 2)["le"]).otherwise(inside)
    return b.select(*by, value.alias("quantile"))


def ratio(part: Column, whole: Column) -> Column:
    """The share of part in whole, from 0 to 1; 0 of nothing."""
    return F.when(whole > 0, F.least(F.greatest(part / whole, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def histogram(values: DataFrame, value: str, edges: list[float], by: str) -> DataFrame:
    """Cumulative counts of values up to each edge, and in all."""
    counts = [F.count_if(F.col(value) <= e).alias(f"le_{e:g}".replace(".", "_")) for e in edges]
    return values.groupBy(by).agg(*counts, F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
