"""Pages as tables of lines and boxes, put in reading order.

lines: doc_id, ordinal (the order in which a page names them), page, x0, y0, x1, y1, height (of the page), block, size, text.
boxes: doc_id, page, x0, y0, x1, y1, markdown: tables that were found on pages.

Null coordinates: such a line lies in no box and is at no edge. Null or blank texts are no lines. Repeated boxes count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources import parsers, tables

from . import documents, ingest

# How far outside a box a centre may lie, and how many bars a table has at least.
REACH, BARS = 1.0, 4
#: Height of a band of a page, in points, and how many bands a box is copied to at most; taller ones meet all lines of their page.
BAND, BANDS = 64.0, 64
#: Begins an item of a list.
ITEM = r"^([•\-*]|\d+[.)])\s"


def regions(boxes: DataFrame) -> DataFrame:
    """Different boxes that are tables: those whose text has BARS bars or more."""
    bars = F.length("markdown") - F.length(F.replace("markdown", F.lit("|"), F.lit("")))
    return boxes.select("doc_id", "page", "x0", "y0", "x1", "y1", F.regexp_replace("markdown", r"(?U)^\s+|\s+\z", "").alias("markdown")).where(bars >= BARS).distinct()


def outside(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines whose centre lies in none of the boxes of their page.

    An interval join by bands: a line is in the band of its centre, a box is copied to the bands that it reaches. So a page
    with many lines and boxes compares those at the same height only."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    placed = lines.withColumns({"x_": x, "y_": y, "band_": F.floor(y / BAND)})
    low, high = F.floor((F.col("y0") - REACH) / BAND), F.floor((F.col("y1") + REACH) / BAND)
    sides = found.select("doc_id", "page", *(F.col(c).alias(f"{c}_") for c in ("x0", "x1", "y0", "y1")), low.alias("low_"), high.alias("high_"))
    sides = sides.where("low_ <= high_")
    within = F.col("x_").between(F.col("x0_") - REACH, F.col("x1_") + REACH) & F.col("y_").between(F.col("y0_") - REACH, F.col("y1_") + REACH)
    tall = F.col("high_") - F.col("low_") >= BANDS
    usual = sides.where(~tall).withColumn("b_", F.explode(F.sequence("low_", "high_"))).select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), "b_", "x0_", "x1_", "y0_", "y1_")
    same = F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("page").eqNullSafe(F.col("p_"))
    left = placed.join(usual, same & (F.col("band_") == F.col("b_")) & within, "left_anti")
    large = sides.where(tall).select(F.col("doc_id").alias("d_"), F.col("page").alias("p_"), "x0_", "x1_", "y0_", "y1_")
    return left.join(large, same & within, "left_anti").select(*lines.columns)


def with_heights(lines: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines and tables as items: `late`, and `at`, how far down the page an item's turn comes. pages: doc_id, page of the lines.

    A line's turn is the largest y0 so far on its page; a table comes before the first line whose turn isn't above its
    upper side. Tables of pages without lines, and those below the last line of the last page with lines, come after all."""
    page = Window.partitionBy("doc_id", "page")
    so_far = page.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("markdown").isNull()
    item_lines = lines.select("doc_id", "page", "ordinal", "block", "level", "text", F.col("y0").cast("double").alias("y0"), F.lit(None).cast("string").alias("markdown"))
    none = lambda kind: F.lit(None).cast(kind)
    item_tables = found.select("doc_id", "page", none("long").alias("ordinal"), none("long").alias("block"), none("int").alias("level"), none("string").alias("text"), F.col("y0").cast("double").alias("y0"), "markdown")
    both = item_lines.unionByName(item_tables)
    last = pages.groupBy(F.col("doc_id").alias("d_")).agg(F.max("page").alias("last_"))
    turned = both.withColumn("at", F.when(line, F.max(F.when(line, F.col("y0"))).over(so_far)).otherwise(F.col("y0")))
    turned = turned.withColumn("at", F.coalesce("at", F.lit(float("-inf"))))
    turned = turned.withColumn("end_", F.max(F.when(line, F.col("at"))).over(page)).join(last, F.col("doc_id").eqNullSafe(F.col("d_")), "left")
    late = ~line & (F.col("end_").isNull() | (F.col("page").eqNullSafe(F.col("last_")) & (F.col("at") > F.col("end_"))))
    return turned.withColumn("late", late).drop("d_", "last_", "end_")


def blocks(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, late, page, place, kind, text, level: the blocks of documents; their order is that of late, page, place.

    Lines inside tables go, then running heads and feet. What is left becomes headings by size (neighbours of a level are one),
    and paragraphs or lists of the lines of a block, closed up at hyphens; tables stand where they are on the page. All windows
    are over a page, so that a document of any length needs no task of its own."""
    found = tables.settled(regions(boxes), "regions")
    said = lines.where("trim(text) <> ''").withColumn("ordinal", F.col("ordinal").cast("long"))
    pages = said.select("doc_id", "page").unionByName(found.select("doc_id", "page"))
    kept = ingest.running_lines(outside(said, found).withColumn("y", F.col("y0")), bottom=F.col("y1"), pages=pages)
    # written before levels: these read the lines twice, and what finds them isn't to be done twice
    kept = tables.settled(kept.select("doc_id", "page", "ordinal", F.col("block").cast("long").alias("block"), "size", "y0", "text"), "lines")
    items = with_heights(documents.heading_levels(kept).withColumn("level", F.col("level").cast("int")), found, kept.select("doc_id", "page"))
    order = Window.partitionBy("doc_id", "page").orderBy("late", "at", F.col("markdown").isNull(), "ordinal", "markdown")
    kind = F.when(F.col("markdown").isNotNull(), "table").when(F.col("level") > 0, "heading").otherwise("text")
    marked = items.withColumn("kind", kind)
    before = lambda c: F.lag(c).over(order)
    joins = (F.col("kind") == before("kind")) & (
        F.when(F.col("kind") == "heading", F.col("level") == before("level")).when(F.col("kind") == "text", F.col("block").eqNullSafe(before("block")) & ~F.col("text").rlike(r"^\s*" + ITEM[1:])).otherwise(False)
    )
    placed = marked.withColumns({"number": F.row_number().over(order), "begins": (~F.coalesce(joins, F.lit(False))).cast("int")})
    grouped = placed.withColumn("group", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = grouped.groupBy("doc_id", "late", "page", "group").agg(
        F.first("kind").alias("kind"), F.max("level").alias("level"), F.max("markdown").alias("markdown"),
        F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda p: p["text"]).alias("parts"),
    )
    raw = F.when(F.col("kind") == "table", F.col("markdown")).when(F.col("kind") == "heading", F.array_join(F.transform("parts", flat), " ")).otherwise(documents.dehyphenated(F.col("parts")))
    text = F.when(F.col("kind") == "table", F.col("raw")).otherwise(parsers.normalized(F.col("raw")))
    full = one.withColumn("raw", raw).withColumn("text", text).where("text <> ''")
    shown = F.when(F.col("kind") != "text", F.col("kind")).when(F.col("text").rlike(ITEM), "list").otherwise("paragraph")
    return full.select("doc_id", "late", "page", F.col("group").cast("int").alias("place"), shown.alias("kind"), "text", F.coalesce("level", F.lit(0)).alias("level"))


def flat(text: Column) -> Column:
    """One line without white space around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
