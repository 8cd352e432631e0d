"""Crawling as joins over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import scans

from . import tables

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def normalized_url(url: Column) -> Column:
    """Without fragment; scheme and host in lower case; without a final slash unless it is the whole path."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    path, query = F.regexp_extract(rest, r"^[^?]*", 0), F.regexp_extract(rest, r"\?.*$", 0)
    shorter = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    return F.concat(F.lower(head), shorter, query)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def absolute(link: Column, base: Column) -> Column:
    """Links with a scheme as they are, others below the base's host."""
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("/"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), link))


def links(pages: DataFrame) -> DataFrame:
    """url, link (normalised) of pages (url, html), same host only."""
    found = pages.select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("raw"))
    out = found.select(normalized_url(F.col("url")).alias("url"), normalized_url(absolute(F.col("raw"), F.col("url"))).alias("link"))
    return out.where(F.col("link").isNotNull() & (host(F.col("url")) == host(F.col("link")))).distinct()


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"\s+", " "))


def crawled(pages: DataFrame, start: DataFrame, max_depth: int = 2) -> DataFrame:
    """url, depth of what is reached from start (url) within max_depth links. One join a level, each level written; what was
    seen is left out by an anti-join."""
    edges = tables.settled(links(pages).select(F.col("url").alias("from"), "link"), "links")
    frontier = tables.settled(start.select(normalized_url(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct(), "crawl")
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, F.col("url") == F.col("from")).select(F.col("link").alias("url")).distinct()
        frontier = tables.settled(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "crawl")
        seen = seen.unionByName(frontier)
    return seen


def placed_links(pages: DataFrame) -> DataFrame:
    """url, link, position: each link (normalised, same host) of pages (url, html) with the place where the page names it first. Rows
    of one address count as one page."""
    found = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("position", "raw"))
    out = found.select(normalized_url(F.col("url")).alias("url"), normalized_url(absolute(F.col("raw"), F.col("url"))).alias("link"), "position")
    return out.where(F.col("link").isNotNull() & (host(F.col("url")) == host(F.col("link")))).groupBy("url", "link").agg(F.min("position").alias("position"))


def crawl(
    pages: DataFrame, start: DataFrame, known: DataFrame | None = None, robots: DataFrame | None = None,
    include: str | None = None, exclude: str | None = None, max_depth: int = 2, max_pages: int = 200,
) -> DataFrame:
    """source, url, depth, place, fetched of each page that the crawls see, a crawl for each source.

    pages: url, html of what can be read. start: source, url and, where a source has several, position. known: source, url
    of pages of former crawls, which are seen after the start and not followed. robots: as for with_permission.

    A crawl takes pages in the order in which they are named (its start, what is known, then page by page the links in
    order), and ends after max_pages of them, the feature's own limit. A page that doesn't match `include`, matches `exclude` or
    is forbidden counts as seen but isn't fetched, and its links aren't followed; start pages are exempt from the patterns.
    place: 0 for the first page of a source.

    Each level is written. Places are running sums over ranges of the level, so that no task gets a level or a source whole.
    Nulls among addresses are left out; repeated rows count once; without pages there are start pages only."""
    edges = tables.settled(placed_links(pages).withColumnRenamed("url", "from"), "links")
    position = F.col("position").cast("long") if "position" in start.columns else F.lit(0).cast("long")
    first = start.select("source", normalized_url(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit(0).alias("parent"), position.alias("position"), F.lit(True).alias("start"))
    if known is not None:
        rest = known.select("source", normalized_url(F.col("url")).alias("url"), F.lit(max_depth).alias("depth"), F.lit(1).alias("parent"), F.lit(0).cast("long").alias("position"), F.lit(False).alias("start"))
        first = first.unionByName(rest)
    order = F.struct("parent", "position", "url")
    named = first.where("url IS NOT NULL").withColumn("parent", F.col("parent").cast("long"))
    seen, counts = None, None
    for depth in range(max_depth + 1):
        once = named.groupBy("source", "url").agg(F.min(order).alias("order"), F.min_by("depth", order).alias("depth"), F.bool_or("start").alias("start"))
        if seen is not None:
            same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("url") == F.col("url_"))
            once = once.join(seen.select(F.col("source").alias("source_"), F.col("url").alias("url_")), same, "left_anti")
        placed = scans.with_sums_before(once, [F.col("source"), F.col("order.parent"), F.col("order.position"), F.col("url")], {"before": F.lit(1).cast("long")}, "frontier")
        placed = tables.settled(placed, "level")
        # the first place of a source in the level, and how many of its pages were seen before
        firsts = placed.groupBy("source").agg(F.min("before").alias("begin"))
        if counts is not None:
            had = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("had"))
            firsts = firsts.join(had, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        else:
            firsts = firsts.withColumn("had", F.lit(0).cast("long"))
        firsts = tables.settled(firsts.withColumn("had", F.coalesce("had", F.lit(0).cast("long"))), "firsts")
        level = tables.matched(placed, firsts, "source", F.col("url")).withColumn("place", F.col("had") + F.col("before") - F.col("begin"))
        level = level.where(F.col("place") < max_pages)
        wanted = (F.col("url").rlike(include) if include else F.lit(True)) & (~F.col("url").rlike(exclude) if exclude else F.lit(True))
        level = level.withColumn("fetched", F.col("start") | wanted)
        if robots is not None:
            level = with_permission(level, robots).withColumn("fetched", F.col("fetched") & F.col("allowed"))
        level = tables.settled(level.select("source", "url", "depth", "place", "fetched"), "crawl")
        seen = level if seen is None else seen.unionByName(level)
        here = level.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        counts = here if counts is None else counts.unionByName(here)
        followed = level.where(F.col("fetched") & (F.col("depth") == depth) & (F.col("depth") < max_depth))
        if followed.isEmpty():
            break
        met = followed.join(edges, F.col("url") == F.col("from"))
        named = met.select("source", F.col("link").alias("url"), F.lit(depth + 1).alias("depth"), F.col("place").alias("parent"), F.col("position").cast("long").alias("position"), F.lit(False).alias("start"))
    return seen


def fetch_outcome(status: Column, content_type: Column) -> Column:
    return (
        F.when(status == 304, "unchanged").when(status.isin(404, 410), "deleted").when(status != 200, "error")
        .when(~F.lower(content_type).contains("html"), "skipped").otherwise("upsert")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """origin, allow, prefix: the rules for all agents of robots files (origin, status, text); a file that wasn't found allows all."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", "")))
    mark = F.transform(lines, lambda s: F.regexp_replace(F.lower(F.regexp_extract(s, r"^([A-Za-z-]+)\s*:", 1)), "-", ""))
    value = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^[A-Za-z-]+\s*:", "")))
    each = robots.where("status = 200").select("origin", F.posexplode(F.arrays_zip(mark.alias("mark"), value.alias("value"))).alias("place", "x")).select("origin", "place", "x.mark", "x.value")
    # rules belong to the agents named before them; agents in a row share rules
    before = Window.partitionBy("origin").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("origin").orderBy("place")
    known = each.where(F.col("mark").isin("useragent", "allow", "disallow"))
    begins = (F.col("mark") == "useragent") & F.coalesce(F.lag("mark").over(earlier) != "useragent", F.lit(True))
    grouped = known.withColumn("group", F.sum(begins.cast("int")).over(before))
    whole = Window.partitionBy("origin", "group")
    for_all = grouped.withColumn("all", F.bool_or((F.col("mark") == "useragent") & (F.col("value") == "*")).over(whole))
    return for_all.where("all AND mark <> 'useragent' AND value <> ''").select("origin", (F.col("mark") == "allow").alias("allow"), F.col("value").alias("prefix"))


def with_permission(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """urls (url) with `allowed`: the longest rule of the origin that the path begins with decides, of equals one that allows;
    without any, or without a file, all is allowed."""
    origin = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    asked = urls.withColumns({"origin": origin, "__path": F.when(path == "", "/").otherwise(path)})
    met = asked.select("url", "origin", "__path").distinct().join(robots_rules(robots), "origin").where(F.col("__path").startswith(F.col("prefix")))
    ruled = met.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("ruled"))
    return asked.join(ruled, "url", "left").withColumn("allowed", F.coalesce("ruled", F.lit(True))).drop("ruled", "origin", "__path")


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """url: the pages that sitemaps (url, xml) list, from the roots (url) on; an index leads to further sitemaps, `depth` deep."""
    located = sitemaps.select("url", F.col("xml").rlike(r"(?i)<sitemapindex[\s>]").alias("index"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc"))
    level, out = roots.select("url").distinct(), None
    for _ in range(depth + 1):
        listed = level.join(located, "url")
        pages = listed.where("NOT index").select(normalized_url(F.col("loc")).alias("url"))
        out = pages if out is None else out.unionByName(pages)
        level = listed.where("index").select(F.col("loc").alias("url")).distinct()
    return out.distinct()


def within(urls: DataFrame, start: DataFrame, include: str | None = None, exclude: str | None = None, max_pages: int | None = None) -> DataFrame:
    """Crawled urls (url, depth) that match include and not exclude, start pages exempt, and of these the first max_pages by
    depth and url: the feature's own limit on what is seen."""
    exempt = urls.join(start.select(normalized_url(F.col("url")).alias("url"), F.lit(True).alias("first")).distinct(), "url", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    keep = F.col("first")
    matched = (F.col("url").rlike(include) if include else F.lit(True)) & (~F.col("url").rlike(exclude) if exclude else F.lit(True))
    kept = exempt.where(keep | matched).drop("first")
    return kept if max_pages is None else kept.orderBy("depth", "url").limit(max_pages)
