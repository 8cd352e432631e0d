"""Crawls under a budget against a plain queue."""

import random
from collections import deque

import pytest

from corpusloom.sources import web


def plain(pages, start, known, include, exclude, max_depth, max_pages):
    links = {}
    for url, targets in pages.items():
        links[url] = list(dict.fromkeys(targets))
    queue = deque([(start, 0)] + [(u, max_depth) for u in known])
    seen, out = set(), []
    while queue and len(out) < max_pages:
        url, depth = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        fetched = url == start or (include in url and exclude not in url)
        out.append((url, depth, len(out), fetched))
        if fetched and depth < max_depth:
            queue.extend((t, depth + 1) for t in links.get(url, []))
    return out


@pytest.mark.parametrize("max_depth,max_pages", [(1, 5), (3, 60), (5, 1000)])
def test_crawls_equal_a_queue(spark, max_depth, max_pages):
    rng = random.Random(max_pages)
    site = lambda s, k: f"http://{s}/{'e' if k % 5 else 'q'}{k}{'z' if k % 7 == 3 else ''}"
    pages, rows = {}, []
    for s in ("a", "b"):
        for k in range(80):
            targets = [site(s, rng.randrange(100)) for _ in range(rng.randrange(6))]
            pages[site(s, k)] = targets
            body = "".join(f'<a href="{t.removeprefix(f"http://{s}") if rng.random() < 0.5 else t}#x">l</a>' for t in targets)
            rows.append((site(s, k), body + f'<a href="http://other/{k}">o</a>'))
    known = {"a": sorted(rng.sample(sorted(u for u in pages if "//a/" in u), 6)), "b": []}
    df = spark.createDataFrame([*rows, *rows[:3], (None, "x"), ("http://a/none", None)], "url string, html string").repartition(3)
    start = spark.createDataFrame([(s, site(s, 0)) for s in known] + [("empty", None)], "source string, url string")
    before = spark.createDataFrame([(s, u) for s, us in known.items() for u in us], "source string, url string")
    got = web.crawl(df, start, before, None, "e", "z", max_depth, max_pages).collect()
    for s in known:
        want = plain(pages, site(s, 0), known[s], "/e", "z", max_depth, max_pages)
        assert sorted((r.place, r.url, r.depth, r.fetched) for r in got if r.source == s) == [(p, u, d, f) for u, d, p, f in want]
    assert {r.source for r in got} == {"a", "b"}


def test_forbidden_pages_are_seen_but_not_followed(spark):
    df = spark.createDataFrame([("http://a/", '<a href="/x">'), ("http://a/x", '<a href="/y">')], "url string, html string")
    start = spark.createDataFrame([(1, "http://A")], "source int, url string")
    robots = spark.createDataFrame([("http://a", 200, "User-agent: *\nDisallow: /x")], "origin string, status int, text string")
    found = lambda r: sorted((x.url, x.fetched) for x in web.crawl(df, start, robots=r).collect())
    assert found(robots) == [("http://a/", True), ("http://a/x", False)]
    assert found(None) == [("http://a/", True), ("http://a/x", True), ("http://a/y", True)]
    assert web.crawl(df.limit(0), start).count() == 1 and web.crawl(df, start.limit(0)).count() == 0
