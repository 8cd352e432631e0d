"""Blocks of pages against a plain loop over lines; the column normaliser against the plain one."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import layout
from corpusloom.plans import document_queries as Q
from corpusloom.sources import parsers

SF = "/root/testdata/sf0.001"
ITEM = re.compile(r"([•\-*]|\d+[.)])\s")


def plain(lines, boxes):
    """(page, kind, text, level) of one document's blocks in order."""
    boxes = sorted({(b.page, b.y0, b.markdown.strip(), b.x0, b.x1, b.y1) for b in boxes if b.markdown.count("|") >= 4})
    inside = lambda l: any(b[0] == l.page and b[3] - 1 <= (l.x0 + l.x1) / 2 <= b[4] + 1 and b[1] - 1 <= (l.y0 + l.y1) / 2 <= b[5] + 1 for b in boxes)
    said = sorted((l for l in lines if l.text and l.text.strip()), key=lambda l: (l.page, l.ordinal))
    pages = {l.page for l in said} | {b[0] for b in boxes}
    said = [l for l in said if not inside(l)]
    mark = lambda l: re.sub("[0-9]+", "#", l.text.strip().lower())
    edge = lambda l: l.y1 < 0.12 * l.height or l.y0 > 0.88 * l.height
    on = Counter(m for m, _ in {(mark(l), l.page) for l in said if edge(l)})
    said = [l for l in said if not (edge(l) and len(pages) >= 2 and 2 * on[mark(l)] > len(pages))]
    signs = Counter()
    for l in said:
        signs[l.size] += len(l.text)
    body = max(signs, key=lambda s: (signs[s], s), default=0)
    level = {s: min(k + 1, 3) for k, s in enumerate(sorted((s for s in signs if s >= body * 1.15), reverse=True))}
    out, waiting = [], []

    def close():
        text = ""
        for l in waiting:
            t = l.text.strip()
            text = text[:-1] + t if text.endswith("-") and re.match("[a-z]", t) else f"{text} {t}".strip()
        if text := parsers.normalize(text):
            out.append([waiting[0].page, "list" if ITEM.match(text) else "paragraph", text, 0])
        waiting.clear()

    def tables(page, below):
        while (first := next((b for b in boxes if b[0] == page), None)) and (below is None or first[1] <= below):
            boxes.remove(first)
            close()
            out.append([page, "table", first[2], 0])

    for k, l in enumerate(said):
        if k and said[k - 1].page != l.page:
            close()
            tables(said[k - 1].page, None)
        tables(l.page, l.y0)
        if l.size in level and len(l.text.strip()) < 120:
            close()
            if out and out[-1][:2] == [l.page, "heading"] and out[-1][3] == level[l.size]:
                out[-1][2] += " " + parsers.normalize(l.text)
            else:
                out.append([l.page, "heading", parsers.normalize(l.text), level[l.size]])
            continue
        if waiting and (waiting[-1].block != l.block or ITEM.match(l.text.strip())):
            close()
        waiting.append(l)
    close()
    for page in sorted({b[0] for b in boxes}):
        tables(page, None)
    return [tuple(b) for b in out]


def check(got, lines, boxes):
    ids = {r.doc_id for r in lines} | {r.doc_id for r in boxes}
    for d in ids:
        want = plain([r for r in lines if r.doc_id == d], [r for r in boxes if r.doc_id == d])
        rows = sorted((r for r in got if r.doc_id == d), key=lambda r: (r.late, r.page, r.place))
        assert [(r.page, r.kind, r.text, r.level) for r in rows] == want, d


def test_pages_of_all_documents(spark):
    lines, boxes = Q.page_lines(spark, SF), Q.page_boxes(spark, SF)
    check(Q.s9_page_blocks(spark, SF).collect(), lines.collect(), boxes.collect())


def test_random_pages(spark):
    rng = random.Random(5)
    words = ["plain", "ﬁne", "cut-", "lower", "• item", "2) item", "Page 1", "Page 22", "naïve", "  wide ", " ", ""]
    rows, boxes = [], []
    for d in range(12):
        for k in range(rng.randrange(60)):
            x, y = rng.choice([0.0, 300.0]), rng.choice([5.0, 830.0, rng.randrange(800) * 1.0])
            text = " ".join(rng.choices(words, k=rng.randrange(1, 4))) * rng.choice([1, 1, 9])
            rows.append((d, k, 1 + k // 9, x, y, x + 200, y + 10, 842.0, k // 3, rng.choice([10.0, 10.0, 10.0, 14.0, 18.0]), text))
        for _ in range(rng.randrange(6)):
            x, y = rng.choice([-5.0, 250.0]), rng.randrange(800) * 1.0
            boxes.append((d, rng.randrange(1, 9), x, y, x + 300, y + rng.choice([0, 30, 90, 9000]), rng.choice(["| a | b |\n", "|a|", "| c | d |"])))
    rows += [(99, 0, 1, None, None, None, None, None, None, 10.0, None)]
    names = "doc_id long, {}page int, x0 double, y0 double, x1 double, y1 double, "
    lines = spark.createDataFrame(rows, names.format("ordinal int, ") + "height double, block int, size double, text string").repartition(3)
    found = spark.createDataFrame(boxes + boxes[:4], names.format("") + "markdown string")
    check(layout.blocks(lines, found).collect(), lines.where("doc_id < 99").collect(), found.collect())
    assert layout.blocks(lines.limit(0), found.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 0, 1, None, None, None, None, None, None, 10.0, "kept")], lines.schema)
    assert [r.text for r in layout.blocks(odd, found.limit(0)).collect()] == ["kept"]


def test_normalized_columns(spark):
    rng = random.Random(1)
    signs = "aB é ﬁ½Å ­ \xa0\t\n\r\x01\x0b\x1f   \x85　・̈e"
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(800)] + ["", " \n ", "a\n\n\n\nb"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k long, t string")
    got = {r.k: r.n for r in df.select("k", parsers.normalized(F.col("t")).alias("n")).collect()}
    assert got.pop(-1) is None and [got[k] for k in range(len(texts))] == [parsers.normalize(t) for t in texts]


def test_running_lines_are_found_once(spark, monkeypatch):
    """What is outside tables and no running line is found and written once, before the levels of headings, which read lines twice."""
    plans, plain = {}, layout.tables.settled
    monkeypatch.setattr(layout.tables, "settled", lambda df, kind: plans.update({kind: df._jdf.queryExecution().optimizedPlan().toString()}) or plain(df, kind))
    rows = [(1, k, k // 3 + 1, 0.0, 280.0 * (k % 3), 9.0, 280.0 * (k % 3) + 12, 842.0, k, 10.0, f"line {k}" if k % 3 else "head") for k in range(9)]
    lines = spark.createDataFrame(rows, "doc_id long, ordinal int, page long, x0 double, y0 double, x1 double, y1 double, height double, block long, size double, text string")
    boxes = spark.createDataFrame([], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double, markdown string")
    assert sorted(r.text for r in layout.blocks(lines, boxes).collect()) == sorted(f"line {k}" for k in range(9) if k % 3)
    assert plans["lines"].count("Join LeftAnti") <= 5
