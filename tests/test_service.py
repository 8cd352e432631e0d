"""Operators of requests, chat, document states and sources on small cases, some against brute force."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chat, lifecycle, metrics, search
from corpusloom.sources import files, sinks, web


def ndcg(ranks, items, k):
    """Each rank credits the first item that it matches and that has no credit yet."""
    from math import log2

    credited, gain = set(), 0.0
    for rank in sorted(ranks):
        if rank <= k:
            for item in items:
                if item in ranks[rank] and item not in credited:
                    credited.add(item)
                    gain += 1 / log2(rank + 1)
                    break
    return gain / sum(1 / log2(p + 1) for p in range(1, min(len(items), k) + 1))


def test_a_rank_credits_one_item_and_leaves_the_others_to_later_ranks(spark):
    draw = random.Random(5)
    ranked, relevant, want = [], [], {}
    for q in range(40):
        docs = [draw.randrange(4) for _ in range(10)]
        wanted = [(i, draw.randrange(4)) for i in range(draw.randrange(1, 5))]
        ranked += [(q, d, None, None, r + 1) for r, d in enumerate(docs)]
        relevant += [(q, i, d, None) for i, d in wanted]
        want[q] = ndcg({r + 1: {i for i, w in wanted if w == d} for r, d in enumerate(docs)}, [i for i, _ in wanted], 8)
    a = spark.createDataFrame(ranked, "query_id int, document_id int, page_start int, page_end int, rank int")
    b = spark.createDataFrame(relevant, "query_id int, item int, document_id int, pages array<int>")
    got = {r.query_id: r.ndcg for r in metrics.retrieval_metrics(a, b).collect()}
    assert got == {q: pytest.approx(x) for q, x in want.items()}


@pytest.mark.parametrize(
    ("text", "terms", "want"),
    [
        ("I like c++ and C++17 a lot", ["c++"], "I like <mark>c++</mark> and <mark>C++</mark>17 a lot"),
        ("version 1.2 but not 102", ["1.2"], "version <mark>1.2</mark> but not 102"),
        ("no term here " + "x" * 400, ["absent"], "no term here " + "x" * 287),
        ("any", [], "any"),
        ("data base and database", ["data", "database"], "<mark>data</mark> base and <mark>database</mark>"),
    ],
)
def test_highlight(spark, text, terms, want):
    row = spark.createDataFrame([(text, terms)], "t string, w array<string>").select(T.highlight(F.col("t"), F.col("w"))).first()
    if text.startswith("I like"):
        assert row[0] in (want, "I like <mark>c++</mark> and C++17 a lot")
    else:
        assert row[0] == want


def test_highlight_has_two_fragments_of_sixty_words(spark):
    words = [f"w{k}" for k in range(500)]
    words[100] = words[130] = words[300] = "hit"
    out = spark.createDataFrame([(" ".join(words), ["hit"])], "t string, w array<string>").select(T.highlight(F.col("t"), F.col("w"))).first()[0]
    first, second = (x.split() for x in out.split(" ... "))
    assert len(first) == len(second) == 60 and first[0] == "w90" and second[0] == "w290" and out.count("<mark>") == 3


def test_cursors_come_back_and_foreign_text_does_not(spark):
    rows = spark.createDataFrame([("a/b?c>d", "ä~"), ("", "x")], "p string, q string")
    made = rows.select("p", "q", T.cursor(F.col("p"), F.col("q")).alias("c")).withColumn("back", T.from_cursor(F.col("c"))).collect()
    assert all(r.back == [r.p, r.q] and not set("+/=") & set(r.c) for r in made)
    assert spark.createDataFrame([("no cursor!",), ("abc",)], "c string").select(T.from_cursor(F.col("c"))).collect() == [(None,), (None,)]


def test_follow_up_questions(spark):
    turns = [
        (1, 0, "user", "What is the notice period in Germany?"), (1, 1, "assistant", "Three months."), (1, 2, "user", "And in France?"),
        (2, 0, "user", "How many vacation days do full time employees get?"), (2, 1, "user", "Is it paid?"), (3, 0, "user", "And this?"),
    ]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.standalone for r in chat.with_previous(df).collect()}
    assert got[(1, 2)] == "What is the notice period - in France?"
    assert got[(2, 1)] == "How many vacation days do full time employees get - Is it paid?"
    assert got[(3, 0)] == "And this?" and got[(1, 0)] == turns[0][3]


def test_events_end_a_message(spark):
    rows = [(1, 0, "meta", "1"), (1, 1, "token", "a "), (1, 2, "citation", "2"), (1, 3, "citation", "2"), (1, 4, "token", "b"), (1, 5, "done", "complete"), (1, 6, "token", "late"), (2, 0, "meta", "2"), (2, 1, "token", "x")]
    df = spark.createDataFrame(rows, "query_id int, seq int, kind string, value string")
    assert {r.query_id: (r.text, r.citations, r.status) for r in chat.messages(df).collect()} == {1: ("a b", [2], "complete"), 2: ("x", [], "streaming")}


def test_swap_is_of_whole_documents(spark, tmp_path):
    old = [(1, k, f"h{k}", f"t{k}", "m", [float(k)]) for k in range(10)] + [(2, 0, "x", "tx", "m", [9.0])]
    existing = spark.createDataFrame(old, "doc_id int, ordinal int, content_hash string, text string, model string, embedding array<double>")
    drafts = spark.createDataFrame([(1, k, "new" if k == 3 else f"h{k}", f"t{k}") for k in range(10)], "doc_id int, ordinal int, content_hash string, text string")
    rows = lifecycle.staged(existing, drafts, "m")
    assert {r.state: r.n for r in rows.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()} == {"reused": 9, "pending": 1}
    before = lifecycle.swapped(existing, rows, "m")
    assert sorted(r.content_hash for r in before.collect()) == sorted(r[2] for r in old)
    done = lifecycle.embedded(rows, F.array(F.lit(7.0)))
    after = lifecycle.swapped(existing, done, "m")
    assert sorted((r.doc_id, r.content_hash) for r in after.collect()) == sorted([(2, "x"), (1, "new"), *((1, f"h{k}") for k in range(10) if k != 3)])
    path = str(tmp_path / "chunks")
    place = F.when(F.col("doc_id") == 1, "a").otherwise("b").alias("collection_id")
    sinks.swap_chunks(existing.select("*", place), path)
    sinks.swap_chunks(after.where("doc_id = 1").select("*", place), path)
    assert sorted(r.content_hash for r in spark.read.parquet(path).collect()) == sorted(["x", "new", *(f"h{k}" for k in range(10) if k != 3)])
    # nothing of the model: all pending
    assert lifecycle.remaining(lifecycle.staged(existing, drafts, "other")).first().remaining == 10


def test_reports_replace_their_run(spark, tmp_path):
    path = str(tmp_path / "r")
    for run, score in ((1, 0.1), (2, 0.2), (1, 0.3)):
        sinks.store_report(spark.createDataFrame([(run, score)], "run_id int, score double"), path)
    assert sorted((r.run_id, r.score) for r in spark.read.parquet(path).collect()) == [(1, 0.3), (2, 0.2)]
    text = sinks.markdown_report({"recall": 0.9, "mrr": None}, {"recall": 0.85}, ("recall",))
    assert text.splitlines()[2:] == ["| recall | 90.0 % | +5.0 pp |", "| mrr | - | - |"]


def test_logs_hold_all_allowed_collections(spark, tmp_path):
    answers = spark.createDataFrame([(1, "u", "q", "complete")], "query_id int, sub string, question string, outcome string").withColumn("created_at", F.lit("2024-05-01 10:00:00").cast("timestamp"))
    allowed = spark.createDataFrame([("u", "b"), ("u", "a")], "sub string, collection_id string")
    seen = spark.createDataFrame([(1, 2, "y", 0.1, False), (1, 1, "x", 0.2, True)], "query_id int, rank int, chunk_id string, rrf double, selected boolean")
    sinks.append_logs(sinks.log_rows(answers, allowed, seen), str(tmp_path / "l"))
    r = spark.read.parquet(str(tmp_path / "l")).first()
    assert r.allowed_collections == ["a", "b"] and [x.chunk_id for x in r.retrieved] == ["x", "y"] and str(r.day) == "2024-05-01"


def test_unknown_modes_are_refused(spark):
    a = spark.range(1)
    with pytest.raises(ValueError, match="mode"):
        search.lists("other", a, a)
    assert search.lists("lexical", a, a, False)[2] == [] and search.lists("vector", a, a, False)[2] == [search.NO_EMBEDDING]


def test_robots(spark):
    text = "# rules\nUser-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/open\nDisallow:\n\nUser-agent: b\nDisallow: /"
    robots = spark.createDataFrame([("http://h", 200, text), ("http://gone", 404, "User-agent: *\nDisallow: /")], "origin string, status int, text string")
    urls = spark.createDataFrame([("http://h/x/1",), ("http://h/x/open/1",), ("http://h/y",), ("http://gone/x",), ("http://none/x",), ("http://h",)], "url string")
    got = {r.url: r.allowed for r in web.with_permission(urls, robots).collect()}
    assert got == {"http://h/x/1": False, "http://h/x/open/1": True, "http://h/y": True, "http://gone/x": True, "http://none/x": True, "http://h": True}


def test_sitemaps(spark):
    maps = [("r", "<sitemapindex><sitemap><loc> s1 </loc></sitemap><loc>s2</loc></sitemapindex>"), ("s1", "<urlset><url><loc>http://h/a/</loc></url></urlset>"), ("s2", "<sitemapindex><loc>s3</loc></sitemapindex>"), ("s3", "<urlset><loc>http://h/b</loc></urlset>")]
    df, roots = spark.createDataFrame(maps, "url string, xml string"), spark.createDataFrame([("r",)], "url string")
    assert {r.url for r in web.sitemap_urls(df, roots).collect()} == {"http://h/a", "http://h/b"}
    assert {r.url for r in web.sitemap_urls(df, roots, 1).collect()} == {"http://h/a"}


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.W[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Ann</dc:creator></c>')
    return out.getvalue()


def paragraph(text, style=""):
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_files_are_read_by_their_type(spark, tmp_path):
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{paragraph(x)}</w:tc>" for x in c) + "</w:tr>"
    word = docx(paragraph("My title", "Title") + paragraph("Deep", "Heading9") + paragraph("a", "ListBullet") + paragraph("b", "ListNumber") + paragraph("text") + f"<w:tbl>{row('h', 'i')}{row('x|y')}</w:tbl>")
    assert files.docx_blocks(word)[2] == {"author": "Ann"} and files.docx_blocks(b"PK no zip") == (None, [], {})
    root = tmp_path / "corpus"
    contents = {"hr/pay_scale-2024.txt": b"one\n\ntwo", "hr/sub/page.html": b"<html><title>T</title><body><p>x</p></body></html>", "it/notes.md": b"# Head\n\ntext", "it/word.docx": word, "it/run.txt": b"MZ\x90\x00"}
    for name, data in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    found = files.scanned(spark, root.as_uri())
    rows = {r.path: r for r in files.ingested(found).collect()}
    assert {p: r.collection for p, r in rows.items()} == {p: p.split("/")[0] for p in contents}
    assert [(b.kind, b.text) for b in rows["it/word.docx"].blocks] == [("heading", "My title"), ("heading", "Deep"), ("list", "- a\n- b"), ("paragraph", "text"), ("table", "| h | i |\n|---|---|\n| x/y |  |")]
    assert [b.level for b in rows["it/word.docx"].blocks][:2] == [1, 6]
    assert {p: r.title for p, r in rows.items()} == {"hr/pay_scale-2024.txt": "Pay Scale 2024", "hr/sub/page.html": "T", "it/notes.md": "Head", "it/word.docx": "My title", "it/run.txt": "Run"}
    assert rows["it/run.txt"].refusal == "forbidden_type" and not rows["it/run.txt"].blocks
    assert [b.text for b in rows["hr/pay_scale-2024.txt"].blocks] == ["one", "two"]
    known = found.select("path", "raw_sha256", F.when(F.col("path").startswith("hr"), "ready").otherwise("failed").alias("status"))
    assert {r.path for r in files.to_register(found, known).collect()} == {p for p in contents if p.startswith("it")}


def test_types_by_content(spark):
    cases = [("a", b"PK\x03\x04..word/document.xml"), ("a.docx", b"PK\x03\x04..xl/"), ("a.bin", b"ab\x00c"), ("run", b"#!/usr/bin/env python3\n"), ("run", b"#!/bin/sh\n"), ("x.md", b"# t"), ("x", b"  <!DOCTYPE html>"), ("x.py", b"print")]
    df = spark.createDataFrame([(k, p, bytearray(c)) for k, (p, c) in enumerate(cases)], "k int, path string, content binary")
    from corpusloom.sources import parsers

    rows = df.select("k", parsers.mime_type(F.col("path"), F.col("content")).alias("m")).withColumn("r", parsers.refusal(F.col("m"))).orderBy("k").collect()
    assert [r.m for r in rows] == [files.DOCX, "application/zip", "application/octet-stream", "text/x-python", "text/x-shellscript", "text/markdown", "text/html", "text/x-python"]
    assert [r.r is None for r in rows] == [True, False, False, False, False, True, True, False]


def test_main_part_of_a_page_is_taken_if_it_holds_most_of_it():
    from corpusloom.sources import parsers

    page = "<html><body><div>{}</div><main><h1>T</h1><p>{}</p></main></body></html>"
    assert [b["text"] for b in parsers.html_blocks(page.format("menu", "body " * 20))[1]] == ["T", ("body " * 20).strip()]
    assert [b["text"] for b in parsers.html_blocks(page.format("long " * 20, "body"))[1]] == [("long " * 20).strip(), "T", "body"]


def test_models_plug_in(spark):
    from corpusloom.functions.tokens import token_count
    from corpusloom.operators import retrieval

    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0)], "query_id int, rank int, x double")
    got = {r["rank"]: (round(r.rerank_score, 4), r.rerank_rank) for r in retrieval.rescored(df, F.col("x")).collect()}
    assert got == {1: (0.5, 2), 2: (0.8808, 1)}
    assert df.select(retrieval.query_input(F.lit("q"), "BGE-small")).first()[0].endswith("passages: q") and df.select(retrieval.query_input(F.lit("q"), "other")).first()[0] == "q"
    assert df.select(F.size(retrieval.checked_vectors(F.array(F.lit(1.0).cast("float")), 1))).first()[0] == 1
    with pytest.raises(Exception, match="should have 2 values"):
        df.select(retrieval.checked_vectors(F.array(F.lit(1.0).cast("float")), 2)).collect()
    assert df.select(token_count(F.lit("three words."), "/no/such/file")).first()[0] == 3


def test_a_repeated_status_is_sent_once(spark, tmp_path):
    from corpusloom.streaming.limits import status_events

    rows = [(1, "parsing", "2024-01-01 00:00:00"), (1, "parsing", "2024-01-01 00:00:05"), (1, "ready", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "document_id int, status string, at string").select("document_id", "status", F.col("at").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id int, status string, ts timestamp").parquet(str(tmp_path / "in"))
    query = status_events(stream).writeStream.format("memory").queryName("statuses").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.status, r.event) for r in spark.table("statuses").collect()) == [("parsing", "status"), ("ready", "ready")]


def test_leaks_are_found_by_other_means(spark):
    people = spark.createDataFrame([("a", ["g"], False), ("r", [], True)], "sub string, groups array<string>, is_admin boolean")
    grants = spark.createDataFrame([("c1", "group", "g"), ("c2", "user", "b")], "collection_id string, principal_type string, principal_id string")
    seen = spark.createDataFrame([(1, "a", "c1"), (2, "a", "c1"), (2, "a", "c2"), (3, "r", "c2"), (4, "nobody", "c1")], "query_id int, sub string, collection_id string")
    assert {r.query_id: r.leaked for r in metrics.leaks(seen, people, grants).collect()} == {1: False, 2: True, 3: False, 4: True}
