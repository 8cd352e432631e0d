"""Queries over documents take whole texts and lines, whatever their length."""

import os
import re

import pytest

from corpusloom.plans import document_queries, domain, queries

SF = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")


@pytest.fixture
def tables(spark, tmp_path):
    texts = [(1, "a b. " * 1000 + "It costs 12 euros. None here. 7 more"), (2, "Two 2. Three"), (3, "dir one " * 30 + "/the file name.txt")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), dict(texts)


def test_numeric_claims(spark, tables):
    path, texts = tables
    got = {r.doc_id: r.claims for r in queries()["g12_numeric_claims"](spark, path).collect()}
    assert got == {i: [s for s in re.split(r"(?<=[.!?])\s+", t) if re.search("[0-9]", s)] for i, t in texts.items()}


def test_safe_filename(spark, tables):
    path, texts = tables
    got = {r.doc_id: r[1] for r in queries()["t24_safe_filename"](spark, path).collect()}
    assert got == {i: re.sub(r"[^A-Za-z0-9._-]+", "_", re.split(r"[/\\\\]", t)[-1]) for i, t in texts.items()}


@with_tables
def test_lines(spark):
    """Lines of s10, s11 and s13 are the whole chunks."""
    whole = {(r.document_id, r.ordinal): r.text for r in domain.chunks(spark, SF).select("document_id", "ordinal", "text").collect()}
    assert max(map(len, whole.values())) > 150
    assert {(r.doc_id, r.ordinal): r.text for r in document_queries.lines(spark, SF).collect()} == whole
    assert all(r.text == whole[(r.doc_id, r.ordinal)] for r in queries()["s10_running_lines"](spark, SF).collect())
