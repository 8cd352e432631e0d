import os

import public_tokenizers
import pytest

import corpus_pipeline
from corpusloom.llm.queries import QUERIES
from corpusloom.llm.sql import ORACLE_SQL

from ..oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got, want = both(spark, SF, QUERIES[name], ORACLE_SQL[name])
    assert got == want


EN = "the cat and the dog went over the hill with a lot of things that they had found in the old house near the river"
DE = "der hund und die katze gingen über den hügel mit vielen dingen die sie in dem alten haus am fluss gefunden hatten"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_equals_plain_rules(spark, tmp_path):
    from tokenizers import Tokenizer

    leak = "this benchmark passage must never be part of any training text at all"
    rows = [(k, f"{EN} number{k} {' '.join(f'alpha{k}x{j} and the' for j in range(12))}", "en") for k in range(12)]
    rows += [(20 + k, f"{DE} nummer{k} {' '.join(f'beta{k}y{j} und die' for j in range(12))}", "de") for k in range(12)]
    rows += [(40, rows[3][1], "en"), (41, rows[3][1] + " more", "en"), (42, "12345 67890 !!!", "en"), (43, None, "en"), (44, f"{EN} {leak} {EN[::-1]}", "en")]
    rows += [(45, f"{EN} call +1 (784) 555-9263 or write joe@x.org because they had found the things that we want", "en"), (None, f"{DE} ohne nummer und die namen die wir nicht kennen", "de")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept: list[tuple] = []
    for i, t, lang in sorted((r for r in rows if any(map(str.isalpha, r[1] or ""))), key=lambda r: (r[0] is None, r[0])):
        s = shingles(t)
        if not any(100 * len(s & o) >= 75 * len(s | o) for _, _, _, o in kept):
            kept.append((i, t, lang, s))
    wanted = shingles(leak)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t, lang, s in kept:
        if 100 * len(s & wanted) < 75 * len(wanted):
            clean = t.replace("+1 (784) 555-9263", "<PHONE>").replace("joe@x.org", "<EMAIL>")
            want[i] = (lang, lib.encode(clean, add_special_tokens=False).ids)
    got = {r.doc_id: (r.lang, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert {40, 41, 42, 43, 44}.isdisjoint(got) and 45 in got and None in got


def test_stages_take_tables_without_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
