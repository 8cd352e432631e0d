"""Signs on which the regular expressions of Java and of SQL differ."""
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import both

TEXTS = [
    "Is Paris Geä in the list", "Gegekeitä?", "AB CDä and ÄAB CD", "AB\x0bCD EF", "ſo it\n", "What About Über Rom, of the Hei?", "and Über\n", "İt İs AB CD", "also Rom-?\n",
    "a holiday policy at Rom for the", None, "Hei-ä", "x\x85", "what about\x0bEF GH?", "Ende", "", "it",
]


@pytest.mark.parametrize("name", ["g2_standalone_questions", "t22_payloads", "t2_tokens"])
def test_java_and_sql_edges(spark, tmp_path, name):
    turns = [(str(k), t, "user", x) for k, first in enumerate(TEXTS) for t, x in [(1, first), *((2 + j, y) for j, y in enumerate(TEXTS)), (None, first)]]
    spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, str(tmp_path), queries()[name], oracle_sql()[name])
    assert got == want


def test_a_token_count_takes_every_sign_as_sql(spark, tmp_path):
    """Alone, behind a letter and before one: each sign that there is; and texts without words or signs."""
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"{s} abcdef{s} {s}abcdef" for s in signs[k : k + 8]) for k in range(0, len(signs), 8)]
    texts += ["", "   ", "\x0b", None, "a½ ²", "éte ́", "‍_‿Ⓐ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, str(tmp_path), queries()["t8_simple_token_count"], oracle_sql()["t8_simple_token_count"])
    assert got == want
