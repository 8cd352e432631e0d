"""Language identification by compression with per-language dictionaries.

Each language has a zstandard raw-content dictionary made of training texts. Texts are lower-cased and
each run of signs that aren't letters becomes one space. A text is cut into blocks; each block is
compressed with every dictionary, and the sizes are added up, so a text of any length is judged as a
whole and its last block counts like its first. The smallest total
names the language. The score is the share by which it undercuts the runner-up, against `full_margin`.

A null text, or one without a letter, has the language `und`, score 0 and is rejected. Ties go to the
language that sorts first; with a tie the score is 0. A result is rejected if it undercuts the runner-up
by less than `min_margin` of its size. Input columns named like the results are replaced.

The dictionaries are fitted on a bounded sample: for each language the training rows with the smallest
hashes of their texts, `sample_rows` at most, and of these `dictionary_bytes` at most. Languages are counted first, so
that about four times the sample is all that is shuffled, whatever the size of the corpus.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below

UNKNOWN = "und"
BLOCK = 2000
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 400, dictionary_bytes: int = 50_000, longest: int = 2000) -> dict[str, bytes]:
    """Dictionaries by language. Rows without text or language are left out. Of a sampled row at most
    `longest` code points are kept, so that no language is learned from one document."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = rows.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.substring(text, 1, longest).alias("text"))
    # how many texts a language has decides below which hash a row can be of the sample; the others don't leave their tasks
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    bounds = [(k, below(sample_rows, n)) for k, n in sizes.items()]
    some = hashed.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where("hash <= bound")
    # equal texts have equal hashes and count once
    first = Window.partitionBy("lang").orderBy("hash", "text")
    sample = some.drop("bound").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_rows)
    out: dict[str, dict[int, str]] = {}
    for r in sample.collect():
        out.setdefault(r["lang"], {})[r["hash"]] = r["text"]
    return {k: " ".join(letters(v) for _, v in sorted(texts.items())).encode()[:dictionary_bytes] for k, texts in sorted(out.items())}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        # short matches tell languages apart better than the speed-first defaults find them
        how = z.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False
        )
        self.names, self.tools = sorted(dictionaries), []
        for name in self.names:
            content = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.tools.append(z.ZstdCompressor(compression_params=how, dict_data=content))

    def sizes(self, text: str) -> np.ndarray:
        plain = letters(text)
        blocks = [plain[i : i + BLOCK].encode() for i in range(0, len(plain), BLOCK)]
        return np.array([sum(len(t.compress(b)) for b in blocks) for t in self.tools])


@functools.lru_cache(1)
def compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> Compressors:
    return Compressors(dict(dictionaries))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.001, full_margin: float = 0.1) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected. Without dictionaries all rows are `und`.

    The dictionaries, of a bounded size each, go to the executors in one broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def judge(texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        tools = compressors(sent.value)
        for t in texts:
            if not t or not tools.names or not any(map(str.isalpha, t)):
                yield UNKNOWN, 0.0, True
                continue
            sizes = tools.sizes(t)
            order = np.argsort(sizes, kind="stable")
            best, second = sizes[order[0]], sizes[order[min(1, len(order) - 1)]]
            margin = (second - best) / second if len(order) > 1 else full_margin
            yield tools.names[order[0]], float(min(1.0, margin / full_margin)), bool(margin < min_margin)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def result(column):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.DataFrame(judge([x if isinstance(x, str) else None for x in column]), columns=["lang_pred", "score", "rejected"])

    out = docs.withColumn("__language", result(text))
    return out.withColumns({c: F.col(f"__language.{c}") for c in ("lang_pred", "score", "rejected")}).drop("__language")


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: those whose crc32 of the key's text leaves 2 when divided by 4."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2
