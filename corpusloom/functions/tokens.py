"""Token numbers by a tokenizer's vocabulary file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def token_count(text: Column, vocabulary: str | None) -> Column:
    """Tokens of a text as the tokenizers library counts them with a vocabulary file, no special ones added; without such a file
    the estimate of T.simple_token_count. A null text has none."""
    plain = F.coalesce(text, F.lit(""))
    if not vocabulary or not os.path.isfile(vocabulary):
        return F.coalesce(T.simple_token_count(plain), F.lit(0))

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(vocabulary)
        lib.no_truncation()
        lib.no_padding()
        for texts in batches:
            yield pd.Series([len(e.ids) for e in lib.encode_batch(texts.tolist(), add_special_tokens=False)], dtype="int32")

    return count(plain)
