"""Fill-in-the-middle transformation by a two-pass streaming matcher.

The units of a text are runs of the letters A to Z in either case, and every other code point by itself.
A first pass of a lazy matcher counts them; a second one advances to the two ranks at which the text is cut,
and no further. No array of units is ever stored: beyond the text itself a row takes constant memory. Ranks
and forms come from a hash of the document's id, so that reruns and retried tasks agree.

Everything but the two counts is column expressions, and rows stay where they are read: there is no shuffle.

Defined results: a null text is an empty one; an empty text, or one that holds a mark, is plain; a null id
hashes as empty; rows with the same id and text get the same result; extra columns stay, those with a name
of the result are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: The units, the marks, and the shares in a hundred.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 90, 20

CUT = ["n", "prefix_chars", "middle_chars"]


def count(text: str) -> int:
    """Units of the text: the first pass."""
    return sum(map(bool, UNIT.finditer(text)))


def advanced(units: Iterator[re.Match], by: int, now: int) -> int:
    """The end of the unit `by` places on, or `now` where that is none."""
    return next(itertools.islice(units, by - 1, None)).end() if by else now


def ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Offsets after `first` and after `second` units, first <= second: the second pass."""
    units = UNIT.finditer(text)
    begin = advanced(units, first, 0)
    return begin, advanced(units, second - first, begin)


@F.pandas_udf(StructType([StructField(name, LongType()) for name in CUT]))
def cuts(texts: pd.Series, plain: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Units of each text and, unless it stays plain, the sizes of prefix and middle."""
    rows = []
    for text, same, a, b in zip(texts, plain, h1, h2):
        n = count(text)
        begin, end = (0, 0) if same else ends(text, *sorted((a % (n + 1), b % (n + 1))))
        rows.append((n, begin, end - begin))
    return pd.DataFrame(rows, columns=CUT)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 for each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars (null where plain) and output."""
    given = F.coalesce(F.col(text), F.lit(""))
    marked = given.contains(PREFIX) | given.contains(SUFFIX) | given.contains(MIDDLE)
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    plain = (given == "") | marked | (h3 % 100 >= RATE)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_RATE, "spm").otherwise("psm")
    cut = docs.withColumn("form", form).withColumn("cut", cuts(given, F.col("form") == "plain", h1, h2))
    head, mid = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    prefix, middle = F.substring(given, F.lit(1), head), F.substring(given, head + 1, mid)
    suffix = F.substring(given, head + mid + 1, F.lit(2**31 - 1))
    whole = F.when(F.col("form") == "plain", given)
    whole = whole.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    whole = whole.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cutting = F.col("form") != "plain"
    return cut.withColumns({
        "n": F.col("cut.n"), "prefix_chars": F.when(cutting, F.col("cut.prefix_chars")),
        "middle_chars": F.when(cutting, F.col("cut.middle_chars")), "output": whole,
    }).drop("cut")


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made from. A mark can't arise where two parts meet, so the three
    that were put in are the only ones."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )
