"""Token counts without the tokens: rank-synchronous merging of ragged arrays.

A piece model (byte-pair pieces with byte fallback) merges, in a whole text, the neighbouring symbols
whose joined piece scores best. No piece of such a model crosses from a sign to a following space mark,
nor holds a line feed, so a text falls into pre-tokens that merge independently (checked when the model
is loaded). A batch holds its distinct pre-tokens as one flat array of symbols; see merging.py for the
rounds. What remains of each pre-token is its number of tokens; symbols that the model lacks count a
token for each UTF-8 byte.

Nulls and empty texts have no tokens. Rows are counted where they are read: there is no shuffle, and
what a task holds is bounded by its batch and by the memory of pre-tokens (ragged.Memory).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .merging import PairMerger

MARK = "▁"


class PieceCounter:
    """Counts for one piece model; made once in each Python worker."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        pieces = {lib.id_to_piece(i): i for i in ids}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses the borders of pre-tokens")
        scores = {i: lib.get_score(i) for i in ids}
        ranks = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rows = [(pieces[a], pieces[b], ranks[scores[i]], i) for p, i in pieces.items() for k in range(1, len(p)) if (a := p[:k]) in pieces and (b := p[k:]) in pieces]
        self.merger = PairMerger(*np.array(rows, np.int64).reshape(-1, 4).T)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.memory = ragged.Memory(self.merge)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One value, the number of tokens, for each pre-token."""
        words = [p.decode() for p in pieces]
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[points]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        extra = ragged.sums(np.where(symbols < 0, width - 1, 0), sizes)
        _, left = self.merger.run(symbols, sizes)
        return (left + extra).astype(np.int32), np.ones(len(words), np.int32)

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column of any length."""
        return np.concatenate([np.zeros(0, np.int64), *map(self.count_slice, ragged.slices(ragged.strings(column)))])

    def count_slice(self, texts: pa.Array) -> np.ndarray:
        marked = pc.replace_substring(texts, " ", MARK)
        prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", MARK).cast(pa.large_string())
        parts = ragged.Texts(pc.binary_join_element_wise(prefix, marked, pa.scalar("", pa.large_string())))
        if not len(parts.points):
            return np.zeros(len(texts), np.int64)
        first, mark, line = parts.starts_of_texts(), parts.points == ord(MARK), parts.points == 10
        before = np.concatenate([[False], (mark | line)[:-1]])
        start = np.flatnonzero(first | line | np.concatenate([[False], line[:-1]]) | (mark & ~before))
        tokens, _ = self.memory.values(parts.pieces(start, np.append(start[1:], len(parts.points))))
        return ragged.sums(tokens, parts.counts(start))


@functools.cache
def counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def with_token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than `limit` tokens) in place of columns of
    these names. model: path of the piece model on every machine."""

    @F.pandas_udf("long")
    def tokens(column):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(counter(model).count(pa.array(column, pa.large_string(), from_pandas=True)))

    return docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.coalesce(F.col(text), F.lit("")))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
