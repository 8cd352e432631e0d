"""Exact encoding and decoding for a word-level BPE vocabulary, with a lexicon automaton.

Frequent words of the corpus are compiled, with their ids as outputs, into a minimal acyclic automaton
whose words share suffixes: each edge carries the number of words that its earlier siblings lead to, so
the sum along a path is the word's place in the table of outputs. The automaton is a block of arrays
that each Python worker maps from a file. Words it lacks are merged exactly (merging.py).

The text rules are those of the vocabulary file: special strings are cut out of the raw text; the rest is
composed (NFC), lower-cased sign by sign, and split into runs of letters, single numbers, English short
forms and runs of other signs; white space is dropped. A word's UTF-8 bytes are its first symbols, the
last one marked as a word end. Decoding joins the ids' entries with single spaces, as a vocabulary
without a decoder does. Truncation and padding are never applied.

Nulls count as empty texts, which give no ids and an empty decoded text. Equal words of any frequency and
repeated rows change nothing but time; clashing extra columns are the caller's to keep (encode() adds
`ids` only). The lexicon's contents never change a result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .common import lean
from .merging import PairMerger

#: Bytes of text that are held as arrays at once.
SLICE = 1 << 19


class Lexicon:
    """A minimal acyclic automaton over byte words in ascending order; each word has a run of ids."""

    FIELDS = ("key", "target", "skip", "final", "start", "size", "ids")
    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32, np.int32)

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.n = len(self.size)

    @classmethod
    def build(cls, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> Lexicon:
        """words: distinct and ascending; ids: flat; sizes: ids of each word."""
        register: dict[tuple, int] = {}
        edges: list[tuple] = []  # by state: final, edges
        counts: list[int] = []

        def state_of(node: list) -> int:
            what = (node[0], tuple(node[1]))
            if what not in register:
                register[what] = len(edges)
                edges.append(what)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return register[what]

        path, last = [[0, []]], b""  # open nodes along the last word

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], state_of(node)))

        for word in words:
            common = len(os.path.commonprefix([last, word]))
            close(common)
            path.extend([0, []] for _ in word[common:])
            path[-1][0], last = 1, word
        close(0)
        root = state_of(path[0])
        key, target, skip = [], [], []
        for s, (final, out) in enumerate(edges):
            before = final
            for byte, t in out:
                key.append((s << 8) | byte)
                target.append(t)
                skip.append(before)
                before += counts[t]
        key.append((len(edges) << 8) | 255)  # never matches; ends the search
        target.append(root)  # the last entry names the root
        skip.append(0)
        start = np.cumsum(sizes) - sizes
        values = (key, target, skip, [f for f, _ in edges], start, sizes, ids)
        return cls({k: np.asarray(v, t) for k, v, t in zip(cls.FIELDS, values, cls.KINDS)})

    def to_bytes(self) -> bytes:
        parts = [getattr(self, k) for k in self.FIELDS]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """From a file, through the page cache."""
        sizes = np.fromfile(path, np.int64, len(cls.FIELDS)).tolist()
        arrays, at = {}, 8 * len(cls.FIELDS)
        for name, kind, n in zip(cls.FIELDS, cls.KINDS, sizes):
            arrays[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize + -n * np.dtype(kind).itemsize % 8
        return cls(arrays)

    def find(self, words: pa.Array) -> np.ndarray:
        """The numbers of the words (large_binary), -1 for those the lexicon lacks; all in step, byte by byte."""
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        offset = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        size = np.diff(offset)
        number, out = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        live = np.flatnonzero(size > 0)
        state = np.full(len(live), int(self.target[-1]), np.int64)
        depth = 0
        while len(live):
            want = (state << 8) | data[offset[live] + depth]
            at = np.searchsorted(self.key[:-1], want)
            hit = self.key[at] == want
            live, at = live[hit], at[hit]
            number[live] += self.skip[at]
            state = self.target[at].astype(np.int64)
            depth += 1
            ended = size[live] == depth
            done = ended & (self.final[state] == 1)
            out[live[done]] = number[live[done]]
            live, state = live[~ended], state[~ended]
        return out


class Codec:
    """Encoding and decoding for one vocabulary file; made once in each Python worker."""

    def __init__(self, vocabulary: str, lexicon: Lexicon | None = None):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), "")
        names |= {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names[i] for i in range(len(names))]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rows = np.array([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)], np.int64)
        self.merger = PairMerger(*rows.reshape(-1, 4).T)
        signs = byte_signs()
        self.plain = np.array([vocab[s] for s in signs], np.int64)
        self.ending = np.array([vocab[s + end] for s in signs], np.int64)
        self.lexicon = lexicon
        self.memory = ragged.Memory(self.merge, 100_000)
        spaced = [n + " " for n in self.names]
        self.spaced = pa.array(spaced, pa.large_string())
        self.numbers = pa.array([f"{i} " for i in range(len(self.names))], pa.large_string())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.plain[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.ending[data[last]]
        return self.merger.run(symbols, sizes)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of texts without special strings, and how many each text has."""
        parts = ragged.Texts(pa.array(map(self.normal, texts.to_pylist()), pa.large_string()))
        starts, ends = ragged.word_pieces(parts)
        return parts.pieces(starts, ends), parts.counts(starts)

    def ids_of_words(self, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, flat, and how many each word has: from the lexicon, or merged."""
        if self.lexicon is None or not self.lexicon.n:
            return self.memory.values(words)
        lex, distinct = self.lexicon, words.dictionary
        number = lex.find(distinct)
        unseen = np.flatnonzero(number < 0)
        slots = self.memory.slots(distinct.take(pa.array(unseen)).to_pylist())
        start, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        seen = np.flatnonzero(number >= 0)
        start[seen], size[seen] = lex.start[number[seen]], lex.size[number[seen]]
        start[unseen], size[unseen] = self.memory.start[slots] + len(lex.ids), self.memory.size[slots]
        at = words.indices.to_numpy()
        both = np.concatenate([lex.ids, self.memory.flat[: self.memory.used]])
        return both[ragged.spread(start[at], size[at])], size[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large_string without nulls), flat, and how many each has."""
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not special.any():
            words, counts = self.words(texts)
            ids, sizes = self.ids_of_words(words)
            return ids, ragged.sums(sizes, counts)
        parts: list[str] = []
        owner: list[int] = []
        fixed: list[int] = []
        for k, text in enumerate(texts.to_pylist()):
            for piece, i in self.cut(text) if special[k] else [(text, -1)]:
                parts.append(piece)
                owner.append(k)
                fixed.append(i)
        words, counts = self.words(pa.array(parts, pa.large_string()))
        ids, sizes = self.ids_of_words(words)
        sizes, fixed_ids = ragged.sums(sizes, counts), np.array(fixed)
        total = sizes + (fixed_ids >= 0)
        out = np.zeros(int(total.sum()), np.int64)
        begin = np.cumsum(total) - total
        out[ragged.spread(begin, sizes)] = ids
        out[begin[fixed_ids >= 0]] = fixed_ids[fixed_ids >= 0]
        return out, np.bincount(owner, total, len(texts)).astype(np.int64)

    def cut(self, text: str) -> Iterator[tuple[str, int]]:
        """The text's parts: ordinary ones with -1, special strings as empty parts with their ids."""
        at = 0
        while True:
            found = min(((p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0), default=None)
            if found is None:
                yield text[at:], -1
                return
            yield text[at : found[0]], -1
            yield "", self.special[found[2]]
            at = found[0] - found[1]

    def joined(self, table: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """For each text the table's entries of its ids, without the space that ends the last one."""
        flat = table.take(pa.array(ids, pa.int64()))
        offset = np.frombuffer(flat.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(flat.buffers()[2] or b"") if len(ids) else memoryview(b"")
        end = np.cumsum(sizes)
        return [data[a : b - 1] if b > a else data[:0] for a, b in zip(offset[end - sizes].tolist(), offset[end].tolist())]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        return [str(x, "utf-8") for x in self.joined(self.spaced, ids, sizes)]


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


@functools.lru_cache(2)
def codec(vocabulary: str, name: str, content: Content) -> Codec:
    """name: of the lexicon, so that a worker maps each one once."""
    with tempfile.NamedTemporaryFile(suffix=".lexicon") as f:  # the mapping outlives the name
        f.write(content.get())
        f.flush()
        return Codec(vocabulary, Lexicon.mapped(f.name))


class Content:
    """A broadcast lexicon; equal for lru_cache whatever the broadcast object is."""

    def __init__(self, broadcast):  # type: ignore[no-untyped-def]
        self.broadcast = broadcast

    def get(self) -> bytes:
        return self.broadcast.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Content)

    def __hash__(self) -> int:
        return 0


def frequent_words(docs: DataFrame, vocabulary: str, text: str = "text", share: float = 2e-6, most: int = 200_000) -> DataFrame:
    """Words that make up at least `share` of all words of the corpus, with counts.

    Words are counted in blocks of a task's rows, and a block passes on those with at least that share
    of its own words; a word with that share overall has it in some block, so none is missed. A block
    ends when it holds half a million distinct words. `most` bounds the lexicon, by count, then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, totals, n = plain_codec(vocabulary), {}, 0

        def block() -> pa.RecordBatch:
            rows = [(w, c) for w, c in totals.items() if c >= max(2, share * n)]
            columns = [pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for part in ragged.slices(ragged.strings(batch.column(0)), SLICE):
                words, _ = tool.words(part)
                n += len(words)
                counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).tolist()
                for w, c in zip(words.dictionary.to_pylist(), counts):
                    totals[w] = totals.get(w, 0) + c
                if len(totals) > 500_000:
                    yield block()
                    totals.clear()
                    n = 0
        yield block()

    found = docs.select(text).mapInArrow(lean(count), "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


@functools.lru_cache(1)
def plain_codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def build_lexicon(docs: DataFrame, vocabulary: str, text: str = "text", **bounds: float) -> Lexicon:
    """The lexicon of the corpus's frequent words; bounds as for frequent_words()."""
    words = sorted(bytes(r[0]) for r in frequent_words(docs, vocabulary, text, **bounds).select("word").collect())
    ids, sizes = plain_codec(vocabulary).merge(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Lexicon.build(words, ids, sizes)


def shipped(docs: DataFrame, lexicon: Lexicon) -> tuple[str, Content]:
    data = lexicon.to_bytes()
    return hashlib.sha256(data).hexdigest(), Content(docs.sparkSession.sparkContext.broadcast(data))


def encode(docs: DataFrame, vocabulary: str, lexicon: Lexicon, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with the column `ids`, the ids of the whole text, and with `decoded` on request what these
    decode to; columns of these names are replaced. A slice of a batch at a time is held and passed on."""
    name, content = shipped(docs, lexicon)
    kept = docs.drop("ids", "decoded")
    place = kept.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, name, content)
        for batch in batches:
            at = 0
            for part in ragged.slices(ragged.strings(batch.column(place)), SLICE):
                ids, sizes = tool.encode(part)
                columns = [c.slice(at, len(part)) for c in batch.columns] + [ragged.list_array(ids.astype(np.int32), sizes, pa.int32())]
                if decoded:
                    columns.append(pa.array(tool.decode(ids, sizes), pa.string()))
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])
    return kept.mapInArrow(lean(each), schema)


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """docs with the column `decoded`; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def text_of(column):  # type: ignore[no-untyped-def]
        import pandas as pd

        tool = plain_codec(vocabulary)
        lists = [np.asarray(x if x is not None else [], np.int64) for x in column]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return pd.Series(tool.decode(np.concatenate([np.zeros(0, np.int64), *lists]), sizes), dtype=object)

    return docs.withColumn("decoded", text_of(ids))


def digests(docs: DataFrame, vocabulary: str, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row, computed beside the ids so that these
    need not leave the task."""
    name, content = shipped(docs, lexicon)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, name, content)
        for batch in batches:
            at = 0
            for part in ragged.slices(ragged.strings(batch.column(1)), SLICE):
                ids, sizes = tool.encode(part)
                hexes = [[hashlib.sha256(x).hexdigest() for x in tool.joined(t, ids, sizes)] for t in (tool.numbers, tool.spaced)]
                columns = [batch.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), *(pa.array(h, pa.string()) for h in hexes)]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(lean(digest), schema)
