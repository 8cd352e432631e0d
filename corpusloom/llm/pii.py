"""Personal data by fixed rules and a skip-chain conditional random field.

The rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers; what they find stays.
The field judges the other mentions of a document: signs with an @ and groups of seven digits or more
that no rule accepted. Mentions are nodes with the labels O, email, ip, card and phone; those of the
rules are clamped. Neighbouring mentions share a chain potential. Mentions with the same last seven
digits, or the same local part, share a skip potential with the one before, however far away, so a number
that is written once in full and later without its prefix gets one label. Sum-product messages pass along
all edges until they settle; a mention whose marginal for a kind is at least `sure` becomes a span.

Weights are trained here, all at once, by the pseudo-likelihood of the rules' labels: each mention's label given its
shape, the word before it, and the labels of its chain and skip neighbours. A mention that no rule accepted counts as O with a
low weight (it is unlabelled rather than negative); one that resembles an accepted mention is what the field is to judge
and isn't trained on. Without repeated mentions in the sample skip weights stay at zero. The sample
is bounded: the `sample_docs` documents with the smallest text hashes among those with mentions, `sample_mentions` of each.

A null text is an empty one. Spans are in code points, end exclusive; those of one kind don't overlap;
kinds may. Edges link a mention to one earlier one, so work is linear in a text's length whatever repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# tried at the start of a run of digits only: later starts in the run end alike
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().:/-]{0,3}[0-9]){6,}(?![A-Za-z0-9])")
AT = re.compile(r"(?<!\S)[^\s@]{1,64}\s?(?:@|\(at\)|\[at\])\s?[^\s@]{1,255}(?!\S)")
NOT_DIGIT = re.compile(r"[^0-9]+")
BEFORE = re.compile(r"(\w+)\W*$")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield "email", begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind and then start."""
    if not ANY.search(text):
        return []
    out = list(emails(text))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """start, end, label of the nodes of a text in order; label -1: to be judged."""
    out = [(s, e, LABELS.index(k)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    for m in (*NUMBER.finditer(text), *AT.finditer(text)):
        s, e = m.span()
        k = int(np.searchsorted(starts, e)) - 1
        if k < 0 or ends[k] <= s:
            out.append((s, e, -1))
    return sorted(out)


WORDS = 32
N_FEATURES = 18 + WORDS


def features(text: str, start: int, end: int) -> list[int]:
    """Indexes of the features that hold for a mention."""
    said = text[start:end]
    digits = NOT_DIGIT.sub("", said)
    size = np.searchsorted([1, 7, 8, 10, 11, 13, 16, 20], len(digits), side="right")
    signs = [said.count(".") == 3, "(" in said, "-" in said, " " in said, "@" in said, "/" in said or ":" in said, len(digits) > 12 and luhn(digits), said[:1] == "+"]
    word = BEFORE.search(text, max(0, start - 40), start)
    near = int.from_bytes(hashlib.blake2b(word[1].lower().encode(), digest_size=2).digest()) % WORDS if word else 0
    return [0, 1 + int(size), *(10 + k for k, s in enumerate(signs) if s), 18 + near]


def likeness(text: str, start: int, end: int) -> str:
    """Mentions with the same value, other than the empty one, are similar."""
    said = text[start:end]
    if "@" in said or "at)" in said or "at]" in said:
        return "@" + re.sub(r"\W", "", re.split(r"\s?(?:@|\(at\)|\[at\])", said)[0].lower())
    digits = NOT_DIGIT.sub("", said)
    return digits[-7:] if len(digits) >= 7 else ""


def skips(likenesses: list[str]) -> list[tuple[int, int]]:
    """Each mention with the nearest similar one before it."""
    last: dict[str, int] = {}
    out = []
    for k, x in enumerate(likenesses):
        if x:
            if x in last:
                out.append((last[x], k))
            last[x] = k
    return out


class Field:
    """Weights: unary (features, labels), chain and skip (labels, labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, scores: np.ndarray, edges: np.ndarray, skipping: np.ndarray, rounds: int = 30) -> np.ndarray:
        """Loopy sum-product. scores: nodes by labels; edges: rows of two nodes; skipping: whether an
        edge is a skip edge. Messages are damped and stop when they settle."""
        n, k = scores.shape
        if not len(edges):
            return soft(scores)
        tables = np.where(skipping[:, None, None], self.skip, self.chain)
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        messages = np.zeros((2 * m, k))
        for _ in range(rounds):
            belief = scores.copy()
            np.add.at(belief, target, messages)
            out = belief[source] - messages[back]
            new = np.logaddexp.reduce(out[:, :, None] + tables, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            change = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if change < 1e-4:
                break
        belief = scores.copy()
        np.add.at(belief, target, messages)
        return soft(belief)

    def added(self, text: str, base: list[Span], sure: float) -> list[Span]:
        nodes = mentions(text, base)
        if not any(label < 0 for *_, label in nodes):
            return []
        scores = np.zeros((len(nodes), len(LABELS)))
        for k, (s, e, label) in enumerate(nodes):
            if label < 0:
                scores[k] = self.unary[features(text, s, e)].sum(axis=0)
            else:
                scores[k] = -30.0
                scores[k, label] = 0.0
        chain = [(k, k + 1) for k in range(len(nodes) - 1)]
        skip = skips([likeness(text, s, e) for s, e, _ in nodes])
        edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        p = self.marginals(scores, edges, np.arange(len(edges)) >= len(chain))
        return [(LABELS[j], s, e) for (s, e, label), q in zip(nodes, p) if label < 0 and (j := int(q.argmax())) > 0 and q[j] >= sure]


def soft(x: np.ndarray) -> np.ndarray:
    return np.exp(x - np.logaddexp.reduce(x, axis=1)[:, None])


def train(docs: DataFrame, text: str = "text", sample_docs: int = 3000, sample_mentions: int = 50, unlabelled: float = 0.1) -> Field:
    """The field's weights from at most sample_docs documents, and of each at most sample_mentions mentions. Documents are
    counted first; only features of mentions leave the tasks."""
    hashed = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("hash"), text)
    n = hashed.agg(F.approx_count_distinct("hash").alias("n")).first()["n"]
    some = hashed.where(F.col("hash") <= F.lit(below(sample_docs, n)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, t in zip(batch["hash"], batch[text]):
                nodes = mentions(t, base_spans(t))[:sample_mentions]
                links = dict((b, a) for a, b in skips([likeness(t, s, e) for s, e, _ in nodes]))
                shown = [[*features(t, s, e), max(label, 0), int(label >= 0), links.get(k, -1)] for k, (s, e, label) in enumerate(nodes)]
                rows.append((h, [len(x) for x in shown], [v for x in shown for v in x]))
            yield pd.DataFrame(rows, columns=["hash", "sizes", "values"])

    found = some.mapInPandas(each, "hash long, sizes array<int>, values array<int>")
    # texts with one hash count once
    kept = found.groupBy("hash").agg(F.min(F.struct("sizes", "values")).alias("x")).orderBy("hash").limit(sample_docs).collect()
    rows: list[tuple] = []
    for r in kept:
        at, first = 0, len(rows)
        for k, size in enumerate(r["x"]["sizes"]):
            *shape, label, known, link = r["x"]["values"][at : at + size]
            rows.append((shape, label, bool(known), first + k - 1 if k else -1, first + link if link >= 0 else -1))
            at += size
    return fit(rows, unlabelled)


class Sample:
    """Mentions as arrays: features, labels, weights, and for each the mentions before and after it in the chain and by likeness
    (a number beyond the last for none)."""

    def __init__(self, rows: list[tuple], unlabelled: float):
        n = len(rows)
        self.x = np.zeros((n, N_FEATURES), np.float32)
        for i, r in enumerate(rows):
            self.x[i, r[0]] = 1
        self.y = np.array([r[1] for r in rows], np.int64)
        known = np.array([r[2] for r in rows], bool)

        def neighbours(column: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            before, after = np.full(n, n), np.full(n, n)
            for i, r in enumerate(rows):
                if r[column] >= 0 and among[i] and among[r[column]]:
                    before[i], after[r[column]] = r[column], i
            return before, after

        self.chain, self.skip = neighbours(3, np.ones(n, bool)), neighbours(4, known)
        alike = np.zeros(n, bool)
        for i, r in enumerate(rows):
            if r[4] >= 0 and known[i] != known[r[4]]:
                alike[i if known[r[4]] else r[4]] = True
        self.weight = np.where(known, 1.0, np.where(alike, 0.0, unlabelled))

    def likelihood(self, field: Field) -> tuple[float, Field]:
        """The mean weighted log pseudo-likelihood and its gradient."""
        k, n = len(LABELS), len(self.y)
        hot = np.zeros((n + 1, k))
        hot[np.arange(n), self.y] = 1.0
        scores = self.x @ field.unary
        for (before, after), table in ((self.chain, field.chain), (self.skip, field.skip)):
            scores = scores + hot[before] @ table + hot[after] @ table.T
        total = max(self.weight.sum(), 1e-9)
        logs = scores - np.logaddexp.reduce(scores, axis=1)[:, None]
        gap = (hot[:n] - np.exp(logs)) * (self.weight / total)[:, None]
        tables = [hot[before].T @ gap + (hot[after].T @ gap).T for before, after in (self.chain, self.skip)]
        return float((logs[np.arange(n), self.y] * self.weight).sum() / total), Field(self.x.T @ gap, *tables)


def fit(rows: list[tuple], unlabelled: float, rounds: int = 300, rate: float = 0.05, shrink: float = 1e-4) -> Field:
    """Weights of greatest pseudo-likelihood, less `shrink` / 2 times their squares, by gradient steps of adapted size.
    rows: features, label, whether a rule gave it, the mention before, and the similar one before (-1: none)."""
    k = len(LABELS)
    weights = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))]
    weights[0][0, 0] = 2.0  # without examples a mention is O
    sample = Sample(rows, unlabelled)
    slope, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, rounds + 1 if rows else 1):
        found = sample.likelihood(Field(*weights))[1]
        for w, g, m, v in zip(weights, (found.unary, found.chain, found.skip), slope, square):
            g = g - shrink * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(*weights)


def written(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find(docs: DataFrame, field: Field, text: str = "text", sure: float = 0.9) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of the rules), base_spans and spans ("kind:start:end" by
    kind as listed and start, joined by commas; spans has the field's too)."""
    sent = docs.sparkSession.sparkContext.broadcast((field.unary, field.chain, field.skip))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")
    def result(column: pd.Series) -> pd.DataFrame:
        model, rows = Field(*sent.value), []
        for t in column:
            base = base_spans(t) if t else []
            more = model.added(t, base, sure) if t and ANY.search(t) else []
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, written(base), written(base + more)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    out = docs.withColumn("__pii", result(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({c: F.col(f"__pii.{c}") for c in ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")}).drop("__pii")


def redacted(docs: DataFrame, field: Field, text: str = "text", sure: float = 0.9) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become
    one, named by the first. Null texts stay null; the other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((field.unary, field.chain, field.skip))

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        model = Field(*sent.value)
        return pd.Series([t if t is None or not ANY.search(t) else without(t, (b := base_spans(t)) + model.added(t, b, sure)) for t in column], dtype=object)

    return docs.withColumn(text, clean(text))


def without(text: str, spans: list[Span]) -> str:
    out, end, kind = [], 0, ""
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if kind and a < end:
            end = max(end, b)
            continue
        if kind:
            out.append(f"<{kind.upper()}>")
        out.append(text[end:a])
        kind, end = k, b
    return "".join([*out, f"<{kind.upper()}>" if kind else "", text[end:]])
