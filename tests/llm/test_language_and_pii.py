"""Language identification against plain zstandard, and the parts of the personal data search against brute force."""

import itertools
import os
import random
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import language_id, pii

SF = "/root/testdata/sf0.01"


def sizes(text, content):
    """Compressed size of a text, block by block, with a compressor made anew for each block."""
    plain = re.sub(r"[\W\d_]+", " ", text.lower())
    how = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False
    )
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=words).compress(plain[k : k + 2000].encode())) for k in range(0, len(plain), 2000))


@pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")
def test_languages_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language_id.held_out()
    learned = language_id.learn(docs.where(~held))
    rows = language_id.identify(docs.select("doc_id", "text", "lang", held.alias("held")), learned).collect()
    right = [r.lang_pred == r.lang for r in rows if r.held and r.lang is not None and r.lang_pred != "und"]
    assert len(rows) == docs.count() and np.mean(right) > 0.95
    for r in rows[::9]:
        if r.lang_pred != "und":
            got = {k: sizes(r.text, v) for k, v in learned.items()}
            assert r.lang_pred == min(sorted(got), key=got.get)
            a, b = sorted(got.values())[:2]
            assert r.score == pytest.approx(min(1.0, (b - a) / b / 0.1)) and r.rejected == ((b - a) / b < 0.001)


def test_tied_languages_go_to_the_first_by_name(spark):
    docs = spark.createDataFrame([(1, "some words that both know")], "doc_id long, text string")
    r = language_id.identify(docs, {"b": b"some words", "a": b"some words"}).first()
    assert (r.lang_pred, r.score, r.rejected) == ("a", 0.0, True)


def test_sample_is_that_of_the_smallest_hashes(spark):
    docs = spark.range(5000).select(F.concat(F.lit("text "), F.col("id") % 3000).alias("text"), F.when(F.col("id") % 7 == 0, "x").otherwise("y").alias("lang"))
    got = language_id.learn(docs, sample_rows=20)
    for lang in "xy":
        mine = docs.where(F.col("lang") == lang).select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(20).collect()
        assert got[lang] == " ".join(language_id.letters(r.text) for r in mine).encode()


def plain_spans(text):
    """The rules as patterns: leftmost matches of each kind, those that fail their test left out."""
    def luhn(d):
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, good) in rules.items() for m in re.finditer(p, text) if good(m)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "@", ".", "-", "+", " ", "(", ")", "0", "1", "9", "25", "255", "4111", "1111 1111", "x@y.z", "+49 30", "\n", "é", "_", "%"]), max_size=40).map("".join))
def test_rules_equal_their_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("seed", range(8))
def test_marginals_equal_enumeration(seed):
    """On trees of chain and skip edges messages give exact marginals; on loops they come near."""
    draw, k = np.random.default_rng(seed), len(pii.LABELS)
    field = pii.Field(np.zeros((pii.N_FEATURES, k)), draw.normal(size=(k, k)), draw.normal(size=(k, k)))
    n = 5
    edges = [(0, 1), (1, 2), (2, 3), (1, 4)] if seed % 2 else [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)]
    skipping = np.array([False, False, False, True] if seed % 2 else [False] * 4 + [True])
    scores = draw.normal(size=(n, k))
    want = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        s = sum(scores[i, y] for i, y in enumerate(labels)) + sum((field.skip if z else field.chain)[labels[a], labels[b]] for (a, b), z in zip(edges, skipping))
        for i, y in enumerate(labels):
            want[i, y] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    got = field.marginals(scores, np.array(edges), skipping, rounds=300)
    assert np.abs(got - want).max() < (1e-3 if seed % 2 else 0.15)


def test_gradient_of_the_pseudo_likelihood():
    draw, k = random.Random(2), len(pii.LABELS)
    rows = [([0, draw.randrange(1, pii.N_FEATURES)], draw.randrange(k), draw.random() < 0.7, i - 1 if i % 5 else -1, i - 3 if i % 7 > 3 else -1) for i in range(40)]
    sample, noise = pii.Sample(rows, 0.1), np.random.default_rng(3)
    weights = [noise.normal(size=s) for s in ((pii.N_FEATURES, k), (k, k), (k, k))]
    found = sample.likelihood(pii.Field(*weights))[1]
    for part, gradient in enumerate((found.unary, found.chain, found.skip)):
        for _ in range(20):
            at = tuple(noise.integers(0, s) for s in gradient.shape)
            ends = []
            for step in (1e-5, -1e-5):
                moved = [w.copy() for w in weights]
                moved[part][at] += step
                ends.append(sample.likelihood(pii.Field(*moved))[0])
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(gradient[at], abs=1e-6)


def test_skip_weights_are_learned_from_repeated_mentions(spark):
    """Numbers that come back carry their label to a mention that no rule accepts."""
    draw = random.Random(4)
    number = lambda: f"{draw.randrange(200, 999)}-{draw.randrange(1000000, 9999999)}"
    rows = []
    for k in range(120):
        a = number()
        rows.append((k, f"call +1 {a} or mail n{k}@x.org today, lot {draw.randrange(10**8, 10**9)}; again +1 {a} and n{k}@x.org."))
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    phone, none = pii.LABELS.index("phone"), 0
    assert field.skip[phone, phone] > 0.5 > 0 > field.skip[phone, none]
    text = "call +1 784-5559263 now. " + "filler " * 300 + "then 784-5559263 again"
    nodes = pii.mentions(text, pii.base_spans(text))
    edges = np.array(pii.skips([pii.likeness(text, s, e) for s, e, _ in nodes]))
    assert edges.tolist() == [[0, 1]]
    clamped = np.where(np.arange(len(pii.LABELS)) == phone, 0.0, -30.0)
    scores = np.array([clamped, field.unary[pii.features(text, *nodes[1][:2])].sum(axis=0)])
    linked = field.marginals(scores, edges, np.array([True]))[1, phone]
    alone = field.marginals(scores, edges[:0], np.zeros(0, bool))[1, phone]
    assert linked > 2 * alone
