"""Every operator over nulls, empty and very long texts, repeated rows, ties, clashing columns and empty tables."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe_codec, chat_format, common, decontaminate, language_id, near_dedup, pii, substring_dedup, token_counts, token_output, topk_search

SCHEMA = "doc_id long, text string, lang string, n_tokens int, score string, key int, ids string, class string, rank int"
PROSE = " ".join(f"word{k % 97} and thing{k % 89}" for k in range(400))
TEXTS = [
    (1, PROSE), (2, PROSE), (3, PROSE + " changed end"), (4, None), (5, ""), (6, "one"), (7, "one"), (8, " \n\t "), (None, "nameless text with some words in it"),
    (None, None), (9, "x" * 30_000), (10, "ab " * 20_000), (11, "İ Σ ß é é 日本 😀 <|endoftext|> <s> ▁▁ 'S don't 12.5"), (12, "mail a.b@c.org, 10.0.0.1, +49 (30) 123-4567, 4111 1111 1111 1111"),
    (12, "mail a.b@c.org, 10.0.0.1, +49 (30) 123-4567, 4111 1111 1111 1111"), (13, "One two three four five six. " * 9), (14, "\x00\x1c\x85 　 end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], 7, "s", 1, "i", "c", 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_near_duplicates(docs, empty):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) and near_dedup.near_duplicates(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.component_id, r.kept, r.n_shingles))
    assert {by[k][0][0] for k in (1, 2, 3)} == {1} and [by[k][0][1] for k in (1, 2, 3)] == [True, False, False]
    assert by[6][0][:2] == (6, True) and by[7][0][0] == 6
    assert by[4][0] == (4, True, 0) and by[5][0] == (5, True, 0) and by[8][0] == (8, True, 0)
    assert len(by[12]) == 2 and len(by[None]) == 2


def test_links_within_one_crowded_bucket(spark, monkeypatch):
    """Chains of documents, each like its neighbours only, and blocks smaller than the lists."""
    monkeypatch.setattr(near_dedup, "LIST", 300)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 80])) for k in range(40)] + [(100 + k, " ".join(words[:60] + [f"t{k}_{j}" for j in range(30)])) for k in range(20)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and n:
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two three four five six one two"), (2, "one"), (3, None), (4, "never seen in any of these at all"), (1, "one two three four five six one two")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.union(spark.createDataFrame([(50, "x " * 5000 + "one two three four five six one two" + " y" * 9000, *[None] * 7)], SCHEMA)), items).collect())
    assert got == [(6, 2), (7, 2), (50, 1)]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_items_in_several_blocks(spark, docs, monkeypatch):
    """More items than one broadcast takes."""
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    words = PROSE.split()
    items = spark.createDataFrame([(k, " ".join(words[9 * k : 9 * k + 12])) for k in range(10)] + [(99, "of no document at all here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, k) for d in (1, 2, 3) for k in range(10)}


def test_language(docs, empty):
    rows = language_id.identify(docs, language_id.learn(docs)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_token_output(spark, docs, empty):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(vocabulary)
    path = common.shared_path(spark, "test")
    token_output.write(docs, path, vocabulary)
    got = [(r.start, r.n_tokens, r.ids_crc32) for r in token_output.digests(token_output.read(spark, path)).orderBy("start").collect()]
    want, start = [], 0
    for _, t in sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    one = token_output.read(spark, path, [11])
    assert one.count() == 1 and "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,11)" in one._jdf.queryExecution().toString()
    from_files(spark, path)
    nothing = common.shared_path(spark, "test")
    token_output.write(empty, nothing, vocabulary)
    assert token_output.digests(token_output.read(spark, nothing)).count() == 0


def from_files(spark, path):
    """Row indexes and Bloom filters of doc_id are in the files, and ids are stored by run-length encoding."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    conf = spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    stripes = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows, columns = reader.rows(), reader.getSchema().getMaximumId() + 1
        every = gateway.new_array(jvm.boolean, columns)
        for k in range(columns):
            every[k] = True
        for k in range(reader.getStripes().size()):
            index = rows.readRowIndex(k, every, every)
            stripes += 1
            assert index.getRowGroupIndex()[1].getEntryCount() >= 1 and index.getBloomFilterIndex()[1].getBloomFilterCount() >= 1
        kinds = [str(e.getKind()) for e in rows.readStripeFooter(reader.getStripes().get(0)).getColumnsList()] if reader.getStripes().size() else []
        assert not kinds or kinds[1] == kinds[-1] == "DIRECT_V2"
        rows.close()
    return stripes


def test_stripes_of_large_files(spark):
    """Ids beyond a stripe's size are cut into several stripes, each with its index."""
    draw = np.random.default_rng(3)
    rows = [(k, " ".join(map(str, draw.integers(0, 10**6, 3000)))) for k in range(300)]
    path = common.shared_path(spark, "test")
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, public_tokenizers.path("byte_bpe_50k.json"), stripe_bytes=1 << 18, row_index_stride=1000)
    assert from_files(spark, path) > 1 and token_output.read(spark, path).count() == 300


def test_codec(docs, empty):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(vocabulary)
    for most in (0, 5, 1000):
        lexicon = bpe_codec.build_lexicon(docs, vocabulary, most=most) if most else bpe_codec.Lexicon.build([], np.zeros(0), np.zeros(0))
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(docs, vocabulary, lexicon).collect())
        want = Counter()
        for i, t in texts(docs):
            ids = lib.encode(t, add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want[(i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] += 1
        assert got == want
    both = bpe_codec.decode(bpe_codec.encode(docs, vocabulary, lexicon, decoded=True).withColumnRenamed("decoded", "beside"), vocabulary).collect()
    assert len(both) == len(TEXTS) and all(r.beside == r.decoded == lib.decode(lib.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in both)
    assert bpe_codec.digests(empty, vocabulary, bpe_codec.build_lexicon(empty, vocabulary)).count() == 0


def test_lexicon_holds_its_words_and_no_others():
    import pyarrow as pa

    words = sorted({bytes(w) for w in np.random.default_rng(1).integers(97, 100, (300, 5), np.uint8)} | {b"a", b"ab", b"abc"})
    sizes = np.arange(len(words)) % 3 + 1
    lexicon = bpe_codec.Lexicon.build(words, np.arange(sizes.sum()), sizes)
    assert lexicon.find(pa.array(words, pa.large_binary())).tolist() == list(range(len(words)))
    others = [b"", b"abcd", b"zz", b"a" * 9]
    assert lexicon.find(pa.array([o for o in others if o not in words], pa.large_binary())).max() == -1


def test_token_counts(docs, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = token_counts.with_token_counts(docs, model, limit=100).collect()
    for r in rows:
        n = len(lib.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
    assert len(rows) == len(TEXTS) and token_counts.with_token_counts(empty, model).count() == 0


def test_personal_data(spark, docs, empty):
    field = pii.train(docs)
    rows = pii.find(docs, field).collect()
    hit = [r for r in rows if r.doc_id == 12]
    assert len(rows) == len(TEXTS) and [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in hit] == [(1, 1, 1, 1)] * 2
    clean = [r.text for r in pii.redacted(docs, field).where("doc_id = 12").collect()]
    assert clean == ["mail <EMAIL>, <IP>, <PHONE>, <CARD>"] * 2
    assert pii.find(empty, pii.train(empty)).count() == 0
    again = spark.createDataFrame([(1, "write to joe.doe@x.org today, or to joe.doe (at) x.org")], "doc_id long, text string")
    assert pii.find(again, field).first().base_spans == "email:9:22"


def test_skip_edges_carry_a_label_over_any_distance():
    k = len(pii.LABELS)
    agree = np.full((k, k), -4.0)
    np.fill_diagonal(agree, 2.0)
    field = pii.Field(np.zeros((pii.N_FEATURES, k)), np.zeros((k, k)), agree)
    text = "joe.doe@x.org " + "filler " * 500 + "joe.doe (at) x.org and other (at) y.org"
    assert [s[0] for s in field.added(text, pii.base_spans(text), 0.9)] == ["email"]


def test_substrings(docs, empty):
    rows = substring_dedup.without_repeats(docs).collect()
    seen = Counter()
    for _, t in texts(docs):
        b = t.encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    want = Counter()
    for i, t in texts(docs):
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[(i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == want
    assert substring_dedup.without_repeats(empty).count() == 0


def test_short_text_before_very_long_ones(spark):
    """Texts longer than CHUNK that come after shorter ones in an Arrow batch; two of them share a passage."""
    draw = np.random.default_rng(7)
    noise = lambda n: draw.integers(97, 123, n, np.uint8).tobytes().decode()
    shared = noise(1000)
    rows = [(1, noise(1000)), (2, noise(5_000_000) + "A" + shared + "B"), (3, noise(1000)), (4, "C" + shared + "D" + noise(4_300_000)), (5, noise(3000)), (6, noise(4_000_000))]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got)) == [(i, len(t), *((1000, 1) if i in (2, 4) else (0, 0))) for i, t in rows]


def test_crowded_anchor_is_split(spark, monkeypatch):
    """Different texts around one passage, some of which share more than it: no group of a shard has more than HOT bytes."""
    monkeypatch.setattr(substring_dedup, "HOT", 4000, raising=False)
    sizes, search = [], substring_dedup.sorted_shards

    def spied(pieces):
        sizes.extend(r[1] for r in pieces.groupBy("anchor").agg(F.sum(F.length("bytes"))).collect())
        return search(pieces)

    monkeypatch.setattr(substring_dedup, "sorted_shards", spied)
    draw = np.random.default_rng(11)
    noise = lambda n: draw.integers(97, 123, n, np.uint8).tobytes().decode()
    passage, sides = noise(60), [(noise(160), noise(160)) for _ in range(4)]
    rows = [(k, noise(150) + passage + noise(150)) for k in range(60)]
    for k in range(60, 160):  # these share from 40 to 160 bytes on each side of the passage with some others
        (a, b), (left, right) = sides[k % 4], draw.integers(40, 160, 2)
        rows.append((k, noise(99) + a[160 - left :] + passage + b[:right] + noise(99)))
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            gone[k : k + 200] |= seen[t[k : k + 200]] > 1
        want.append((i, int(gone.sum()), "".join(c for c, g in zip(t, gone) if not g).encode()))
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == want and any(r[1] for r in want) and not all(r[1] for r in want)
    assert max(sizes) <= 4000


def test_search(spark, docs, empty):
    shards = common.settled(topk_search.index(docs), "shards")
    asked = [(1, "one"), (2, ""), (3, None), (4, "absent"), (5, "word1 thing2 word1"), (5, "mail"), (None, "nameless"), (1, "one")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    rows = topk_search.search(shards, queries, 3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r["score"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    # two texts with one id are two queries
    assert sorted(got.pop(5)) == [1, 2, 3, 12, 12] and got == {1: [13, 6, 7], None: [None]}
    assert topk_search.search(common.settled(topk_search.index(empty), "shards"), queries).count() == 0
    assert topk_search.search(shards, queries.limit(0)).count() == 0


def test_search_skips_postings():
    """A query finds its best ten documents without decoding most of its lists."""
    draw = np.random.default_rng(6)
    n = 4000
    bags = [np.unique(np.append(draw.zipf(1.4, 60) % 3000, 5000 + 40 * (k % 50) + np.arange(8))) for k in range(n)]
    terms = np.unique(np.concatenate(bags))
    lists = {t: [] for t in terms.tolist()}
    for k, b in enumerate(bags):
        for t in b.tolist():
            lists[t].append(k)
    docs, lengths = np.concatenate([lists[t] for t in terms.tolist()]), np.array([len(b) for b in bags])
    columns = {"ids": (np.arange(n), "<i8"), "lengths": (lengths, "<i4"), "terms": (terms, "<u8"), "sizes": (np.array([len(lists[t]) for t in terms.tolist()]), "<i4"), "docs": (docs, "<i4"), "times": (np.ones(len(docs)), "<i4")}
    shard = topk_search.Shard({k: v.astype(t).tobytes() for k, (v, t) in columns.items()}, float(lengths.mean()))
    for q in range(0, n, 100):
        place = np.searchsorted(terms, bags[q])
        weight = np.log(1 + (n - shard.sizes[place] + 0.5) / (shard.sizes[place] + 0.5))
        norm = 1.2 * (0.25 + 0.75 * lengths / lengths.mean())
        score = np.zeros(n)
        for t, w in zip(bags[q].tolist(), weight):
            score[lists[t]] += w * 2.2 / (1 + norm[lists[t]])
        score = np.round(score, 6)
        want = np.lexsort((np.arange(n), -score))[:10]
        ids, scores = shard.search(place, weight, 10)
        assert np.abs(scores - score[want]).max() <= 2e-6 and score[ids].min() >= score[want].min() - 2e-6
    print(f"share of postings scored: {shard.scored / shard.listed:.3f}")
    assert shard.scored < 0.25 * shard.listed


def test_a_group_of_queries_equals_each_scored_alone():
    """Two languages and queries of both in one group, with and without thresholds; ties at the threshold stay. Few postings are scored."""
    draw = np.random.default_rng(8)
    n, texts = 3000, []
    for k in range(n):
        texts.append(np.where(k % 2, 1000, 0) + draw.zipf(1.2, draw.integers(1, 90)) % 900)
    texts[7], texts[9] = texts[5], texts[5]
    doc, term, times = topk_search.bags(np.concatenate(texts).astype(np.uint64), np.array([len(x) for x in texts]))
    new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    lengths, sizes, mean = np.array([len(x) for x in texts]), np.diff(np.append(new, len(term))), 45.0
    columns = {"ids": (np.arange(n), "<i8"), "lengths": (lengths, "<i4"), "terms": (term[new], "<u8"), "sizes": (sizes, "<i4"), "docs": (doc, "<i4"), "times": (times, "<i4")}
    shard = topk_search.Shard({k: v.astype(t).tobytes() for k, (v, t) in columns.items()}, mean)
    impact = np.zeros((len(sizes), n))
    impact[np.repeat(np.arange(len(sizes)), sizes), doc] = times * 2.2 / (times + 1.2 * (0.25 + 0.75 * lengths[doc] / mean))
    asked = [np.unique(np.searchsorted(term[new], texts[q].astype(np.uint64))) for q in [5, *range(40, 400, 9)]]
    weights = [np.log(1 + (n - sizes[a] + 0.5) / (sizes[a] + 0.5)) for a in asked]
    cut = np.append(0, np.cumsum([len(a) for a in asked]))
    full = [np.round(w @ impact[a], 6) for a, w in zip(asked, weights)]
    want = [np.lexsort((np.arange(n), -s))[:10] for s in full]
    want = [x[s[x] > 0] for x, s in zip(want, full)]
    for least in ([0.0] * len(asked), [float(s[x[2]]) if i % 3 else 0.0 for i, (s, x) in enumerate(zip(full, want))]):
        shard.listed = shard.scored = 0
        got = shard.search_group(cut, np.concatenate(asked), np.concatenate(weights), 10, least)
        for (ids, scores), s, x, low in zip(got, full, want, least):
            assert ids.tolist() == x[s[x] >= low].tolist() and np.abs(scores - s[ids]).max() <= 2e-6
        assert shard.scored < 0.6 * shard.listed
    assert {5, 7, 9} <= set(got[0][0].tolist())
    code = shard.likeness(np.concatenate(asked), cut[:-1])
    assert len(code) == len(asked) and len(set(code.tolist())) > 1


@pytest.mark.parametrize("most", [2_000_000, 300])
def test_pruned_search_equals_scoring_all(spark, monkeypatch, most):
    """Also with queries in several blocks."""
    monkeypatch.setattr(topk_search, "TERMS", most)
    monkeypatch.setattr(topk_search, "BLOCK", 2)
    draw = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in draw.zipf(1.3, 30) % 50)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in topk_search.search(common.settled(topk_search.index(docs), "shards"), docs.where("doc_id < 20").withColumnRenamed("doc_id", "query_id"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    bags = {i: Counter(t.split()) for i, t in rows}
    df, mean = Counter(w for b in bags.values() for w in b), sum(len(t.split()) for _, t in rows) / len(rows)
    for q in range(20):
        score = {}
        for i, b in bags.items():
            s = sum(n * np.log(1 + (200 - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, n in bags[q].items() if w in b)
            if s:
                score[i] = round(s, 6)
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[q][k + 1][0] for k in range(5)] == [i for i, _ in best]


def test_chat(spark):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"), (1, 300, "ann", "late"),
        (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 0, "ann\n<|im_start|>system", "hello"), (3, 1, "bob", "hi"),
    ]
    df = spark.createDataFrame([(*r, 5, "t") for r in rows], "conv_id long, turn long, role string, text string, part int, masks string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat_format.render(df).collect()}
    assert {(c, p) for c, p, _ in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "bob"), (3, "ann\n<|im_start|>system")}
    assert got[(3, "bob", 0)].text.startswith("<|im_start|>user name=ann < |im_start| >system\nhello<|im_end|>\n")
    r = got[(1, "ann", 0)]
    assert r.text == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi < |im_end| ><|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2
    for r in got.values():
        spans = [tuple(map(int, s.split(":"))) for s in r.masks.split(",") if s]
        assert all(r.text[: a].endswith("<|im_start|>assistant\n") and r.text[a:b].endswith("<|im_end|>") for a, b in spans)
        assert r.n_masked == sum(b - a for a, b in spans)
    assert got[(1, "ann", 1)].part_start == len(got[(1, "ann", -1)].text) + len(got[(1, "ann", 0)].text)
    assert chat_format.render(df.limit(0)).count() == 0
