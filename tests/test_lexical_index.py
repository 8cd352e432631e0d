"""The English stemmer on its published examples, and searches of a stored index against the plain ones."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stemming
from corpusloom.operators import lexical_index, retrieval
from corpusloom.sources import tables

# Words and stems of the published sample vocabulary and description.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli singly singl sky sky news news howe howe atlas atlas
cosmos cosmos bias bias andes andes inning inning outing outing canning canning herring herring proceed proceed exceed exceed succeed succeed
gas gas this this gaps gap kiwis kiwi ties tie cries cri caresses caress ponies poni by by say say cry cri luxuriated luxuri hopping hop hoping hope
falling fall hissing hiss fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration valenci valenc digitizer digit
conformably conform radically radic differently differ vilely vile analogously analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format
formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic
gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism communism activate
activ angularity angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll
generate generat generates generat generous generous general general generally general communication communic arsenal arsenal agreed agre feed feed
plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size boy boy boyish boyish youth youth syzygy syzygi
""".split()


def test_stems(spark):
    words, want = STEMS[::2], STEMS[1::2]
    rows = spark.createDataFrame(list(enumerate(words)), "k int, w string").select("k", stemming.english_stem(F.col("w")).alias("s")).orderBy("k").collect()
    wrong = [(w, r.s, s) for w, r, s in zip(words, rows, want) if r.s != s]
    assert not wrong


def test_stems_of_odd_words(spark):
    words = ["", "a", "is", "'s", "'''", "don't", "dog's", "dogs'", "x12s", "größe", "yyyy", "sayyyys", None, "eee", "bcd", "ing", "ed", "ational"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(stemming.english_stem(F.col("w"))).collect()]
    assert got[:3] == ["", "a", "is"] and got[5:8] == ["don't", "dog", "dog"] and got[8:10] == ["x12s", "größe"] and got[12] is None


CHUNKS = [
    (f"c{k:03d}", f"s{k % 5}", " ".join(["running runner runs ", "general generals generated ", "cats policies ", "12.5 a-b the "][j % 4] * (k % (j + 2)) for j in range(4))) for k in range(200)
] + [("c500", "s1", None), ("c501", "s1", ""), ("c502", None, "running"), (None, "s1", "running"), ("c503", "s1", "cats " * 5000), ("c504", "s1", "run"), ("c504", "s1", "running cats")]
QUESTIONS = [(1, "u", "Which cats are running?"), (2, "v", "the generals"), (3, "u", "a-b 12.5 cats"), (4, "u", "the of"), (5, "w", "cats"), (6, "u", None)]


def index_and_questions(spark, path, stemmer):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, collection_id string, text string").withColumns({"chunk": F.lit(1), "term": F.lit("x")})
    lexical_index.build(chunks.repartition(3), path, stemmer)
    questions = spark.createDataFrame(QUESTIONS, "query_id long, sub string, question string")
    allowed = spark.createDataFrame([("u", f"s{k}") for k in range(5)] + [("v", "s2"), ("v", "s2"), ("u", None)], "sub string, collection_id string")
    return chunks, questions, allowed


@pytest.mark.parametrize("facts", [tables.FACTS, 1])
def test_index_equals_the_plain_search(spark, tmp_path, monkeypatch, facts):
    monkeypatch.setattr(tables, "FACTS", facts)
    chunks, questions, allowed = index_and_questions(spark, str(tmp_path / "i"), "light")
    plain = retrieval.lexical(questions, chunks.where("chunk_id IS NOT NULL"), allowed, 30).collect()
    for named in (lexical_index.NAMED, 1):
        monkeypatch.setattr(lexical_index, "NAMED", named)
        got = lexical_index.search(str(tmp_path / "i"), questions, allowed, 30).collect()
        assert sorted((r.query_id, r.chunk_id, r.rank) for r in got) == sorted((r.query_id, r.chunk_id, r.rank) for r in plain) and got


def test_english_index_finds_other_forms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FACTS", 1)
    path = str(tmp_path / "i")
    _, _, allowed = index_and_questions(spark, path, "english")
    asked = spark.createDataFrame([(1, "u", "generalize policy"), (2, "u", "runs")], "query_id long, sub string, question string")
    by = {}
    for r in lexical_index.search(path, asked, allowed, 500, "english").collect():
        by.setdefault(r.query_id, set()).add(r.chunk_id)
    forms = lambda *words: {c for c, s, t in CHUNKS if c and s and set(words) & set((t or "").split())}
    assert by == {1: forms("general", "generals", "policies"), 2: forms("running", "runs", "run")}
    terms = {r.term: (r.df, r.most) for r in lexical_index.terms(spark, path).collect()}
    assert terms["cat"][1] == 5000 and "running" not in terms and "the" not in terms


def test_only_asked_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    index_and_questions(spark, path, "light")
    rows = lexical_index.of_terms(spark, path, spark.createDataFrame([("cats",), ("nowhere",)], "term string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [cats,nowhere])" in plan
    assert {r.term for r in rows.select("term").distinct().collect()} == {"cats"}


def test_index_of_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([], "chunk_id string, collection_id string, text string")
    lexical_index.build(chunks, str(tmp_path / "i"))
    questions = spark.createDataFrame(QUESTIONS, "query_id long, sub string, question string")
    assert lexical_index.search(str(tmp_path / "i"), questions, spark.createDataFrame([("u", "s1")], "sub string, collection_id string")).count() == 0


def test_chunks_are_counted_where_they_lie(spark):
    """Postings of a chunk of one row come without a shuffle; chunks of several rows are added up."""
    rows = [(0, 1, 1, "doctors doctor the dog"), (1, 1, 1, None), (2, 2, 1, ""), (3, 1, 2, "doctor"), (3, 1, 2, "doctors dog"), (4, 1, 1, "the")]
    df = spark.createDataFrame(rows, "chunk long, access long, rows long, text string")
    want = {("doctor", 0, 1, 2), ("dog", 0, 1, 1), ("doctor", 3, 1, 2), ("dog", 3, 1, 1)}
    assert sorted(map(tuple, lexical_index.postings(df, "light").collect())) == sorted(want)
    assert sorted(map(tuple, lexical_index.postings(df, "english").collect())) == sorted(want)
    plan = lexical_index.postings(df.where("rows = 1"), "light")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
