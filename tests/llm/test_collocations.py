"""Collocations against SQL, plain counting and awkward rows."""

import random

import duckdb

from tessera.llm import collocations
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_op12_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op12_collocations"])
    names = [c[0] for c in want.description]
    got = QUERIES["op12_collocations"](spark, SF)
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == names and rows == sorted(want.fetchall()) and len(rows) > 100


def _docs(seed):
    rng = random.Random(seed)
    words = ["a", "aa", "b", "a-b", "the", "of", "É", "x\x1cy", "\x00", "z" * 30]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", " ? "]) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "en", "und", None, ""]), text()) for _ in range(150)] + [("en", None), ("en", ""), (None, "the the The THE. the the the")]


def test_small_blocks_and_ranges(spark, monkeypatch):
    docs = _docs(1)
    want = sorted(collocations.brute_force(docs, 5, 4, None))
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "lang string, text string, n long, bucket long, word string")
    assert sorted(map(tuple, collocations.collocations(df, 5, 4, None).collect())) == want and len(want) > 50
    for name, value in (("MAX_WORDS", 2), ("RANGE_COUNTERS", 20), ("BLOCK_PATTERNS", 30), ("_TOGETHER", 50), ("_ENTRIES", 5)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.collocations(df, 5, 4, None).collect())) == want


def test_ties_and_top(spark):
    docs = [("en", "b c. " * 20 + "a d. " * 20 + "É f. " * 20), ("fr", "le la le la le la " * 30)]
    df = spark.createDataFrame(docs, "lang string, text string")
    got = sorted(map(tuple, collocations.collocations(df, top=2).collect()))
    assert got == sorted(collocations.brute_force(docs, top=2)) and [r[2] for r in got if r[0] == "en"] == ["a d", "b c"]


def test_first_phrases_by_bounds(spark, monkeypatch):
    """The pruned way gives the first rows of all, also when its first lists are too short, and in ranges and blocks."""
    docs = _docs(3)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    want = sorted(collocations.brute_force(docs, 5, 3, 9))
    assert sorted(map(tuple, collocations.collocations(df, 5, 3, 9).collect())) == want and len(want) > 20
    whole = collocations.first_phrases
    monkeypatch.setattr(collocations, "first_phrases", lambda corpus, top: whole(corpus, top, 2))
    for name, value in (("RANGE_COUNTERS", 20), ("BLOCK_PATTERNS", 30), ("_TOGETHER", 50)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.collocations(df, 5, 3, 9).collect())) == want
    monkeypatch.setattr(collocations, "MAX_WORDS", 2)
    assert sorted(map(tuple, collocations.collocations(df, 5, 3, 9).collect())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    once = spark.createDataFrame([("en", "all words once"), (None, None)], "lang string, text string")
    assert collocations.collocations(once).count() == 0


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    row = spark.range(1).selectExpr("cast(3000000000000 as decimal(16,0)) a", "cast(3000000000001 as decimal(16,0)) l")
    assert row.selectExpr("(a * a * cast(1000000 as decimal(7,0))) div (l * l)").first()[0] == 10**6 * 9 * 10**24 // 3000000000001**2


def test_only_counters_of_high_scores_are_sent(spark, monkeypatch):
    """Pairs that are frequent but score low stay in Spark, however many: the counters that leave it do not grow with them."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [("en", " ".join(rng.choice(words) for _ in range(200)) + f". only{i % 30} here{i % 30}.") for i in range(300)]
    sent = []
    ranges = collocations._ranges
    monkeypatch.setattr(collocations, "_ranges", lambda counters, total, bits: sent.append(total) or ranges(counters, total, bits))
    df = spark.createDataFrame(docs, "lang string, text string")
    got = sorted(map(tuple, collocations.collocations(df, 10, 3, 20).collect()))
    assert got == sorted(collocations.brute_force(docs, 10, 3, 20)) and sum(sent) < 200


def test_long_words_and_parts(spark, monkeypatch):
    """Words across the lots of bytes that are looked at together."""
    monkeypatch.setattr(collocations, "_BYTES", 16)
    docs = [("en", f"{'x' * 100} {'y' * 33}\t{'z' * 5}. a b\na b ")] * 12 + [("fr", "")]
    places = [(w[s:e], int(h)) for w, start, end, code in collocations.word_places([t.encode() for _, t in docs], "en") for s, e, h in zip(start, end, code, strict=True)]
    assert [w for w, _ in places] == [w for _, t in docs for w in collocations.words_of(t.encode()) if w != b"."] and len(set(places)) == len({w for w, _ in places}) == 5
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df).collect())) == sorted(collocations.brute_force(docs))
