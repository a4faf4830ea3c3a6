"""The stored index against search over texts, with small blocks, phrases and updates."""

import random

import pytest

from tessera.operators import bm25_index as bi
from tessera.operators import retrieval

RNG = random.Random(8)
WORDS = [f"w{int(RNG.paretovariate(0.6))}" for _ in range(400)]


def text(n=20):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, text(4)) for i in range(6)] + [(6, "w1_w2"), (7, "w1_w1 W3"), (8, "nothing_here"), (9, "?"), (10, "w2 w2_w1_w3 zzz")]
    return spark.createDataFrame(rows, "qid long, text string")


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, text string")


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())


def test_updates_equal_search_over_texts(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(bi, "BLOCK_DOCS", 16)
    docs = {i: text(RNG.randrange(5, 40)) for i in range(200)} | {200: "", 201: "w1 w2 w1 w2", 202: "w1 w2 w1 w2", 203: None}
    index = bi.Bm25Index(spark, str(tmp_path / "i"))
    index.update(0, frame(spark, docs))
    assert rows_of(index.search(asked, 5, 0)) == rows_of(retrieval.bm25(frame(spark, docs), asked, 5))
    changed = {i: text() for i in range(0, 60, 7)} | {300: text(), 301: "w1 w2"}
    gone = [1, 2, 201]
    for _ in range(2):  # run again
        index.update(1, frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "id long"))
    now = {k: v for k, v in (docs | changed).items() if k not in gone}
    want = rows_of(retrieval.bm25(frame(spark, now), asked, 5))
    assert rows_of(index.search(asked, 5, 1)) == want and len(want) > 25
    monkeypatch.setattr(bi, "MAX_BROADCAST", 1)
    assert rows_of(index.search(asked, 5, 1)) == want
    assert rows_of(index.search(asked, 5, 0)) == rows_of(retrieval.bm25(frame(spark, docs), asked, 5))  # versions stay


def test_bounds_skip_blocks_and_no_text_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bi, "BLOCK_DOCS", 10)
    docs = {i: ("rare rare rare" if i < 20 else f"rare {'x ' * 50}") + f" y{i}" for i in range(400)}
    index = bi.Bm25Index(spark, str(tmp_path / "i"))
    index.update(0, frame(spark, docs).repartitionByRange(4, "id"))
    q = spark.createDataFrame([(1, "rare y3")], "qid long, text string")
    got = index.search(q, 2, 0)
    assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == [3, 0]
    assert index.rest.count() < 5  # of some forty blocks that hold the word
    assert all(str(tmp_path) in f or "tessera-" in f for f in got.inputFiles())


def test_places_in_blocks_outlive_updates(spark, tmp_path):
    """Postings carry the place of a document in its block, by which an update finds who left; it stays as it was when others leave."""
    index = bi.Bm25Index(spark, str(tmp_path / "places"))
    docs = spark.createDataFrame([(i, f"word{i % 3} all") for i in range(30)], "id long, text string").coalesce(1)
    index.update(0, docs)
    index.update(1, docs.where("id % 5 = 0").selectExpr("id", "'new all' as text"), docs.where("id % 7 = 1").select("id"))
    at = {(r["block"], r["at"]): r["id"] for r in index.docs.current(1).collect()}
    assert sorted(at.values()) == [i for i in range(30) if i % 7 != 1 or i % 5 == 0]
    rows = index.postings.current(1).select("block", "word", "at", "ids").collect()
    assert all(at[r["block"], p] == i for r in rows for p, i in zip(r["at"], r["ids"], strict=True))
    assert sum(len(r["ids"]) for r in rows if r["word"] == "all") == len(at)


def test_blocks_hold_every_place_and_are_built_from_arrays(spark, monkeypatch):
    """Blocks cut across Arrow batches hold each token once, in order; a block of eight million tokens takes no Python object for each."""
    from time import perf_counter

    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(bi, "BLOCK_DOCS", 16)
    texts = {i: ("b a b é B" if i % 3 else "") + f" w{i % 5}" * (i % 4) for i in range(40)} | {40: None}
    try:
        got = bi._blocks(frame(spark, texts).coalesce(1), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    places = {(i, p): r["word"] for r in got if r["word"] for i, ps in zip(r["ids"], r["places"], strict=True) for p in ps}
    assert places == {(i, p): w for i, t in texts.items() for p, w in enumerate((t or "").lower().split())}
    assert all([len(p) for p in r["places"]] == r["tfs"] and r["dls"] == [len((texts[i] or "").split()) for i in r["ids"]] for r in got if r["word"])
    whole = {r["block"] & 0xFF: r["ids"] for r in got if r["word"] is None}
    assert whole == {0: list(range(16)), 1: list(range(16, 32)), 2: list(range(32, 41))} and all(r["at"] == sorted(r["at"]) for r in got)
    monkeypatch.setattr(bi, "BLOCK_DOCS", 4096)
    long = spark.range(4000).coalesce(1).select("id", F.expr("array_join(transform(sequence(1, 2000), i -> concat('w', (i * 7 + id) % 900)), ' ')").alias("text"))
    start = perf_counter()
    assert bi._blocks(long, 0).where("word = 'w5'").count() == 1
    took = perf_counter() - start
    assert took < 25
