"""Ranked search against SQL, plain counting and awkward rows."""

import random

import duckdb
import numpy as np

from tessera.llm import lexical
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_op11_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES["op11_lexical_search"])
    names = [c[0] for c in want.description]
    got = QUERIES["op11_lexical_search"](spark, SF)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_carries_and_top_sets():
    rng = np.random.default_rng(4)
    for _ in range(60):
        docs, terms, k = int(rng.integers(1, 200)), int(rng.integers(1, 9)), int(rng.integers(1, 12))
        values = rng.integers(0, rng.choice([2, 3, 50, 2**34]), (terms, docs)) * (rng.random((terms, docs)) < rng.random())
        slices = {bytes([i]): lexical.bit_slices(np.arange(docs), v) for i, v in enumerate(values)}
        questions = [[bytes([i]) for i in range(terms) if rng.random() < 0.6] for _ in range(5)]
        ids = rng.permutation(docs).tolist()
        got = list(lexical.best_of_run(slices, ids, questions, k))
        for q, own in enumerate(questions):
            total = values[[t[0] for t in own]].sum(axis=0) if own else np.zeros(docs, np.int64)
            want = sorted((-int(s), ids[d]) for d, s in enumerate(total) if s)[:k]
            assert sorted((-s, d) for x, d, s in got if x == q) == want


def _frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, term int, run string"), spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, q int")


def test_small_runs_blocks_and_hot_terms(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    docs = [(i, "the " + " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)] + [(1000 + i, "The same, TEXT the") for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(20)] + [(99, "the same text"), (99, "nothing-known")]
    want = sorted(lexical.brute_force(docs, items))
    d, i = _frames(spark, docs, items)
    assert sorted(map(tuple, lexical.ranked_search(d, i).collect())) == want
    for name, value in (("_ADD_TERMS", 3), ("_ADD_BYTES", 1), ("BLOCK_TERMS", 40)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.ranked_search(d, i).collect())) == want


def test_awkward_rows(spark):
    docs = [(None, "alpha beta"), (None, None), (3, ""), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA-beta é" * 1), (6, "é " * 30_000), (7, "a" * 70_000), (8, " .,; ")]
    items = [(1, "alpha é"), (1, "alpha é"), (None, "Beta"), (2, None), (3, ""), (4, "É"), (5, "zeta")]
    d, i = _frames(spark, docs, items)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted(map(tuple, lexical.ranked_search(d, i).collect()), key=key)
    assert got == sorted(lexical.brute_force(docs, items), key=key) and len(got) > 10
    assert lexical.ranked_search(d.limit(0), i).count() == 0 and lexical.ranked_search(d, i.limit(0)).count() == 0
