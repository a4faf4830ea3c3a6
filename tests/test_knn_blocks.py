"""Blocks against the plain search, with skewed, equal and zero vectors, and what the bounds skip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn_blocks as kb
from tessera.operators import retrieval


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), (centres[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000 + i, [0.0] * 16) for i in range(5)] + [(3000 + i, rng.normal(size=5).tolist()) for i in range(40)] + [(4000, None), (4001, [])]
    asked = [(int(i), rows[i][1]) for i in range(0, 600, 7)] + [(9000, [0.0] * 16), (9001, rng.normal(size=5).tolist()), (9002, rng.normal(size=3).tolist()), (9003, None), (7, rows[7][1])]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(5), spark.createDataFrame(asked, "qid long, qvec array<double>")


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


def test_equal_to_plain_search(frames, monkeypatch):
    corpus, asked = frames
    distinct = asked.dropDuplicates(["qid"])
    want = rows_of(retrieval.top_k(retrieval._knn_block(corpus, distinct.where("size(qvec) > 0"), 4), ["qid"], [F.desc("score"), F.asc("id")], 4))
    assert rows_of(kb.knn_blocks(corpus, distinct, 4)) == want and len(want) > 300
    for name, value in (("BLOCK_ROWS", 16), ("BLOCK_QUESTIONS", 7), ("BROADCAST_BYTES", 2000), ("_HELD", 10), ("PIVOTS", 12), ("MAX_LENGTHS", 1)):
        monkeypatch.setattr(kb, name, value)
    assert rows_of(kb.knn_blocks(corpus, distinct, 4)) == want
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 20)
    assert rows_of(retrieval.knn(corpus, distinct, 4)) == want
    assert len(rows_of(kb.knn_blocks(corpus, asked, 4))) == len(want) + 4  # a repeated question is one of its own


def test_bounds_skip(frames, monkeypatch):
    corpus, asked = frames
    monkeypatch.setattr(kb, "BLOCK_ROWS", 16)
    r = kb.knn_report(corpus, asked, 4).first()
    assert r["skipped"] > 2 * r["met"] > 0


def test_empty(frames):
    corpus, asked = frames
    assert kb.knn_blocks(corpus.limit(0), asked, 3).count() == 0 and kb.knn_blocks(corpus, asked.limit(0), 3).count() == 0
