"""Search as a whole: filters, models, fusion, evidence."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, store
from tessera.sources import models

SCHEMA = "chunk_id string, content string, embedding array<double>, chunk_type string, model_id string, file string, symbol_id string"


def vectors_for(spark, known):
    """An embedder that knows the vectors of some texts."""
    rows = spark.createDataFrame([(t, v) for t, v in known.items()], "text string, vec array<double>")
    return lambda df: df.join(rows, "text", "left").select("id", "vec")


def test_buried_identifier_surfaces(spark):
    noise = [(f"n{i}", f"noise text {i}", [1.0, 0.05 * i], "code", "m", "a.py", f"s{i}") for i in range(6)]
    rows = [*noise, ("target", "def rotate_refresh_token(): pass", [0.0, 1.0], "code", "m", "b.py", "t"), ("other", "rotate_refresh_token rotate", [0.0, 1.0, 2.0], "code", "m", "b.py", "o"), ("old", "rotate_refresh_token", [1.0, 0.0], "code", "m0", "c.py", "x")]
    index = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(1, "rotate_refresh_token"), (2, "nothing lexical")], "qid long, text string")
    embed = vectors_for(spark, {"rotate_refresh_token": [1.0, 0.0], "nothing lexical": [1.0, 0.0]})
    got = retrieval.search(index, q, embed, 3, model_id="m").collect()
    one = {r["chunk_id"]: r for r in got if r["qid"] == 1}
    assert "target" in one and one["target"]["score"] == 0.0 and "other" not in one and "old" not in one  # another length, another model
    assert [r["chunk_id"] for r in sorted((r for r in got if r["qid"] == 2), key=lambda r: r["rank"])] == ["n0", "n1", "n2"]
    asked = retrieval.search(index, q.where("qid = 1"), embed, 3, {"embeddingModelId": "m0", "nonsense": 5, "chunkType": None}, "m").collect()
    assert [r["chunk_id"] for r in asked] == ["old"]
    files = retrieval.search(index, q.where("qid = 1"), embed, 9, {"sourceFilePath": "b.py"}, "m").collect()
    assert {r["chunk_id"] for r in files} == {"target"}
    found = retrieval.retrieve_evidence(index.union(index.where("chunk_id = 'n0'")), q, embed, 3, "m")
    assert found.groupBy("qid", "chunk_id").count().where("count > 1").count() == 0 and "symbol_id" in found.columns


def test_search_of_nothing(spark):
    q = spark.createDataFrame([(1, "x")], "qid long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert retrieval.search(empty, q).count() == 0  # before an embedder is asked for
    with pytest.raises(ValueError):
        retrieval.search(spark.createDataFrame([("a", "t", [1.0], "code", "m", "f", "s")], SCHEMA), q)
    down = models.Embedder("down", lambda df: df, lambda: False)
    with pytest.raises(models.ModelUnavailable):
        retrieval.search(spark.createDataFrame([("a", "t", [1.0], "code", "m", "f", "s")], SCHEMA), q, down)


def test_hashing_embedder_in_search(spark):
    texts = [(f"c{i}", t) for i, t in enumerate(["parse the config file", "render a page", "token refresh rotation", "", None])]
    emb = {r["id"]: r["vec"] for r in models.hashing_embedder()(spark.createDataFrame(texts, "id string, text string")).collect()}
    assert len(emb["c0"]) == 128 and abs(sum(x * x for x in emb["c0"]) - 1) < 1e-12 and not any(emb["c3"]) and not any(emb["c4"])
    index = spark.createDataFrame([(i, t or "", emb[i], "code", "hashing-128", "f", i) for i, t in texts], SCHEMA)
    got = retrieval.search(index, spark.createDataFrame([(7, "refresh the token")], "qid long, text string"), models.hashing_embedder(), 2, model_id="hashing-128").orderBy("rank").collect()
    assert got[0]["chunk_id"] == "c2"


def test_flags_and_order(spark):
    r = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.47), (1, "c", 3, 0.9), (2, "a", 1, 0.1)], "qid long, id string, rank long, score double")
    flags = {f["qid"]: (f["insufficient"], f["ambiguous"]) for f in retrieval.evidence_flags(r, spark.createDataFrame([(1,), (2,), (3,)], "qid long")).collect()}
    assert flags == {1: (False, True), 2: (True, False), 3: (True, False)}  # the first in fused order counts, also where another scores more
    near = spark.createDataFrame([(1, "c"), (2, "a")], "qid long, id string")
    order = {(x["qid"], x["id"]): x["new_rank"] for x in retrieval.rerank_adjacent(r, near).collect()}
    assert order == {(1, "c"): 1, (1, "a"): 2, (1, "b"): 3, (2, "a"): 1}
    all_of = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "qid long, id string")
    assert [x["new_rank"] for x in retrieval.rerank_adjacent(r, all_of).where("qid = 1").orderBy("rank").collect()] == [1, 2, 3]


def test_knn_in_blocks_and_with_odd_vectors(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)] + [(900, None), (901, []), (902, [0.0, 0.0, 0.0]), (903, [1.0, 2.0])]
    c = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    q = c.where("id % 9 = 0 or id > 899").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    whole = sorted(map(tuple, retrieval.knn(c, q, 4).collect()))
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 8)
    assert sorted(map(tuple, retrieval.knn(c, q, 4).collect())) == whole
    assert {r[0] for r in whole} == {i for i, v in rows if (i % 9 == 0 or i > 899) and v}
    assert [r[1:] for r in whole if r[0] == 903] == [(903, 1.0, 1)] and all(r[2] == 0.0 for r in whole if r[0] == 902)
    ties = [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == 902]
    assert ties == [0, 1, 2, 3]


def test_a_failed_summary_fails_no_other(spark):
    u = spark.createDataFrame([(1, "h1", "one two three"), (2, "h2", ""), (3, "h3", "kept")], "unit long, hash string, text string")
    out = store.compute_misses(u, spark.createDataFrame([("h3", "old")], "hash string, value string"), models.first_words(2))
    assert {r["unit"]: (r["value"], r["source"]) for r in out.collect()} == {1: ("one two", "computed"), 2: (None, "failed"), 3: ("old", "cache")}
    assert models.is_loopback("http://127.0.0.1:11434/api") and models.is_loopback("http://localhost") and not models.is_loopback("http://10.0.0.1") and not models.is_loopback("http://127.0.0.1.evil.org")


def test_terms_of_several_words(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b a c"), (3, "a c b"), (4, None), (5, "A_B, again"), (6, "x")], "id long, text string")
    q = spark.createDataFrame([(1, "a_b"), (2, "x zz"), (3, "??")], "qid long, text string")
    got = {(r["qid"], r["id"]): r["rank"] for r in retrieval.bm25(docs, q, 5).collect()}
    assert got == {(1, 1): 1, (1, 5): 2, (2, 6): 1} or got == {(1, 5): 1, (1, 1): 2, (2, 6): 1}


def test_texts_of_the_search_index_are_embedded_once(spark):
    from tessera.plans import retrieval_queries

    plan = retrieval_queries._index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # vectors are read, not made, by each reader of the index
