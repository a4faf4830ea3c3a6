"""Exact vector search, BM25, reciprocal-rank fusion, evidence flags and reranking, many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import durable, ship_package
from .knn_blocks import knn_blocks

RRF = 60
K1, B = 1.2, 0.75
#: Queries, or their terms, reach every executor in blocks of at most this many rows.
MAX_BROADCAST_QUERIES = 10_000
#: What a search may be filtered by.
FILTER_KEYS = ("chunkType", "embeddingModelId", "sourceFilePath", "sourceSymbolId", "dimensionality")


def metadata_filter(df: DataFrame, filters: dict, columns: dict[str, str]) -> DataFrame:
    """Equality on known keys; unknown keys and expected nulls are ignored; paths are compared with forward slashes.

    Applied before scoring, so it reaches the scan.
    """
    for k, v in filters.items():
        if k in columns and v is not None:
            c = F.col(columns[k])
            df = df.where(tx.normalize_path(c) == v.replace("\\", "/") if k == "sourceFilePath" else c == v)
    return df


def top_k(scored: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rank within group and keep k; the limit is pushed below the shuffle by the optimizer's window-group limit."""
    return scored.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(rank) <= k)


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    """Queries, or their terms, are broadcast up to MAX_BROADCAST_QUERIES rows; beyond that the join is left to the optimizer."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES else rows


def knn(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """corpus(id, vec) x queries(qid, qvec) -> qid, id, score, rank: exact cosine, ties by id. Rows of another length are invisible.

    Up to half of MAX_BROADCAST_QUERIES questions go to the executors as matrices; each task multiplies its batches with them
    and sends its own k best. More questions meet the corpus in blocks, of which the driver sees none.
    """
    asked = queries.where("qvec is not null and size(qvec) > 0").select("qid", "qvec")
    if asked.limit(MAX_BROADCAST_QUERIES // 2 + 1).count() > MAX_BROADCAST_QUERIES // 2:
        return knn_blocks(corpus, asked, k)
    return top_k(_knn_block(corpus, asked, k), ["qid"], [F.desc("score"), F.asc("id")], k)


def _knn_block(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    got = queries.toArrow()
    qids = got.column("qid").combine_chunks()
    stacked = [(at, vx.unit_rows(m)) for at, m in vx.matrices(got.column("qvec"))]
    ship_package(corpus.sparkSession)
    kind = corpus.schema["id"].dataType.simpleString()
    best = corpus.select("id", "vec").mapInArrow(vx.top_k_of_batches(stacked, k, 9), f"q long, id {kind}, score double")
    named = queries.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(qids)), pa.int64()), "qid": qids}))
    return best.join(F.broadcast(named), "q").select("qid", "id", "score")


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """docs(id, text), queries(qid, text) -> qid, id, score, rank.

    A query term is a run of ASCII letters, digits and underscores; where it holds several words, they must follow
    one another in the document. Texts are tokenised once, into a table of postings that also has a row for each
    document; statistics cover all documents, and those without a query term count in them.
    """
    spark = docs.sparkSession
    kind = queries.schema["qid"].dataType.simpleString()
    terms = queries.select("qid", F.explode(tx.lexical_terms(F.col("text"))).alias("term")).withColumn("words", tokens_of(F.col("term"))).where("size(words) > 0")
    few = terms.limit(MAX_BROADCAST_QUERIES + 1).collect()
    small = len(few) <= MAX_BROADCAST_QUERIES
    if small:  # the terms are a local table from here on
        terms = spark.createDataFrame([(r["qid"], r["term"], r["words"]) for r in few], f"qid {kind}, term string, words array<string>")
    several = any(len(r["words"]) > 1 for r in few) or not small
    parts = terms.select("term", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")).distinct()
    # every document ends in an empty word, which no text has: its rows are what the statistics are taken from
    mark = spark.createDataFrame([("", 1, 0, "")], "term string, n int, off int, word string")
    wanted = parts.unionByName(mark)
    placed = docs.select("id", tokens_of(F.coalesce("text", F.lit(""))).alias("t")).select("id", F.size("t").alias("dl"), F.posexplode(F.concat("t", F.array(F.lit("")))).alias("pos", "word"))
    met = placed.join(F.broadcast(wanted) if small else wanted, "word")
    post = met.where("n = 1").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    if several:
        whole = met.where("n > 1").groupBy("term", "id", "dl", "n", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("held")).where("held = n")
        post = post.unionByName(whole.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")))
    every = durable(post, "postings")
    n, avg_dl = every.where("term = ''").agg(F.count("*"), F.avg("dl")).first()
    post = every.where("term <> ''")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    if small:
        df = F.broadcast(spark.createDataFrame([tuple(r) for r in df.collect()], "term string, df long"))
    raw = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avg_dl or 1.0)))
    asking = terms.select("qid", "term").join(df, "term")
    weighted = post.join(F.broadcast(asking) if small else asking, "term").select("qid", "id", part.alias("part"))
    scored = weighted.groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("id")], k)


def hash_embed(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id and vec, the hashing embedder's unit vector; a text without tokens has a zero vector."""
    return _hashed(docs, lambda m: vx.unit_rows(m / 12.0))


def hash_weights(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id and vec, the bucket weights in whole twelfths."""
    return _hashed(docs, lambda m: m.astype(np.float64))


def _hashed(docs: DataFrame, finish) -> DataFrame:
    def run(batches):
        seen: dict[str, int] = {}
        for b in batches:
            m = finish(np.stack([vx.hash_weights(t, seen) for t in b.column("text").to_pylist()])) if b.num_rows else np.zeros((0, vx.DIM))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * vx.DIM), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), vec], ["id", "vec"])

    ship_package(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, vec array<double>")


def fuse(vec: DataFrame, lex: DataFrame, k: int) -> DataFrame:
    """qid, id, rank of both -> qid, id, vec_rank, lex_rank, rrf, rank."""
    v = vec.select("qid", "id", F.col("rank").alias("vec_rank"))
    x = lex.select("qid", "id", F.col("rank").alias("lex_rank"))
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = v.join(x, ["qid", "id"], "full_outer").withColumn("rrf", F.round(share("vec_rank") + share("lex_rank"), 9))
    return top_k(both, ["qid"], [F.desc("rrf"), F.asc("id")], k)


def hybrid(corpus: DataFrame, queries: DataFrame, k: int, filters: dict | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """corpus(id, text, vec, filter columns), queries(qid, text, qvec): 4k of each side, fused; score stays the cosine.

    Vectors are filtered before their list is cut; the lexical list covers the whole corpus, rows without a
    vector too, and is cut before it is filtered. A lexical hit without a vector of the query's length drops.
    Without lexical hits the head of the vector list is the result.
    """
    kept = metadata_filter(corpus, filters or {}, columns or {})
    vec = knn(kept.select("id", "vec"), queries.select("qid", "qvec"), 4 * k)
    lex = bm25(corpus.select("id", "text"), queries.select("qid", "text"), 4 * k)
    q = _broadcast_if_small(queries.select("qid", "qvec"))
    lexical = lex.select("qid", "id", F.col("rank").alias("lex_order")).join(kept.select("id", "vec"), "id").join(q, "qid").where("size(vec) = size(qvec)")
    lexical = lexical.select("qid", "id", F.round(vx.cosine(F.col("qvec"), F.col("vec")), 9).alias("score"), "lex_order")
    lexical = lexical.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("lex_order")).cast("bigint"))
    vec, lexical = durable(vec, "vector-side"), durable(lexical, "lexical-side")
    fused = fuse(vec, lexical, k)
    scores = vec.select("qid", "id", "score").unionByName(lexical.select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return fused.join(scores, ["qid", "id"]).select("qid", "id", "rank", "vec_rank", "lex_rank", F.round("score", 6).alias("score"))


def search(index: DataFrame, queries: DataFrame, embed=None, k: int = 5, filters: dict | None = None, model_id: str | None = None) -> DataFrame:
    """index(chunk_id, content, embedding, chunk_type, model_id, file, symbol_id) searched for queries(qid, text): qid, chunk_id, rank, score.

    An empty index gives no rows, before an embedder is asked for; without an embedder a full one raises. Only
    vectors of the embedder's model answer, unless the caller filters by a model.
    """
    columns = {"chunkType": "chunk_type", "embeddingModelId": "model_id", "sourceFilePath": "file", "sourceSymbolId": "symbol_id"}
    if not index.limit(1).count():
        return index.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id string, rank long, score double")
    if embed is None:
        raise ValueError("search needs an embedder")
    wanted = dict(filters or {})
    if model_id:
        wanted.setdefault("embeddingModelId", model_id)
    asked = queries.join(embed(queries.select(F.col("qid").alias("id"), "text")).select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
    corpus = index.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), F.col("embedding").alias("vec"), *columns.values())
    return hybrid(corpus, asked, k, wanted, columns).select("qid", F.col("id").alias("chunk_id"), "rank", "score")


def retrieve_evidence(index: DataFrame, questions: DataFrame, embed, k: int = 5, model_id: str | None = None) -> DataFrame:
    """search() joined with the chunks' symbols and files, each chunk once a question."""
    found = search(index, questions, embed, k, model_id=model_id).dropDuplicates(["qid", "chunk_id"])
    return found.join(index.select("chunk_id", "symbol_id", "file", "content").dropDuplicates(["chunk_id"]), "chunk_id")


def answer_context(evidence: DataFrame, questions: DataFrame, adjacent: DataFrame) -> DataFrame:
    """qid, insufficient, ambiguous (both before reranking), symbols and files: the distinct citations in reranked order.

    evidence(qid, rank, score, symbol_id, file), questions(qid), adjacent(qid, id of symbols).
    """
    flags = evidence_flags(evidence, questions)
    ranked = rerank_adjacent(evidence.withColumn("id", F.col("symbol_id")), adjacent)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("new_rank", "symbol_id", "file"))), lambda x: x)
    cited = ranked.groupBy("qid").agg(in_order.alias("e"))
    none = F.array().cast("array<string>")
    distinct = lambda name: F.coalesce(F.array_distinct(F.filter(F.transform("e", lambda x: x[name]), lambda v: F.coalesce(v, F.lit("")) != "")), none).alias(name + "s")
    return flags.join(cited, "qid", "left").select("qid", "insufficient", "ambiguous", distinct("symbol_id"), distinct("file"))


def evidence_flags(results: DataFrame, questions: DataFrame, low: float = 0.15, close: float = 0.05) -> DataFrame:
    """qid -> insufficient (nothing, or the first in fused order is weak), ambiguous (two or more within ``close`` of the first); a row for each of questions(qid)."""
    first = results.groupBy("qid").agg(F.min_by("score", "rank").alias("top"))
    near = results.join(first, "qid").groupBy("qid", "top").agg(F.sum(F.when(F.col("top") - F.col("score") <= close, 1).otherwise(0)).alias("near"))
    return questions.select("qid").join(near, "qid", "left").select("qid", F.coalesce(F.col("top") < low, F.lit(True)).alias("insufficient"), F.coalesce(F.col("near") >= 2, F.lit(False)).alias("ambiguous"))


def rerank_adjacent(results: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Stable partition: ids in adjacent(qid, id) first, old order within; scores untouched.

    A question with fewer than two results, with none adjacent or with all adjacent keeps its order.
    """
    marked = results.join(adjacent.select("qid", "id").distinct().withColumn("near", F.lit(1)), ["qid", "id"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    new = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("near"), "rank")).cast("bigint")
    return marked.withColumn("near", F.col("near") == 1).withColumn("new_rank", new)


def build_chunks(symbols: DataFrame) -> DataFrame:
    """symbols(symbol_id, file, signature, source, docstring, summary) -> a ``code`` chunk of each with source and a ``summary`` chunk of each that has a summary."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    some = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    code = symbols.select("symbol_id", "file", F.lit("code").alias("chunk_type"), trimmed(F.col("source")).alias("content"))
    note = symbols.where(some("summary").isNotNull()).select("symbol_id", "file", F.lit("summary").alias("chunk_type"), F.concat_ws("\n\n", F.nullif(F.col("signature"), F.lit("")), some("docstring"), some("summary")).alias("content"))
    both = code.where("content <> ''").unionByName(note)
    return both.select(tx.chunk_id(F.col("symbol_id"), F.col("chunk_type"), F.col("content")).alias("chunk_id"), "symbol_id", "file", "chunk_type", "content")


def seed_cache(entries: DataFrame) -> DataFrame:
    """entries(symbol_id, chunk_type, content, model_id, embedding, seq) -> cache rows by chunk id; rows without model or content are skipped, the last of a chunk stays."""
    usable = entries.where("coalesce(model_id, '') <> '' and coalesce(content, '') <> ''")
    keyed = usable.withColumn("chunk_id", tx.chunk_id(F.col("symbol_id"), F.col("chunk_type"), F.col("content"))).withColumn("norm", F.sha2(tx.normalize_content(F.col("content")), 256))
    return keyed.groupBy("chunk_id", "chunk_type", "norm").agg(F.max_by(F.struct("model_id", "embedding", "seq"), F.struct("seq", "model_id", "embedding")).alias("x")).select("chunk_id", "chunk_type", "norm", "x.*")


def cached_embeddings(chunks: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """chunks(chunk_id, chunk_type, content) with the cached embedding: of the same chunk, else of the last equal content of its type, of this model only."""
    norm = F.sha2(tx.normalize_content(F.col("content")), 256)
    by_id = cache.select("chunk_id", F.when(F.col("model_id") == model_id, F.col("embedding")).alias("own"))
    by_content = cache.groupBy("chunk_type", "norm").agg(F.max_by(F.struct("model_id", "embedding"), F.struct("seq", "model_id", "embedding")).alias("y")).select("chunk_type", "norm", F.when(F.col("y.model_id") == model_id, F.col("y.embedding")).alias("same"))
    out = chunks.withColumn("norm", norm).join(by_id, "chunk_id", "left").join(by_content, ["chunk_type", "norm"], "left")
    return out.withColumn("embedding", F.coalesce("own", "same")).withColumn("hit", F.col("embedding").isNotNull()).drop("own", "same", "norm")
