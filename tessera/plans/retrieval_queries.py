"""Queries of retrieval and of the conversation around it.

Documents are chunks; a document with the id of an embedding has that vector, the others have none. Benchmark
items whose id is divisible by 20 are the questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code_graph as cg
from ..operators import bm25_index, context, knn_blocks, retrieval
from ..session import documents, durable, table
from ..streaming import feed
from .catalogue import _BM25, _KNN, _corpus, _text_queries, _vec_queries
from .registry import query

_HYBRID = f"""{_BM25},
q0 AS (SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 20 = 0),
sc AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qvec AS DOUBLE[])), 9) AS score FROM embeddings JOIN documents ON doc_id = vec_id, q0 {{where}}),
vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc),
lx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY lex.rank) AS rank FROM lex JOIN sc USING (qid, id) WHERE lex.rank <= 20),
f AS (SELECT coalesce(v.qid, x.qid) AS qid, coalesce(v.id, x.id) AS id, v.rank AS vec_rank, x.rank AS lex_rank, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + x.rank), 0), 9) AS rrf
  FROM (SELECT * FROM vec WHERE rank <= 20) v FULL JOIN lx x ON v.qid = x.qid AND v.id = x.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM f)"""


@query(f"WITH {_BM25} SELECT qid, id, round(score, 4) AS score, rank FROM lex WHERE rank <= 10")
def bm25_stored_index(spark, d):
    """The stored index after three updates: every third document comes first with another text, some come and go, then all have the text they have."""
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    k = F.col("id")
    index = bm25_index.Bm25Index(spark, feed.folder(spark, "bm25"))
    index.update(0, docs.where(k % 3 != 1).select("id", F.when(k % 3 == 0, F.concat(F.lit("before "), "text")).otherwise(F.col("text")).alias("text")))
    index.update(1, docs.where(k % 3 == 1).unionByName(docs.where(k % 6 == 0).select((-1 - k).alias("id"), "text")))
    index.update(2, docs.where(k % 3 == 0), docs.where(k % 6 == 0).select((-1 - k).alias("id")))
    return index.search(_text_queries(spark, d), 10, 2).select("qid", "id", F.round("score", 4).alias("score"), "rank")


def _chunks(spark, d) -> DataFrame:
    """All documents, with their vectors where they have one."""
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    return docs.join(_corpus(spark, d).select("id", "vec"), "id", "left")


def _questions(spark, d) -> DataFrame:
    return _text_queries(spark, d).join(_corpus(spark, d).select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")


@query(f"WITH {_HYBRID.format(where='')} SELECT qid, id, rank, vec_rank, lex_rank, round(score, 6) AS score FROM r JOIN sc USING (qid, id) WHERE rank <= 5")
def hybrid_rrf_topk(spark, d):
    return retrieval.hybrid(_chunks(spark, d), _questions(spark, d), 5)


@query(f"""WITH {_HYBRID.format(where="WHERE lang = 'en'")} SELECT qid, id, rank, vec_rank, lex_rank, round(score, 6) AS score FROM r JOIN sc USING (qid, id) WHERE rank <= 5""")
def hybrid_filtered_topk(spark, d):
    return retrieval.hybrid(_chunks(spark, d), _questions(spark, d), 5, {"chunkType": "en", "other": 1}, {"chunkType": "lang"})


@query(f"""WITH {_KNN.format(where='WHERE label <> 3')}, r AS (SELECT * FROM knn WHERE rank <= 5 AND score > 0.3), t AS (SELECT qid, score AS top FROM r WHERE rank = 1),
n AS (SELECT qid, top < 0.15 AS insufficient, count(*) FILTER (top - score <= 0.05) >= 2 AS ambiguous FROM r JOIN t USING (qid) GROUP BY qid, top)
SELECT q.qid, coalesce(insufficient, true) AS insufficient, coalesce(ambiguous, false) AS ambiguous FROM q LEFT JOIN n USING (qid)""")
def evidence_flags(spark, d):
    q = _vec_queries(spark, d)
    found = retrieval.knn(_corpus(spark, d).where("label <> 3"), q, 5).where("score > 0.3")
    return retrieval.evidence_flags(found, q)


_NEAR = """ed AS (SELECT DISTINCT l_partkey % 500 AS a, l_suppkey % 500 AS b FROM lineitem), nb AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed)"""


@query(f"""WITH {_KNN.format(where='')}, r AS (SELECT * FROM knn WHERE rank <= 5), {_NEAR}, md AS (SELECT vec_id AS id, vec_id - 1 AS module FROM embeddings WHERE vec_id % 20 = 1),
at_ AS (SELECT DISTINCT qid, coalesce(md.id, qid) AS n FROM q LEFT JOIN md ON module = qid), n1 AS (SELECT DISTINCT qid, b AS id FROM at_ JOIN nb ON a = n), adjn AS (SELECT qid, id FROM n1 UNION SELECT qid, module FROM n1 JOIN md USING (id))
SELECT r.qid, r.id, rank, row_number() OVER (PARTITION BY r.qid ORDER BY (adjn.id IS NOT NULL) DESC, rank) AS new_rank FROM r LEFT JOIN adjn ON adjn.qid = r.qid AND adjn.id = r.id""")
def graph_rerank(spark, d):
    """Line items tie parts and suppliers. A question cites the module of its own id, which stands for the file whose id is one more; neighbouring files bring their modules."""
    r = retrieval.knn(_corpus(spark, d), _vec_queries(spark, d), 5)
    edges = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).cast("string").alias("src"), (F.col("l_suppkey") % 500).cast("string").alias("dst")).distinct()
    cited = _vec_queries(spark, d).select("qid", F.col("qid").cast("string").alias("id"))
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 20 == 1, (F.col("vec_id") - 1).cast("string")).alias("module_id"))
    near = cg.rerank_neighbours(edges, nodes, cited).select("qid", F.col("id").cast("long").alias("id"))
    return retrieval.rerank_adjacent(r, near).select("qid", "id", "rank", "new_rank")


@query(f"""WITH {_KNN.format(where='')}, r AS (SELECT * FROM knn WHERE rank <= 5), {_NEAR}, t AS (SELECT qid, score AS top FROM r WHERE rank = 1),
fl AS (SELECT qid, top < 0.15 AS insufficient, count(*) FILTER (top - score <= 0.05) >= 2 AS ambiguous FROM r JOIN t USING (qid) GROUP BY qid, top),
o AS (SELECT r.qid, 'sym' || r.id % 7 AS s, 'file' || r.id % 3 AS f, row_number() OVER (PARTITION BY r.qid ORDER BY (adjn.id IS NOT NULL) DESC, rank) AS p FROM r LEFT JOIN (SELECT DISTINCT qid, 'sym' || b % 7 AS id FROM q JOIN nb ON a = qid WHERE b % 7 < 2) adjn ON adjn.qid = r.qid AND adjn.id = 'sym' || r.id % 7),
cs AS (SELECT qid, string_agg(s, ',' ORDER BY p) AS symbols FROM (SELECT qid, s, min(p) AS p FROM o GROUP BY qid, s) GROUP BY qid), cf AS (SELECT qid, string_agg(f, ',' ORDER BY p) AS files FROM (SELECT qid, f, min(p) AS p FROM o GROUP BY qid, f) GROUP BY qid)
SELECT fl.qid, insufficient, ambiguous, symbols, files FROM fl JOIN cs USING (qid) JOIN cf USING (qid)""")
def answer_context(spark, d):
    q = _vec_queries(spark, d)
    r = retrieval.knn(_corpus(spark, d), q, 5).withColumns({"symbol_id": F.concat(F.lit("sym"), F.col("id") % 7), "file": F.concat(F.lit("file"), F.col("id") % 3)})
    a, b = F.col("l_partkey") % 500, F.col("l_suppkey") % 500
    ed = table(spark, d, "lineitem").select(a.alias("a"), b.alias("b"))
    near = ed.union(ed.select("b", "a")).distinct().where("b % 7 < 2").select(F.col("a").alias("qid"), F.concat(F.lit("sym"), F.col("b") % 7).alias("id"))
    out = retrieval.answer_context(r.drop("id"), q.select("qid"), near.join(q.select("qid"), "qid", "left_semi"))
    return out.select("qid", "insufficient", "ambiguous", F.array_join("symbol_ids", ",").alias("symbols"), F.array_join("files", ",").alias("files"))


_EMBED = """tk AS (SELECT id, CASE WHEN len(t) > 0 THEN t ELSE list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') END AS ts FROM (SELECT id, text, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda x: lower(x)) AS t FROM {source})),
e AS (SELECT id, CAST(('0x' || substr(sha1(t), 1, 8)) AS BIGINT) % 128 AS b, 12 + least(length(t), 12) AS w FROM (SELECT id, unnest(ts) AS t FROM tk)
  UNION ALL SELECT id, CAST(('0x' || substr(sha1(ts[i] || ' ' || ts[i + 1]), 1, 8)) AS BIGINT) % 128, 3 FROM (SELECT id, ts, unnest(range(1, len(ts))) AS i FROM tk)),
bw AS (SELECT id, b, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY id, b)"""


@query("WITH " + _EMBED.format(source="(SELECT doc_id AS id, text FROM documents)") + " SELECT id AS doc_id, CAST(b AS INTEGER) AS bucket, w AS weight FROM bw")
def hash_embedding(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return retrieval.hash_weights(docs).select(F.col("id").alias("doc_id"), F.posexplode("vec").alias("bucket", "weight")).where("weight > 0").withColumn("weight", F.col("weight").cast("long"))


@query("WITH " + _EMBED.format(source="(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE item_id % 20 = 0)") + """,
nr AS (SELECT id, sqrt(sum(w * w)) AS n FROM bw GROUP BY id), qs AS (SELECT -1 - id AS qid, b, w, n FROM bw JOIN nr USING (id) WHERE id < 0),
s AS (SELECT qid, x.id, round(sum(x.w * qs.w) / (min(nr.n) * min(qs.n)), 9) AS score FROM bw x JOIN qs ON qs.b = x.b JOIN nr ON nr.id = x.id WHERE x.id >= 0 GROUP BY qid, x.id)
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def hash_embed_topk(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    asked = retrieval.hash_embed(_text_queries(spark, d).select(F.col("qid").alias("id"), "text")).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.knn(retrieval.hash_embed(docs), asked, 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _index(spark, d) -> DataFrame:
    """Documents as the rows of a search index, with vectors of the hashing embedder; every fifth is of another model."""
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "lang", "source")
    vec = durable(retrieval.hash_embed(docs.select("id", "text")), "vectors")  # texts are embedded once, however often a search reads the index
    k = F.col("id")
    return docs.join(vec, "id").select(k.alias("chunk_id"), F.col("text").alias("content"), F.col("vec").alias("embedding"), F.lit("code").alias("chunk_type"), F.when(k % 5 == 0, "m2").otherwise("m1").alias("model_id"), F.col("source").alias("file"), F.concat(F.lit("sym"), k % 50).alias("symbol_id"))


_SEARCH = _EMBED.format(source="(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE item_id % 20 = 0)") + f""", {_BM25},
nr AS (SELECT id, sqrt(sum(w * w)) AS n FROM bw GROUP BY id), qs AS (SELECT -1 - id AS qid, b, w, n FROM bw JOIN nr USING (id) WHERE id < 0),
dt AS (SELECT qs.qid, x.id, sum(x.w * qs.w) / (min(nr.n) * min(qs.n)) AS score FROM bw x JOIN qs ON qs.b = x.b JOIN nr ON nr.id = x.id WHERE x.id >= 0 GROUP BY qs.qid, x.id),
sc AS (SELECT q.qid, doc_id AS id, round(coalesce(dt.score, 0), 9) AS score FROM documents, (SELECT item_id AS qid FROM benchmark WHERE item_id % 20 = 0) q LEFT JOIN dt ON dt.qid = q.qid AND dt.id = doc_id WHERE doc_id % 5 <> 0),
vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc),
lx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY lex.rank) AS rank FROM lex JOIN sc USING (qid, id) WHERE lex.rank <= 20),
f AS (SELECT coalesce(v.qid, x.qid) AS qid, coalesce(v.id, x.id) AS id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + x.rank), 0), 9) AS rrf FROM (SELECT * FROM vec WHERE rank <= 20) v FULL JOIN lx x ON v.qid = x.qid AND v.id = x.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM f)"""


@query(f"WITH {_SEARCH} SELECT qid, id AS chunk_id, rank, round(score, 6) AS score FROM r JOIN sc USING (qid, id) WHERE rank <= 5")
def search_implicit_model(spark, d):
    """Questions as texts; only vectors of the embedder's own model answer, the lexical side is cut before that."""
    return retrieval.search(_index(spark, d), _text_queries(spark, d), retrieval.hash_embed, 5, model_id="m1").select("qid", "chunk_id", "rank", "score")


@query(f"WITH {_SEARCH} SELECT qid, id AS chunk_id, rank, 'sym' || id % 50 AS symbol_id, source AS file, sha256(text) AS content FROM r JOIN sc USING (qid, id) JOIN documents ON doc_id = id WHERE rank <= 5")
def evidence_retrieval(spark, d):
    found = retrieval.retrieve_evidence(_index(spark, d), _text_queries(spark, d), retrieval.hash_embed, 5, model_id="m1")
    return found.select("qid", "chunk_id", "rank", "symbol_id", "file", F.sha2("content", 256).alias("content"))


@query("""SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'red bolt' THEN 100 WHEN starts_with(lower(p_name), 'red bolt') THEN 80 WHEN contains(lower(p_name), 'bolt') THEN 60 ELSE 20 END AS score
FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'brand#1') ORDER BY score DESC, name, id LIMIT 400""")
def symbol_search_rank(spark, d):
    n = F.lower("p_name")
    score = F.when(n == "red bolt", 100).when(n.startswith("red bolt"), 80).when(n.contains("bolt"), 60).otherwise(20)
    p = table(spark, d, "part").where(n.contains("bolt") | F.lower("p_brand").contains("brand#1"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), score.alias("score")).orderBy(F.desc("score"), "name", "id").limit(400)


_MESSAGES = "m AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN ['s' || turn % 3, 'f' || conv_id % 4] ELSE [] END AS cited FROM conversations)"


def _messages(spark, d) -> DataFrame:
    cited = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("s"), F.col("turn") % 3), F.concat(F.lit("f"), F.col("conv_id") % 4))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", cited.alias("cited"))


@query(f"""WITH {_MESSAGES}, u AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS q FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m WHERE role = 'user') WHERE r <= 3 GROUP BY conv_id),
a AS (SELECT conv_id, turn, i, unnest(cited) AS c, generate_subscripts(cited, 1) AS j FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM m WHERE role = 'assistant') WHERE i <= 3),
c AS (SELECT conv_id, string_agg(c, ', ' ORDER BY p) AS c FROM (SELECT conv_id, c, min(turn * 10 + j) AS p FROM a GROUP BY conv_id, c) GROUP BY conv_id), k AS (SELECT DISTINCT conv_id FROM m UNION SELECT -1)
SELECT conv_id, concat_ws(chr(10), 'Recent conversation questions: ' || q, 'Recently discussed code: ' || c, 'why ' || conv_id) AS query FROM k LEFT JOIN u USING (conv_id) LEFT JOIN c USING (conv_id)""")
def recent_context_window(spark, d):
    m = _messages(spark, d)
    ids = m.select("conv_id").distinct().union(spark.range(1).select(F.lit(-1).cast("long")))
    return context.enriched_query(m, ids.select("conv_id", F.concat(F.lit("why "), "conv_id").alias("question")), 3)


@query(f"""WITH {_MESSAGES}, a AS (SELECT conv_id, turn, unnest(cited) AS c, generate_subscripts(cited, 1) AS j FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM m WHERE role = 'assistant') WHERE i <= 3)
SELECT conv_id, string_agg(c, ',' ORDER BY p) AS cited FROM (SELECT conv_id, c, min(j - turn * 10) AS p FROM a GROUP BY conv_id, c) GROUP BY conv_id""")
def recent_citations(spark, d):
    return context.recent_citations(_messages(spark, d)).select("conv_id", F.array_join("cited", ",").alias("cited"))


def _conversations(spark, d) -> DataFrame:
    m = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("t")))).alias("h"))
    return m.select("id", F.transform("h", lambda x: x["t"]).alias("history"))


def _contexts(spark, d) -> DataFrame:
    """Conversations with documents dealt to them by id; the first is the README. As many documents a conversation as there are of each."""
    chats = _conversations(spark, d)
    n = chats.agg(F.max("id")).first()[0] + 1
    docs = table(spark, d, "documents").select(F.pmod("doc_id", F.lit(n)).alias("id"), F.col("doc_id").alias("n"), "text").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("e"))
    return chats.join(docs, "id", "left").select("id", "history", F.get("e", F.lit(0))["text"].alias("readme"), F.transform("e", lambda x: x["text"]).alias("evidence"))


@query()
def context_budget_full(spark, d):
    """Conversations with all documents as README and evidence, whole, within 3,000 estimated tokens."""
    out = context.context_budget(_contexts(spark, d), 3000)
    return out.select("id", "dropped", F.size("history").alias("n_history"), F.length("readme").alias("readme_length"), F.sha1(F.array_join("evidence", "\0")).alias("evidence"))


@query("""WITH m AS (SELECT conv_id AS id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS h FROM conversations GROUP BY conv_id), e AS (SELECT doc_id // 10 AS id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS e FROM documents GROUP BY 1)
SELECT m.id, sha256(concat_ws(chr(10) || chr(10), 'Conversation so far:' || chr(10) || h, CASE WHEN m.id % 2 = 0 THEN 'Project README (README):' || chr(10) || text END, 'Retrieved evidence:' || chr(10) || e, 'q' || m.id)) AS prompt FROM m LEFT JOIN e USING (id) LEFT JOIN documents ON doc_id = m.id""")
def prompt_assembly(spark, d):
    """Whole conversations; every second has the document of its id as README, and ten documents are its evidence."""
    docs = table(spark, d, "documents")
    found = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("evidence"))
    rows = _conversations(spark, d).join(found, "id", "left").join(docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("readme")), "id", "left")
    rows = rows.withColumns({"question": F.concat(F.lit("q"), "id"), "readme_path": F.lit("README"), "evidence": F.coalesce("evidence", F.array().cast("array<string>"))})
    return context.prompt_text(rows).select("id", F.sha2("prompt", 256).alias("prompt"))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'view' AND value <= 50 AND user_id % 2 = 0 THEN 'The model did not return an answer for this question.' ELSE concat_ws(chr(10) || chr(10),
CASE WHEN value > 50 THEN 'The repository does not contain enough evidence to fully answer this question. Here is the nearest relevant local evidence found:' END, CASE WHEN event_type <> 'view' THEN 'said ' || event_type END, CASE WHEN user_id % 2 = 1 THEN 'Multiple retrieved fragments were similarly relevant to this question.' END) END AS text FROM events""")
def answer_assembly(spark, d):
    said = F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit(" said "), "event_type", F.lit("\n")))
    return context.answer_text(table(spark, d, "events").select(F.col("event_id").alias("id"), said.alias("raw"), (F.col("value") > 50).alias("insufficient"), (F.col("user_id") % 2 == 1).alias("ambiguous")))


_SYMS = "sy AS (SELECT doc_id AS id, source AS file, CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS src, 'f' || doc_id || '()' AS sig, CASE WHEN doc_id % 4 = 0 THEN 'sum ' || lang END AS summary, CASE WHEN doc_id % 8 = 0 THEN 'doc' END AS doc FROM documents)"


@query(f"WITH {_SYMS} SELECT id AS symbol_id, file, 'code' AS chunk_type, src AS content FROM sy WHERE src <> '' UNION ALL SELECT id, file, 'summary', concat_ws(chr(10) || chr(10), sig, doc, summary) FROM sy WHERE summary IS NOT NULL")
def chunk_building(spark, d):
    k = F.col("doc_id")
    s = table(spark, d, "documents").select(k.alias("symbol_id"), F.col("source").alias("file"), F.when(k % 3 == 0, "  ").otherwise(F.col("text")).alias("source"), F.concat(F.lit("f"), k, F.lit("()")).alias("signature"),
                                            F.when(k % 4 == 0, F.concat(F.lit("sum "), "lang")).alias("summary"), F.when(k % 8 == 0, " doc ").alias("docstring"))
    return retrieval.build_chunks(s.withColumn("symbol_id", F.col("symbol_id").cast("string"))).select(F.col("symbol_id").cast("long").alias("symbol_id"), "file", "chunk_type", "content")


_CACHE = """en AS (SELECT doc_id AS seq, source AS sym, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, 'body ' || doc_id % 60 AS content FROM documents),
us AS (SELECT *, sym || '|code|' || content AS cid FROM en WHERE model <> ''), byid AS (SELECT cid, arg_max(model, seq) AS m, max(seq) AS s FROM us GROUP BY cid), byc AS (SELECT content, arg_max(model, seq) AS m, max(seq) AS s FROM us GROUP BY content)"""


@query(f"""WITH {_CACHE}, ch AS (SELECT doc_id, source || '|code|' || 'body ' || doc_id % 90 AS cid, 'body ' || doc_id % 90 AS content FROM documents)
SELECT doc_id, coalesce(CASE WHEN a.m = 'm1' THEN a.s END, CASE WHEN b.m = 'm1' THEN b.s END) AS vector, (coalesce(CASE WHEN a.m = 'm1' THEN a.s END, CASE WHEN b.m = 'm1' THEN b.s END)) IS NOT NULL AS hit FROM ch LEFT JOIN byid a USING (cid) LEFT JOIN byc b USING (content)""")
def embedding_cache(spark, d):
    k, docs = F.col("doc_id"), table(spark, d, "documents")
    body = lambda n: F.concat(F.lit("body "), k % n)
    entries = docs.select(F.col("source").alias("symbol_id"), F.lit("code").alias("chunk_type"), body(60).alias("content"), F.when(k % 5 == 0, "").when(k % 2 == 0, "m1").otherwise("m2").alias("model_id"), F.array(k.cast("double")).alias("embedding"), k.alias("seq"))
    chunks = docs.select("doc_id", tx.chunk_id(F.col("source"), F.lit("code"), body(90)).alias("chunk_id"), F.lit("code").alias("chunk_type"), body(90).alias("content"))
    out = retrieval.cached_embeddings(chunks, retrieval.seed_cache(entries), "m1")
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("vector"), "hit")


@query("SELECT 16 + label AS dimensionality, count(*) AS n FROM embeddings GROUP BY label")
def rows_per_dimensionality(spark, d):
    """Vectors cut to lengths by their label."""
    v = table(spark, d, "embeddings").select(F.slice("embedding", F.lit(1), 16 + F.col("label")).alias("vec"))
    return v.groupBy(F.size("vec").alias("dimensionality")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, label, list_slice(embedding, 1, 60 + label % 2) AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(CAST(c.v AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 9) AS score FROM v c JOIN v q ON len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 3""")
def knn_mixed_lengths(spark, d):
    """Vectors of two lengths; a question sees those of its own."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", F.lit(1), 60 + F.col("label") % 2).alias("vec"))
    return retrieval.knn(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 3).select("qid", "id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings c, embeddings q)
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def knn_of_every_vector(spark, d):
    """Every vector is a question; blocks of questions meet blocks of vectors."""
    c = _corpus(spark, d).select("id", "vec")
    return knn_blocks.knn_blocks(c, c.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS position FROM conversations")
def message_order(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")).cast("bigint").alias("position"))
