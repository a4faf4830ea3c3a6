"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context, graph, retrieval, store
from ..session import documents, durable, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')"
_TERMS = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t)))"
_BM25 = f"""
qt AS (SELECT DISTINCT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark WHERE item_id % 20 = 0),
tok AS (SELECT doc_id AS id, {_TOK} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM tok),
post AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY id, len(t), term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
lex AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT qid, id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM post JOIN dfs USING (term) JOIN qt USING (term), st GROUP BY qid, id))"""
_KNN = """
q AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0),
knn AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT qid, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qvec AS DOUBLE[])), 9) AS score FROM embeddings, q {where}))"""


def _corpus(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _vec_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _text_queries(spark, d):
    """Every item whose id is divisible by 20 is a question of the retrieval queries."""
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")


@query(f"WITH {_KNN.format(where='')} SELECT qid, id, round(score, 6) AS score, rank FROM knn WHERE rank <= 5")
def knn_cosine_topk(spark, d):
    return retrieval.knn(_corpus(spark, d), _vec_queries(spark, d), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_KNN.format(where='WHERE label = 3')} SELECT qid, id, round(score, 6) AS score, rank FROM knn WHERE rank <= 5")
def knn_filtered_topk(spark, d):
    c = retrieval.metadata_filter(_corpus(spark, d), {"label": 3, "model": None, "unknown": 1}, {"label": "label", "model": "model"})
    return retrieval.knn(c, _vec_queries(spark, d), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT qid, id, round(score, 4) AS score FROM lex WHERE rank <= 10")
def bm25_topk(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(docs, _text_queries(spark, d), 10).select("qid", "id", F.round("score", 4).alias("score"))


@query("""SELECT doc_id, 'chunk_' || substr(sha1(source || '|' || lang || '|' || regexp_replace(regexp_replace(text, '[ \\t\\r\\x0B\\f]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')), 1, 16) AS chunk_id, sha256(text) AS content_hash FROM documents""")
def chunk_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.chunk_id(F.col("source"), F.col("lang"), F.col("text")).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


@query("""WITH h AS (SELECT doc_id, sha1(text) AS h FROM documents), k AS (SELECT h, min(doc_id) AS reuse_of FROM h GROUP BY h)
SELECT doc_id, reuse_of, doc_id <> reuse_of AS reused FROM h JOIN k USING (h)""")
def duplicate_content_reuse(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("h"))
    k = h.groupBy("h").agg(F.min("doc_id").alias("reuse_of"))
    return h.join(k, "h").select("doc_id", "reuse_of", (F.col("doc_id") != F.col("reuse_of")).alias("reused"))


@query("""SELECT conv_id, turn, cost, CAST(total AS BIGINT) AS total FROM (SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total
FROM (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 3 + 1 END AS cost FROM conversations)) WHERE total <= 300""")
def history_budget(spark, d):
    return context.history_budget(table(spark, d, "conversations"), 300)


@query("SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id LIMIT 64")
def session_recency(spark, d):
    return context.session_recency(table(spark, d, "conversations"), "turn")


_EDGES = """e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'placed' AS type FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'contains' FROM lineitem
UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by' FROM lineitem
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'located_in' FROM nation)"""


def edges(spark, d, once: bool = True) -> DataFrame:
    """The star schema as a typed property graph. With ``once`` no edge repeats; what drops repeated edges itself needs none of that."""
    def e(t, a, ka, b, kb, kind):
        x = table(spark, d, t).select(F.concat(F.lit(a), F.col(ka)).alias("src"), F.concat(F.lit(b), F.col(kb)).alias("dst"), F.lit(kind).alias("type"))
        return x.distinct() if once and t == "lineitem" else x

    parts = [("orders", "c", "o_custkey", "o", "o_orderkey", "placed"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "contains"), ("lineitem", "p", "l_partkey", "s", "l_suppkey", "supplied_by"),
             ("supplier", "s", "s_suppkey", "n", "s_nationkey", "located_in"), ("customer", "c", "c_custkey", "n", "c_nationkey", "located_in"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "located_in")]
    out = None
    for p in parts:
        out = e(*p) if out is None else out.unionByName(e(*p))
    return out


@query(f"WITH {_EDGES} SELECT type, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM e GROUP BY type")
def typed_edges(spark, d):
    return graph.count_by_type(edges(spark, d))


@query("SELECT l_partkey AS src, l_suppkey AS dst, 'supplied_by' AS type, arg_min(l_shipmode, k) AS metadata FROM (SELECT *, l_returnflag AS l_shipmode, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY l_partkey, l_suppkey")
def edge_dedupe_first(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("supplied_by").alias("type"), F.col("l_returnflag").alias("metadata"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return graph.dedupe_edges(e, "k")


@query(f"WITH {_EDGES}, b AS (SELECT src AS id, dst AS o FROM e UNION SELECT dst, src FROM e) SELECT id, count(*) AS degree FROM b GROUP BY id ORDER BY degree DESC, id LIMIT 40")
def degree_topn(spark, d):
    return graph.degree(edges(spark, d, once=False)).orderBy(F.desc("degree"), "id").limit(40)


_CALLS = "c AS (SELECT DISTINCT 'n' || n_nationkey AS callee, 'r' || n_regionkey AS caller, n_nationkey AS line FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey AS INTEGER) FROM supplier)"


# The graph searches over all nodes, or from every node whose key is divisible by 20, each root by itself.
_ROOTS = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), roots AS (SELECT id FROM v WHERE CAST(substr(id, 2) AS BIGINT) % 20 = 0)"


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()


def _roots(e: DataFrame) -> DataFrame:
    return _nodes(e).where(F.substring("id", 2, 20).cast("bigint") % 20 == 0)


@query(f"WITH {_EDGES} SELECT DISTINCT src AS id, dst AS other, type FROM e")
def dependencies_1hop(spark, d):
    return graph.dependencies(edges(spark, d, once=False))


@query(f"WITH {_EDGES} SELECT DISTINCT dst AS id, src AS other, type FROM e WHERE type = 'located_in'")
def dependents_1hop(spark, d):
    return graph.dependents(edges(spark, d, once=False), kind="located_in")


@query(f"WITH {_EDGES} SELECT src AS id, dst AS other FROM e UNION SELECT dst, src FROM e")
def both_directions(spark, d):
    return graph.neighbours(edges(spark, d, once=False))


@query(f"WITH {_EDGES}, {_ROOTS}, b AS (SELECT src AS id, dst AS o FROM e UNION SELECT dst, src FROM e), n AS (SELECT roots.id AS root, o AS id FROM roots JOIN b ON b.id = roots.id UNION SELECT id, id FROM roots) SELECT DISTINCT x.root, src, dst, type FROM e JOIN n x ON x.id = src JOIN n y ON y.id = dst AND y.root = x.root")
def ego_network(spark, d):
    e = durable(edges(spark, d, once=False).distinct(), "graph")
    return graph.ego_networks(e, _roots(e), once=True)


@query(f"WITH RECURSIVE {_EDGES}, {_ROOTS}, b AS (SELECT DISTINCT src, dst FROM e), w AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 6) SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id")
def bfs_depth_roots(spark, d):
    e = durable(edges(spark, d, once=False).select("src", "dst").distinct(), "graph")
    return graph.bfs_of_each(e, _roots(e), 6, once=True)


@query(f"WITH RECURSIVE {_EDGES}, {_ROOTS}, b AS (SELECT DISTINCT src, dst FROM e), w AS (SELECT id, 0 AS depth FROM roots UNION SELECT dst, depth + 1 FROM w JOIN b ON src = id WHERE depth < 6) SELECT id, min(depth) AS depth FROM w GROUP BY id")
def bfs_depth(spark, d):
    """Least number of steps from any of the roots."""
    e = durable(edges(spark, d, once=False).select("src", "dst").distinct(), "graph")
    return graph.bfs(e, _roots(e), 6, once=True)


@query(f"""WITH RECURSIVE {_CALLS}, e AS (SELECT caller AS src, callee AS dst FROM c), {_ROOTS}, w AS (SELECT id AS root, id, 0 AS depth, '' AS path FROM roots
UNION ALL SELECT root, callee, depth + 1, path || chr(1) || lpad(CAST(line AS VARCHAR), 9, '0') || ':' || callee FROM w JOIN c ON caller = id WHERE depth < 6),
p AS (SELECT root, id, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position, count(*) OVER (PARTITION BY root) > 1000 AS truncated FROM w) SELECT * FROM p WHERE position < 1000""")
def dfs_sequence(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    calls = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").alias("line")).unionByName(
        s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.col("s_suppkey").cast("int").alias("line")))
    return graph.dfs_of_each(calls, _roots(calls))


@query("""WITH RECURSIVE a AS (SELECT o_orderkey AS old, o_orderkey // 2 AS new FROM orders WHERE o_orderkey % 3 <> 0),
w AS (SELECT old, new AS target FROM a UNION SELECT w.old, a.new FROM w JOIN a ON a.old = w.target) SELECT old, target FROM w WHERE target NOT IN (SELECT old FROM a)""")
def alias_chain(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("old"), F.floor(F.col("o_orderkey") / 2).alias("new"))
    return graph.alias_targets(a)


_PATHS = "p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), s AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), i, len(string_split(path, '/'))), '/') AS name FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p))"


def _paths(spark, d):
    return table(spark, d, "pages").select(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path")).distinct()


@query(f"WITH {_PATHS}, q AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), -1, len(string_split(path, '/'))), '/') AS name FROM p) SELECT name, CASE WHEN count(DISTINCT path) = 1 THEN min(path) END AS path FROM q LEFT JOIN s USING (name) GROUP BY name")
def suffix_resolution(spark, d):
    p = _paths(spark, d)
    return graph.resolve_unique_suffix(p, p.select(F.element_at(F.split("path", "/"), -1).alias("name")))


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'CREATED' WHEN a.h IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def catchup_diff(spark, d):
    docs = table(spark, d, "documents")
    m = F.col("doc_id") % 10
    before = docs.where(m != 1).select("doc_id", F.sha2("text", 256).alias("h"))
    after = docs.where(m != 2).select("doc_id", F.sha2(F.when(m == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return store.catchup_diff(before, after, "doc_id", "h")


@query("""WITH b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <= 4), a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber >= 2)
SELECT src, dst, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT src, dst, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def edge_symmetric_difference(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return store.symmetric_difference(e.where("l_linenumber <= 4").drop("l_linenumber"), e.where("l_linenumber >= 2").drop("l_linenumber"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderpriority AS created FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey AS k, 'new' AS v, 'later' AS created FROM orders WHERE o_orderkey % 4 <= 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, coalesce(o.created, n.created) AS created, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'kept' ELSE 'replaced' END AS lifecycle FROM o FULL JOIN n ON o.k = n.k""")
def upsert_merge(spark, d):
    o = table(spark, d, "orders")
    m = F.col("o_orderkey") % 4
    old = o.where(m != 0).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("created"))
    new = o.where(m <= 1).select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"), F.lit("later").alias("created"))
    return store.upsert(old, new, "k", ("created",))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1")
def replace_by_file(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = li.where("l_orderkey % 7 = 0 and l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") * 2)
    return store.replace_groups(li, new, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {_EDGES} SELECT src, dst, type FROM e WHERE src NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 20) AND dst NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 20)")
def cascade_delete(spark, d):
    gone = table(spark, d, "part").where("p_size < 20").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return store.cascade_delete(edges(spark, d), gone).select("src", "dst", "type")


@query("""WITH u AS (SELECT doc_id AS unit, source AS name, sha1(text) AS hash FROM documents), l AS (SELECT source AS name, sha1(text) AS hash, CAST(quality AS VARCHAR) AS summary, doc_id AS ts FROM documents JOIN labels USING (doc_id)),
x AS (SELECT hash, arg_max(summary, ts) AS exact FROM l GROUP BY hash), y AS (SELECT name, arg_max(summary, ts) AS latest FROM l GROUP BY name)
SELECT unit, CASE WHEN exact IS NOT NULL THEN 'fresh' WHEN latest IS NOT NULL THEN 'stale' ELSE 'missing' END AS state, coalesce(exact, latest) AS summary FROM u LEFT JOIN x USING (hash) LEFT JOIN y USING (name)""")
def ledger_recall(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha1("text").alias("hash"))
    ledger = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("name"), "hash", F.col("quality").cast("string").alias("summary"), F.col("doc_id").alias("at"))
    return store.ledger_recall(docs.select(F.col("doc_id").alias("unit"), F.col("source").alias("name"), "hash"), ledger)


@query(f"WITH {_EDGES}, c AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0) SELECT id, 'changed' AS reason FROM c UNION ALL SELECT DISTINCT src, 'dependent' FROM e WHERE dst IN (SELECT id FROM c) AND src NOT IN (SELECT id FROM c)")
def impact_set(spark, d):
    return store.impact_set(edges(spark, d), table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))


def _events(spark, d):
    return table(spark, d, "events")


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN event_type END, 'interrupted') AS outcome FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def run_log_prune(spark, d):
    e = _events(spark, d).select("event_id", "ts", F.coalesce(F.when(F.col("value") > 50, F.col("event_type")), F.lit("interrupted")).alias("outcome"))
    return store.keep_newest(e, [F.desc("ts"), F.desc("event_id")]).select("event_id", "outcome")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def props_json_parse(spark, d):
    return _events(spark, d).select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"}).alias("p")).where("p is not null").select("event_id", "p.k")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal, CAST(grouping(r_name) AS TINYINT) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)")
def cube_rollup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.cube("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"), F.grouping("r_name").alias("g"))


@query("""SELECT 'sets' AS kind, o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
UNION ALL SELECT 'rollup', o_orderstatus, o_orderpriority, count(*), CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def grouping_sets_rollup(spark, d):
    o = table(spark, d, "orders")
    keys = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    counts = lambda kind, g: g.agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(F.lit(kind).alias("kind"), *keys, "n", "g")
    return counts("sets", o.groupingSets([keys[:1], keys[1:], []], *keys)).unionByName(counts("rollup", o.rollup(*keys)))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def semi_anti(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS last3, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)""")
def window_frames(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


# The other queries register themselves.
from . import code_queries, feature_queries, incremental_queries, retrieval_queries, source_queries, store_queries, stream_queries, text_queries  # noqa: E402, F401
