"""Queries of keyed-table maintenance, caches and summaries of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import store
from ..session import table
from .registry import query


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'excluded' WHEN doc_id % 5 = 1 THEN 'binary' WHEN lang = 'fr' THEN 'unsupported' ELSE 'candidate' END AS class, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN true ELSE false END AS changed FROM documents")
def change_classes(spark, d):
    k, h = F.col("doc_id"), F.sha1("text")
    c = table(spark, d, "documents").select("doc_id", F.col("source").alias("path"), (k % 5 == 0).alias("excluded"), (k % 5 <= 1).alias("is_binary"), F.when(F.col("lang") != "fr", F.col("lang")).alias("language"), h.alias("now"), F.when(k % 3 == 0, "").when(k % 3 == 2, h).otherwise("old").alias("was"))
    return store.classify_changes(c).select("doc_id", "class", store.is_changed(F.col("now"), F.col("was")).alias("changed"))


@query("WITH n AS (SELECT l_orderkey AS file, count(*) AS written FROM lineitem WHERE l_orderkey % 6 = 0 AND l_linenumber <= 2 GROUP BY 1), o AS (SELECT l_orderkey AS file, count(*) AS removed FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1) SELECT file, coalesce(removed, 0) AS removed, written FROM n LEFT JOIN o USING (file)")
def replace_counts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber")
    return store.replace_by_file(li.where("file % 4 <> 0"), li.where("file % 6 = 0 and l_linenumber <= 2"), "file")[1]


_BUNDLE = """f AS (SELECT o_orderkey AS path, o_orderstatus AS hash FROM orders WHERE o_orderkey % 5 <> 0), nf AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'new' END AS hash FROM orders WHERE o_orderkey % 10 < 6),
fr AS (SELECT nf.path FROM nf LEFT JOIN f USING (path) WHERE f.hash IS NULL OR f.hash <> nf.hash), s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS path FROM lineitem WHERE l_orderkey % 5 <> 0),
ns AS (SELECT -(l_orderkey * 10 + l_linenumber) AS id, l_orderkey AS path FROM lineitem WHERE l_linenumber <= 2), e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS src, l_orderkey * 10 + 11 AS dst FROM lineitem WHERE l_orderkey % 5 <> 0),
gone AS (SELECT id FROM s WHERE path IN (SELECT path FROM fr)), kept AS (SELECT DISTINCT id FROM ns WHERE path IN (SELECT path FROM fr))"""


@query(f"WITH {_BUNDLE} SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION SELECT id, 0 FROM kept")
def store_bundle(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    key, sid = F.col("o_orderkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    files = o.where(key % 5 != 0).select(key.alias("path"), F.col("o_orderstatus").alias("hash"))
    new_files = o.where(key % 10 < 6).select(key.alias("path"), F.when(key % 2 == 0, F.col("o_orderstatus")).otherwise("new").alias("hash"))
    old = li.where("l_orderkey % 5 <> 0")
    new = li.where("l_linenumber <= 2").select((-sid).alias("id"), F.col("l_orderkey").alias("path"))
    edges = old.select(sid.alias("src"), (F.col("l_orderkey") * 10 + 11).alias("dst")).distinct()
    return store.store_bundles(files, old.select(sid.alias("id"), F.col("l_orderkey").alias("path")), edges, new_files, new, new.select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))[2]


@query("WITH m AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), g AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 5) SELECT src, dst FROM m WHERE dst NOT IN (SELECT id FROM g) AND src NOT IN (SELECT id FROM g)")
def graph_remove_file(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("file"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return store.remove_files(nodes, edges, nodes.where("file < 5").select("file").distinct())[1].select("src", "dst")


@query("SELECT l_partkey AS src, l_suppkey AS dst, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS metadata FROM lineitem GROUP BY 1, 2")
def edge_upsert_last(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("x").alias("type"), F.col("l_returnflag").alias("metadata"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return store.last_metadata(e, "k").drop("type")


@query("WITH o AS (SELECT conv_id, max(turn) + 1 AS last FROM conversations WHERE turn < 3 GROUP BY conv_id) SELECT conv_id, turn, coalesce(last, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations LEFT JOIN o USING (conv_id) WHERE turn >= 3 OR conv_id % 7 = 0")
def sequence_allocation(spark, d):
    c = table(spark, d, "conversations")
    old = c.where("turn < 3").select("conv_id", (F.col("turn") + 1).alias("seq"))
    return store.next_sequence(old, c.where("turn >= 3 or conv_id % 7 = 0").select("conv_id", "turn"), "seq", ["turn"])


_MANIFEST = "man AS (SELECT 'p' || p_partkey AS page, ['p' || (p_partkey * 3) % 100, 'p' || p_partkey + 1] AS links FROM part), prev AS (SELECT page FROM man), cur AS (SELECT 'p' || p_partkey AS page FROM part WHERE p_size > 10 UNION SELECT 'p' || s_suppkey FROM supplier), rem AS (SELECT page FROM prev WHERE page NOT IN (SELECT page FROM cur))"


@query(f"WITH {_MANIFEST}, l AS (SELECT page, unnest(links) AS t FROM man) SELECT page, 'removed' AS what FROM rem UNION ALL SELECT DISTINCT page, 'referrer' FROM l WHERE t IN (SELECT page FROM rem) AND page NOT IN (SELECT page FROM rem)")
def removed_pages(spark, d):
    page = lambda t, c: table(spark, d, t).select(F.concat(F.lit("p"), c).alias("page"))
    k = F.col("p_partkey")
    man = table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("page"), F.array(F.concat(F.lit("p"), (k * 3) % 100), F.concat(F.lit("p"), k + 1)).alias("links"))
    removed = store.removed_pages(man, [table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), k).alias("page")), page("supplier", "s_suppkey")])
    return removed.withColumn("what", F.lit("removed")).unionByName(store.referrers(man, removed).withColumn("what", F.lit("referrer")))


@query("SELECT 'p' || p_partkey AS page FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def pages_in_target(spark, d):
    pages = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("page"))
    return store.pages_in_target(pages, table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("p"), "l_partkey").alias("page")), False)


#: Kinds of pages by number.
_PAGE_KINDS = ["module", "feature", "sequence-diagram", "class-diagram", "readme"]
#: What happened to the pages between two builds: a condition for each that is gone, came, has another title or another template.
_PAGE_CASES = {
    "same": {}, "one gone": {"gone": "page_id % 5 = 0 and page_id < 20"}, "diagram came": {"came": "page_id % 5 = 3"}, "readme came": {"came": "page_id % 5 = 4"}, "feature titles": {"title": "page_id % 10 = 1"},
    "module titles": {"title": "page_id % 5 = 0"}, "template of some": {"template": "page_id % 11 = 2"}, "all": {"gone": "page_id % 7 = 0", "came": "page_id % 7 = 1", "title": "page_id % 7 = 2", "template": "page_id % 7 = 3"},
}


def _flags_sql(case: str) -> str:
    c = {k: _PAGE_CASES[case].get(k, "false") for k in ("gone", "came", "title", "template")}
    return f"""SELECT '{case}' AS case_, coalesce(bool_or((moved AND kind IN ('module', 'feature')) OR (NOT moved AND kind = 'feature' AND {c['title']})), false) AS navigation,
coalesce(bool_or(moved AND kind IN ('module', 'sequence-diagram', 'class-diagram', 'use-case-diagram')), false) AS diagrams, coalesce(bool_or(NOT moved AND {c['template']}), false) AS everything
FROM (SELECT *, {c['gone']} OR {c['came']} AS moved FROM pg WHERE NOT ({c['gone']} AND {c['came']}))"""


@query(f"WITH pg AS (SELECT page_id, {_PAGE_KINDS}[page_id % 5 + 1] AS kind FROM pages) " + " UNION ALL ".join(map(_flags_sql, _PAGE_CASES)))
def regeneration_flags(spark, d):
    """The pages table before and after each of _PAGE_CASES."""
    k = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), k).alias("page"), F.element_at(F.array(*map(F.lit, _PAGE_KINDS)), (k % 5 + 1).cast("int")).alias("kind"), F.col("url").alias("title"), F.lit("t").alias("template"))
    out = None
    for name, case in _PAGE_CASES.items():
        holds = lambda what: F.expr(case.get(what, "false"))
        after = pages.where(~holds("gone")).withColumns({"title": F.when(holds("title"), F.concat("title", F.lit("!"))).otherwise(F.col("title")), "template": F.when(holds("template"), "u").otherwise(F.col("template"))})
        one = store.regeneration_flags(pages.where(~holds("came")), after).select(F.lit(name).alias("case_"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 4 <> 2")
def content_gate(spark, d):
    k, docs = F.col("doc_id"), table(spark, d, "documents")
    stored = docs.where(k % 4 != 0).select("doc_id", F.when(k % 4 == 1, "").when(k % 4 == 2, F.sha2("text", 256)).otherwise("other").alias("hash"))
    return store.content_gated(docs.select("doc_id", F.col("text").alias("content")), stored, "doc_id").select("doc_id", "hash")


@query("WITH u AS (SELECT doc_id AS unit, sha1(text) AS hash, lang FROM documents), c AS (SELECT hash, max(unit) AS v FROM u WHERE unit % 3 = 0 GROUP BY hash) SELECT unit, CASE WHEN v IS NOT NULL THEN 'c' || v WHEN lang <> 'de' THEN 'made ' || lang END AS value, CASE WHEN v IS NOT NULL THEN 'cache' WHEN lang = 'de' THEN 'failed' ELSE 'computed' END AS source FROM u LEFT JOIN c USING (hash)")
def compute_misses(spark, d):
    u = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), F.sha1("text").alias("hash"), F.col("lang").alias("text"))
    cache = u.where("unit % 3 = 0").groupBy("hash").agg(F.max("unit").alias("m")).select("hash", F.concat(F.lit("c"), "m").alias("value"))
    return store.compute_misses(u, cache, lambda t: F.when(t != "de", F.concat(F.lit("made "), t))).select("unit", "value", "source")


_NARR = """rq AS (SELECT 'r' || n_nationkey AS repo, 'k' || n_nationkey % 3 AS key, 'fp' || n_nationkey % 2 AS fingerprint FROM nation), ca AS (SELECT 'r' || o_custkey % 25 AS repo, 'k' || o_orderkey % 3 AS key, 'fp' || o_orderkey % 2 AS fingerprint, 't' || o_orderkey AS text, o_orderkey AS tm FROM orders WHERE o_custkey % 25 < 12 AND (o_custkey % 25) % 3 <> o_orderkey % 3 OR o_custkey % 25 = 20),
an AS (SELECT 'r' || n_nationkey AS repo, 'answer' AS text FROM nation WHERE n_nationkey % 4 = 0)"""


@query(f"""WITH {_NARR}, h AS (SELECT repo, key, arg_max(text, tm) AS hit FROM ca GROUP BY repo, key), l AS (SELECT repo, arg_max(text, tm) AS t, arg_max(fingerprint, tm) AS f FROM ca GROUP BY repo)
SELECT rq.repo, CASE WHEN hit IS NOT NULL THEN 'cached' WHEN an.text IS NOT NULL THEN 'generated' WHEN t IS NULL THEN 'none' WHEN f = fingerprint THEN 'previous-prompt' ELSE 'stale' END AS state, coalesce(hit, an.text, t) AS text FROM rq LEFT JOIN h USING (repo, key) LEFT JOIN an USING (repo) LEFT JOIN l USING (repo)""")
def narrative_cache(spark, d):
    k, o, c = F.col("n_nationkey"), F.col("o_orderkey"), F.col("o_custkey") % 25
    pre = lambda p, x: F.concat(F.lit(p), x)
    n = table(spark, d, "nation")
    cache = table(spark, d, "orders").where(((c < 12) & (c % 3 != o % 3)) | (c == 20)).select(pre("r", c).alias("repo"), pre("k", o % 3).alias("key"), pre("fp", o % 2).alias("fingerprint"), pre("t", o).alias("text"), o.alias("at"))
    return store.narrative_state(n.select(pre("r", k).alias("repo"), pre("k", k % 3).alias("key"), pre("fp", k % 2).alias("fingerprint")), cache, n.where(k % 4 == 0).select(pre("r", k).alias("repo"), F.lit("answer").alias("text")))


@query("SELECT 'r' || n_nationkey AS repo, CASE WHEN n_regionkey < 2 THEN 'cache' WHEN n_nationkey % 2 = 0 THEN 'call' ELSE 'none' END AS source, CASE WHEN n_regionkey < 2 THEN 'plan ' || n_regionkey WHEN n_nationkey % 2 = 0 THEN 'new' END AS plan FROM nation")
def plan_cache(spark, d):
    n = table(spark, d, "nation")
    repo = F.concat(F.lit("r"), "n_nationkey").alias("repo")
    cache = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.when(F.col("r_regionkey") < 2, F.concat(F.lit("plan "), "r_regionkey")).alias("plan"))
    return store.plan_state(n.select(repo, F.col("n_regionkey").alias("key")), cache, n.where("n_nationkey % 2 = 0").select(repo, F.lit("new").alias("plan")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'fresh' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def carry_forward(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return store.carry_forward(o.where("k % 2 = 0").withColumn("v", F.lit("old")), o.where("k % 3 = 0").withColumn("v", F.lit("fresh")), "k").select("k", "v")


@query("SELECT source AS repo, sha1('lead' || chr(0) || string_agg('d' || doc_id || chr(0) || sha1(text) || chr(10), '' ORDER BY 'd' || doc_id || chr(0) || sha1(text))) AS fingerprint FROM documents GROUP BY source")
def ordered_fingerprint(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("path"), F.sha1("text").alias("hash"))
    return store.fingerprint(files, "repo", "lead")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS seen, count(*) FILTER (lang = 'en') AS kept, count(*) FILTER (n_chars < 500) AS small, count(*) FILTER (doc_id % 9 = 0) AS excluded, count(*) FILTER (lang IS NULL) AS unknown FROM documents GROUP BY source")
def scan_counters(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.count("*").alias("seen"), F.count_if(F.col("lang") == "en").alias("kept"), F.count_if(F.col("n_chars") < 500).alias("small"),
        F.count_if(F.col("doc_id") % 9 == 0).alias("excluded"), F.count_if(F.col("lang").isNull()).alias("unknown"))


@query("SELECT count(*) FILTER (k <> 2) AS modules, count(*) FILTER (k = 2) AS documents, CAST(sum(CASE WHEN k <> 2 THEN c ELSE 0 END) AS BIGINT) AS classes FROM (SELECT p_partkey % 4 AS k, p_size % 5 AS c FROM part)")
def architecture_summary(spark, d):
    prose = tx.is_prose(F.concat(F.lit("a/b"), F.when(F.col("p_partkey") % 4 == 2, ".md").otherwise(".py")))
    p = table(spark, d, "part").select(prose.alias("prose"), (F.col("p_size") % 5).alias("c"))
    return p.agg(F.count_if(~F.col("prose")).alias("modules"), F.count_if("prose").alias("documents"), F.sum(F.when(F.col("prose"), 0).otherwise(F.col("c"))).cast("long").alias("classes"))


@query("SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'class' ELSE 'function' END AS kind, c_name AS name, CASE WHEN c_nationkey % 3 = 1 AND c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS parent, CASE WHEN c_nationkey % 3 = 2 THEN 'int' ELSE '' END AS returns, CASE WHEN c_nationkey % 3 = 2 THEN c_custkey % 4 ELSE 0 END AS n_parameters FROM customer")
def symbol_variants(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_nationkey") % 3
    base = c.select(F.col("c_custkey").alias("id"), F.when(k == 0, "module").when(k == 1, "class").otherwise("function").alias("kind"), F.col("c_name").alias("name"))
    classes = c.where((k == 1) & (F.col("c_custkey") % 2 == 0)).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("parent"))
    return store.variants(base, classes, c.where(k == 2).select(F.col("c_custkey").alias("id"), F.lit("int").alias("returns"), (F.col("c_custkey") % 4).alias("n_parameters")))


@query("WITH s AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS path FROM supplier), e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem) SELECT 'n' || n_nationkey AS path, n_name AS hash, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS symbols, count(dst) AS n_edges FROM nation LEFT JOIN s ON s.path = 'n' || n_nationkey LEFT JOIN e ON e.src = s.id GROUP BY n_nationkey, n_name")
def repository_bundle(spark, d):
    pre = lambda p, c: F.concat(F.lit(p), c)
    files = table(spark, d, "nation").select(pre("n", "n_nationkey").alias("path"), F.col("n_name").alias("hash"))
    syms = table(spark, d, "supplier").select(pre("s", "s_suppkey").alias("id"), pre("n", "s_nationkey").alias("path"))
    edges = table(spark, d, "lineitem").select(pre("s", "l_suppkey").alias("src"), pre("p", "l_partkey").alias("dst")).distinct()
    return store.bundles(files, syms, edges).withColumn("symbols", F.array_join("symbols", ","))


@query("SELECT o_custkey, arg_max(o_orderkey, epoch(o_orderdate) * 10000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def asof_latest(spark, d):
    return store.latest_by_key(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
def having_filter(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return g.where("n > 12 and t > 100000").select("o_custkey", "n", F.round("t", 2).alias("total"))


@query("WITH e AS (SELECT count(DISTINCT l_partkey) AS exact FROM lineitem) SELECT exact, true AS within FROM e")
def approximate_distinct(spark, d):
    """The sketch's count is within five standard errors of the exact one."""
    g = table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("approx"))
    return g.select("exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL (30 + o_orderkey % 60) DAY AS z FROM orders WHERE o_orderkey % 5 = 0), p AS (SELECT o_custkey, o_orderkey AS k, o_orderdate AS t FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT k, s.o_orderkey AS e, row_number() OVER (PARTITION BY k ORDER BY z - a, s.o_orderkey) AS r FROM p JOIN s ON p.o_custkey = s.o_custkey AND t >= a AND t < z) SELECT k, e AS enclosing FROM j WHERE r = 1""")
def range_containment(spark, d):
    """The least of the spans that hold a point. Spans are cut into months, so the join meets those of one customer and month only."""
    o = table(spark, d, "orders")
    z = F.expr("o_orderdate + make_dt_interval(30 + o_orderkey % 60)")
    month = lambda c: F.year(c) * 12 + F.month(c)
    spans = o.where("o_orderkey % 5 = 0").select("o_custkey", F.col("o_orderkey").alias("e"), F.col("o_orderdate").alias("a"), z.alias("z")).withColumn("m", F.explode(F.sequence(month("a"), month("z"))))
    points = o.where("o_orderkey % 5 <> 0").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"), month("o_orderdate").alias("m"))
    return points.join(spans, ["o_custkey", "m"]).where("t >= a and t < z").groupBy("k").agg(F.min_by("e", F.struct(F.expr("z - a"), "e")).alias("enclosing"))


@query("""WITH l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS view_id, ts AS vt, user_id FROM events WHERE event_type = 'view')
SELECT event_id, arg_max(view_id, CAST(epoch_us(vt) AS HUGEINT) * 1000000000000 + view_id) AS last_view, count(*) AS n FROM l JOIN r ON l.user_id = r.user_id AND vt <= ts AND vt > ts - INTERVAL 12 HOUR GROUP BY event_id""")
def interval_join(spark, d):
    """Events and the earlier ones of the same user within twelve hours, met by half-day cells; the last of them, of one time that of greater id, is the as-of match."""
    e = table(spark, d, "events")
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 43_200)
    left = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id", F.explode(F.array(cell("ts"), cell("ts") - 1)).alias("cell"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("ts").alias("vt"), "user_id", cell("ts").alias("cell"))
    j = left.join(right, ["user_id", "cell"]).where("vt <= ts and vt > ts - interval 12 hours")
    return j.groupBy("event_id").agg(F.max_by("view_id", F.struct("vt", "view_id")).alias("last_view"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS last_kind FROM events GROUP BY user_id")
def latest_event(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"))
