"""Queries of the code graph, over a repository of Python files made from the driver's tables.

Parts are files in five packages (most file names occur in each, some once), line items are import lines of
five forms, customers are classes and functions, orders are calls, suppliers are subclasses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code_graph as cg
from ..session import table
from .registry import query, sql_values, values

_REPO = """
np AS (SELECT count(*) AS np FROM part), nc AS (SELECT count(*) AS nc FROM customer),
mods AS (SELECT p_partkey AS k, p_partkey % 5 AS pkg, CASE WHEN p_partkey % 11 = 0 THEN 'only' || p_partkey ELSE 'mod' || p_partkey // 5 END AS name FROM part),
files AS (SELECT k, name, 'pkg' || pkg || '/' || name || '.py' AS path FROM mods),
imps AS (SELECT f.path AS file, l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 5 WHEN 0 THEN 'from .' || t.name || ' import x' WHEN 1 THEN 'from pkg' || t.pkg || '.' || t.name || ' import y'
  WHEN 2 THEN 'import ' || t.name WHEN 3 THEN 'import os, ' || t.name ELSE 'from ..pkg' || t.pkg || '.' || t.name || ' import z' END AS text
  FROM lineitem, np JOIN files f ON f.k = l_partkey JOIN mods t ON t.k = (l_orderkey * 7 + l_linenumber) % np),
syms AS (SELECT 's' || c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'own' || c_custkey ELSE 'fn-' || c_custkey % 40 END AS name, path AS file
  FROM customer, np JOIN files ON k = c_custkey % np),
calls AS (SELECT coalesce(s.file, 'none') AS file, CASE WHEN o_orderkey % 7 = 0 THEN 'module' ELSE 's' || o_custkey END AS caller,
  CASE WHEN o_orderkey % 10 = 0 THEN 'nope' || o_orderkey % 3 WHEN o_orderkey % 4 = 0 THEN 'obj.' || t.name ELSE t.name END AS callee, o_orderkey AS line
  FROM orders, nc JOIN syms s ON s.id = 's' || o_custkey JOIN syms t ON t.id = 's' || (o_orderkey * 3) % nc),
inh AS (SELECT s.file, s.id AS subclass, CASE WHEN s_suppkey % 5 = 0 THEN 'Base' ELSE t.name END AS parent, s_suppkey AS line
  FROM supplier, nc JOIN syms s ON s.id = 's' || s_suppkey JOIN syms t ON t.id = 's' || (s_suppkey * 11 + 3) % nc)"""
_NAMES = r"""
names AS (SELECT file, seq, text, unnest(CASE WHEN starts_with(text, 'from ') THEN [regexp_extract(text, '^from (\S+) import', 1)] ELSE string_split(substr(text, 8), ', ') END) AS name FROM imps),
refs AS (SELECT DISTINCT file, name FROM names),
rel AS (SELECT r.file, r.name, f.path FROM refs r JOIN files f ON starts_with(r.name, '.') AND f.path <> r.file AND f.path = CASE WHEN starts_with(r.name, '..') THEN replace(substr(r.name, 3), '.', '/') ELSE regexp_extract(r.file, '^(.*)/', 1) || '/' || replace(substr(r.name, 2), '.', '/') END || '.py'),
uniq AS (SELECT DISTINCT name FROM refs WHERE NOT starts_with(name, '.')),
tail AS (SELECT u.name, f.path FROM uniq u JOIN files f ON contains(u.name, '.') AND ends_with('/' || f.path, '/' || replace(u.name, '.', '/') || '.py')),
tail1 AS (SELECT file, r.name, min(path) AS path FROM refs r JOIN tail t ON r.name = t.name AND path <> file GROUP BY file, r.name HAVING count(*) = 1),
bare AS (SELECT file, r.name, min(path) AS path FROM refs r JOIN files f ON f.name = regexp_extract(r.name, '([^.]*)$', 1) AND NOT starts_with(r.name, '.') AND path <> file GROUP BY file, r.name HAVING count(*) = 1),
res AS (SELECT n.file, n.seq, n.text, n.name, coalesce(rel.path, tail1.path, bare.path) AS target FROM names n LEFT JOIN rel ON rel.file = n.file AND rel.name = n.name
  LEFT JOIN tail1 ON tail1.file = n.file AND tail1.name = n.name LEFT JOIN bare ON bare.file = n.file AND bare.name = n.name)"""
_NORM = "replace(replace({}, ' ', ''), '-', '_')"


def _targets(kind: str, refs: str, n: str = "") -> str:
    """CTEs up to found{n}(file, name, target) of the names in refs."""
    norm = _NORM.format("r.name")
    return f"""
keys{n} AS (SELECT DISTINCT file, name, unnest([{norm}, regexp_extract({norm}, '([^.]*)$', 1)]) AS key FROM (SELECT DISTINCT file, name FROM {refs}) r),
own{n} AS (SELECT id, file AS home, {_NORM.format('name')} AS key FROM syms WHERE kind = '{kind}'),
hits{n} AS (SELECT k.file, k.name, count(DISTINCT id) AS n, min(id) AS any_id, min(CASE WHEN home = k.file THEN id END) AS here FROM keys{n} k JOIN own{n} USING (key) GROUP BY k.file, k.name),
found{n} AS (SELECT DISTINCT r.file, r.name, coalesce(here, CASE WHEN n = 1 THEN any_id END, 'unresolved::{kind}::' || {norm}) AS target FROM {refs} r LEFT JOIN hits{n} h ON h.file = r.file AND h.name = r.name)"""


def _modules(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, F.concat(F.lit("only"), k)).otherwise(F.concat(F.lit("mod"), F.floor(k / 5)))
    return table(spark, d, "part").select(k.alias("k"), (k % 5).alias("pkg"), name.alias("name"))


def files(spark, d) -> DataFrame:
    return _modules(spark, d).select("k", F.concat(F.lit("pkg"), "pkg", F.lit("/"), "name", F.lit(".py")).alias("path"))


def imports(spark, d) -> DataFrame:
    n = table(spark, d, "part").count()
    li = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n).alias("t"))
    j = li.join(files(spark, d).select(F.col("k").alias("l_partkey"), F.col("path").alias("file")), "l_partkey").join(_modules(spark, d).withColumnRenamed("k", "t"), "t")
    form = lambda *p: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(p)])
    forms = [form("from .", "name", " import x"), form("from pkg", "pkg", ".", "name", " import y"), form("import ", "name"), form("import os, ", "name"), form("from ..pkg", "pkg", ".", "name", " import z")]
    text = F.element_at(F.array(*forms), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return j.select("file", "seq", text.alias("text"))


def symbols(spark, d) -> DataFrame:
    n, c = table(spark, d, "part").count(), F.col("c_custkey")
    name = F.when(c % 3 == 0, F.concat(F.lit("own"), c)).otherwise(F.concat(F.lit("fn-"), c % 40))
    s = table(spark, d, "customer").select(F.concat(F.lit("s"), c).alias("id"), F.when(F.col("c_nationkey") % 4 == 0, "class").otherwise("function").alias("kind"), name.alias("name"), (c % n).alias("k"))
    return s.join(files(spark, d).withColumnRenamed("path", "file"), "k").drop("k")


def calls(spark, d) -> DataFrame:
    n, s, o = table(spark, d, "customer").count(), symbols(spark, d), F.col("o_orderkey")
    j = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("s"), "o_custkey").alias("id"), F.concat(F.lit("s"), (o * 3) % n).alias("t"))
    j = j.join(s.select("id", "file"), "id").join(s.select(F.col("id").alias("t"), "name"), "t")
    callee = F.when(o % 10 == 0, F.concat(F.lit("nope"), o % 3)).when(o % 4 == 0, F.concat(F.lit("obj."), "name")).otherwise(F.col("name"))
    return j.select("file", F.when(o % 7 == 0, "module").otherwise(F.col("id")).alias("caller"), callee.alias("callee"), o.alias("line"))


def inherits(spark, d) -> DataFrame:
    n, s, k = table(spark, d, "customer").count(), symbols(spark, d), F.col("s_suppkey")
    j = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("s"), (k * 11 + 3) % n).alias("t"))
    j = j.join(s.select("id", "file"), "id").join(s.select(F.col("id").alias("t"), "name"), "t")
    return j.select("file", F.col("id").alias("subclass"), F.when(k % 5 == 0, "Base").otherwise(F.col("name")).alias("parent"), k.alias("line"))


@query(f"WITH {_REPO}, {_NAMES} SELECT file, seq, name, target FROM res")
def resolve_imports(spark, d):
    return cg.resolve_imports(imports(spark, d), files(spark, d)).select("file", "seq", "name", "target")


@query(f"""WITH {_REPO}, {_NAMES}, e AS (SELECT 'file::' || file AS src, CASE WHEN target IS NULL THEN 'file::external::' || {_NORM.format('name')} ELSE 'file::' || target END AS dst, seq, name, text,
coalesce(regexp_extract(target, '([^/]*)[.]py$', 1), name) AS tn FROM res), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq, name) AS r FROM e) SELECT src, dst, text, tn AS target_name FROM r WHERE r = 1""")
def import_edges(spark, d):
    e = cg.import_edges(cg.resolve_imports(imports(spark, d), files(spark, d)))
    return e.select("src", "dst", F.col("metadata")["text"].alias("text"), F.col("metadata")["targetName"].alias("target_name"))


def _edges_sql(rows: str, source: str, name: str, kind: str) -> str:
    return f"""WITH {_REPO}, rel AS (SELECT file, {source} AS src, {name} AS name, line FROM {rows} WHERE {source} IN (SELECT id FROM syms)), {_targets(kind, 'rel')},
j AS (SELECT rel.src, target AS dst, rel.name, line FROM rel JOIN found ON rel.file = found.file AND rel.name = found.name)
SELECT src, dst, arg_min(name, line) AS raw, min(line) AS line FROM j GROUP BY src, dst"""


def _relation(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", F.col("metadata")["rawTarget"].alias("raw"), F.col("metadata")["line"].cast("long").alias("line"))


@query(_edges_sql("calls", "caller", "callee", "function"))
def call_edges(spark, d):
    return _relation(cg.call_edges(calls(spark, d), symbols(spark, d)))


@query(_edges_sql("inh", "subclass", "parent", "class"))
def inherit_edges(spark, d):
    return _relation(cg.inheritance_edges(inherits(spark, d), symbols(spark, d)))


@query(f"""WITH {_REPO}, nodes AS (SELECT 'file::' || path AS id, name FROM files UNION ALL SELECT id, name FROM syms),
w AS (SELECT id AS key FROM nodes UNION SELECT path FROM files UNION SELECT name FROM syms UNION SELECT name FROM files UNION SELECT 'absent'),
u AS (SELECT name, min(id) AS id FROM nodes GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT key, coalesce(a.id, b.id, c.id, u.id) AS id FROM w LEFT JOIN nodes a ON a.id = key LEFT JOIN nodes b ON b.id = {_NORM.format('key')} LEFT JOIN nodes c ON c.id = 'file::' || key LEFT JOIN u ON u.name = key""")
def node_lookup(spark, d):
    f, s = files(spark, d), symbols(spark, d)
    nodes = f.select(cg.file_id(F.col("path")).alias("id"), cg.stem(F.col("path")).alias("name")).unionByName(s.select("id", "name"))
    keys = nodes.select(F.col("id").alias("key")).union(f.select("path")).union(s.select("name")).union(f.select(cg.stem(F.col("path")))).union(spark.range(1).select(F.lit("absent")))
    return cg.lookup_nodes(keys, nodes)


@query(f"""WITH {_REPO}, {_NAMES}, ie AS (SELECT DISTINCT file, coalesce('file::' || target, 'file::external::' || {_NORM.format('name')}) AS dst FROM res),
rel1 AS (SELECT file, caller AS src, callee AS name FROM calls WHERE caller IN (SELECT id FROM syms)), {_targets('function', 'rel1')},
ce AS (SELECT DISTINCT rel1.src, target AS dst FROM rel1 JOIN found ON rel1.file = found.file AND rel1.name = found.name),
rel2 AS (SELECT file, subclass AS src, parent AS name FROM inh), {_targets('class', 'rel2', '2')},
he AS (SELECT DISTINCT rel2.src, target AS dst FROM rel2 JOIN found2 ON rel2.file = found2.file AND rel2.name = found2.name),
strange AS (SELECT dst FROM ie WHERE starts_with(dst, 'file::external::') UNION SELECT dst FROM ce WHERE starts_with(dst, 'unresolved::') UNION SELECT dst FROM he WHERE starts_with(dst, 'unresolved::'))
SELECT 'import' AS what, count(*) AS n FROM ie UNION ALL SELECT 'call', count(*) FROM ce UNION ALL SELECT 'inheritance', count(*) FROM he UNION ALL SELECT 'file', count(*) FROM files
UNION ALL SELECT kind, count(*) FROM syms GROUP BY kind UNION ALL SELECT 'unresolved', count(*) FROM strange""")
def graph_counts(spark, d):
    nodes, edges = cg.build_graph(files(spark, d), symbols(spark, d), imports(spark, d), calls(spark, d), inherits(spark, d))
    return nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")))


_JAVA = """jf AS (SELECT p_partkey AS k, 'app/src/main/java/com/acme/' || lower(p_type) || '/g' || p_partkey // 20 || '/C' || p_partkey || '.java' AS path, 'com.acme.' || lower(p_type) || '.g' || p_partkey // 20 AS pkg FROM part),
ji AS (SELECT DISTINCT f.path AS file, CASE l_linenumber % 4 WHEN 0 THEN t.pkg || '.*' WHEN 1 THEN t.pkg || '.C' || t.k WHEN 2 THEN 'static ' || t.pkg || '.C' || t.k || '.method' ELSE 'java.util.List' END AS name
  FROM lineitem JOIN jf f ON f.k = l_partkey JOIN jf t ON t.k = l_suppkey)"""


@query(f"""WITH {_JAVA}, pk AS (SELECT pkg, count(*) AS n FROM jf GROUP BY pkg),
star AS (SELECT ji.file, t.path AS target, pk.n - CASE WHEN me.pkg = t.pkg THEN 1 ELSE 0 END AS den FROM ji JOIN jf me ON me.path = ji.file JOIN jf t ON ji.name = t.pkg || '.*' AND t.path <> ji.file JOIN pk ON pk.pkg = t.pkg),
one AS (SELECT DISTINCT ji.file, t.path AS target FROM ji JOIN jf t ON (ji.name = t.pkg || '.C' || t.k OR ji.name = 'static ' || t.pkg || '.C' || t.k || '.method') AND t.path <> ji.file)
SELECT file, target, 1 AS num, 1 AS den FROM one UNION ALL SELECT file, target, count(*), den FROM star GROUP BY file, target, den""")
def java_imports(spark, d):
    k = F.col("p_partkey")
    jf = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("app/src/main/java/com/acme/"), F.lower("p_type"), F.lit("/g"), F.floor(k / 20), F.lit("/C"), k, F.lit(".java")).alias("path"), F.concat(F.lit("com.acme."), F.lower("p_type"), F.lit(".g"), F.floor(k / 20)).alias("pkg"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    j = li.join(jf.select(F.col("k").alias("l_partkey"), F.col("path").alias("file")).hint("merge"), "l_partkey").join(jf.select(F.col("k").alias("l_suppkey"), "k", "pkg").hint("merge"), "l_suppkey")
    c = F.concat("pkg", F.lit(".C"), "k")
    forms = F.array(F.concat("pkg", F.lit(".*")), c, F.concat(F.lit("static "), c, F.lit(".method")), F.lit("java.util.List"))
    return cg.java_imports(j.select("file", F.element_at(forms, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("name")), jf)


#: Folder and ending of a page's file, and how a file names another one, by number.
_JS_PLACES = [("web", ".ts"), ("web", ".js"), ("web/ui", ".tsx"), ("web/ui", "/index.jsx"), ("lib", ".mjs"), ("lib", ".json")]


def _js_sql() -> str:
    place = lambda k: f"CASE {k} % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_JS_PLACES)) + " END"
    end = lambda k: f"CASE {k} % 6 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_JS_PLACES)) + " END"
    return f"""p AS (SELECT page_id AS k, {place('page_id')} AS dir, {place('page_id')} || '/p' || page_id || {end('page_id')} AS path FROM pages),
i AS (SELECT p.k, p.dir, p.path AS file, q.dir || '/p' || q.k AS base, q.path AS target, p.k % 5 AS form, j FROM p, range(1, 4) t(j) JOIN p q ON q.k = p.k + j),
up AS (SELECT *, CASE k % 6 WHEN 2 THEN '../../' WHEN 3 THEN '../../../' ELSE '../' END AS up FROM i)"""


@query(f"""WITH {_js_sql()}, {sql_values('e', list(enumerate(cg.JS_ENDINGS)), 'n, ending')},
w AS (SELECT file, CASE form WHEN 0 THEN up || base WHEN 1 THEN './' || up || 'x/../' || base WHEN 2 THEN up || target WHEN 3 THEN up || base || '/absent' ELSE 'pkg/' || base END AS name, CASE form WHEN 0 THEN base WHEN 1 THEN base WHEN 2 THEN target WHEN 3 THEN base || '/absent' END AS at_ FROM up)
SELECT file, name, arg_min(path, n) AS target FROM (SELECT DISTINCT * FROM w) w, e JOIN p ON p.path = at_ || ending AND p.path <> file GROUP BY file, name""")
def js_imports(spark, d):
    """Every page is a file that names the next three: without ending, by a detour, with its ending, a file below it, or a package."""
    k = F.col("page_id")
    pick = lambda n, at: F.element_at(F.array(*[F.lit(x[at]) for x in _JS_PLACES]), (n % 6 + 1).cast("int"))
    pages = table(spark, d, "pages").select(k.alias("k"), pick(k, 0).alias("dir"), F.concat(pick(k, 0), F.lit("/p"), k, pick(k, 1)).alias("path"))
    up = F.when(F.col("k") % 6 == 2, "../../").when(F.col("k") % 6 == 3, "../../../").otherwise("../")
    q = pages.select(F.col("k").alias("other"), F.concat("dir", F.lit("/p"), "k").alias("base"), F.col("path").alias("target"))
    named = pages.withColumn("other", F.explode(F.array(*[F.col("k") + i for i in (1, 2, 3)]))).join(q, "other")
    forms = [F.concat(up, "base"), F.concat(F.lit("./"), up, F.lit("x/../"), "base"), F.concat(up, "target"), F.concat(up, "base", F.lit("/absent")), F.concat(F.lit("pkg/"), "base")]
    return cg.js_imports(named.select(F.col("path").alias("file"), F.element_at(F.array(*forms), (F.col("k") % 5 + 1).cast("int")).alias("name")), pages.select("path"))


def _decorated(spark, d) -> DataFrame:
    """Symbols with decorators, owners and nesting made from their keys."""
    k = F.substring("id", 2, 20).cast("long")
    deco = F.when(k % 13 == 0, F.array(F.lit("app.command()"))).when(k % 17 == 0, F.array(F.lit("x"), F.lit("router.get('/a')"))).otherwise(F.array().cast("array<string>"))
    name = F.when(k % 29 == 0, F.lit("main")).when(k % 19 == 0, F.concat(F.lit("_"), "name")).otherwise(F.col("name"))
    return symbols(spark, d).withColumns({"decorators": deco, "owner": F.when(k % 6 == 0, F.lit("Box")), "nested": k % 23 == 0, "name": name})


@query(f"""WITH {_REPO}, s AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM syms WHERE kind = 'function'),
f AS (SELECT id, file, k, CASE WHEN k % 29 = 0 THEN 'main' WHEN k % 19 = 0 THEN '_' || name ELSE name END AS name, CASE WHEN k % 6 = 0 THEN 'Box' END AS owner FROM s WHERE k % 23 <> 0),
b AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'cli-command' WHEN k % 17 = 0 THEN 'api-route' WHEN id NOT IN (SELECT 's' || o_custkey FROM orders) THEN 'function' END AS base FROM f WHERE NOT starts_with(name, '_'))
SELECT id, file || '::' || coalesce(owner, 'module') || '::' || name AS stable_key, CASE WHEN base = 'function' AND name = 'main' THEN 'main' ELSE base END AS kind,
regexp_extract(file, '([^/]*)[.]py$', 1) || coalesce('.' || owner, '') || '.' || name AS use_case, CASE base WHEN 'cli-command' THEN 'CLI' WHEN 'api-route' THEN 'API' ELSE 'External Caller' END AS actor FROM b WHERE base IS NOT NULL""")
def entry_points_anti(spark, d):
    called = table(spark, d, "orders").select(F.concat(F.lit("s"), "o_custkey").alias("dst"))
    return cg.entry_points(_decorated(spark, d), called, files(spark, d)).drop("file")


@query(f"WITH {_REPO}, {_NAMES}, e AS (SELECT DISTINCT file AS src, target AS dst FROM res WHERE target IS NOT NULL), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, dst AS other, regexp_extract(dst, '([^/]*)[.]py$', 1) AS name, row_number() OVER (PARTITION BY src ORDER BY regexp_extract(dst, '([^/]*)[.]py$', 1), dst) AS position FROM b")
def related_modules(spark, d):
    e = cg.resolve_imports(imports(spark, d), files(spark, d)).where("target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst"))
    return cg.related_modules(e, files(spark, d).select(F.col("path").alias("id"), cg.stem(F.col("path")).alias("name")))


@query(f"""WITH {_REPO}, nodes AS (SELECT id, kind, name, file FROM syms), edges AS (SELECT DISTINCT 's' || o_custkey AS src, 's' || (o_orderkey * 3) % nc AS dst FROM orders, nc),
ch AS (SELECT path AS file FROM files WHERE k % 9 = 0), gone AS (SELECT * FROM nodes WHERE file IN (SELECT file FROM ch)), fresh AS (SELECT id || 'n' AS id, kind, name, file FROM gone WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 1),
lft AS (SELECT * FROM nodes WHERE file NOT IN (SELECT file FROM ch) UNION ALL SELECT * FROM fresh), uq AS (SELECT name, kind, min(id) AS id FROM lft GROUP BY name, kind HAVING count(DISTINCT id) = 1),
aft AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION SELECT src, uq.id FROM edges JOIN gone ON dst = gone.id JOIN uq ON uq.name = gone.name AND uq.kind = gone.kind WHERE src NOT IN (SELECT id FROM gone))
SELECT src, dst, 'removed' AS side FROM (SELECT * FROM edges EXCEPT SELECT * FROM aft) UNION ALL SELECT src, dst, 'added' FROM (SELECT * FROM aft EXCEPT SELECT * FROM edges)""")
def graph_sync(spark, d):
    n = table(spark, d, "customer").count()
    nodes = symbols(spark, d)
    edges = table(spark, d, "orders").select(F.concat(F.lit("s"), "o_custkey").alias("src"), F.concat(F.lit("s"), (F.col("o_orderkey") * 3) % n).alias("dst"), F.lit("call").alias("type")).distinct()
    changed = files(spark, d).where("k % 9 = 0").select(F.col("path").alias("file"))
    fresh = nodes.join(changed, "file", "left_semi").where(F.substring("id", 2, 20).cast("long") % 2 == 1).withColumn("id", F.concat("id", F.lit("n"))).select(nodes.columns)
    return cg.sync_graph(nodes, edges, changed, fresh, edges.limit(0))[2].select("src", "dst", "side")


_TEXTS = "CASE k % 6 WHEN 0 THEN path WHEN 1 THEN name || '.py' WHEN 2 THEN name WHEN 3 THEN path || ' :: file::' || path WHEN 4 THEN path || ' :: gone' ELSE 'fn-' || k % 40 END"


@query(f"""WITH {_REPO}, en AS (SELECT k AS seq, 'file::' || path AS id, 'module' AS kind, name, path AS file FROM files UNION ALL SELECT 10000000 + CAST(substr(id, 2) AS BIGINT), id, kind, name, file FROM syms),
m AS (SELECT DISTINCT {_TEXTS} AS t, path AS cur FROM files), nm AS (SELECT name, count(*) AS n, min(id) AS id FROM en GROUP BY name), own AS (SELECT name, file, count(*) AS n, min(id) AS id FROM en GROUP BY name, file),
sf AS (SELECT substr(path, strpos(path, '/') + 1) AS tail, count(*) AS n, min('file::' || path) AS id FROM files GROUP BY 1)
SELECT t AS text, cur AS current, coalesce(CASE WHEN contains(t, ' :: ') THEN coalesce(i.id, 'file::' || pp.path) END, 'file::' || p.path, CASE WHEN sf.n = 1 THEN sf.id END, CASE WHEN nm.n = 1 THEN nm.id END, CASE WHEN own.n = 1 THEN own.id END) AS id
FROM m LEFT JOIN en i ON i.id = split_part(t, ' :: ', 2) LEFT JOIN files pp ON pp.path = split_part(t, ' :: ', 1) AND contains(t, ' :: ') LEFT JOIN files p ON p.path = t LEFT JOIN sf ON sf.tail = t LEFT JOIN nm ON nm.name = t LEFT JOIN own ON own.name = t AND own.file = cur""")
def mention_cascade(spark, d):
    f = files(spark, d)
    name, k, p = cg.stem(F.col("path")), F.col("k"), F.col("path")
    forms = F.array(p, F.concat(name, F.lit(".py")), name, F.concat(p, F.lit(" :: file::"), p), F.concat(p, F.lit(" :: gone")), F.concat(F.lit("fn-"), k % 40))
    mentions = f.select(F.element_at(forms, (k % 6 + 1).cast("int")).alias("text"), p.alias("current"))
    s = symbols(spark, d).select((F.lit(10000000) + F.substring("id", 2, 20).cast("long")).alias("seq"), "id", "kind", "name", "file")
    return cg.resolve_mentions(mentions, f.select(k.alias("seq"), cg.file_id(p).alias("id"), F.lit("module").alias("kind"), name.alias("name"), p.alias("file")).unionByName(s))


@query(f"""WITH {_REPO}, s AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM syms), o AS (SELECT id, kind, file, CASE WHEN k % 29 = 0 THEN 'main' WHEN k % 19 = 0 THEN '_' || name ELSE name END AS name, CASE WHEN k % 6 = 0 THEN 'Box' END AS owner, k % 23 = 0 AS nested FROM s)
SELECT name, 'module' AS kind, 'file::' || path AS id FROM files UNION ALL SELECT CASE WHEN owner IS NOT NULL THEN owner || '.' || name ELSE name END, CASE WHEN kind = 'class' THEN 'class' WHEN owner IS NOT NULL THEN 'method' ELSE 'function' END, id FROM o WHERE kind = 'class' OR owner IS NOT NULL OR NOT nested""")
def search_index_rows(spark, d):
    return cg.search_entries(files(spark, d), _decorated(spark, d)).select("name", "kind", "id")


#: Import lines with a name in them and the names they import, by number.
_IMPORT_FORMS = [("import {{ a }} from './{x}';", "./{x}"), ("from .{x} import y", ".{x}"), ("import {x}, sys", "{x}|sys"), ("import {x}.b as c", "{x}.b"), ("use std::{x} as io;", "std::{x}"), ("extern crate {x};", "{x}"), ("require lib/{x}", "lib/{x}"), ("import ({x})", "{x}"), ("", "")]


def _form_sql(at: int) -> str:
    return "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN replace('" + f[at].format(x="{x}").replace("'", "''") + "', '{x}', x)" for i, f in enumerate(_IMPORT_FORMS)) + " END"


@query(f"WITH p AS (SELECT p_partkey, 'n' || p_partkey || '_' || lower(split_part(p_name, ' ', 1)) AS x FROM part) SELECT p_partkey, {_form_sql(0)} AS text, {_form_sql(1)} AS names FROM p")
def import_names(spark, d):
    """A line of one form or another for each part."""
    k = F.col("p_partkey")
    x = F.concat(F.lit("n"), k, F.lit("_"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))
    line = F.element_at(F.array(*[F.lit(f.format(x="{x}")) for f, _ in _IMPORT_FORMS]), (k % 9 + 1).cast("int"))
    lines = table(spark, d, "part").select("p_partkey", F.replace(line, F.lit("{x}"), x).alias("text"))
    return lines.select("p_partkey", "text", F.array_join(cg.import_candidates(F.col("text")), "|").alias("names"))


@query(f"""WITH {_REPO}, s AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM syms), o AS (SELECT id, kind, file, CASE WHEN k % 19 = 0 THEN '_' || name ELSE name END AS name, k % 23 = 0 AS nested, k FROM s)
SELECT id FROM o WHERE kind = 'class' OR (NOT nested AND NOT starts_with(CASE WHEN k % 29 = 0 THEN 'main' ELSE name END, '_')) UNION ALL SELECT 'file::' || path FROM files""")
def in_scope_symbols(spark, d):
    s = _decorated(spark, d)
    public = s.where("kind = 'class' or (not nested and name not like '\\\\_%')").select("id")
    return public.unionByName(files(spark, d).select(cg.file_id(F.col("path")).alias("id")))


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, CASE WHEN l_linenumber = 7 THEN 'unresolved::function::x' WHEN l_linenumber = 6 THEN 'file::external::y' ELSE 'p' || l_partkey END AS b FROM lineitem)
SELECT a AS id, count(*) AS n FROM e WHERE NOT starts_with(b, 'unresolved::') AND NOT starts_with(b, 'file::external::') GROUP BY a""")
def placeholder_exclusion(spark, d):
    n = F.col("l_linenumber")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("id"), F.when(n == 7, "unresolved::function::x").when(n == 6, "file::external::y").otherwise(F.concat(F.lit("p"), "l_partkey")).alias("b")).distinct()
    return e.where(~tx.is_placeholder(F.col("b"))).groupBy("id").agg(F.count("*").alias("n"))
