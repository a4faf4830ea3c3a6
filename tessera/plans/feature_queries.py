"""Queries of feature grouping: customers are modules, nations their folders, orders couple them, suppliers are entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering as cl
from ..operators import features as ft
from ..session import table
from .registry import query

_BASE = """
mods AS (SELECT 'c' || c_custkey AS key, 'name' || c_custkey % 50 AS name, CASE WHEN c_custkey % 9 = 0 THEN 'tests/' ELSE '' END || 'r' || c_nationkey % 5 || '/n' || c_nationkey || '/name' || c_custkey % 50 || CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.md' END AS path,
  CASE WHEN c_custkey % 9 = 0 THEN 'tests/' ELSE '' END || 'r' || c_nationkey % 5 || '/n' || c_nationkey AS dir, c_custkey AS k, c_nationkey AS nat FROM customer),
nc AS (SELECT count(*) AS nc FROM customer),
imp AS (SELECT 'c' || o_custkey AS src, 'c' || (o_orderkey * 7) % nc AS dst, CAST(count(*) AS BIGINT) AS w FROM orders, nc WHERE o_custkey <> (o_orderkey * 7) % nc GROUP BY 1, 2),
adj AS (SELECT a, b, CAST(sum(w) AS BIGINT) AS w FROM (SELECT src AS a, dst AS b, w FROM imp UNION ALL SELECT dst, src, w FROM imp) GROUP BY a, b),
pts AS (SELECT 's' || s_suppkey AS point, 'c' || (s_suppkey * 3) % nc AS key, CASE s_suppkey % 4 WHEN 0 THEN 'cli-command' WHEN 1 THEN 'main' ELSE 'function' END AS kind FROM supplier, nc),
rch AS (SELECT DISTINCT 's' || l_suppkey AS point, 'c' || l_partkey % nc AS key FROM lineitem, nc),
mem AS (SELECT 'f' || nat AS feature, key FROM mods),
ev AS (SELECT m.key, m.name, m.k % 9 = 0 AS is_test, CASE WHEN m.k % 9 = 0 THEN 0 ELSE coalesce(p.n, 0) END AS n_points, m.k % 9 <> 0 AND coalesce(p.e, false) AS is_entry, m.k % 9 <> 0 AND p.n IS NOT NULL AS is_seed
  FROM mods m LEFT JOIN (SELECT key, count(*) AS n, bool_or(kind <> 'function') AS e FROM pts GROUP BY key) p USING (key)),
ro AS (SELECT p.key, count(DISTINCT r.key) AS reach FROM pts p LEFT JOIN rch r USING (point) GROUP BY p.key),
deg AS (SELECT x.feature, x.key, coalesce(CAST(sum(w) AS BIGINT), 0) AS degree FROM mem x LEFT JOIN (SELECT a, b, w, m.feature AS fb FROM adj JOIN mem m ON m.key = b) e ON e.a = x.key AND e.fb = x.feature GROUP BY x.feature, x.key)"""


def _n(spark, d) -> int:
    return table(spark, d, "customer").count()


def modules(spark, d) -> DataFrame:
    k, nat = F.col("c_custkey"), F.col("c_nationkey")
    folder = F.concat(F.when(k % 9 == 0, "tests/").otherwise(""), F.lit("r"), nat % 5, F.lit("/n"), nat)
    name = F.concat(F.lit("name"), k % 50)
    return table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("key"), name.alias("name"), F.concat(folder, F.lit("/"), name, F.when(k % 2 == 0, ".py").otherwise(".md")).alias("path"), folder.alias("dir"), nat.alias("nat"))


def imports(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), (F.col("o_orderkey") * 7) % _n(spark, d)).alias("dst"))
    return o.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def adjacency(spark, d) -> DataFrame:
    return cl.adjacency(imports(spark, d))


def points(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "cli-command").when(k % 4 == 1, "main").otherwise("function")
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("point"), F.concat(F.lit("c"), (k * 3) % _n(spark, d)).alias("key"), kind.alias("kind"))


def reach(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("point"), F.concat(F.lit("c"), F.col("l_partkey") % _n(spark, d)).alias("key")).distinct()


def members(spark, d) -> DataFrame:
    return modules(spark, d).select(F.concat(F.lit("f"), "nat").alias("feature"), "key")


def evidence(spark, d) -> DataFrame:
    exported = modules(spark, d).select("key", F.col("name").alias("symbol"))
    return ft.module_evidence(modules(spark, d), points(spark, d), reach(spark, d), exported)


@query(f"WITH {_BASE} SELECT a, b, w FROM adj")
def adjacency_weights(spark, d):
    return adjacency(spark, d)


_SEEDS = "l0 AS (SELECT key AS node, 'f' || nat AS label FROM mods WHERE k % 10 = 0)"


def _sweep(i: int) -> str:
    return f"""v{i} AS (SELECT a, label, sum(w) AS w FROM adj JOIN l{i - 1} ON b = node GROUP BY a, label), w{i} AS (SELECT a AS node, label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, label) AS r FROM v{i}) WHERE r = 1),
l{i} AS (SELECT * FROM l0 UNION ALL SELECT * FROM w{i} WHERE node NOT IN (SELECT node FROM l0))"""


@query(f"WITH {_BASE}, {_SEEDS}, {_sweep(1)}, {_sweep(2)} SELECT node, label FROM l2")
def label_propagation_2(spark, d):
    seeds = modules(spark, d).where(F.substring("key", 2, 20).cast("long") % 10 == 0).select(F.col("key").alias("node"), F.concat(F.lit("f"), "nat").alias("label"))
    return cl.propagate(adjacency(spark, d), seeds)


@query(f"""WITH {_BASE}, sm AS (SELECT k, key AS member, dir || CASE WHEN k % 37 = 0 THEN '/deep/x' || k WHEN k % 41 = 0 THEN '/low' || k ELSE '' END AS dir FROM mods), sz AS (SELECT dir, count(*) AS n FROM sm GROUP BY dir),
small AS (SELECT dir FROM sz WHERE n < 2), cadj AS (SELECT a, b, w FROM adj WHERE CAST(substr(a, 2) AS BIGINT) % 41 <> 0),
cp AS (SELECT x.dir, y.dir AS target, sum(w) AS w FROM cadj JOIN sm x ON x.member = a JOIN sm y ON y.member = b WHERE x.dir IN (SELECT dir FROM small) AND y.dir NOT IN (SELECT dir FROM small) GROUP BY x.dir, y.dir),
c1 AS (SELECT dir, target FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY w DESC, target) AS r FROM cp) WHERE r = 1),
an AS (SELECT s.dir, z.dir AS target, row_number() OVER (PARTITION BY s.dir ORDER BY length(z.dir) DESC) AS r FROM small s JOIN sz z ON z.n >= 2 AND starts_with(s.dir, z.dir || '/'))
SELECT member, coalesce(c1.target, an.target, sm.dir) AS dir FROM sm LEFT JOIN c1 ON c1.dir = sm.dir LEFT JOIN an ON an.dir = sm.dir AND an.r = 1""")
def directory_absorb(spark, d):
    k = F.substring("key", 2, 20).cast("long")
    deep = F.when(k % 37 == 0, F.concat(F.lit("/deep/x"), k)).when(k % 41 == 0, F.concat(F.lit("/low"), k)).otherwise("")
    m = modules(spark, d).select(F.col("key").alias("member"), F.concat("dir", deep).alias("dir"))
    return cl.absorb_small(m, adjacency(spark, d).where(F.substring("a", 2, 20).cast("long") % 41 != 0))


@query(f"""WITH {_BASE}, o AS (SELECT feature, key, row_number() OVER (PARTITION BY feature ORDER BY tier, CASE WHEN tier < 2 THEN -n_points ELSE 0 END, CASE WHEN tier < 2 THEN -coalesce(reach, 0) ELSE -degree END, name, key) AS r
FROM (SELECT d.*, e.name, e.n_points, ro.reach, CASE WHEN is_entry THEN 0 WHEN is_seed THEN 1 WHEN NOT is_test THEN 2 ELSE 3 END AS tier FROM deg d JOIN ev e USING (key) LEFT JOIN ro USING (key)))
SELECT feature, key AS anchor FROM o WHERE r = 1""")
def group_anchor(spark, d):
    return ft.feature_anchors(members(spark, d), evidence(spark, d), ft.reach_of(points(spark, d), reach(spark, d)), adjacency(spark, d))


@query(f"WITH {_BASE} SELECT key, reach FROM ro")
def entry_reach(spark, d):
    return ft.reach_of(points(spark, d), reach(spark, d))


@query(f"""WITH {_BASE}, rb AS (SELECT key, string_agg(point, ',' ORDER BY point) AS reached_by FROM rch GROUP BY key)
SELECT e.key, coalesce(reached_by, '') AS reached_by, name AS exports, is_test, CAST(n_points AS BIGINT) AS n_points, is_entry, is_seed FROM ev e LEFT JOIN rb USING (key)""")
def module_evidence(spark, d):
    e = evidence(spark, d)
    return e.select("key", F.array_join("reached_by", ",").alias("reached_by"), F.array_join("exports", ",").alias("exports"), "is_test", "n_points", "is_entry", "is_seed")


@query(f"WITH {_BASE} SELECT feature, CAST(sum(n_points) AS BIGINT) AS n_points FROM mem JOIN ev USING (key) GROUP BY feature")
def entry_points_per_group(spark, d):
    return members(spark, d).join(evidence(spark, d), "key").groupBy("feature").agg(F.sum("n_points").alias("n_points"))


@query(f"""WITH {_BASE}, sd AS (SELECT feature, min(key) AS seed FROM mem JOIN ev USING (key) WHERE is_seed GROUP BY feature),
cw AS (SELECT x.feature, a AS key, sum(w) AS w FROM adj JOIN mem x ON x.key = a JOIN mem y ON y.key = b AND y.feature = x.feature JOIN ev e ON e.key = b AND NOT e.is_test GROUP BY x.feature, a)
SELECT feature, key, row_number() OVER (PARTITION BY feature ORDER BY coalesce(key <> seed, true), is_test, CASE WHEN is_test THEN 0 ELSE -n_points END, -coalesce(w, 0), name, key) AS position
FROM mem JOIN ev USING (key) LEFT JOIN sd USING (feature) LEFT JOIN cw USING (feature, key)""")
def relevance_order(spark, d):
    e, m = evidence(spark, d), members(spark, d)
    seeds = m.join(e.where("is_seed").select("key"), "key").groupBy("feature").agg(F.min("key").alias("seed"))
    return ft.by_relevance(m, seeds, e, adjacency(spark, d))


@query(f"""WITH {_BASE}, v AS (SELECT a, feature, sum(w) AS w FROM adj JOIN ev t ON t.key = a AND t.is_test JOIN ev p ON p.key = b AND NOT p.is_test JOIN mem ON mem.key = b GROUP BY a, feature),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, feature) AS r FROM v) SELECT key, feature FROM ev LEFT JOIN (SELECT * FROM r WHERE r = 1) ON a = key WHERE is_test""")
def test_placement(spark, d):
    e = evidence(spark, d)
    production = members(spark, d).join(e.where("not is_test").select("key"), "key")
    return ft.place_tests(e.where("is_test").select("key"), production, adjacency(spark, d))


@query(f"WITH {_BASE}, n AS (SELECT 'g' || nat % 7 AS feature, dir, count(*) AS n FROM mods GROUP BY 1, 2) SELECT feature, dir FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, dir) AS r FROM n) WHERE r = 1")
def modal_directory(spark, d):
    return ft.modal_directory(modules(spark, d).select(F.concat(F.lit("g"), F.col("nat") % 7).alias("feature"), "dir"))


@query(f"""WITH {_BASE}, x AS (SELECT feature, key FROM mem WHERE CAST(substr(key, 2) AS BIGINT) % 50 <> 1 UNION ALL SELECT 'again', key FROM mods WHERE k % 100 = 2), g AS (SELECT key, count(DISTINCT feature) AS f, count(*) AS n FROM x GROUP BY key)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (f > 1) AS shared, (SELECT count(*) FROM mods WHERE key NOT IN (SELECT key FROM x)) AS unplaced FROM g""")
def partition_invariant(spark, d):
    k = F.substring("key", 2, 20).cast("long")
    m = members(spark, d).where(k % 50 != 1).unionByName(modules(spark, d).where(k % 100 == 2).select(F.lit("again").alias("feature"), "key"))
    return ft.partition_invariant(m, modules(spark, d).select("key"))


@query(f"WITH {_BASE} SELECT DISTINCT x.feature, CASE WHEN x.feature = y.feature THEN least(a, b) END AS a, CASE WHEN x.feature = y.feature THEN greatest(a, b) END AS b, CASE WHEN x.feature <> y.feature THEN y.feature END AS other FROM adj JOIN mem x ON x.key = a JOIN mem y ON y.key = b")
def feature_edges(spark, d):
    inner, outer = ft.feature_edges(members(spark, d), adjacency(spark, d))
    none = F.lit(None).cast("string")
    return inner.withColumn("other", none).unionByName(outer.select("feature", none.alias("a"), none.alias("b"), "other"))


_FEATURES = """ftab AS (SELECT s_nationkey AS repo, 'f' || s_suppkey AS key, s_name AS title, CASE s_suppkey % 5 WHEN 0 THEN 'tooling' WHEN 1 THEN 'overview' WHEN 2 THEN 'odd' WHEN 3 THEN 'capability' ELSE 'subsystem' END AS kind, s_suppkey % 4 AS n_points FROM supplier),
nav AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE kind WHEN 'overview' THEN 1 WHEN 'capability' THEN 2 WHEN 'tooling' THEN 4 ELSE 3 END, n_points DESC, title, key) AS position FROM ftab)"""


def _features(spark, d) -> DataFrame:
    """Suppliers are features, nations their repositories."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ["tooling", "overview", "odd", "capability", "subsystem"])), (k % 5 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("repo"), F.concat(F.lit("f"), k).alias("key"), F.col("s_name").alias("title"), kind.alias("kind"), (k % 4).alias("n_points"))


@query(f"WITH {_FEATURES} SELECT repo, position, key, title, kind FROM nav")
def navigation_order(spark, d):
    return ft.navigation(_features(spark, d), "repo").select("repo", "position", "key", "title", "kind")


@query(f"WITH {_FEATURES}, p AS (SELECT *, position <= 12 AS prompted FROM nav), m AS (SELECT key, row_number() OVER (PARTITION BY repo ORDER BY position) AS m FROM p WHERE prompted AND kind <> 'tooling' AND n_points <> 2) SELECT repo, position, p.key, prompted, coalesce(m <= 8, false) AS major FROM p LEFT JOIN m USING (key)")
def overview_caps(spark, d):
    return ft.overview_caps(ft.navigation(_features(spark, d), "repo").withColumn("prose_or_tests", F.col("n_points") == 2), repository="repo")


@query(f"""WITH {_BASE}, dep AS (SELECT point, key, 1 + CAST(substr(key, 2) AS BIGINT) % 4 AS depth FROM rch), hd AS (SELECT 'f' || n_nationkey AS feature, n_nationkey AS handle FROM nation),
own AS (SELECT point, kind, feature FROM pts LEFT JOIN mem USING (key)), nm AS (SELECT point, count(DISTINCT key) AS n FROM dep GROUP BY point),
nr AS (SELECT d.point, m.feature AS other, handle, min(depth) AS depth FROM dep d JOIN mem m USING (key) JOIN own o ON o.point = d.point JOIN hd ON hd.feature = m.feature WHERE m.feature <> o.feature GROUP BY d.point, m.feature, handle),
ls AS (SELECT point, string_agg(other, ',' ORDER BY depth, handle) AS reached FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY depth, handle) AS r FROM nr) WHERE r <= 5 GROUP BY point)
SELECT row_number() OVER (ORDER BY CASE WHEN kind = 'function' THEN 1 ELSE 0 END, coalesce(n, 0) DESC, own.point) AS position, own.point, kind, feature, coalesce(reached, '') AS reached FROM own LEFT JOIN nm USING (point) LEFT JOIN ls USING (point) ORDER BY position LIMIT 6""")
def entry_flows(spark, d):
    depths = reach(spark, d).withColumn("depth", 1 + F.substring("key", 2, 20).cast("long") % 4)
    handles = table(spark, d, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("feature"), F.col("n_nationkey").alias("handle"))
    return ft.entry_flows(points(spark, d), depths, members(spark, d), handles).withColumn("reached", F.array_join("reached", ","))


@query(f"""WITH {_BASE}, inh AS (SELECT 'c' || s_suppkey AS src, 'c' || s_suppkey + 5 AS dst FROM supplier WHERE s_suppkey % 4 = 0), pr AS (SELECT src AS id FROM inh UNION SELECT dst FROM inh),
dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM imp UNION ALL SELECT dst FROM imp) GROUP BY id),
x AS (SELECT m.key AS id, m.name, pr.id IS NOT NULL AS in_inheritance, coalesce(degree, 0) AS degree FROM mods m LEFT JOIN pr ON pr.id = m.key LEFT JOIN dg ON dg.id = m.key)
SELECT id, name, in_inheritance, degree FROM x ORDER BY in_inheritance DESC, degree DESC, name, id LIMIT 40""")
def major_classes(spark, d):
    k = F.col("s_suppkey")
    inh = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("c"), k).alias("src"), F.concat(F.lit("c"), k + 5).alias("dst"))
    return ft.major_classes(modules(spark, d).select(F.col("key").alias("id"), "name"), inh, imports(spark, d))


@query(f"WITH {_BASE} SELECT feature, key, position FROM (SELECT feature, key, row_number() OVER (PARTITION BY feature ORDER BY degree DESC, key) AS position FROM deg) WHERE position <= 24")
def diagram_members(spark, d):
    return ft.diagram_members(members(spark, d), adjacency(spark, d))


@query(f"WITH {_BASE}, pg AS (SELECT 'page' || k % 40 AS page, key FROM mods WHERE k % 40 <> 0 UNION ALL SELECT 'page0', 'gone' || k FROM mods), t AS (SELECT page, feature, count(*) AS n FROM pg JOIN mem USING (key) GROUP BY page, feature) SELECT page, feature FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, feature) AS r FROM t) WHERE r = 1")
def superseded_pages(spark, d):
    k = F.substring("key", 2, 20).cast("long")
    m = modules(spark, d)
    pages = m.where(k % 40 != 0).select(F.concat(F.lit("page"), k % 40).alias("page"), "key").unionByName(m.select(F.lit("page0").alias("page"), F.concat(F.lit("gone"), k).alias("key")))
    return ft.superseded_pages(pages, members(spark, d))


@query(r"""WITH p AS (SELECT 'm' || p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'solo' || p_partkey ELSE '__init__' END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'a/solo' || p_partkey || '.py' WHEN p_partkey % 5 = 0 THEN 'z' || p_partkey // 10 || '/x/__init__' || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.md' END ELSE 'k' || p_partkey || '/' || p_brand || '/__init__.py' END AS path FROM part),
b AS (SELECT *, regexp_replace(path, '[.][^./]*$', '') AS bare, count(*) OVER (PARTITION BY name) AS n FROM p),
t AS (SELECT key, name, array_to_string(list_slice(string_split(bare, '/'), i, len(string_split(bare, '/'))), '/') AS tail FROM (SELECT key, name, bare, unnest(range(1, len(string_split(bare, '/')) + 1)) AS i FROM b WHERE n > 1)),
f AS (SELECT min(key) AS key, tail FROM t GROUP BY name, tail HAVING count(*) = 1), s AS (SELECT key, arg_min(tail, length(tail)) AS tail FROM f GROUP BY key),
l AS (SELECT b.key, path, CASE WHEN n = 1 THEN name ELSE coalesce(tail, bare) END AS label FROM b LEFT JOIN s USING (key))
SELECT key, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN path ELSE label END AS label FROM l""")
def labels_disambiguated(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 7 == 0, F.concat(F.lit("a/solo"), k, F.lit(".py"))).when(k % 5 == 0, F.concat(F.lit("z"), F.floor(k / 10), F.lit("/x/__init__"), F.when(k % 2 == 0, ".py").otherwise(".md"))).otherwise(F.concat(F.lit("k"), k, F.lit("/"), "p_brand", F.lit("/__init__.py")))
    p = table(spark, d, "part").select(F.concat(F.lit("m"), k).alias("key"), F.when(k % 7 == 0, F.concat(F.lit("solo"), k)).otherwise("__init__").alias("name"), path.alias("path"))
    return ft.disambiguated_labels(p)


_PLAN = """cand AS (SELECT n_nationkey AS handle, CASE WHEN n_nationkey % 8 = 6 THEN 'Same Title' WHEN n_nationkey = 7 THEN repeat('x', 61) ELSE 'Seed ' || n_nationkey END AS title FROM nation),
plan AS (SELECT r_regionkey AS ordinal, CASE r_regionkey WHEN 2 THEN '  ' WHEN 4 THEN upper(r0) ELSE r_name END AS title, CASE WHEN r_regionkey = 0 THEN ' Capability ' ELSE 'strange' END AS kind FROM region, (SELECT r_name AS r0 FROM region WHERE r_regionkey = 1)),
claims AS (SELECT n_regionkey AS ordinal, n_nationkey AS handle FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL SELECT (n_regionkey + 1) % 5, n_nationkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 1, 100)"""


@query(f"""WITH {_PLAN}, fair AS (SELECT ordinal, trim(title) AS title, lower(trim(kind)) AS kind FROM plan WHERE trim(title) <> '' AND length(trim(title)) <= 60), kn AS (SELECT * FROM claims WHERE handle IN (SELECT handle FROM cand)),
w1 AS (SELECT handle, min(ordinal) AS ordinal FROM kn WHERE ordinal IN (SELECT ordinal FROM fair) GROUP BY handle),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY ordinal) AS r FROM fair WHERE ordinal IN (SELECT ordinal FROM w1)) WHERE r = 1),
w2 AS (SELECT handle, min(ordinal) AS ordinal FROM kn WHERE ordinal IN (SELECT ordinal FROM one) GROUP BY handle),
pl AS (SELECT handle, title AS feature, CASE WHEN kind IN ('overview', 'capability', 'subsystem', 'tooling') THEN kind ELSE 'subsystem' END AS kind, true AS planned FROM w2 JOIN one USING (ordinal)),
fr AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY handle) = 1 AND length(title) <= 60 AS alone FROM cand WHERE handle NOT IN (SELECT handle FROM pl))
SELECT * FROM pl UNION ALL SELECT handle, CASE WHEN alone THEN title ELSE 'Support & Utilities' END, CASE WHEN alone THEN 'subsystem' ELSE 'tooling' END, false FROM fr""")
def plan_repair(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k, g = F.col("n_nationkey"), F.col("n_regionkey")
    cand = n.select(k.alias("handle"), F.when(k % 8 == 6, "Same Title").when(k == 7, "x" * 61).otherwise(F.concat(F.lit("Seed "), k)).alias("title"))
    one = r.where("r_regionkey = 1").select(F.upper("r_name").alias("r0"))
    o = F.col("r_regionkey")
    plan = r.crossJoin(one).select(o.alias("ordinal"), F.when(o == 2, "  ").when(o == 4, F.col("r0")).otherwise(F.col("r_name")).alias("title"), F.when(o == 0, " Capability ").otherwise("strange").alias("kind"))
    claims = n.where(k % 4 != 3).select(g.alias("ordinal"), k.alias("handle")).unionByName(n.where(k % 3 == 0).select(((g + 1) % 5).alias("ordinal"), k.alias("handle"))).unionByName(spark.range(1).select(F.lit(1).alias("ordinal"), F.lit(100).alias("handle")))
    return ft.repair_plan(plan, claims, cand)


@query()
def fold_groups(spark, d):
    m = modules(spark, d).join(evidence(spark, d).select("key", "is_entry"), "key")
    k = F.substring("key", 2, 20).cast("long")
    rows = m.select(F.concat(F.lit("repo"), F.col("nat") % 5).alias("repo"), F.when(k % 4 == 0, F.col("key")).otherwise(F.concat(F.lit("g"), "nat")).alias("group"), "key", "dir", "is_entry")
    a = adjacency(spark, d).join(rows.select(F.col("key").alias("a"), "repo"), "a").join(rows.select(F.col("key").alias("b"), F.col("repo").alias("rb")), "b").where("repo = rb").select("repo", "a", "b", "w")
    return ft.fold(rows, a)


@query()
def group_communities(spark, d):
    return cl.communities(adjacency(spark, d), modules(spark, d).select(F.col("key").alias("member"), F.col("dir").alias("group")))


#: What follows a paragraph's letters, by number; SRC is the document's source, which is known.
_ENDS = [" and nothing", " and/or `SRC`", " `no SRC`", " [[ f1 ]] `SRC`", " [[f99]] `SRC`", " lone ` tick", " uses some_name in `SRC`", " CamelCase by `SRC`", " for your `SRC`", " run_all() is robust `no SRC`", " One. Two, e.g. Three. Four? Five with `SRC`", ""]
_G = "SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, doc_id AS doc, source FROM documents"
_STYLE = r"\b(" + "|".join([*ft.ADDRESS, *sorted(ft.PRAISE, key=len, reverse=True)]) + r")\b"


@query(rf"""WITH l AS (SELECT *, (doc * 7 + idx) % 12 AS k, trim(regexp_replace(lower(line), '[^a-z]+', ' ', 'g')) AS base FROM ({_G})),
a AS (SELECT doc, idx, k, base, CASE WHEN idx % 3 = 2 THEN 'subsystem' ELSE 'lead' END AS section, regexp_matches(base, '{_STYLE}') AS styled, len(string_split(base, ' ')) - CASE WHEN base = '' THEN 1 ELSE 0 END AS n FROM l),
v AS (SELECT *, CASE WHEN k = 11 THEN 'G1' WHEN k = 5 THEN 'G2' WHEN k IN (6, 7, 9) THEN 'G5' WHEN styled OR k = 8 THEN 'G6' WHEN k = 4 THEN 'G3' WHEN k = 2 THEN 'G4' WHEN k = 0 THEN 'G7' WHEN k = 10 AND section = 'subsystem' THEN 'G8' END AS v1, n + CASE k WHEN 10 THEN 8 WHEN 3 THEN 4 ELSE 2 END AS words FROM a),
c AS (SELECT *, CASE WHEN v1 IS NULL AND section = 'lead' AND count(*) FILTER (v1 IS NULL) OVER (PARTITION BY doc, section ORDER BY idx) > 4 THEN 'G9' ELSE v1 END AS v2 FROM v),
s AS (SELECT *, CASE WHEN v2 IS NULL AND sum(CASE WHEN v2 IS NULL THEN words ELSE 0 END) OVER (PARTITION BY doc ORDER BY section <> 'lead', idx) >= 720 THEN 'G9' ELSE v2 END AS v3 FROM c)
SELECT doc, section, CAST(idx AS INTEGER) AS idx, coalesce(v3, CASE WHEN section = 'lead' AND bool_or(section = 'lead' AND idx = 0 AND v3 IS NOT NULL) OVER (PARTITION BY doc) THEN 'G10' ELSE 'kept' END) AS verdict FROM s""")
def grounding_rules(spark, d):
    """Every line of every document is a paragraph: its letters, and an end that keeps a rule or breaks one."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("doc"), "source", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    end = F.replace(F.element_at(F.array(*map(F.lit, _ENDS)), ((F.col("doc") * 7 + F.col("idx")) % 12 + 1).cast("int")), F.lit("SRC"), F.col("source"))
    text = F.when((F.col("doc") * 7 + F.col("idx")) % 12 == 11, " ").otherwise(F.concat(F.regexp_replace(F.lower("line"), "[^a-z]+", " "), end))
    p = lines.select("doc", F.when(F.col("idx") % 3 == 2, "subsystem").otherwise("lead").alias("section"), "idx", text.alias("text"))
    handles = table(spark, d, "region").select(F.concat(F.lit("f"), "r_regionkey").alias("handle"))
    return ft.ground_paragraphs(p, docs.select(F.col("source").alias("name")).distinct(), handles)


@query(f"WITH {_BASE}, t AS (SELECT 's' || s_suppkey AS a, ['n' || s_nationkey, 'r' || s_suppkey % 3] AS xs FROM supplier), u AS (SELECT ['n3', 'r1'] AS ys) SELECT a, NOT list_has_any(xs, ys) AS disjoint, list_has_all(xs, ys) AS covers FROM t, u")
def disjoint_sets(spark, d):
    xs = F.array(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("r"), F.col("s_suppkey") % 3))
    ys = F.array(F.lit("n3"), F.lit("r1"))
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), (~F.arrays_overlap(xs, ys)).alias("disjoint"), (F.size(F.array_intersect(xs, ys)) == F.size(ys)).alias("covers"))


@query(f"""WITH RECURSIVE {_BASE}, w AS (SELECT key AS root, key AS id, 0 AS depth FROM mods WHERE k % 20 = 0 UNION SELECT root, dst, depth + 1 FROM w JOIN imp ON src = id WHERE depth < 2)
SELECT w.root, dir AS module, min(depth) AS depth FROM w JOIN mods ON key = id GROUP BY w.root, dir""")
def first_depth_per_module(spark, d):
    """The depth at which a walk from each root first meets a folder."""
    from ..operators import graph

    m = modules(spark, d)
    roots = m.where(F.substring("key", 2, 20).cast("long") % 20 == 0).select(F.col("key").alias("id"))
    walk = graph.bfs_of_each(imports(spark, d), roots, 2)
    return walk.join(m.select(F.col("key").alias("id"), F.col("dir").alias("module")), "id").groupBy("root", "module").agg(F.min("depth").alias("depth"))
