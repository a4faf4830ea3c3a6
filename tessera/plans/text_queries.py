"""Queries of text, path and page expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as tx
from ..session import documents, table
from .registry import query


@query()
def markdown_plain(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", F.sha2(tx.markdown_plain(t), 256).alias("plain"), tx.sentence_count(t).alias("sentences"), tx.excerpt(t, 120).alias("excerpt"),
        tx.marked_excerpt(t, 120).alias("marked"), tx.first_sentence(t).alias("first"),
    )


@query()
def html_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", html.sanitized("html").alias("html"))


@query(r"""WITH w AS (SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CAST(1 + len(regexp_extract_all(t, '[.!?] [A-Z`\[]')) AS INTEGER) AS sentences, substr(CASE WHEN contains(t, '. ') THEN split_part(t, '. ', 1) || '.' ELSE t END, 1, 120) AS first FROM w""")
def sentence_rules(spark, d):
    t = F.regexp_replace(F.trim("text"), r"\s+", " ")
    return table(spark, d, "documents").select("doc_id", tx.sentence_count(t).alias("sentences"), tx.planner_sentence(t).alias("first"))


_EXT = "['.py', '.MTS', '.cts', '.pyi', '.rs', '.markdown', '', '.kt']"


@query(f"""WITH p AS (SELECT doc_id, source || '/' || lang || doc_id || ({_EXT})[doc_id % 8 + 1] AS path, doc_id % 8 AS e, CASE WHEN doc_id % 9 = 0 THEN chr(0) || text WHEN doc_id % 10 = 0 THEN repeat(chr(2), 3000) || text ELSE text END AS t FROM documents)
SELECT doc_id, contains(substr(t, 1, 4096), chr(0)) OR len(regexp_extract_all(substr(t, 1, 4096), '[\\x01-\\x08\\x0E-\\x1F\\x7F]')) > 0.3 * length(substr(t, 1, 4096)) AS is_binary,
CASE e WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'TypeScript' WHEN 4 THEN 'Rust' WHEN 5 THEN 'Markdown' WHEN 7 THEN 'Kotlin' END AS language FROM p""")
def lang_detect(spark, d):
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".py", ".MTS", ".cts", ".pyi", ".rs", ".markdown", "", ".kt"])), (k % 8 + 1).cast("int"))
    t = F.when(k % 9 == 0, F.concat(F.lit("\0"), "text")).when(k % 10 == 0, F.concat(F.repeat(F.lit("\x02"), 3000), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.looks_binary(t).alias("is_binary"), tx.language_of(F.concat("source", F.lit("/"), "lang", k, ext)).alias("language"))


_NAMES = "CASE p_partkey % 10 WHEN 0 THEN 'tests/a' || p_partkey || '.py' WHEN 1 THEN 'src/test_' || p_partkey || '.py' WHEN 2 THEN 'src/conftest.py' WHEN 3 THEN 'app/Foo' || p_partkey || 'Test.java' WHEN 4 THEN 'web/x.spec.ts' WHEN 5 THEN 'docs/README.md' WHEN 6 THEN 'node_modules/y/z.js' WHEN 7 THEN 'src/contest.py' WHEN 8 THEN 'a/b_test.go' ELSE 'Doc.Markdown' END"


@query(f"""WITH p AS (SELECT p_partkey, {_NAMES} AS path FROM part) SELECT p_partkey, starts_with(path, 'tests/') OR regexp_matches(path, '(^|/)(test_[^/]+[.]py|[^/]+_test[.](py|go)|conftest[.]py|[^/]+Tests?[.](java|kt|cs)|[^/]+[.](spec|test)[.][cm]?[jt]sx?)$') AS is_test,
regexp_matches(lower(path), '[.](md|markdown)$') AS is_prose, contains('/' || path, '/node_modules/') AS excluded FROM p""")
def path_predicates(spark, d):
    k, form = F.col("p_partkey"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = [form("tests/a", k, ".py"), form("src/test_", k, ".py"), F.lit("src/conftest.py"), form("app/Foo", k, "Test.java"), F.lit("web/x.spec.ts"), F.lit("docs/README.md"), F.lit("node_modules/y/z.js"), F.lit("src/contest.py"), F.lit("a/b_test.go"), F.lit("Doc.Markdown")]
    p = F.element_at(F.array(*forms), (k % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", tx.is_test_file(p).alias("is_test"), tx.is_prose(p).alias("is_prose"), tx.is_excluded(p).alias("excluded"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'java' || chr(9) || 'script:x' WHEN 1 THEN 'MAILTO:a@b' WHEN 2 THEN regexp_replace(url, '^[a-z]+:', 'data:') WHEN 3 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS u FROM pages)
SELECT page_id, page_id % 5 IN (1, 3, 4) AS safe FROM u""")
def safe_urls(spark, d):
    k = F.col("page_id") % 5
    u = F.when(k == 0, "java\tscript:x").when(k == 1, "MAILTO:a@b").when(k == 2, F.regexp_replace("url", "^[a-z]+:", "data:")).when(k == 3, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.safe_url(u).alias("safe"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, array_to_string(list_transform(range(len(parts) - 1, 0, -1), lambda n: array_to_string(list_slice(parts, 1, n), '/')), '|') AS folders, replace(replace(replace(path, ' ', ''), '-', '_'), chr(92), '/') AS ident,
repeat('../', CAST(len(parts) - 1 AS INTEGER)) || 'index.html' AS home, CAST(CASE WHEN parts[1] = 'm.x' THEN 1 ELSE 0 END AS INTEGER) AS common FROM s""")
def path_functions(spark, d):
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", F.array_join(tx.ancestors(F.col("path")), "|").alias("folders"), tx.normalize_identifier(F.col("path")).alias("ident"), tx.relative_link(F.col("path"), F.lit("index.html")).alias("home"),
                    tx.common_length(F.split("path", "/"), F.array(F.lit("m.x"))).alias("common"))


@query(r"""WITH s AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'class' ELSE 'function' END AS kind, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS parent, string_split(p_name, ' ') AS ps, CASE WHEN p_partkey % 4 = 0 THEN 'int' END AS ret FROM part)
SELECT p_partkey, CASE kind WHEN 'module' THEN 'module ' || name WHEN 'class' THEN 'class ' || name || CASE WHEN parent <> '' THEN '(' || parent || ')' ELSE '' END ELSE name || '(' || array_to_string(ps, ', ') || ')' || coalesce(' -> ' || ret, '') END AS signature,
greatest(8, least(20, p_partkey // 8)) AS target FROM s""")
def signatures(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("module"), F.lit("class"), F.lit("function")), F.col("p_size") % 3 + 1)
    sig = tx.symbol_signature(kind, F.col("p_brand"), F.when(k % 2 == 0, F.col("p_type")).otherwise(""), F.split("p_name", " "), F.when(k % 4 == 0, "int"))
    return table(spark, d, "part").select("p_partkey", sig.alias("signature"), tx.target_features(k).alias("target"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 4 + 1 AS a, doc_id % 7 AS z FROM documents)
SELECT doc_id, sha1(regexp_replace(coalesce(array_to_string(CASE WHEN a > len(l) THEN [] ELSE list_slice(l, a, least(greatest(z, a), len(l))) END, chr(10)), ''), '^\s+|\s+$', '', 'g')) AS slice FROM l""")
def source_slices(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.sha1(tx.source_slice(F.col("text"), (k % 4 + 1).cast("int"), (k % 7).cast("int"))).alias("slice"))


@query(r"""WITH p AS (SELECT page_id, '<a href="p' || page_id || '.md#x">l</a> <a href="https://e.org/y.md">m</a> <a href="q/r.md">n</a>' AS h FROM pages)
SELECT page_id, '<a href="p' || page_id || '.html#x">l</a> <a href="https://e.org/y.md">m</a> <a href="q/r.html">n</a>' AS html FROM p""")
def page_links(spark, d):
    h = F.concat(F.lit('<a href="p'), "page_id", F.lit('.md#x">l</a> <a href="https://e.org/y.md">m</a> <a href="q/r.md">n</a>'))
    return table(spark, d, "pages").select("page_id", tx.html_links(h).alias("html"))


@query(r"""WITH p AS (SELECT p_partkey, p_type || '/' || p_brand || '/' || p_name || '/' || repeat('seg', CAST(p_partkey % 20 AS INTEGER)) AS label FROM part), t AS (SELECT p_partkey, label, string_split(label, '/') AS s FROM p)
SELECT p_partkey, CASE WHEN length(label) <= 40 THEN label WHEN length(s[4]) > 40 THEN substr(s[4], 1, 40) WHEN length(s[3] || '/' || s[4]) > 40 THEN s[4] WHEN length(s[2] || '/' || s[3] || '/' || s[4]) > 40 THEN s[3] || '/' || s[4] ELSE s[2] || '/' || s[3] || '/' || s[4] END AS label FROM t""")
def member_labels(spark, d):
    label = F.concat_ws("/", "p_type", "p_brand", "p_name", F.repeat(F.lit("seg"), (F.col("p_partkey") % 20).cast("int")))
    return table(spark, d, "part").select("p_partkey", tx.member_label(label).alias("label"))


@query(r"""WITH t AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || chr(10) || '- item **' || lang || '**' || chr(10) || 'plain' || chr(10) || '2. second   point' AS t FROM documents)
SELECT doc_id, 'Title ' || doc_id || '|item **' || lang || '|second point' AS bullets FROM t JOIN documents USING (doc_id)""")
def readme_bullets(spark, d):
    t = F.concat(F.lit("# Title "), "doc_id", F.lit("\n\n- item **"), "lang", F.lit("**\nplain\n2. second   point"))
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.readme_bullets(t), "|").alias("bullets"))


@query(r"""WITH p AS (SELECT p_partkey AS k, p_type AS page, coalesce(nullif(lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'page') AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY page, base ORDER BY k) AS n FROM p) SELECT k, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS anchor FROM r""")
def slug_anchor(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("page"), tx.slugify(F.col("p_name")).alias("base"))
    lists = p.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "base"))).alias("xs"))
    return lists.select(F.explode(tx.unique_anchors(F.col("xs"))).alias("x")).select("x.k", "x.anchor")


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'x No Index Found y' WHEN 'click' THEN 'The model for the ''summary'' stage is not available' WHEN 'purchase' THEN 'Could not start the server' WHEN 'error' THEN 'the model for the chat is gone' ELSE 'Address may already be in use' END AS o FROM events)
SELECT event_id, CASE WHEN contains(lower(o), 'no index found') THEN 'index_missing' WHEN contains(lower(o), 'the model for the') AND contains(lower(o), 'stage is not available') THEN 'provider_unavailable' WHEN contains(lower(o), 'address may already be in use') OR contains(lower(o), 'could not start the server') THEN 'bind_failed' ELSE 'failed' END AS kind,
CASE WHEN contains(o, '''summary''') THEN 'summary' END AS stage FROM e""")
def failure_kinds(spark, d):
    kind = F.col("event_type")
    o = F.when(kind == "view", "x No Index Found y").when(kind == "click", "The model for the 'summary' stage is not available").when(kind == "purchase", "Could not start the server").when(kind == "error", "the model for the chat is gone").otherwise("Address may already be in use")
    return table(spark, d, "events").select("event_id", tx.failure_kind(o).alias("kind"), tx.failed_stage(o).alias("stage"))


@query("""SELECT doc_id, 'About ' || lang || ' ' || doc_id || ', plainly.' AS lead FROM documents""")
def readme_leads(spark, d):
    t = F.concat(F.lit("# Title\n\n[![b](c)](d)\n\n- x\n- y\n\n```\ncode\n\nmore\n```\nSetext\n===\n\n1. one\n\nAbout *"), "lang", F.lit("*\n"), "doc_id", F.lit(", plainly.\n\nNext."))
    return table(spark, d, "documents").select("doc_id", tx.readme_lead(t).alias("lead"))
