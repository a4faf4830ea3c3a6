"""The registered queries of the training-data operators, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, collocations, decontam, langid, lexical, near_dedup, packing, pii, quality_gam, quality_rules, suffix_dedup, url_filter
from ..session import documents
from .common import table

#: (host, path, verdict) of the page query. Fixed values of its contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the split pattern."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _joined(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return byte_bpe.bpe_round_trip(documents(spark, sf_dir), path, pattern, keep_ids=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = decontam.scan_documents(docs, table(spark, sf_dir, "benchmark"))
    h = F.col("hits")
    return out.select("row.doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", h["items"]), 256).alias("items_sha256"), (h["n_hit"] > 0).alias("contaminated"), F.size(h["near"]).cast("long").alias("n_near"), F.concat_ws(",", h["near"]).alias("near_items"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=4)


def _fold(n: int):
    """The remainder of crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0)
    out = quality_gam.quality_scores(documents(spark, sf_dir), labels)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, langid.training_sample(docs.where(_fold(4) != 2)))
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir).select("lang", "text"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packing.pack_documents(documents(spark, sf_dir), f.read(), keep_ids=False)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_byte_bpe, op4_url_filter, op5_chat_format, op6_decontam, op7_quality_rules, op8_minhash, op9_quality_gam, op10_langid, op11_lexical_search, op12_collocations, op13_packing)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op4_url_filter": f"""
WITH u AS (SELECT row_number() OVER () AS rn, page_id, url, strpos(url, '://') AS k FROM pages),
p AS (SELECT rn, page_id,
  CASE WHEN k > 0 THEN translate(regexp_extract(substr(url, k + 3), '^([^/?#]*)', 1), {_AZ}) ELSE '' END AS host,
  CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(rh, rp, rv) AS (VALUES {_RULE_ROWS}),
m AS (SELECT rn, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m USING (rn)""",
    "op5_chat_format": """
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER () AS rn FROM conversations),
t AS (SELECT DISTINCT conv_id AS c, NULL AS rn, turn, role, text FROM rows WHERE conv_id IS NOT NULL UNION ALL SELECT NULL, rn, NULL, role, text FROM rows WHERE conv_id IS NULL),
c AS (SELECT c AS conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY c, rn),
g AS (SELECT l, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l),
inner_ AS (SELECT DISTINCT list_slice(l, 1, i) AS l FROM (SELECT l, unnest(range(1, n)) AS i FROM g))
SELECT conv_id, n AS n_turns, n_copies,
  list_aggregate(list_transform(l, lambda x: '<|im_start|>' || x.r || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS chat
FROM g WHERE l NOT IN (SELECT l FROM inner_)""",
    "op6_decontam": rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS k, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT rn, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT g.rn, g.s, g.n, win.item_id FROM g JOIN win ON g.k = win.k AND g.n = win.n),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS p FROM h) GROUP BY rn),
it AS (SELECT rn, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY rn),
wt AS (SELECT DISTINCT k, n, unnest(string_split(k, ' ')) AS term FROM win),
kinds AS (SELECT k, count(*) AS kinds FROM wt GROUP BY k),
dw AS (SELECT rn, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
dt AS (SELECT rn, p, term FROM dw WHERE term IN (SELECT term FROM wt)),
cf AS (SELECT term, count(*) AS cf FROM dt GROUP BY term),
rare AS (SELECT k, n, kinds, term FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cf, term) AS r FROM wt JOIN cf USING (term) JOIN kinds USING (k)) WHERE r <= 3),
prs AS (SELECT x.k, x.term AS t1, y.term AS t2, CASE WHEN x.kinds = 1 AND x.n > 1 THEN 1 ELSE 0 END AS least FROM rare x JOIN rare y ON x.k = y.k AND (x.term < y.term OR (x.kinds = 1 AND x.term = y.term))),
pit AS (SELECT DISTINCT t1, t2, least, CAST(item_id AS VARCHAR) AS i FROM prs JOIN win USING (k)),
rp AS (SELECT rn, p, term FROM dt WHERE term IN (SELECT t1 FROM pit UNION SELECT t2 FROM pit)),
met AS (SELECT DISTINCT x.rn, least(x.term, y.term) AS t1, greatest(x.term, y.term) AS t2, gap FROM (SELECT *, unnest(range(0, 6)) AS gap FROM rp) x JOIN rp y ON y.rn = x.rn AND y.p = x.p + gap),
nr AS (SELECT rn, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_items FROM (SELECT DISTINCT rn, i FROM met JOIN pit USING (t1, t2) WHERE gap >= pit.least) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN hit USING (rn) LEFT JOIN it USING (rn) LEFT JOIN nr USING (rn)""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
st AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT qn, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS qn, item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
tf AS (SELECT rn, doc_id, n, t, count(*) AS tf FROM (SELECT rn, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, st GROUP BY t, docs),
im AS (SELECT rn, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS v FROM tf JOIN wt USING (t), st),
s AS (SELECT qn, item_id, rn, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN im USING (t) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    "op12_collocations": rf"""
WITH p AS (SELECT row_number() OVER () AS pn, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT pn, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p WHERE len(w) > 0),
o AS (SELECT lang, x, lead(x, 1) OVER win AS y, lead(x, 2) OVER win AS z FROM t WINDOW win AS (PARTITION BY pn ORDER BY i)),
u AS (SELECT lang, x AS g, count(*) AS a FROM o GROUP BY ALL),
d AS (SELECT lang, x, y, x || ' ' || y AS g, count(*) AS a FROM o WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
e AS (SELECT lang, x, x || ' ' || y AS xy, y || ' ' || z AS yz, z, x || ' ' || y || ' ' || z AS g, count(*) AS a FROM o WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM u GROUP BY lang),
f AS (SELECT lang, g, a FROM u UNION ALL SELECT lang, g, a FROM d),
c AS (SELECT lang, g, a, 1 AS j, x AS q, y AS v FROM d UNION ALL SELECT lang, g, a, 1, x, yz FROM e UNION ALL SELECT lang, g, a, 2, xy, z FROM e),
cut AS (SELECT c.lang, c.g, c.a, j, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.g = c.q JOIN f r ON r.lang = c.lang AND r.g = c.v),
b AS (SELECT lang, g, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS nth FROM cut) WHERE nth = 1),
h AS (SELECT DISTINCT d.lang, d.g FROM d JOIN (SELECT lang, xy AS g, a FROM e UNION ALL SELECT lang, yz, a FROM e) k ON d.lang = k.lang AND d.g = k.g WHERE 100 * k.a >= 50 * d.a),
s AS (SELECT lang, g AS phrase, a, l, r, score FROM b ANTI JOIN h USING (lang, g))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang)) WHERE rank <= 2000""",
    "op8_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
