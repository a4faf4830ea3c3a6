"""Queries of source reading: each part gives a small file whose records SQL can write down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread, table
from ..sources import extract, files
from .registry import query


def _sources(spark, d, language: str, pieces: list) -> DataFrame:
    """One file a part: pieces are texts, or numbers taken from the key (key modulo the number; 0: the key). The table of parts is small, the files' reading is not: they are dealt over all cores."""
    k = F.col("p_partkey")
    parts = [F.lit(p) if isinstance(p, str) else (k if p == 0 else k % p).cast("string") for p in pieces]
    return spread(table(spark, d, "part").select("p_partkey")).select(F.concat(F.lit("m"), k).alias("path"), F.lit(language).alias("language"), F.concat(*parts).alias("text"))


def _records(df: DataFrame) -> DataFrame:
    out = extract.extract(df)
    return out.select("path", "record", "name", "owner", "nested", F.array_join(F.coalesce("parameters", F.array().cast("array<string>")), ",").alias("parameters"), "start", "end", "status")


@query("""WITH k AS (SELECT p_partkey AS k, 'm' || p_partkey AS path FROM part)
SELECT path, 'module' AS record, path AS name, NULL AS owner, false AS nested, '' AS parameters, 1 AS start, 10 AS "end", 'success' AS status FROM k
UNION ALL SELECT path, 'import', 'from lib' || k % 7 || ' import x', NULL, false, '', 1, 1, 'success' FROM k UNION ALL SELECT path, 'function', 'f' || k, NULL, false, 'a,rest', 3, 7, 'success' FROM k
UNION ALL SELECT path, 'call', 'g' || k % 5, NULL, false, '', 4, 4, 'success' FROM k UNION ALL SELECT path, 'function', 'inner', NULL, true, '', 6, 7, 'success' FROM k
UNION ALL SELECT path, 'call', 'h', NULL, false, '', 7, 7, 'success' FROM k UNION ALL SELECT path, 'class', 'C' || k, NULL, false, '', 8, 10, 'success' FROM k
UNION ALL SELECT path, 'inherit', 'B' || k % 3, NULL, false, '', 8, 10, 'success' FROM k UNION ALL SELECT path, 'function', 'm', 'C' || k, false, 'self', 9, 10, 'success' FROM k""")
def python_symbols(spark, d):
    return _records(_sources(spark, d, "Python", ["from lib", 7, " import x\n\ndef f", 0, "(a, *rest):\n    g", 5, "()\n    b = 1\n    def inner():\n        h()\nclass C", 0, "(B", 3, "):\n    def m(self):\n        pass\n"]))


@query("""WITH k AS (SELECT p_partkey AS k, 'm' || p_partkey AS path FROM part)
SELECT path, 'module' AS record, path AS name, NULL AS owner, false AS nested, '' AS parameters, 1 AS start, 8 AS "end", 'success' AS status FROM k UNION ALL SELECT path, 'import', 'import lib' || k % 7, NULL, false, '', 1, 1, 'success' FROM k
UNION ALL SELECT path, 'class', 'C' || k, NULL, false, '', 2, 7, 'success' FROM k UNION ALL SELECT path, 'inherit', 'B' || k % 3, NULL, false, '', 2, 7, 'success' FROM k
UNION ALL SELECT path, 'function', 'go' || k % 4, 'C' || k, false, 'a,b', 4, 6, 'success' FROM k UNION ALL SELECT path, 'call', 'run' || k % 5, NULL, false, '', 5, 5, 'success' FROM k""")
def brace_symbols(spark, d):
    return _records(_sources(spark, d, "Java", ["import lib", 7, ";\nclass C", 0, " extends B", 3, " {\n  // go() {\n  int go", 4, "(int a, Map<K, V> b) {\n    run", 5, '("}");\n  }\n}\n']))


@query("""WITH k AS (SELECT p_partkey AS k, 'm' || p_partkey AS path FROM part)
SELECT path, 'module' AS record, path AS name, NULL AS owner, false AS nested, '' AS parameters, 1 AS start, 12 AS "end", 'success' AS status FROM k UNION ALL SELECT path, 'class', 'Part ' || k, NULL, false, '', 3, 8, 'success' FROM k
UNION ALL SELECT path, 'function', 'Sub ' || k % 6, 'Part ' || k, false, '', 7, 8, 'success' FROM k UNION ALL SELECT path, 'class', 'Last', NULL, false, '', 9, 12, 'success' FROM k""")
def markdown_sections(spark, d):
    return _records(_sources(spark, d, "Markdown", ["# Title\nintro\n## Part ", 0, "\n```\n## no\n```\n### Sub ", 6, " ##\n#### deep\nLast\n----\nend\nmore"]))


@query("""SELECT p_partkey, p_partkey % 6 IN (1, 2, 4) AS is_binary FROM part""")
def binary_sniff(spark, d):
    """NUL; control characters; text cut inside a character; bytes of no encoding; the same as a small share."""
    k = F.col("p_partkey") % 6
    text = F.encode(F.repeat(F.concat("p_name", F.lit(" ééé ")), 300), "UTF-8")
    kinds = [text, F.concat(F.lit(b"a\0"), text), F.encode(F.concat(F.repeat(F.lit("\x01"), 2000), "p_name"), "UTF-8"), F.substring(F.concat(F.lit(b"x"), F.encode(F.repeat(F.lit("é"), 3000), "UTF-8")), 1, 4097), F.concat(F.lit(bytes(range(128, 256)) * 20), text), F.concat(text, F.lit(b"\xff\xfe"))]
    data = kinds[-1]
    for i in range(4, -1, -1):
        data = F.when(k == i, kinds[i]).otherwise(data)
    ship_package(spark)

    @F.pandas_udf("boolean")
    def binary(c):
        return c.map(lambda x: files.is_binary(bytes(x)))

    head = F.substring(data, 1, 4096)  # what the sniffer looks at is all that leaves the JVM
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", binary(head).alias("is_binary"))
