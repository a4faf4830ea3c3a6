"""Stored states: graph snapshots, published builds, pages with their manifest, redirects, the history of repositories, provenance.

Tables are Parquet in a store that Spark reads. Replacements are made atomic by a pointer file that names the
current version: a reader sees the old version or the new one, and a build that fails leaves the old one.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_placeholder
from ..operators.graph import alias_targets
from .files import _file_system, read_text

#: A commit is 40 or 64 hexadecimal digits.
_SHA = re.compile(r"[0-9a-f]{40}|[0-9a-f]{64}")


def _fs(spark: SparkSession, root: str):
    return _file_system(spark, root)[0], spark._jvm.org.apache.hadoop.fs.Path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: written beside, then renamed over the old one, so a reader finds the old text or the new one."""
    fs, place = _fs(spark, path)
    beside = place(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    over = gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(place(path)), over)


class Published:
    """A folder of versions and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> str | None:
        name = read_text(self.spark, f"{self.root}/CURRENT")
        return f"{self.root}/{name.strip()}" if name else None

    def publish(self, build) -> str:
        """build(folder) fills a staging folder; it becomes current if build returns, and is deleted if it raises."""
        fs, place = _fs(self.spark, self.root)
        name = f"v-{uuid.uuid4().hex}"
        staging = f"{self.root}/.staging-{name}"
        fs.mkdirs(place(staging))
        try:
            build(staging)
            if not fs.rename(place(staging), place(f"{self.root}/{name}")):
                raise OSError(f"could not rename {staging}")
        except BaseException:
            fs.delete(place(staging), True)
            raise
        old = self.current()
        write_text(self.spark, f"{self.root}/CURRENT", name)
        if old:
            fs.delete(place(old), True)
        return f"{self.root}/{name}"


def save_graph(spark: SparkSession, root: str, graph_id: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Replaces everything stored under graph_id by nodes(id, kind, name, file) and edges(src, dst, type)."""

    def build(folder: str) -> None:
        nodes.write.parquet(f"{folder}/nodes")
        edges.write.parquet(f"{folder}/edges")

    fs, place = _fs(spark, root)
    fs.mkdirs(place(f"{root}/{graph_id}"))
    Published(spark, f"{root}/{graph_id}").publish(build)


def load_graph(spark: SparkSession, root: str, graph_id: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes in order of kind, name, id; edges in order of source, target, type) of a stored graph, or None."""
    folder = Published(spark, f"{root}/{graph_id}").current()
    if folder is None:
        return None
    return spark.read.parquet(f"{folder}/nodes").orderBy("kind", "name", "id"), spark.read.parquet(f"{folder}/edges").orderBy("src", "dst", "type")


def write_search_index(spark: SparkSession, path: str, entries: DataFrame, stamp: str) -> bool:
    """Entries in order as a JSON file, written only if they differ from those stored; whether it was. The index is one file for a browser."""
    rows = [r.asDict() for r in entries.collect()]
    stored = read_text(spark, path)
    try:
        if stored is not None and json.loads(stored).get("entries") == rows:
            return False
    except ValueError:
        pass
    write_text(spark, path, json.dumps({"generatedAt": stamp, "entries": rows}, indent=2))
    return True


def write_pages(spark: SparkSession, root: str, pages: DataFrame) -> DataFrame:
    """pages(page, kind, path, markdown, html, sources array, links array, mentioned array): writes a table of (name, text) with both files of each page, returns the manifest rows.

    The manifest has the hash of the Markdown, the distinct source ids and the distinct pages that a page links to or mentions.
    """
    out = f"{root.rstrip('/')}/pages"
    files = pages.select(F.explode(F.array(F.struct(F.concat("path", F.lit(".md")).alias("name"), F.col("markdown").alias("text")), F.struct(F.concat("path", F.lit(".html")).alias("name"), F.col("html").alias("text")))).alias("f")).select("f.*")
    files.write.mode("overwrite").parquet(out)
    return pages.select("page", "kind", "path", F.sha2("markdown", 256).alias("content_hash"), F.array_distinct("sources").alias("sources"), F.array_distinct(F.concat("links", "mentioned")).alias("links"))


def redirect_stubs(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """aliases(old, new), pages(page, path, title) -> old, target, markdown of the redirect; only of old addresses that are no page now and lead to one."""
    ends = alias_targets(aliases.select("old", "new"))
    lead = ends.join(pages.select(F.col("page").alias("target"), "path", "title"), "target").join(pages.select(F.col("page").alias("old")), "old", "left_anti")
    return lead.select("old", "target", F.concat(F.lit("This page has moved to ["), "title", F.lit("]("), "path", F.lit(".md).\n")).alias("markdown"))


def deletable(removed: DataFrame, manifest: DataFrame, aliases: DataFrame) -> DataFrame:
    """removed(page), manifest(page, path), aliases(old_path) -> path of the files that may go: no redirect stands under them."""
    return manifest.join(removed, "page", "left_semi").join(aliases.select(F.col("old_path").alias("path")), "path", "left_anti").select("path")


def history(spark: SparkSession, root: str) -> DataFrame:
    """state, path, indexed_at: the latest row of the repositories table of each state folder, newest first; folders without a readable one are skipped.

    All folders are read by one scan; a row's folder is in the path of its file.
    """
    fs, place = _fs(spark, root)
    if not fs.globStatus(place(f"{root}/*/repositories")):
        return spark.createDataFrame([], "state string, path string, indexed_at string")
    rows = spark.read.schema("root_path string, last_indexed_at string").option("ignoreCorruptFiles", "true").parquet(f"{root}/*/repositories")
    named = rows.select(F.regexp_extract("_metadata.file_path", "([^/]+)/repositories/", 1).alias("state"), F.col("root_path").alias("path"), F.col("last_indexed_at").alias("indexed_at"))
    known = named.where("coalesce(path, '') <> '' and state not like '.%'")
    latest = known.groupBy("state").agg(F.max(F.struct("indexed_at", "path")).alias("x")).select("state", "x.path", "x.indexed_at")
    return latest.orderBy(F.desc_nulls_last("indexed_at"), "state")


def commit_of(spark: SparkSession, root: str) -> str:
    """The commit of a repository's HEAD, read from its files; "" if there is none. ``.git`` may be a file that names the folder."""
    fs, place = _fs(spark, root)
    git = f"{root.rstrip('/')}/.git"
    pointer = read_text(spark, git)
    if pointer is not None:
        if not pointer.startswith("gitdir:"):
            return ""
        target = pointer[7:].strip()
        git = target if target.startswith("/") else f"{root.rstrip('/')}/{target}"
    head = (read_text(spark, f"{git}/HEAD") or "").strip()
    if _SHA.fullmatch(head):
        return head
    ref = head[4:].strip() if head.startswith("ref:") else ""
    if not ref:
        return ""
    loose = (read_text(spark, f"{git}/{ref}") or "").strip()
    if _SHA.fullmatch(loose):
        return loose
    for line in (read_text(spark, f"{git}/packed-refs") or "").splitlines():
        sha, _, name = line.strip().partition(" ")
        if name.strip() == ref and _SHA.fullmatch(sha):
            return sha
    return ""


def mermaid(nodes: DataFrame, edges: DataFrame, kind: str = "flowchart") -> DataFrame:
    """nodes(diagram, id, label), edges(diagram, src, dst, label, seq) -> diagram, text: a Mermaid diagram with synthetic ids, nodes by id and edges by seq.

    kind is flowchart, class or sequence. A diagram is one row; placeholders are left out.
    """
    n = nodes.where(~is_placeholder(F.col("id"))).withColumn("no", F.concat(F.lit("n"), F.row_number().over(W.partitionBy("diagram").orderBy("id"))))
    safe = F.replace(F.replace(F.col("label"), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    head, line, arrow = {
        "flowchart": ("flowchart LR", F.concat("no", F.lit('["'), safe, F.lit('"]')), " --> "),
        "class": ("classDiagram", F.concat(F.lit("class "), "no", F.lit('["'), safe, F.lit('"]')), " <|-- "),
        "sequence": ("sequenceDiagram", F.concat(F.lit("participant "), "no", F.lit(" as "), safe), "->>"),
    }[kind]
    nodes_ = n.groupBy("diagram").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]).alias("ns"))
    a, b = (n.select("diagram", F.col("id").alias(x), F.col("no").alias(f"{x}_no")) for x in ("src", "dst"))
    ends = edges.join(a, ["diagram", "src"]).join(b, ["diagram", "dst"])
    two = ("dst_no", "src_no") if kind == "class" else ("src_no", "dst_no")
    text = F.when(F.coalesce("label", F.lit("")) == "", "") if kind != "sequence" else F.when(F.lit(False), "")
    note = text.otherwise(F.concat(F.lit(": " if kind != "flowchart" else ""), F.coalesce("label", F.lit("")))) if kind != "flowchart" else F.lit("")
    arrow_ = F.when(F.coalesce("label", F.lit("")) == "", arrow).otherwise(F.concat(F.lit(" -->|"), "label", F.lit("| "))) if kind == "flowchart" else F.lit(arrow)
    rows = ends.select("diagram", "seq", F.concat(F.col(two[0]), arrow_, F.col(two[1]), note).alias("t"))
    edges_ = rows.groupBy("diagram").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]).alias("es"))
    none = F.array().cast("array<string>")
    body = F.transform(F.concat("ns", F.coalesce("es", none)), lambda t: F.concat(F.lit("    "), t))
    return nodes_.join(edges_, "diagram", "left").select("diagram", F.concat_ws("\n", F.lit(head), F.array_join(body, "\n")).alias("text"))
