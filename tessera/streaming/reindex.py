"""An index of files that a stream of changes keeps: files, symbols, calls, edges, summaries and chunks with vectors.

Each micro-batch carries its change through all tables, and after any stream of changes they equal those of a full
build over the files as they are:

1. A path that changed stands once, also where its changes cancel one another: what was created again and then deleted may have been
   in the index before. A change of a rule file makes the rules be read again first, and the paths whose scope they
   change join the micro-batch.
2. Files that are gone or out of scope lose their rows; of the others those whose content differs from the stored hash are read.
   A file that cannot be read keeps its place with a status, without rows, and costs the others nothing.
3. Edges are resolved anew for the changed files and for every file that calls a name which a changed file defined or defines.
4. Summaries are kept by content: only texts the ledger does not know are summarised; a text whose summary fails is asked again next time.
5. Chunks of changed files take the vector of equal content if there is one, else a new one.

All tables are state logs keyed by file (summaries and vectors by content), so a micro-batch writes its change alone and a
micro-batch that is run again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code_graph as cg
from ..operators import store
from ..session import durable, scratch, together
from ..sources import extract
from .changes import RULE_FILES, rules_changed
from .state_log import StateLog

TABLES = {
    "files": ("path", "path string, hash string, language string, status string"),
    "symbols": ("file", "file string, id string, kind string, name string, owner string, nested boolean, text string, content string"),
    "calls": ("file", "file string, caller string, callee string, line long"),
    "edges": ("file", "file string, src string, dst string"),
    "summaries": ("content", "content string, summary string"),
    "vectors": ("content", "content string, vector array<double>"),
    "chunks": ("file", "file string, id string, content string"),
}


def named_paths(changes: DataFrame) -> DataFrame:
    """changes(ts, event_id, path, change) -> path: what a micro-batch names. The files as they are decide what becomes of it."""
    return changes.select("path").distinct()


class Reindexer:
    """For foreachBatch. What it needs of the repository:

    listing(number) -> path, language of all files as they are; contents(paths, number) -> path, text of those that exist;
    rules(number) -> excluded condition of a path column; summarize and embed: text column -> summary, vector column (null where it fails).
    """

    def __init__(self, spark: SparkSession, folder: str, listing: Callable[[int], DataFrame], contents: Callable[[DataFrame, int], DataFrame], rules: Callable[[int], Callable[[Column], Column]], summarize: Callable[[Column], Column], embed: Callable[[Column], Column], compact_every: int = 20):
        self.listing, self.contents, self.rules, self.summarize, self.embed = listing, contents, rules, summarize, embed
        self.logs = {name: StateLog(spark, f"{folder}/{name}", key, schema, compact_every) for name, (key, schema) in TABLES.items()}
        self.read_rules: dict[int, int] = {}

    def current(self, name: str, until: int) -> DataFrame:
        return self.logs[name].current(until)

    def __call__(self, changes: DataFrame, number: int) -> None:
        with scratch(changes.sparkSession):
            self._step(changes, number)

    def _step(self, changes: DataFrame, number: int) -> None:
        before = {name: log.current(number - 1) for name, log in self.logs.items()}
        named = durable(named_paths(changes), "named")
        excluded = self.rules(number)
        listed = self.listing(number)
        paths = named
        if rules_changed(named):  # what comes into scope, and what leaves it
            inside = listed.where(~excluded(F.col("path"))).select("path")
            known = before["files"].select("path")
            paths = paths.unionByName(inside.join(known, "path", "left_anti")).unionByName(known.join(inside, "path", "left_anti")).distinct()
        is_rule = F.element_at(F.split("path", "/"), -1).isin(*RULE_FILES)
        here = paths.where(~is_rule).join(listed, "path", "left").withColumn("out", F.col("language").isNull() | excluded(F.col("path")))
        texts = self.contents(here.where(~F.col("out")).select("path"), number).withColumn("hash", F.sha2("text", 256))
        asked = here.join(texts, "path", "left").join(before["files"].select("path", F.col("hash").alias("was")), "path", "left")
        gone = F.col("out") | F.col("text").isNull()
        action = F.when(gone, F.when(F.col("was").isNotNull(), "remove")).when(store.is_changed(F.col("hash"), F.col("was")), "read")
        work = durable(asked.withColumn("action", action).where("action is not null").select("path", "language", "text", "hash", "action"), "work")
        touched = work.select(F.col("path").alias("file"))

        records = durable(extract.extract(work.where("action = 'read'")), "records")
        status = records.groupBy("path").agg(F.max("status").alias("status"))  # one status a file
        files = work.where("action = 'read'").join(status, "path").select("path", "hash", "language", "status")
        good = records.where("status = 'success'")
        symbols, _, calls, _ = extract.graph_tables(good)
        lines = work.select(F.col("path").alias("file"), F.split("text", "\n").alias("lines"))
        spans = good.where(F.col("record").isin("class", "function")).select("id", "start", "end")
        text = F.array_join(F.slice("lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
        bodies = symbols.join(spans, "id").join(lines, "file").withColumn("text", text).withColumn("content", F.sha2("text", 256))
        together(
            lambda: self.logs["files"].write(number, work.select("path"), files),
            lambda: self.logs["symbols"].write(number, touched, bodies),
            lambda: self.logs["calls"].write(number, touched, calls),
        )
        now = durable(self.current("symbols", number), "symbols")  # the log is merged once, however often a step reads it
        written = self.logs["symbols"].written(number)
        together(
            lambda: self._edges(before, number, touched, now),
            lambda: self._kept_by_content("summaries", "summary", self.summarize, before["summaries"], now, number),
            lambda: self._kept_by_content("vectors", "vector", self.embed, before["vectors"], written, number),
            lambda: self.logs["chunks"].write(number, touched, written.select("file", tx.chunk_id(F.col("id"), F.lit("code"), F.col("text")).alias("id"), "content")),
        )

    def _edges(self, before: dict[str, DataFrame], number: int, touched: DataFrame, symbols: DataFrame) -> None:
        """Calls of touched files, and calls anywhere of names that a touched file defined before or defines now."""
        key = tx.normalize_identifier(F.col("name"))
        old, new = before["symbols"].join(touched, "file", "left_semi"), self.logs["symbols"].written(number)
        names = durable(old.select(key.alias("key")).unionByName(new.select(key.alias("key"))).distinct(), "names")
        calls = self.current("calls", number)
        norm = tx.normalize_identifier(F.coalesce("callee", F.lit("")))
        asked = calls.select("file", F.explode(F.array_distinct(F.array(norm, tx.normalize_identifier(F.element_at(F.split("callee", r"\."), -1))))).alias("key"))
        files = durable(asked.join(names, "key", "left_semi").select("file").distinct().unionByName(touched).distinct(), "edge-files")
        wanted = durable(calls.join(files, "file", "left_semi"), "wanted")
        home = wanted.select("file", "caller").distinct()
        found = cg.call_edges(wanted, symbols).select("src", "dst").join(home.withColumnRenamed("caller", "src"), "src")
        self.logs["edges"].write(number, files, found.select("file", "src", "dst").distinct())

    def _kept_by_content(self, name: str, value: str, make: Callable[[Column], Column], known: DataFrame, texts: DataFrame, number: int) -> None:
        """New contents only; one whose value cannot be made gets no row."""
        new = texts.groupBy("content").agg(F.min("text").alias("text")).join(known.select("content"), "content", "left_anti")
        made = durable(new.select("content", make(F.col("text")).alias(value)).where(F.col(value).isNotNull()), name)
        self.logs[name].write(number, made, made)

    def tables(self, until: int) -> dict[str, DataFrame]:
        """files, symbols, edges, summaries by symbol, chunks with vectors and search rows after micro-batch ``until``."""
        now = {name: log.current(until) for name, log in self.logs.items()}
        s = now["symbols"]
        files = now["files"]
        return {
            "files": files,
            "symbols": s,
            "edges": now["edges"],
            "summaries": s.join(now["summaries"], "content").select("id", "summary"),
            "chunks": now["chunks"].join(now["vectors"], "content").select("id", "file", "vector"),
            "search": cg.search_entries(files.where("status = 'success'").select("path"), s),
        }
