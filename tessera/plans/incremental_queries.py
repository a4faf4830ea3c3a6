"""Queries of streaming sources and of the index that a stream of changes keeps. Users are files; their last event makes the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, shared_dir, table
from ..sources import change_source as cs
from ..streaming import changes, feed
from ..streaming.message_log import MessageLog
from ..streaming.reindex import Reindexer
from .registry import ORACLES, query
from .stream_queries import _events, _in_batches, progress_text

_ORDER = "CAST(epoch_us(ts) AS HUGEINT) * 1000000000000 + event_id"
_SNAPSHOTS = 4


def _states_sql() -> str:
    last = ", ".join(
        f"s{i} AS (SELECT 'u' || user_id AS path, arg_max(event_id, {_ORDER}) AS hash, arg_max(event_type, {_ORDER}) AS kind FROM events, b WHERE epoch_us(ts) <= lo + (hi - lo) * {i} // {_SNAPSHOTS} GROUP BY user_id)" for i in range(1, _SNAPSHOTS + 1)
    )
    live = ", ".join(f"l{i} AS (SELECT path, hash FROM s{i} WHERE kind <> 'error')" for i in range(1, _SNAPSHOTS + 1))
    return f"b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), {last}, l0 AS (SELECT '' AS path, 0 AS hash WHERE false), {live}"


def _diff_sql(i: int) -> str:
    return f"SELECT {i} AS snapshot, coalesce(n.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind, CAST(n.hash AS VARCHAR) AS hash FROM l{i - 1} w FULL JOIN l{i} n ON w.path = n.path WHERE w.hash IS DISTINCT FROM n.hash"


def _drain(stream: DataFrame, out: str) -> None:
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@query(f"WITH {_states_sql()} " + " UNION ALL ".join(map(_diff_sql, range(1, _SNAPSHOTS + 1))))
def stream_change_source(spark, d):
    """Changes between four snapshots of the users' last events. The stream is stopped after the second and started again after the fourth."""
    cs.register(spark)
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    lo, hi = e.agg(F.min("us"), F.max("us")).first()
    folder, out = feed.folder(spark, "snapshots"), feed.folder(spark, "changes")
    s = spark.readStream.format("snapshot_changes").option("path", folder).load()
    for i in range(1, _SNAPSHOTS + 1):
        cut = (lo or 0) + ((hi or 0) - (lo or 0)) * i // _SNAPSHOTS
        last = e.where(F.col("us") <= cut).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
        cs.write_snapshot(last.where("x.event_type <> 'error'").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("x.event_id").cast("string").alias("hash")), folder, i)
        if i % 2 == 0:
            _drain(s, out)
    return spark.read.schema(s.schema).parquet(out).withColumn("snapshot", F.col("snapshot").cast("int"))


@query(ORACLES["progress_lines_parse"])
def stream_progress_lines(spark, d):
    """Progress lines of files that grow in number between two runs of the stream."""
    cs.register(spark)
    folder, out = feed.folder(spark, "logs"), feed.folder(spark, "progress")
    lines = table(spark, d, "events").select("event_id", progress_text().alias("value"))
    s = changes.parse_progress(spark.readStream.format("growing_lines").option("path", folder).load().select("value")).select("seq", "type", "stage")
    for half in (0, 1):
        lines.where(F.floor(F.col("event_id") / 3) % 2 == half).select("value").write.mode("append").text(folder)
        _drain(s, out)
    return spark.read.schema(s.schema).parquet(out)


#: What a user's last event writes. Users of one remainder have a file that no parser reads, of another one that does not parse.
_LINES = ["def n{a}():", "    return m{b}()", "", "", "def m{c}(x):", "    return x", ""]


def _content(user: Column, event: Column) -> Column:
    good = F.lit("\n".join(_LINES))
    for name, value in (("{a}", user % 50), ("{b}", event % 40), ("{c}", event % 30)):
        good = F.replace(good, F.lit(name), value.cast("string"))
    return F.when(user % 11 == 5, "def broken(:\n").otherwise(good)


def _path(user: Column) -> Column:
    return F.when(user % 13 == 0, F.concat(F.lit("docs/u"), user, F.lit(".txt"))).otherwise(F.concat(F.lit("src/u"), user, F.lit(".py")))


def _summary(text: Column) -> Column:
    """Stands for a model; fails for some texts."""
    return F.when(F.length(text) % 7 != 3, F.substring(F.sha1(text), 1, 12))


def _vector(text: Column) -> Column:
    return F.array(F.length(text).cast("double"), F.ascii(F.substring(text, 5, 1)).cast("double"))


_TEXTS = "'def n' || k % 50 || '():' || chr(10) || '    return m' || e % 40 || '()'", "'def m' || e % 30 || '(x):' || chr(10) || '    return x'"
_INDEX = f"""l AS (SELECT user_id AS k, arg_max(event_id, {_ORDER}) AS e, arg_max(event_type, {_ORDER}) AS kind FROM events GROUP BY user_id),
f AS (SELECT k, e, 'src/u' || k || '.py' AS file, k % 11 = 5 AS bad FROM l WHERE kind <> 'error' AND k % 13 <> 0 AND k % 7 <> 5),
s AS (SELECT file, 'n' || k % 50 AS name, {_TEXTS[0]} AS text FROM f WHERE NOT bad UNION ALL SELECT file, 'm' || e % 30, {_TEXTS[1]} FROM f WHERE NOT bad),
one AS (SELECT name, min(file) AS file FROM s GROUP BY name HAVING count(*) = 1)
SELECT 'file' AS what, file, CASE WHEN bad THEN 'failure' ELSE 'success' END AS name, sha256(CASE WHEN bad THEN 'def broken(:' || chr(10) ELSE {_TEXTS[0]} || chr(10) || chr(10) || chr(10) || {_TEXTS[1]} || chr(10) END) AS value FROM f
UNION ALL SELECT 'symbol', file, name, text FROM s
UNION ALL SELECT 'edge', f.file, 'n' || k % 50, CASE WHEN e % 40 = e % 30 THEN f.file || ':m' || e % 30 WHEN one.name IS NOT NULL THEN one.file || ':' || one.name ELSE 'unresolved::function::m' || e % 40 END FROM f LEFT JOIN one ON one.name = 'm' || e % 40 WHERE NOT bad
UNION ALL SELECT 'summary', file, name, substr(sha1(text), 1, 12) FROM s WHERE length(text) % 7 <> 3
UNION ALL SELECT 'chunk', file, name, length(text) || ',' || ascii(substr(text, 5, 1)) FROM s
UNION ALL SELECT 'search', file, name, 'function' FROM s UNION ALL SELECT 'search', file, regexp_extract(file, '([^/]*)[.]py$', 1), 'module' FROM f WHERE NOT bad"""


@query(f"WITH {_INDEX}")
def incremental_reindex(spark, d):
    """The index after seven micro-batches of changes, held against a full build: in the fourth a rule file moves some files out of scope and others into it."""
    e = durable(_in_batches(_events(spark, d).select("ts", "event_id", "user_id", "event_type"), "ts", 7).sortWithinPartitions("batch"), "index-events")
    steps = [r[0] for r in e.select("batch").distinct().orderBy("batch").collect()]
    lasts: dict[int, DataFrame] = {}

    def last(number: int) -> DataFrame:
        """The users' last events; those of a micro-batch are put to what the one before left, so events are read once."""
        if number not in lasts:
            x = e.where(F.col("batch") == steps[number]).select("user_id", F.struct("ts", "event_id", "event_type").alias("x"))
            lasts[number] = durable((x.unionByName(last(number - 1)) if number else x).groupBy("user_id").agg(F.max_by("x", F.struct("x.ts", "x.event_id")).alias("x")), "last", shared_dir(spark))
        return lasts[number]

    def state(number: int) -> DataFrame:
        return last(number).where("x.event_type <> 'error'").select(_path(F.col("user_id")).alias("path"), _content(F.col("user_id"), F.col("x.event_id")).alias("text"))

    def listing(number: int) -> DataFrame:
        return state(number).select("path", F.when(F.col("path").endswith(".py"), "Python").alias("language"))

    def contents(paths: DataFrame, number: int) -> DataFrame:
        return state(number).join(paths, "path", "left_semi")

    def rules(number: int):
        return lambda path: F.regexp_extract(path, r"u(\d+)\.", 1).try_cast("int") % 7 == (3 if number < 3 else 5)

    changed = e.select("ts", "event_id", _path(F.col("user_id")).alias("path"), changes.change_letter(F.col("event_type")).alias("change"), "batch")
    rule = e.where(F.col("batch") == steps[min(3, len(steps) - 1)]).agg(F.min("ts").alias("ts")).select("ts", F.lit(-1).cast("long").alias("event_id"), F.lit(".gitignore").alias("path"), F.lit("M").alias("change"), F.lit(steps[min(3, len(steps) - 1)]).cast("int").alias("batch"))
    folder = feed.folder(spark, "index")
    keep = Reindexer(spark, folder, listing, contents, rules, _summary, _vector, compact_every=4)
    s = feed.replay(changed.unionByName(rule))
    q = s.writeStream.foreachBatch(keep).option("checkpointLocation", folder + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    t = keep.tables(len(steps) - 1)
    sym = t["symbols"].select("id", "file", "name", "text")
    named = t["edges"].join(sym.select(F.col("id").alias("src"), "name"), "src").join(sym.select(F.col("id").alias("dst"), F.concat("file", F.lit(":"), "name").alias("label")), "dst", "left")
    row = lambda rows, what, name, value: rows.select(F.lit(what).alias("what"), "file", name.alias("name"), value.alias("value"))
    c = F.col
    out = row(t["files"].withColumnRenamed("path", "file"), "file", c("status"), c("hash")).unionByName(row(sym, "symbol", c("name"), c("text"))).unionByName(row(named, "edge", c("name"), F.coalesce("label", "dst")))
    out = out.unionByName(row(t["summaries"].join(sym, "id"), "summary", c("name"), c("summary")))
    vec = keep.current("chunks", len(steps) - 1).join(keep.current("vectors", len(steps) - 1), "content").join(t["symbols"].select("file", "name", "content"), ["file", "content"])
    out = out.unionByName(row(vec, "chunk", c("name"), F.concat_ws(",", F.transform("vector", lambda x: x.cast("long").cast("string")))))
    return out.unionByName(row(t["search"], "search", c("name"), c("kind")))


@query("SELECT conv_id AS session, turn, row_number() OVER (PARTITION BY conv_id ORDER BY least(turn, 5), turn, role, text) AS seq, role, sha256(coalesce(text, '')) AS text FROM conversations")
def stream_message_log(spark, d):
    """Conversations appended turn by turn in six micro-batches, each of which is run twice."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", F.least("turn", F.lit(5)).cast("int").alias("batch"))
    place = feed.folder(spark, "messages")
    log = MessageLog(spark, place, "session long, turn long, role string, text string", ["turn", "role", "text"])

    def twice(changed: DataFrame, number: int) -> None:
        log(changed, number)
        log(changed, number)

    q = feed.replay(rows).writeStream.foreachBatch(twice).option("checkpointLocation", place + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return log.messages().select("session", "turn", "seq", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
