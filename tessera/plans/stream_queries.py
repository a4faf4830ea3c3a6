"""Queries of change streams and run states. The streams read the events table and stop when it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import store
from ..session import table
from ..streaming import changes, feed, run_states
from .registry import query


def _changes(spark, d) -> DataFrame:
    return table(spark, d, "events").select("ts", "event_id", F.col("user_id").alias("path"), changes.change_letter(F.col("event_type")).alias("change"))


_FOLD = "list_reduce(list_prepend('N', list(c ORDER BY ts, event_id)), lambda s, x: CASE WHEN s = 'N' THEN x WHEN s = 'C' THEN CASE WHEN x = 'D' THEN 'N' ELSE 'C' END WHEN s = 'M' THEN CASE WHEN x = 'D' THEN 'D' ELSE 'M' END ELSE CASE WHEN x = 'D' THEN 'D' ELSE 'M' END END)"
_BATCHES = """e AS (SELECT ts, event_id, user_id AS path, CASE event_type WHEN 'signup' THEN 'C' WHEN 'error' THEN 'D' ELSE 'M' END AS c FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) < {gap}000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS b FROM g), st AS (SELECT b, min(ts) AS batch_start, max(ts) AS batch_end FROM s GROUP BY b)"""


@query(f"WITH {_BATCHES.format(gap=300)}, f AS (SELECT b, path, {_FOLD} AS change FROM s GROUP BY b, path) SELECT batch_start, path, change FROM f JOIN st USING (b) WHERE change <> 'N'")
def debounce_merge(spark, d):
    return changes.debounce(_changes(spark, d), 300)


def _stream(spark, d) -> DataFrame:
    """The events table as a stream, ts as a timestamp."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows of a micro-batch at most, were events even over time.
BATCH_ROWS = 1_000_000


def _in_batches(rows: DataFrame, at: str, least: int) -> DataFrame:
    """rows with a batch: spans of equal length of the timestamp ``at``, ``least`` or more."""
    us = F.unix_micros(at)
    lo, hi, n = rows.agg(F.min(us), F.max(us), F.count("*")).first()
    parts = max(least, -(-n // BATCH_ROWS))
    return rows.withColumn("batch", ((us - F.lit(lo or 0)) * parts / F.lit((hi or 0) - (lo or 0) + 1)).cast("int"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(rows: DataFrame) -> DataFrame:
    """rows(ts, batch, ...) with a last micro-batch of one event a century later, which closes all that is open before it."""
    last = rows.agg(F.max("ts").alias("ts"), F.max("batch").alias("batch")).select(F.expr("ts + interval 100 years").alias("ts"), F.expr("batch + 1").alias("batch"))
    return rows.unionByName(last, allowMissingColumns=True)


@query(f"WITH {_BATCHES.format(gap=300)}, f AS (SELECT b, path, {_FOLD} AS change FROM s GROUP BY b, path) SELECT batch_start, path, change FROM f JOIN st USING (b) WHERE change <> 'N'")
def stream_debounce_equals_batch(spark, d):
    """Merged changes of all batches, from seven micro-batches or more; a last event closes the last batch."""
    place = feed.folder(spark, "debounce")
    step = changes.DebouncedStream(place, 300, lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/out/n={n}"))
    e = _events(spark, d).select("ts", "event_id", F.col("user_id").alias("path"), changes.change_letter(F.col("event_type")).alias("change"))
    s = feed.replay(_closed(_in_batches(e, "ts", 6)))
    q = s.writeStream.foreachBatch(step).option("checkpointLocation", place + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("batch_start timestamp, path long, change string").parquet(f"{place}/out")
    return out.select(F.col("batch_start").cast("timestamp_ntz").alias("batch_start"), "path", "change")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_session_windows(spark, d):
    """Hourly counts, each given once the watermark has passed its window; a last event closes the last ones."""
    s = feed.replay(_closed(_in_batches(_events(spark, d).select("ts", "event_type"), "ts", 6)))
    w = s.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return feed.drained(w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), "windows")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 43200000000 THEN 0 ELSE 1 END AS new, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_user_sessions(spark, d):
    """Sessions of each user: events less than twelve hours apart, across micro-batches that come out of order by up to a day."""
    e = _events(spark, d).select("ts", "user_id", (F.col("ts") + F.expr("make_dt_interval(0, event_id % 24)")).alias("came"))
    s = feed.replay(_closed(_in_batches(e, "came", 6)))
    w = s.withWatermark("ts", "2 days").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    at = lambda k: F.col(f"w.{k}").cast("timestamp_ntz").alias(f"session_{k}")
    return feed.drained(w.select("user_id", at("start"), at("end"), "n"), "sessions")


@query("""SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 4) t(k) GROUP BY ALL""")
def stream_sliding_windows(spark, d):
    """Windows of an hour that open every quarter."""
    s = feed.replay(_closed(_in_batches(_events(spark, d).select("ts", "event_type", "value"), "ts", 6)))
    w = s.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return feed.drained(w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "sliding")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct_events(spark, d):
    """Every event comes twice, the second time up to three micro-batches later, and leaves once."""
    e = _in_batches(_events(spark, d).select("ts", "event_id", "user_id", "event_type"), "ts", 6)
    twice = e.unionByName(e.withColumn("batch", F.col("batch") + (F.col("event_id") % 4).cast("int")))
    s = feed.replay(twice).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    return feed.drained(s.select("event_id", "user_id", "event_type"), "distinct")


@query("""WITH a AS (SELECT epoch_us(ts) AS us, time_bucket(INTERVAL '1 hour', ts) AS hour, epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN 36 * 3600000000 ELSE 0 END AS came FROM events),
b AS (SELECT *, CAST(floor(CAST((came - (SELECT min(came) FROM a)) * 16 AS DOUBLE) / (SELECT max(came) - min(came) + 1 FROM a)) AS INTEGER) AS batch FROM a),
m AS (SELECT batch, max(us) // 1000 AS ms FROM b GROUP BY batch), w AS (SELECT x.batch, max(y.ms) - 3600000 AS mark FROM m x LEFT JOIN m y ON y.batch < x.batch - 1 GROUP BY x.batch)
SELECT hour, count(*) FILTER (late IS NOT TRUE) AS kept, count(*) FILTER (late) AS late FROM (SELECT hour, epoch_ms(hour) + 3600000 <= mark AS late FROM b JOIN w USING (batch)) GROUP BY hour""")
def stream_late_rows(spark, d):
    """Hourly counts where a tenth of the events comes 36 hours late, in sixteen micro-batches: what was counted and what came too late for its window."""
    e = _events(spark, d).select("ts", (F.col("ts") + F.expr("make_dt_interval(0, if(event_id % 10 = 0, 36, 0))")).alias("came"))
    s = feed.replay(_closed(_in_batches(e, "came", 16)))
    w = s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("kept"))
    kept = feed.drained(w.select(F.col("w.start").alias("hour"), "kept"), "late")
    every = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    n = F.coalesce("kept", F.lit(0))
    return every.join(kept, "hour", "left").select(F.col("hour").cast("timestamp_ntz").alias("hour"), n.alias("kept"), (F.col("n") - n).alias("late"))


@query("SELECT a.event_id AS purchase, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 6 HOUR")
def stream_stream_join(spark, d):
    """Purchases with the clicks of the same user in the six hours before, both sides as streams bounded by watermarks."""
    a = _stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", "1 hour")
    b = _stream(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("click"), "user_id", "ts").withWatermark("ts", "1 hour")
    return feed.drained(a.join(b, F.expr("u = user_id and ts <= t and ts >= t - interval 6 hours")).select("purchase", "click"), "join")


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS last_kind, arg_min(event_type, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) FILTER (event_type IN ('error', 'purchase')) AS outcome FROM events GROUP BY user_id")
def run_state_fold(spark, d):
    return changes.run_state(table(spark, d, "events"))


_RUN = """r AS (SELECT user_id % 40 AS run, event_id AS seq, CASE event_type WHEN 'view' THEN 'stage' WHEN 'click' THEN 'stage_end' WHEN 'purchase' THEN 'items' WHEN 'error' THEN 'failed' ELSE 'catchup' END AS type, CAST(event_id * 7 // 13 % 9 AS INTEGER) AS stage FROM events WHERE user_id % 40 <> event_id % 50),
o AS (SELECT run, stage, arg_max(type, seq) FILTER (type IN ('stage', 'stage_end', 'failed')) AS hard, max(seq) FILTER (type IN ('stage', 'stage_end', 'failed')) AS tm, count(*) FILTER (type = 'items') AS items FROM r GROUP BY run, stage),
l AS (SELECT o.run, o.stage, max(s.seq) AS later FROM o JOIN r s ON s.run = o.run AND s.stage > o.stage AND s.type = 'stage' GROUP BY o.run, o.stage)
SELECT o.run, o.stage, CASE WHEN hard = 'failed' THEN 'failed' WHEN hard = 'stage_end' THEN 'done' WHEN later IS NOT NULL AND (tm IS NULL OR later > tm) THEN 'done' WHEN hard = 'stage' OR items > 0 THEN 'running' ELSE 'pending' END AS status FROM o LEFT JOIN l USING (run, stage)"""


def _run_events(spark, d) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    type_ = F.when(kind == "view", "stage").when(kind == "click", "stage_end").when(kind == "purchase", "items").when(kind == "error", "failed").otherwise("catchup")
    return table(spark, d, "events").where("user_id % 40 <> event_id % 50").select((F.col("user_id") % 40).alias("run"), k.alias("seq"), type_.alias("type"), (F.floor(k * 7 / 13) % 9).cast("int").alias("stage"))


@query(f"WITH {_RUN}")
def run_stage_status(spark, d):
    return changes.stage_status(_run_events(spark, d))


@query("SELECT event_id, user_id, CAST(floor(epoch_us(lead(ts) OVER w) / 1000000) - floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def stage_durations(spark, d):
    return store.stage_durations(table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "seconds")


_STAGE_OF = "[" + ", ".join(f"'{s}'" for s in [*changes.STAGES, "ELSEWHERE"]) + "][event_id % 10 + 1]"


def progress_text() -> Column:
    """A progress line of an event."""
    k = F.col("event_id")
    stage = F.element_at(F.array(*map(F.lit, [*changes.STAGES, "ELSEWHERE"])), (k % 10 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["stage", "items", "failed", "server_ready"])), (k % 4 + 1).cast("int"))
    good = F.concat(F.lit(changes.SENTINEL + " "), F.to_json(F.struct(k.alias("seq"), kind.alias("type"), stage.alias("stage"))))
    m = k % 7
    return F.when(m == 3, F.concat(F.lit("log "), good)).when(m == 4, F.concat(good, F.lit("}{"))).when(m == 5, F.replace(good, F.lit('"seq":'), F.lit('"seq":0.5,"n":'))).when(m == 6, F.replace(good, F.lit('"type":"'), F.lit('"type":"new-'))).otherwise(good)


@query(f"SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'items' WHEN 2 THEN 'failed' ELSE 'server_ready' END AS type, nullif({_STAGE_OF}, 'ELSEWHERE') AS stage FROM events WHERE event_id % 7 < 3")
def progress_lines_parse(spark, d):
    """A line in seven each is of another protocol, broken, without a whole seq or of an unknown type."""
    return changes.parse_progress(table(spark, d, "events").select(progress_text().alias("value"))).select("seq", "type", "stage")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, '@@PROGRESS@@{\"seq\":' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) || ',\"type\":\"' || event_type || '\",\"stage\":\"s' || event_id % 3 || '\"}' AS value FROM events")
def progress_emitter(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("type"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("stage"))
    return changes.progress_lines(e, ["ts", "event_id"], "user_id").withColumn("seq", F.col("seq").cast("long"))


@query("SELECT event_id, user_id AS path, CASE event_type WHEN 'signup' THEN 'C' WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'D' ELSE 'M' END AS change FROM events UNION ALL SELECT event_id, user_id + 1000, 'C' FROM events WHERE event_type = 'purchase'")
def change_source(spark, d):
    kind = F.col("event_type")
    raw = table(spark, d, "events").select("ts", "event_id", F.col("user_id").alias("path"), F.when(kind == "signup", "created").when(kind == "error", "deleted").when(kind == "purchase", "moved").otherwise("modified").alias("kind"), (F.col("user_id") + 1000).alias("dest"))
    return changes.source_events(raw).select("event_id", "path", "change")


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR lang = 'es' THEN CASE WHEN doc_id % 4 <> 0 THEN 'remove' ELSE 'none' END WHEN doc_id % 4 = 0 OR doc_id % 4 = 1 THEN 'parse' ELSE 'none' END AS action FROM documents""")
def incremental_actions(spark, d):
    k, h = F.col("doc_id"), F.sha1("text")
    docs = table(spark, d, "documents")
    asked = docs.select(k.alias("path"), F.when(k % 6 == 0, "D").otherwise("M").alias("change"))
    stored = docs.where(k % 4 != 0).select(k.alias("path"), F.when(k % 4 == 1, "old").otherwise(h).alias("hash"))
    current = docs.where(k % 7 != 0).select(k.alias("path"), h.alias("hash"), (k % 5 == 0).alias("excluded"), F.lit(False).alias("is_binary"), F.when(F.col("lang") != "es", F.col("lang")).alias("language"))
    return changes.incremental_batch(asked, stored, current)


@query(f"WITH {_RUN}")
def stream_run_state(spark, d):
    """The last snapshot of each run. Events are dealt over eight micro-batches by a hash, so most come after others of a higher seq."""
    out = feed.folder(spark, "runs")
    s = feed.replay(_run_events(spark, d).withColumn("batch", F.pmod(F.xxhash64("seq"), F.lit(8)).cast("int")))
    with feed.rocksdb(spark):
        states = run_states.stream_run_states(s)
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/n={n}")
        q = states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    snapshots = spark.read.schema(run_states.SNAPSHOT).parquet(out)
    return snapshots.groupBy("run", "stage").agg(F.max_by("status", "version").alias("status"))
