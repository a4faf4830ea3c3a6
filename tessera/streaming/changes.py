"""Change streams: debounced batches, run-state folds; the same functions serve batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Event type to change letter.
CHANGE_OF = {"signup": "C", "view": "M", "click": "M", "purchase": "M", "error": "D"}


def change_letter(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CHANGE_OF.items() for x in kv])[kind]


def merge_step(state: Column, change: Column) -> Column:
    """Created then deleted cancels; created stays created; deleted then anything else is modified; modified stays modified until deleted."""
    return (F.when(state == "N", change).when(state == "C", F.when(change == "D", "N").otherwise("C"))
            .when(state == "M", F.when(change == "D", "D").otherwise("M")).otherwise(F.when(change == "D", "D").otherwise("M")))


def fold_changes(events: DataFrame, batch: str) -> DataFrame:
    """Per batch and path the merged change; cancelled paths leave."""
    xs = events.groupBy(batch, "path").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "change"))).alias("xs"))
    merged = F.aggregate("xs", F.lit("N"), lambda s, x: merge_step(s, x["change"]))
    return xs.select(batch, "path", merged.alias("change")).where("change <> 'N'")


def with_batches(events: DataFrame, gap_s: int) -> DataFrame:
    """events(ts, ...) with batch_start and batch_end: a gap without any event closes a batch for all paths.

    A session over all paths would be one task. Events of one gap-wide time cell always share a batch,
    so only the cells' least and greatest times are ordered: as many rows as cells, whatever the event rate.
    """
    cell = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (gap_s * 1_000_000))
    e = events.withColumn("cell", cell)
    cells = e.groupBy("cell").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = W.orderBy("cell")
    opens = F.when(F.unix_micros(F.col("lo").cast("timestamp")) - F.unix_micros(F.lag("hi").over(w).cast("timestamp")) < gap_s * 1_000_000, None).otherwise(F.col("lo"))
    starts = cells.withColumn("start", opens).withColumn("batch_start", F.last("start", ignorenulls=True).over(w))
    ends = starts.groupBy("batch_start").agg(F.max("hi").alias("batch_end"))
    return e.join(F.broadcast(starts.select("cell", "batch_start").join(ends, "batch_start")) if _few(cells) else starts.select("cell", "batch_start").join(ends, "batch_start"), "cell").drop("cell")


def _few(cells: DataFrame, most: int = 1_000_000) -> bool:
    return cells.limit(most + 1).count() <= most


def debounce(events: DataFrame, gap_s: int) -> DataFrame:
    """events(ts, event_id, path, change) -> batch_start, path, change: the merged change of each path in each batch."""
    return fold_changes(with_batches(events, gap_s), "batch_start")


def source_events(raw: DataFrame) -> DataFrame:
    """raw(ts, event_id, path, kind created, modified, deleted or moved, dest) -> ts, event_id, path, change. A move is a deletion and a creation."""
    one = F.struct(F.col("path"), F.when(F.col("kind") == "created", "C").when(F.col("kind") == "deleted", "D").otherwise("M").alias("change"))
    two = F.array(F.struct(F.col("path"), F.lit("D").alias("change")), F.struct(F.col("dest").alias("path"), F.lit("C").alias("change")))
    return raw.select("ts", "event_id", F.explode(F.when(F.col("kind") == "moved", two).otherwise(F.array(one))).alias("x")).select("ts", "event_id", "x.path", "x.change")


#: Files whose change makes the rules of a batch be read again first.
RULE_FILES = (".gitignore", ".docs.json")


def rules_changed(batch: DataFrame) -> bool:
    """Whether batch(path) touches a rule file."""
    return batch.where(F.element_at(F.split("path", "/"), -1).isin(*RULE_FILES)).limit(1).count() > 0


class DebouncedStream:
    """Debounce of a change stream by micro-batches, equal to debounce() on all its events.

    Each micro-batch joins what earlier ones left open, hands on the batches that a gap has closed and writes
    the rest to the shared folder. Events that come after their batch was closed are written as late and not
    merged. A micro-batch that is run again reads and writes the same tables, so a retry repeats its result.
    """

    def __init__(self, folder: str, gap_s: int, on_batch):
        """on_batch(changes DataFrame of batch_start, path, change, number of the micro-batch)."""
        self.folder, self.gap_s, self.on_batch = folder, gap_s, on_batch

    def _read(self, spark, name: str):
        path = f"{self.folder}/{name}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None

    def __call__(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.select("ts", "event_id", "path", "change")
        state, before = self._read(spark, f"closed-{number - 1}"), self._read(spark, f"open-{number - 1}")
        closed = state.first()["until"] if state is not None else None
        if closed is not None:
            rows.where(F.col("ts") <= F.lit(closed)).write.mode("overwrite").parquet(f"{self.folder}/late-{number}")
            rows = rows.where(F.col("ts") > F.lit(closed))
        every = rows if before is None else before.unionByName(rows)
        every.write.mode("overwrite").parquet(f"{self.folder}/seen-{number}")
        every = spark.read.parquet(f"{self.folder}/seen-{number}")
        latest = every.agg(F.max("ts")).first()[0]
        placed = with_batches(every, self.gap_s)
        open_ = F.unix_micros(F.lit(latest).cast("timestamp")) - F.unix_micros(F.col("batch_end").cast("timestamp")) < self.gap_s * 1_000_000
        placed.where(open_).select("ts", "event_id", "path", "change").write.mode("overwrite").parquet(f"{self.folder}/open-{number}")
        done = placed.where(~open_)
        until = done.agg(F.max("batch_end")).first()[0]
        spark.createDataFrame([(until or closed,)], "until timestamp").write.mode("overwrite").parquet(f"{self.folder}/closed-{number}")
        self.on_batch(fold_changes(done, "batch_start"), number)
        for name in ("seen", "open", "closed"):  # a retry needs the tables of the micro-batch before it, not older ones
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{number - 2}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def incremental_batch(changes: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """changes(path, change), stored(path, hash), current(path, hash, excluded, is_binary, language) -> path, action.

    What a batch asks for, confirmed against the files as they are: remove files that are gone or out of scope now,
    parse candidates whose hash differs from the stored one, nothing for the rest.
    """
    from ..operators.store import classify_changes, is_changed

    j = changes.select("path", "change").join(classify_changes(current), "path", "left").join(stored.select("path", F.col("hash").alias("was")), "path", "left")
    gone = (F.col("change") == "D") | F.col("hash").isNull() | (F.col("class") != "candidate")
    action = F.when(gone, F.when(F.col("was").isNotNull(), "remove").otherwise("none")).when(is_changed(F.col("hash"), F.col("was")), "parse").otherwise("none")
    return j.select("path", action.alias("action"))


#: Stages of a run in order.
STAGES = ["VALIDATING", "CHECKING_MODELS", "SCANNING", "PARSING", "BUILDING_GRAPH", "GENERATING_DOCS_STRUCTURE", "SUMMARIZING", "GENERATING_DOCS_CONTENT", "EMBEDDING"]
#: Types of progress events.
TYPES = ["stage", "stage_end", "items", "failed", "server_ready", "catchup"]
#: Opens a line of the progress protocol.
SENTINEL = "@@PROGRESS@@"


def parse_progress(lines: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """lines(value) -> seq, type, stage, payload of the well-formed events: the sentinel, then a JSON object with a whole seq and a known type. An unknown stage is null."""
    body = F.trim(F.substring(F.col("value"), len(sentinel) + 1, 1 << 30))
    # in brackets, so that anything after the object makes the text invalid or a second element
    listed = lines.where(F.startswith("value", F.lit(sentinel))).select(body.alias("payload"), F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).alias("w"))
    rows = listed.where("try_variant_get(w, '$[1]', 'variant') is null").select("payload", F.expr("try_variant_get(w, '$[0]', 'variant')").alias("v"))
    seq, kind, stage = (F.expr(f"try_variant_get(v, '$.{k}', 'string')") for k in ("seq", "type", "stage"))
    whole = F.expr("schema_of_variant(variant_get(v, '$.seq', 'variant'))").isin("BIGINT")
    ok = F.expr("schema_of_variant(v)").startswith("OBJECT") & whole & kind.isin(TYPES)
    return rows.where("v is not null").where(ok).select(seq.cast("long").alias("seq"), kind.alias("type"), F.when(stage.isin(STAGES), stage).alias("stage"), "payload")


def progress_lines(events: DataFrame, order: list, group: str, sentinel: str = SENTINEL) -> DataFrame:
    """events(type, stage) as protocol lines of each group, with a seq that counts from 1 in order."""
    seq = F.row_number().over(W.partitionBy(group).orderBy(*order)).alias("seq")
    return events.select(group, seq, F.concat(F.lit(sentinel), F.to_json(F.struct(seq, "type", "stage"))).alias("value"))


def run_state(events: DataFrame, terminal: tuple[str, ...] = ("error", "purchase")) -> DataFrame:
    """Fold of each path's events: number, last kind and the first terminal outcome."""
    done = F.col("event_type").isin(*terminal)
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", at).alias("last_kind"), F.min_by("event_type", F.when(done, at)).alias("outcome"))


def stage_status(events: DataFrame) -> DataFrame:
    """events(run, seq, type, stage index) -> run, stage, status of every stage that an event names, or that precedes a started one.

    A started stage is running, an ended one done, a failed one failed; items start a pending one. When a stage
    starts, all earlier ones that are pending or running are done, even if their end was lost. Of events with one seq the greater type counts.
    """
    own = events.groupBy("run", "stage").agg(
        F.max_by("type", F.when(F.col("type").isin("stage", "stage_end", "failed"), F.struct("seq", "type"))).alias("hard"),
        F.max(F.when(F.col("type").isin("stage", "stage_end", "failed"), F.col("seq"))).alias("at"),
        F.max(F.when(F.col("type") == "stage", F.col("seq"))).alias("started"), F.count_if(F.col("type") == "items").alias("items"),
    )
    later = F.max("started").over(W.partitionBy("run").orderBy(F.desc("stage")).rowsBetween(W.unboundedPreceding, -1))
    j = own.withColumn("later", later)
    passed = F.col("later").isNotNull() & (F.col("at").isNull() | (F.col("later") > F.col("at")))
    status = F.when(F.col("hard") == "failed", "failed").when(F.col("hard") == "stage_end", "done").when(passed, "done").when((F.col("hard") == "stage") | (F.col("items") > 0), "running").otherwise("pending")
    return j.select("run", "stage", status.alias("status"))


def health(query) -> dict:
    """State of a running query: whether it is active, and what stopped it. Reading it never raises."""
    failed = query.exception()
    return {"active": query.isActive, "error": None if failed is None else str(failed).splitlines()[0]}
