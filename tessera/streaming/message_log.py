"""A log of messages that a stream appends to, and a watch over running queries."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .state_log import StateLog


class MessageLog:
    """Messages numbered from 1 on in each session, for foreachBatch.

    The next number of a session comes from a table of counters, which has one row a session, and not from the log. A micro-batch
    reads the counters as they were before it and writes its own rows and counters under its number, so running it again
    adds nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, order: list[str]):
        """schema of the messages, session long first; order: columns that order a session's messages of one micro-batch."""
        self.spark, self.folder, self.schema, self.order = spark, folder, schema, order
        self.counters = StateLog(spark, f"{folder}/counters", "session", "session long, last long")

    def __call__(self, rows: DataFrame, number: int) -> None:
        sessions = rows.select("session").distinct()
        last = self.counters.current(number - 1).join(sessions, "session", "left_semi")
        nth = F.row_number().over(W.partitionBy("session").orderBy(*self.order))
        numbered = rows.join(last, "session", "left").withColumn("seq", (F.coalesce("last", F.lit(0)) + nth).cast("long"))
        columns = [c.split()[0] for c in self.schema.split(", ")]
        place = f"{self.folder}/messages/batch={number}"
        numbered.select(*columns, "seq").write.mode("overwrite").parquet(place)
        written = self.spark.read.schema(f"{self.schema}, seq long").parquet(place)
        self.counters.write(number, written.select("session"), written.groupBy("session").agg(F.max("seq").alias("last")))

    def messages(self) -> DataFrame:
        """All messages with their seq."""
        return self.spark.read.schema(f"{self.schema}, seq long, batch int").parquet(f"{self.folder}/messages").drop("batch")


class QueryWatch(StreamingQueryListener):
    """Told of streaming queries by Spark, without polling. Add it by spark.streams.addListener().

    A query that fails is reported once, by its run; one that stops in good order is not. rows counts what each run has read.
    """

    def __init__(self, on_failure: Callable[[str, str], None]):
        """on_failure(name or id of the query, what stopped it)."""
        self.on_failure = on_failure
        self.rows: dict[str, int] = {}
        self.names: dict[str, str] = {}
        self.ended: set[str] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        with self._lock:
            run = str(event.progress.runId)
            self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        with self._lock:
            first = run not in self.ended
            self.ended.add(run)
        if first and event.exception:
            self.on_failure(self.names.get(run, str(event.id)), event.exception.strip())
