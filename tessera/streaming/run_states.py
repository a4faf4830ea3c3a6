"""States of runs as a stateful stream.

A run's stages follow from its events in order of their seq, yet events come in any order and may come twice. So the state
of a stage is what does not depend on the order of arrival: the last deciding event by seq, the last start, and whether items were
seen. Two states of a stage merge into one by taking the later of each; that is all a micro-batch does, however Spark splits it into
Arrow batches. Late events count at their place in the order, and no event is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..session import ship_package

#: Events that decide a stage's status, and the status they give.
DECIDES = {"stage": "running", "stage_end": "done", "failed": "failed"}
_NONE = -(2**63)
SNAPSHOT = "run long, stage int, status string, version long, expired boolean"


def merged(a: tuple, b: tuple) -> tuple:
    """States are (seq and type of the last deciding event, seq of the last start, whether items were seen); of one seq the greater type counts."""
    return (*max(a[:2], b[:2]), max(a[2], b[2]), a[3] or b[3])


def state_of(events: pd.DataFrame) -> dict[int, tuple]:
    """stage -> state of some of a run's events (seq, type, stage)."""
    out: dict[int, tuple] = {}
    for seq, kind, stage in events[["seq", "type", "stage"]].itertuples(index=False):
        hard = kind in DECIDES
        own = (int(seq) if hard else _NONE, kind if hard else "", int(seq) if kind == "stage" else _NONE, kind == "items")
        out[int(stage)] = merged(out[int(stage)], own) if int(stage) in out else own
    return out


def statuses(states: dict[int, tuple]) -> dict[int, str]:
    """A later stage's start ends what was pending or running before it."""
    out, later = {}, _NONE
    for stage in sorted(states, reverse=True):
        at, kind, started, items = states[stage]
        passed = later > _NONE and later > at
        out[stage] = DECIDES[kind] if kind in ("failed", "stage_end") else "done" if passed else "running" if kind == "stage" or items else "pending"
        later = max(later, started)
    return out


class RunStates(StatefulProcessor):
    """Keeps a map from stage to state for each run, and the number of events seen as the version of its snapshots.

    With ``idle_ms``, a run without events for that long (by the stream's watermark) gives a last snapshot, in which what is
    running has failed, and its state goes.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = StructType([StructField("at", LongType()), StructField("kind", StringType()), StructField("started", LongType()), StructField("items", IntegerType())])
        self.stages = handle.getMapState("stages", StructType([StructField("stage", IntegerType())]), state)
        self.version = handle.getValueState("version", StructType([StructField("events", LongType()), StructField("timer", LongType())]))

    def _held(self) -> dict[int, tuple]:
        return {int(k[0]): (v[0], v[1], v[2], bool(v[3])) for k, v in self.stages.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        events, timer = self.version.get() if self.version.exists() else (0, 0)
        fresh: dict[int, tuple] = {}
        latest = 0
        for frame in rows:
            events += len(frame)
            for stage, own in state_of(frame).items():
                fresh[stage] = merged(fresh[stage], own) if stage in fresh else own
            if self.idle_ms is not None:
                latest = max(latest, int(frame["ts"].max().timestamp() * 1000))
        for stage, own in fresh.items():
            held[stage] = merged(held[stage], own) if stage in held else own
            at, kind, started, items = held[stage]
            self.stages.updateValue((stage,), (at, kind, started, int(items)))
        if self.idle_ms is not None and latest + self.idle_ms > timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = latest + self.idle_ms
            self.handle.registerTimer(timer)
        self.version.update((events, timer))
        yield self._snapshot(key[0], statuses(held), events, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, _ = self.version.get()
        last = {stage: "failed" if s == "running" else s for stage, s in statuses(self._held()).items()}
        self.stages.clear()
        self.version.clear()
        yield self._snapshot(key[0], last, events, True)

    @staticmethod
    def _snapshot(run, status: dict[int, str], version: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(run, stage, s, version, expired) for stage, s in sorted(status.items())], columns=["run", "stage", "status", "version", "expired"])

    def close(self) -> None:
        pass


def stream_run_states(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """events(run, seq, type, stage and, with idle_ms, ts with a watermark) -> SNAPSHOT: the whole state of each run that a micro-batch touched.

    In update mode; start it inside feed.rocksdb(). After all events of a run its last snapshot is stage_status() of them.
    """
    ship_package(events.sparkSession)
    columns = ["run", "seq", "type", "stage", *(["ts"] if idle_ms is not None else [])]
    return events.select(*columns).groupBy("run").transformWithStateInPandas(RunStates(idle_ms), SNAPSHOT, "Update", "None" if idle_ms is None else "EventTime")
