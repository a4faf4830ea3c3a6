"""Streams against the batch functions, in several micro-batches, with late rows and failures."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import changes, feed, message_log, run_states


def test_merge_machine(spark):
    want = {"NC": "C", "NM": "M", "ND": "D", "CC": "C", "CM": "C", "CD": "N", "MC": "M", "MM": "M", "MD": "D", "DC": "M", "DM": "M", "DD": "D"}
    df = spark.createDataFrame([(k[0], k[1]) for k in want], "s string, c string")
    assert {r["s"] + r["c"]: r["m"] for r in df.withColumn("m", changes.merge_step(F.col("s"), F.col("c"))).collect()} == want


def minutes(rows):
    return [(f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", i, p, c) for i, (m, p, c) in enumerate(rows)]


def test_debounced_stream_in_micro_batches(spark, tmp_path):
    parts = [
        [(0, 1, "C"), (1, 1, "M"), (2, 2, "C")],
        [(3, 2, "D"), (20, 1, "D"), (21, 1, "C")],  # closes the first batch
        [(2, 9, "M"), (22, 3, "C"), (50, 3, "M")],  # the first row is late
        [(80, 4, "D")],
    ]
    got, step = [], None
    folder = str(tmp_path)
    step = changes.DebouncedStream(folder, 300, lambda rows, n: got.extend((n, str(r["batch_start"]), r["path"], r["change"]) for r in rows.collect()))
    frame = lambda rows: spark.createDataFrame(minutes(rows), "t string, event_id long, path long, change string").selectExpr("cast(t as timestamp) ts", "event_id", "path", "change")
    for n, rows in enumerate(parts):
        step(frame(rows), n)
        again = list(got)
        step(frame(rows), n)  # a retry gives the same
        assert sorted(got[len(again) :]) == sorted(x for x in again if x[0] == n)
        got[:] = again
    every = frame([r for p in parts for r in p if r != (2, 9, "M")])
    batch = {(str(r["batch_start"]), r["path"], r["change"]) for r in changes.debounce(every, 300).collect()}
    assert {x[1:] for x in got} == {b for b in batch if "01:20" not in b[0]} and len(got) == len({x[1:] for x in got})
    assert spark.read.parquet(f"{folder}/late-2").select("path").collect()[0]["path"] == 9


def test_run_states_equal_batch(spark):
    import random

    rng = random.Random(3)
    kinds = ["stage", "stage_end", "items", "failed", "catchup"]
    rows = [(r, i, rng.choice(kinds), rng.randrange(5)) for r in range(40) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "run long, seq long, type string, stage int")
    got = {(r["run"], r["stage"]): r["status"] for r in changes.stage_status(df).collect()}
    for run in range(40):
        seen = {s for r, _, _, s in rows if r == run}
        state = dict.fromkeys(seen, "pending")
        for _, _, kind, stage in sorted(x for x in rows if x[0] == run):
            if kind == "stage":
                state = {k: "done" if k < stage and v in ("pending", "running") else v for k, v in state.items()} | {stage: "running"}
            elif kind in ("stage_end", "failed"):
                state[stage] = "done" if kind == "stage_end" else "failed"
            elif kind == "items" and state[stage] == "pending":
                state[stage] = "running"
        assert {s: v for (r, s), v in got.items() if r == run} == state


def test_stream_of_run_states_equals_batch(spark):
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    stream, batch = ({tuple(r) for r in catalogue.QUERIES[n](spark, sf).select("run", "stage", "status").collect()} for n in ("stream_run_state", "run_stage_status"))
    assert stream == batch and len({r[0] for r in batch}) > 10


def _random_events(seed, runs=12):
    import random

    rng = random.Random(seed)
    kinds = ["stage", "stage_end", "items", "failed", "catchup"]
    rows = [(r, i, rng.choice(kinds), rng.randrange(12)) for r in range(runs) for i in range(rng.randrange(1, 40))]
    rng.shuffle(rows)
    return [(*x, i * 5 // len(rows)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("arrow_rows", ["10000", "3"])
def test_run_states_for_any_split(spark, tmp_path, arrow_rows):
    """Late seqs, repeated events, runs that cross Arrow batches, a restart between micro-batches."""
    rows = _random_events(int(arrow_rows))
    schema = "run long, seq long, type string, stage int, batch int"
    again = [(*r[:4], min(4, r[4] + 1)) for r in rows[::3]]
    want = {tuple(r) for r in changes.stage_status(spark.createDataFrame(rows, schema)).collect()}
    s = feed.replay(spark.createDataFrame(rows + again, schema))
    snapshots = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        with feed.rocksdb(spark):
            for batches in (2, 9):  # stops after two micro-batches, then goes on from the checkpoint
                def keep(got, n, most=batches):
                    if n >= most:
                        raise RuntimeError("stop")
                    snapshots.extend((n, *r) for r in got.collect())

                q = run_states.stream_run_states(s).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
                try:
                    q.awaitTermination()
                except Exception as stopped:
                    assert batches == 2 and "stop" in str(stopped)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for n, run, stage, status, version, expired in sorted(snapshots):
        last[run, stage] = status
        assert not expired and version > 0
    assert {(*k, v) for k, v in last.items()} == want and len({n for n, *_ in snapshots}) == 5


def test_idle_runs_expire(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [(1, 1, "stage", 0, at(0), 0), (2, 1, "stage", 3, at(0), 0), (1, 2, "stage", 1, at(20), 1), (2, 2, "items", 2, at(1), 1), (3, 1, "stage_end", 0, at(50), 2), (9, 1, "items", 0, at(59), 3)]
    s = feed.replay(spark.createDataFrame(rows, "run long, seq long, type string, stage int, t string, batch int").selectExpr("run", "seq", "type", "stage", "cast(t as timestamp) ts", "batch"))
    with feed.rocksdb(spark):
        got = []
        q = run_states.stream_run_states(s.withWatermark("ts", "0 seconds"), idle_ms=600_000).writeStream.foreachBatch(lambda r, n: got.extend(map(tuple, r.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {x[:3] for x in got if x[4]} == {(1, 0, "done"), (1, 1, "failed"), (2, 2, "done"), (2, 3, "failed")}
    assert (1, 1, "running") in {x[:3] for x in got if not x[4]}


def test_an_operator_before_a_stream_changes_nothing(spark):
    """Queries leave the session's settings as they are."""
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    before = {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"}
    for name in ("hash_embedding", "stream_run_state", "bm25_topk"):
        catalogue.QUERIES[name](spark, sf).collect()
    assert {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"} == before


def test_health_of_a_failed_stream(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def broken(rows, n):
        raise ValueError("no luck")

    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no luck"):
        q.awaitTermination(60)
    state = changes.health(q)
    assert state["active"] is False and "no luck" in str(q.exception())


def test_watch_reports_a_failure_once(spark, tmp_path):
    import time

    told = []
    watch = message_log.QueryWatch(lambda name, why: told.append((name, why)))
    spark.streams.addListener(watch)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

        def broken(rows, n):
            raise ValueError("no luck")

        for name, step in (("good", lambda rows, n: rows.count()), ("bad", broken)):
            q = s.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            try:
                q.awaitTermination(60)
            except Exception:
                assert name == "bad"
        until = time.time() + 20
        while len(watch.ended) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert [n for n, _ in told] == ["bad"] and "no luck" in told[0][1]
    assert 5 in watch.rows.values()


def test_rule_files(spark):
    df = spark.createDataFrame([("a/b.py",), ("sub/.gitignore",)], "path string")
    assert changes.rules_changed(df) and not changes.rules_changed(df.where("path = 'a/b.py'"))
