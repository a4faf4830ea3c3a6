"""The index kept by changes against a build from nothing, with micro-batches run again, failures, moves and rules."""

import random

from pyspark.sql import functions as F

from tessera.streaming.reindex import Reindexer
from tessera.streaming.state_log import StateLog


def source(i, calls, ok=True):
    return f"def f{i}():\n" + "".join(f"    f{c}()\n" for c in calls) + "    return 1\n" if ok else "def ("


def tables(index, until):
    return {name: sorted(map(str, t.collect())) for name, t in index.tables(until).items()}


def test_stream_equals_full_build(spark, tmp_path):
    rng = random.Random(4)
    repo, states, batches = {}, [], []
    for n in range(4):
        changes = []
        for _ in range(7):
            p = rng.randrange(9)
            path = f"m/{p}.py" if p else "m/0.txt"
            if path in repo and rng.random() < 0.35:
                del repo[path]
                changes.append((path, "D"))
            else:
                changes.append((path, "M" if path in repo else "C"))
                repo[path] = source(rng.randrange(6), [rng.randrange(6) for _ in range(2)], rng.random() < 0.85)
        if n == 2:
            changes.append(("sub/.gitignore", "M"))
        states.append(dict(repo))
        batches.append(changes)

    def make(folder, at):
        frame = lambda n: spark.createDataFrame(list(states[at(n)].items()), "path string, text string")
        rule = lambda n: (lambda p: F.regexp_extract(p, r"(\d)", 1).isin(*(["3"] if at(n) < 2 else ["4", "5"])))
        listing = lambda n: frame(n).select("path", F.when(F.col("path").endswith(".py"), "Python").alias("language"))
        return Reindexer(spark, str(folder), listing, lambda paths, n: frame(n).join(paths, "path", "left_semi"), rule, lambda t: F.when(F.ascii(F.substring(t, 6, 1)) % 3 != 0, F.upper(t)), lambda t: F.array(F.length(t).cast("double")), compact_every=2)

    rows = lambda changes: spark.createDataFrame([(f"2024-01-01 00:00:{i:02d}", i, *c) for i, c in enumerate(changes)], "t string, event_id long, path string, change string").selectExpr("cast(t as timestamp) ts", "event_id", "path", "change")
    live = make(tmp_path / "live", lambda n: n)
    for n, changes in enumerate(batches):
        live(rows(changes), n)
        if n == 1:
            live(rows(changes), n)  # run again, as after a lost driver
    whole = make(tmp_path / "whole", lambda n: 3)
    whole(rows([(p, "C") for p in states[3]]), 0)
    got, want = tables(live, 3), tables(whole, 0)
    assert got == want and all(len(want[t]) > 1 for t in ("files", "symbols", "edges", "summaries", "chunks", "search"))
    assert any("failure" in r for r in got["files"])
    assert spark.read.parquet(f"{tmp_path}/live/summaries/rows").groupBy("content").count().where("count > 1").count() == 0  # nothing is summarised twice


def test_created_again_and_deleted(spark, tmp_path):
    """A file of the index that one micro-batch names as created and as deleted is gone."""
    states = [{"a.py": source(1, [2]), "b.py": source(2, [1])}, {"b.py": source(2, [1])}]
    frame = lambda n: spark.createDataFrame(list(states[n].items()), "path string, text string")
    index = Reindexer(spark, str(tmp_path / "index"), lambda n: frame(n).select("path", F.lit("Python").alias("language")), lambda paths, n: frame(n).join(paths, "path", "left_semi"), lambda n: lambda p: F.lit(False), lambda t: F.upper(t), lambda t: F.array(F.length(t).cast("double")))
    for n, changes in enumerate([[("a.py", "C"), ("b.py", "C")], [("a.py", "C"), ("a.py", "D"), ("new.py", "C"), ("new.py", "D")]]):
        index(spark.createDataFrame([(i, i, *c) for i, c in enumerate(changes)], "ts long, event_id long, path string, change string"), n)
    t = index.tables(1)
    assert [r["path"] for r in t["files"].collect()] == ["b.py"] and {r["file"] for r in t["symbols"].collect()} == {"b.py"}
    assert {r["file"] for r in t["chunks"].collect()} == {"b.py"} and all(r["dst"].startswith("unresolved::") for r in t["edges"].collect())


def test_state_log(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"), "k", "k string, v long", compact_every=3)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long")
    want = {}
    for n in range(8):
        keys = [f"k{(n * 5 + i) % 7}" for i in range(3)]
        rows = [(k, n * 10 + j) for k in keys[: 2 + n % 2] for j in range(2)]
        for _ in range(1 + n % 2):  # some are run again
            log.write(n, frame([(k, 0) for k in keys]), frame(rows))
        for k in keys:
            want.pop(k, None)
        for k, v in rows:
            want.setdefault(k, []).append(v)
        assert sorted(map(tuple, log.current(n).collect())) == sorted((k, v) for k, vs in want.items() for v in vs)
    assert log._base(7) == 6 and log.current(-1).count() == 0


def test_a_step_merges_each_log_few_times_and_writes_at_once(spark, tmp_path, monkeypatch):
    """Resolving names reads the symbols in force many times: the log is merged once for all of it, and tables that do not need one another are written at the same time."""
    import threading

    merged, threads = [], set()
    current, save = StateLog.current, StateLog._save
    monkeypatch.setattr(StateLog, "current", lambda self, until: merged.append((self.folder.rsplit("/", 1)[1], until)) or current(self, until))
    monkeypatch.setattr(StateLog, "_save", lambda self, rows, place: threads.add((self.folder.rsplit("/", 1)[1], threading.get_ident())) or save(self, rows, place))
    files = {"a.py": source(1, [2]), "b.py": source(2, [1])}
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    index = Reindexer(spark, str(tmp_path / "index"), lambda n: frame.select("path", F.lit("Python").alias("language")), lambda paths, n: frame.join(paths, "path", "left_semi"), lambda n: lambda p: F.lit(False), lambda t: F.upper(t), lambda t: F.array(F.length(t).cast("double")))
    index(spark.createDataFrame([(0, 0, p, "C") for p in files], "ts long, event_id long, path string, change string"), 0)
    assert merged.count(("symbols", 0)) == 1 and {r["file"] for r in index.current("edges", 0).collect()} == set(files)
    assert threading.get_ident() not in {t for _, t in threads} and len({n for n, _ in threads}) == 7


def test_together_raises_what_a_job_raises():
    import pytest

    from tessera.session import together

    done = []
    with pytest.raises(ZeroDivisionError):
        together(lambda: done.append(1), lambda: 1 / 0)
    assert done == [1]
