"""The streaming sources, stopped and started again."""

import collections
import random

import pytest

from tessera.sources import change_source as cs


@pytest.fixture(scope="module")
def known(spark):
    cs.register(spark)
    return spark


def drain(spark, fmt, path, checkpoint, fail_at=None, **options):
    got = []

    def keep(rows, n):
        got.extend(map(tuple, rows.collect()))
        if n == fail_at:
            raise RuntimeError("stop")

    q = spark.readStream.format(fmt).options(path=path, **options).load().writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:
        assert fail_at is not None
    return got


def test_snapshots(known, tmp_path):
    rng = random.Random(1)
    folder, checkpoint = str(tmp_path / "s"), str(tmp_path / "c")
    states = [{}]
    for _ in range(4):
        state = dict(states[-1])
        for p in rng.sample(range(40), 15):
            if rng.random() < 0.4:
                state.pop(f"p{p}", None)
            else:
                state[f"p{p}"] = f"h{rng.randrange(3)}"
        states.append(state)
    states.append({})  # all gone

    def write(i):
        cs.write_snapshot(known.createDataFrame(list(states[i].items()), "path string, hash string"), folder, i, buckets=3)

    def between(i):
        a, b = states[i - 1], states[i]
        return [(i, p, "created" if p not in a else "modified", b[p]) for p in b if a.get(p) != b[p]] + [(i, p, "deleted", None) for p in a if p not in b]

    key = lambda r: tuple(map(str, r))
    write(1), write(2)
    first = drain(known, "snapshot_changes", folder, checkpoint, buckets=3)
    assert sorted(first, key=key) == sorted(between(1) + between(2), key=key)
    assert drain(known, "snapshot_changes", folder, checkpoint, buckets=3) == []
    write(3)
    broken = drain(known, "snapshot_changes", folder, checkpoint, fail_at=1, buckets=3)
    write(4), write(5)
    again = [r for _ in range(2) for r in drain(known, "snapshot_changes", folder, checkpoint, buckets=3)]  # the failed micro-batch once more, then what came meanwhile
    assert collections.Counter(broken) == collections.Counter(between(3)) and collections.Counter(again) == collections.Counter(between(3) + between(4) + between(5))


def test_growing_lines(known, tmp_path, monkeypatch):
    folder, checkpoint = tmp_path / "l", str(tmp_path / "c")
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nhal")
    (folder / "_b.log").write_text("hidden\n")
    assert sorted(v for _, v in drain(known, "growing_lines", str(folder), checkpoint)) == ["one", "two"]
    with (folder / "a.log").open("a") as f:
        f.write("f\n\né\n")
    (folder / "c.log").write_text("x" * 200_000 + "\nno end")
    assert sorted(v for _, v in drain(known, "growing_lines", str(folder), checkpoint)) == ["", "half", "x" * 200_000, "é"]
    assert drain(known, "growing_lines", str(folder), checkpoint) == []
    monkeypatch.setattr(cs, "SPLIT_BYTES", 10)
    reader = cs.LineReader({"path": str(folder)})
    parts = reader.partitions({"files": {}}, reader.latestOffset())
    lines = [v for p in parts for b in reader.read(p) for v in b.column(1).to_pylist()]
    assert sorted(lines) == ["", "half", "one", "two", "x" * 200_000, "é"] and len(parts) > 2
