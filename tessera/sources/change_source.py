"""Streaming sources: changes between snapshots of a listing, and lines of growing files.

``register(spark)`` makes both known as formats. Offsets are all that a query's checkpoint holds of them, so a query that is
stopped goes on where it was, and a micro-batch that is run again reads the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship_package

#: Bytes of a file that one task reads.
SPLIT_BYTES = 4_000_000


def write_snapshot(files: DataFrame, folder: str, number: int, buckets: int = 8) -> None:
    """files(path, hash) as snapshot ``number`` (from 1) of a folder, dealt over buckets by path. Snapshots of a folder have the same buckets."""
    rows = files.select("path", "hash", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/snapshot={number}")


def _place(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:", "file://", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Bucket(InputPartition):
    """A bucket of one snapshot."""

    def __init__(self, snapshot: int, bucket: int):
        super().__init__((snapshot, bucket))
        self.snapshot, self.bucket = snapshot, bucket


class ChangeReader(DataSourceStreamReader):
    """The offset is the number of the last snapshot that was read. Each later one is compared with the one before it, bucket by bucket."""

    def __init__(self, options: dict):
        self.folder, self.buckets = options["path"], int(options.get("buckets", 8))

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """The last of the snapshots that are complete from the first on."""
        from pyarrow import fs

        system, root = _place(self.folder)
        n = 0
        while system.get_file_info(f"{root}/snapshot={n + 1}/_SUCCESS").type == fs.FileType.File:
            n += 1
        return {"snapshot": n}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        return [Bucket(n, b) for n in range(start["snapshot"] + 1, end["snapshot"] + 1) for b in range(self.buckets)]

    def _state(self, snapshot: int, bucket: int) -> dict[str, str]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = _place(self.folder)
        place = f"{root}/snapshot={snapshot}/bucket={bucket}"
        if snapshot == 0 or system.get_file_info(place).type == fs.FileType.NotFound:
            return {}
        rows = ds.dataset(place, filesystem=system, format="parquet").to_table(columns=["path", "hash"])
        return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        was, now = self._state(partition.snapshot - 1, partition.bucket), self._state(partition.snapshot, partition.bucket)
        rows = [(p, "created" if p not in was else "modified", h) for p, h in now.items() if p not in was or was[p] != h]
        rows += [(p, "deleted", None) for p in was if p not in now]
        rows.sort(key=lambda r: r[0])
        columns = [pa.array([partition.snapshot] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["snapshot", "path", "kind", "hash"])

    def commit(self, end: dict) -> None:
        pass


class SnapshotChanges(DataSource):
    """Format ``snapshot_changes``: snapshot, path, kind (created, modified or deleted) and hash. A move is a deletion and a creation.

    Options: path, the folder of write_snapshot(); buckets, as it was written.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot_changes"

    def schema(self) -> str:
        return "snapshot long, path string, kind string, hash string"

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


class Part(InputPartition):
    """Bytes of a file from start to end, which both follow a line feed or are the file's start."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class LineReader(DataSourceStreamReader):
    """The offset is, for each file, the place after the last whole line that was read."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _place(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path.rpartition("/")[2]
            if info.type == fs.FileType.File and name[0] not in "._" and (end := self._after_line(system, info.path, info.size, 0)):
                found[info.path] = end
        return {"files": found}

    @staticmethod
    def _after_line(system, path: str, end: int, least: int) -> int:
        """The place after the last line feed before ``end``; ``least`` if there is none after it."""
        with system.open_input_file(path) as f:
            while end > least:
                start = max(least, end - 65_536)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return least

    def partitions(self, start: dict, end: dict) -> list[Part]:
        system, _ = _place(self.folder)
        out = []
        for path, until in sorted(end["files"].items()):
            at = start["files"].get(path, 0)
            while at < until:  # a line longer than a split makes its part longer
                stop = until if until - at <= SPLIT_BYTES else self._after_line(system, path, at + SPLIT_BYTES, at)
                if stop == at:
                    stop = until
                out.append(Part(path, at, stop))
                at = stop
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.folder)
        with system.open_input_file(partition.file) as f:
            lines = f.read_at(partition.end - partition.start, partition.start).decode("utf-8", "replace").split("\n")[:-1]
        yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(lines, pa.string())], ["file", "value"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format ``growing_lines``: file and value of each line of the files of a folder, as lines are completed. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(SnapshotChanges)
    spark.dataSource.register(GrowingLines)
