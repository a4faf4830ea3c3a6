"""Tables that micro-batches maintain: append-only, versioned by the number of the micro-batch, safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import together


class StateLog:
    """Rows that belong to a key, of which a micro-batch replaces those of the keys it touches.

    A micro-batch writes the keys it touches and their new rows, nothing else, so its cost is that of the change. The
    rows of a key are those of the last micro-batch that touched it; a key without rows then is gone. Every ``compact_every``
    micro-batches the rows in force are written once more as a base, so that readers meet a bounded number of
    micro-batches. Running a micro-batch again overwrites what it wrote. Rows may be laid out by a column ``partition``, in the
    order that the writer gave them.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, compact_every: int = 20, partition: str | None = None):
        self.spark, self.folder, self.key, self.schema, self.compact_every, self.partition = spark, folder, key, schema, compact_every, partition
        self.kind = next(c.split()[1] for c in schema.split(", ") if c.split()[0] == key)

        self.columns = [c.split()[0] for c in schema.split(", ")]

    def _save(self, rows: DataFrame, place: str) -> None:
        w = rows.write.mode("overwrite")
        (w.partitionBy(self.partition) if self.partition else w).parquet(f"{self.folder}/{place}")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _base(self, until: int) -> int:
        """The newest base that holds all of the micro-batches up to it; 0 if there is none."""
        for n in range(until - until % self.compact_every, 0, -self.compact_every):
            if self._exists(f"{self.folder}/base/until={n}/_SUCCESS"):
                return n
        return 0

    def _read(self, name: str, schema: str, base: int, until: int) -> DataFrame:
        paths = [p for n in range(base, until + 1) if self._exists(p := f"{self.folder}/{name}/batch={n}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def current(self, until: int) -> DataFrame:
        """The rows in force after micro-batch ``until``; -1 is before the first."""
        base = self._base(until)
        last = self._read("touched", f"{self.key} {self.kind}", base, until).groupBy(self.key).agg(F.max("batch").alias("batch"))
        rows = self._read("rows", self.schema, base, until).join(last, [self.key, "batch"], "left_semi").drop("batch")
        if not base:
            return rows.select(*self.columns)
        # a base has what the micro-batches before it left
        kept = self.spark.read.schema(self.schema).parquet(f"{self.folder}/base/until={base}").join(last, self.key, "left_anti")
        return kept.select(*self.columns).unionByName(rows.select(*self.columns))

    def write(self, batch: int, touched: DataFrame, rows: DataFrame) -> None:
        """rows of the keys in touched(key) replace all that these had."""
        jobs = [lambda: touched.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.folder}/touched/batch={batch}"), lambda: self._save(rows.select(*self.columns), f"rows/batch={batch}")]
        if batch and batch % self.compact_every == 0:  # what earlier micro-batches left
            jobs.append(lambda: self._save(self.current(batch - 1), f"base/until={batch}"))
        together(*jobs)

    def written(self, batch: int) -> DataFrame:
        """The rows that this micro-batch wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows/batch={batch}")

    def touched(self, batch: int) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}").parquet(f"{self.folder}/touched/batch={batch}")
