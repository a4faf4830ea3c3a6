"""A table replayed as a stream, one micro-batch for each value of a column."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def replay(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """rows as a stream of micro-batches in the order of the whole number ``batch``, which stays a column.

    Each value is written as one file, so values are to be chosen such that each has what one task can hold. A file
    stream goes by modification time, which is set in order of the values once all files are there.
    """
    spark = rows.sparkSession
    place = folder(spark, "feed")
    rows.repartition(batch).write.partitionBy(batch).parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for d in fs.listStatus(path):
        if d.isDirectory():
            found += [(int(d.getPath().getName().split("=")[1]), f.getPath()) for f in fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet")]
    start = max([f.getModificationTime() for _, p in found for f in [fs.getFileStatus(p)]], default=0) - 1000 * (len(found) + 1)
    for i, (_, p) in enumerate(sorted(found, key=lambda x: x[0])):
        fs.setTimes(p, start + 1000 * i, -1)
    schema = rows.drop(batch).withColumn(batch, F.lit(0)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives in append mode until its source is read, as a table."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@contextmanager
def rocksdb(spark: SparkSession):
    """State of streams that start inside is kept in RocksDB, as keyed state of several kinds needs; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)
