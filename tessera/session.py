"""Session helpers: table loading and shipping this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package once a session, as Python functions are pickled by reference."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer files than cores is dealt over the cores only up to this many bytes.
SMALL_TABLE_BYTES = 128_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table as it is, unless it lies in so few and small files that most cores would idle: then its rows are dealt over all cores.

    A file of one row group is one task, however long its texts. Tables of more than SMALL_TABLE_BYTES have row groups enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    files = df.inputFiles()
    small = 0 < len(files) < cores and sum(_length(df.sparkSession, f) for f in files) <= SMALL_TABLE_BYTES
    return df.repartition(cores) if small else df


def _length(spark: SparkSession, uri: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getLen()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table for work on whole texts."""
    return spread(table(spark, sf_dir, "documents"))


_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a fresh local one in local mode (tests); a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def durable(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing.

    It lies in the innermost scratch() folder, if there is one, unless a folder is given.
    """
    spark = df.sparkSession
    path = os.path.join(folder or (_SCRATCH[-1] if _SCRATCH else shared_dir(spark)), f"tessera-{tag}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def together(*jobs: Callable[[], object]) -> None:
    """Jobs that do not need one another, at the same time: small ones mostly wait for the driver, not for cores."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for running in [pool.submit(inheritable_thread_target(job)) for job in jobs]:
            running.result()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(*tables: DataFrame) -> None:
    """Deletes durable tables that no plan yet to run reads."""
    for t in tables:
        _delete(t.sparkSession, t._durable_path)


@contextmanager
def scratch(spark: SparkSession):
    """Durable tables made inside are deleted at the end; what shall stay is written to a folder outside first."""
    folder = os.path.join(shared_dir(spark), f"tessera-scratch-{uuid.uuid4().hex}")
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.remove(folder)
        _delete(spark, folder)
