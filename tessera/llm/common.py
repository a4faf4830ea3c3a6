"""What the training-data operators share: durable tables, document keys, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, ship_package, table  # noqa: F401

#: Stands for a null doc_id inside joins; sorts before every real id.
NULL_ID = -(2**63)


def id_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col), F.lit(NULL_ID))


def free_name(docs: DataFrame, name: str = "__key") -> str:
    """name, or as many underscores after it as no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with a caller's own column __key under a free name, and the columns' names then by their names before."""
    own = next((c for c in docs.columns if c.lower() == "__key"), None)
    if own is None:
        return docs, {c: c for c in docs.columns}
    aside = free_name(docs)
    return docs.withColumnRenamed(own, aside), {c: aside if c == own else c for c in docs.columns}


def row_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a long __key of its own for each row, in the order of doc_id, and whether doc_ids repeat.

    The key is id_key() where that is unique. Else it numbers the rows by (doc_id, text, other columns),
    nulls first; rows are written once, so that a number stays with its row.
    """
    if not docs.groupBy(id_key().alias("__key")).count().where("count > 1").limit(1).count():
        return docs.withColumn("__key", id_key()), False
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    ordered = docs.orderBy("doc_id", "text", *([F.to_json(F.struct(*rest))] if rest else []))
    return durable(ordered.withColumn("__key", F.monotonically_increasing_id()), "rows"), True


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn: list of columns as Python lists, one call a batch -> dict of columns. Arrow both ways."""
    names = df.columns
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = fn(*(b.column(n).to_pylist() for n in names))
            yield from (out if isinstance(out, list) else [out])

    return df.mapInArrow(run, schema)


#: Rows that a worker turns into Python objects at a time: texts can be long.
ARROW_ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Spark bounds an Arrow batch by bytes; this cuts it by rows as well, and leaves the session's settings alone."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def as_utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
