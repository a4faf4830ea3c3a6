"""The table of registered queries and of the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table, beside ``sql_values`` for the SQL side."""
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, rows: list[tuple], columns: str) -> str:
    """The same table as a common table expression."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"
