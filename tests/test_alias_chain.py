"""Alias chains are followed to their end."""

from tessera.operators import graph


def test_long_chain_and_cycles(spark):
    alias = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (1002, 1001)], "old long, new long")
    got = {r["old"]: r["target"] for r in graph.alias_targets(alias).collect()}
    assert got == dict.fromkeys(range(300), 300)
