"""Operators leave the session as it is."""

from tessera.llm.queries import QUERIES


def test_settings_stay(spark):
    before = {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"}
    for name in ("op2_pii", "op3_byte_bpe", "op7_quality_rules", "op9_quality_gam", "op10_langid", "op13_packing"):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"} == before
