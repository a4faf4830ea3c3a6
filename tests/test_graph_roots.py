"""Graph searches answer for every root, not for chosen ids."""

import pytest

from tessera.operators import graph
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ego_network", "bfs_depth_roots"])
def test_every_node_divisible_by_20_is_a_root(spark, name):
    e = catalogue.edges(spark, SF)
    nodes = {x for r in e.select("src", "dst").distinct().collect() for x in r}
    got = {r["root"] for r in catalogue.QUERIES[name](spark, SF).select("root").distinct().collect()}
    assert got == {x for x in nodes if int(x[1:]) % 20 == 0} and len(got) > 50


def test_roots_are_kept_apart(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "t"), ("a", "b", "u")], "src string, dst string, type string")
    roots = spark.createDataFrame([("a",), ("c",), ("d",), ("z",)], "id string")
    walk = sorted(map(tuple, graph.bfs_of_each(e, roots, 2).collect()))
    assert walk == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("c", "a", 1), ("c", "b", 2), ("c", "c", 0), ("c", "d", 1), ("d", "d", 0), ("z", "z", 0)]
    ego = sorted("".join(r) for r in graph.ego_networks(e, roots).collect())
    assert ego == sorted(["aabt", "aabu", "abct", "acat", "cabt", "cabu", "cbct", "ccat", "ccdt", "dcdt"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_neighbours_by_one_shuffle(spark):
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    assert plan_of(catalogue.QUERIES["both_directions"](spark, sf)).count("Exchange ") == 1
    for name in ("ego_network", "bfs_depth_roots"):  # the edges are made once and then read
        assert "lineitem" not in plan_of(catalogue.QUERIES[name](spark, sf))


def test_ends_are_counted_without_copies_of_the_edges(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("a", "c", "t"), ("d", "c", "u"), (None, "c", "u")], "src string, dst string, type string")
    out = graph.count_by_type(e)
    assert sorted(map(tuple, out.collect())) == [("t", 2, 1, 2), ("u", 2, 1, 1)] and "Expand" not in plan_of(out)
