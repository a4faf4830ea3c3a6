"""Typed property graph over edges(src, dst, type): neighbours, ego nets, bounded walks, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import suffixes
from ..session import durable

#: Ids are broadcast only up to this many.
MAX_BROADCAST_IDS = 1_000_000


def dedupe_edges(edges: DataFrame, order: str) -> DataFrame:
    """One row a (src, dst, type); the metadata of the first by ``order`` stays."""
    return edges.groupBy("src", "dst", "type").agg(F.min_by("metadata", order).alias("metadata"))


def count_by_type(edges: DataFrame) -> DataFrame:
    """edges without repeats -> type, n, n_src, n_dst: edges and different ends of each type. Each side is counted by its own shuffle; no row is copied for the other one."""
    ends = [edges.groupBy("type", end).agg(F.count("*").alias("n")).groupBy("type").agg(F.sum("n").alias("n"), F.count(end).alias("ends")) for end in ("src", "dst")]
    both = ends[0].select("type", "n", F.col("ends").alias("n_src"), F.lit(0).alias("n_dst")).unionByName(ends[1].select("type", F.lit(0).alias("n"), F.lit(0).alias("n_src"), F.col("ends").alias("n_dst")))
    return both.groupBy("type").agg(F.sum("n").alias("n"), F.sum("n_src").alias("n_src"), F.sum("n_dst").alias("n_dst"))


def dependencies(edges: DataFrame, ids: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """id, other, type: what each of ids(id) points at; without ids, what any node does."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    e = e if ids is None else e.join(ids, F.col("src") == F.col("id"), "left_semi")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type").distinct()


def dependents(edges: DataFrame, ids: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    return dependencies(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"), ids, kind)


def neighbours(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, other: both ways, of ids(id) or of all nodes. Repeats leave once, at the end."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    return (both if ids is None else both.join(ids.select("id"), "id", "left_semi")).distinct()


def ego_network(edges: DataFrame, root: str) -> DataFrame:
    """Edges induced by the root and its neighbours; empty for an unknown root."""
    touch = edges.where((F.col("src") == root) | (F.col("dst") == root))
    nodes = touch.select(F.col("src").alias("id")).union(touch.select(F.col("dst").alias("id"))).distinct()
    inside = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi")
    return inside.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type").distinct()


def ego_networks(edges: DataFrame, roots: DataFrame, once: bool = False) -> DataFrame:
    """root, src, dst, type: for each root(id) the edges induced by it and its neighbours; none for a root without edges. With ``once`` edges are a stored table without repeats."""
    r = roots.select(F.col("id").alias("root")).distinct()
    out = edges.join(r, F.col("src") == F.col("root")).select("root", "src", "dst")
    into = edges.join(r, F.col("dst") == F.col("root")).select("root", "src", "dst")
    nodes = out.union(into).select("root", F.explode(F.array("src", "dst")).alias("id")).distinct()
    every = edges.select("src", "dst", "type")
    inside = (every if once else every.distinct()).join(nodes.withColumnRenamed("id", "src"), "src")
    return inside.join(nodes.withColumnRenamed("id", "dst"), ["root", "dst"], "left_semi").select("root", "src", "dst", "type")


def degree(edges: DataFrame) -> DataFrame:
    """id, degree: distinct related nodes both ways."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    return both.distinct().groupBy("id").agg(F.count("*").alias("degree"))


def _if_small(ids: DataFrame) -> DataFrame:
    """A durable table of ids, broadcast if it is small enough; the edges then stay where they are."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def bfs(edges: DataFrame, roots: DataFrame, depth: int = 6, once: bool = False) -> DataFrame:
    """id, depth: least number of steps from any root. With ``once`` edges are a stored table without repeats. Each level writes its new nodes only; seen nodes leave by anti-join."""
    found = _levels(edges, roots.select(F.lit(0).alias("root"), "id").distinct(), depth, once)
    return found.select("id", "depth")


def bfs_of_each(edges: DataFrame, roots: DataFrame, depth: int = 6, once: bool = False) -> DataFrame:
    """root, id, depth: least number of steps from each root(id), as in bfs but for each root alone."""
    return _levels(edges, roots.select(F.col("id").alias("root"), "id").distinct(), depth, once)


def _levels(edges: DataFrame, starts: DataFrame, depth: int, once: bool) -> DataFrame:
    e = edges if once else durable(edges.select("src", "dst").distinct(), "edges")
    seen = frontier = durable(starts.withColumn("depth", F.lit(0)), "frontier")
    for d in range(1, depth + 1):
        step = e.join(_if_small(frontier.select("root", F.col("id").alias("src"))), "src").select("root", F.col("dst").alias("id")).distinct()
        frontier = durable(step.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def dfs_of_each(calls: DataFrame, roots: DataFrame, depth: int = 6, most: int = 1000) -> DataFrame:
    """calls(src, dst, line), roots(id) -> root, id, depth, position, truncated: pre-order walks, children by (line, id).

    There is no visited set: a repeated call is walked again. A walk is cut after ``most`` steps, and truncated
    says so; the paths that can stand among the first ones are all a level keeps, so a walk does not grow with
    the number of paths.
    """
    kids = calls.select("src", F.col("dst").alias("id"), F.concat(F.lpad(F.col("line").cast("string"), 9, "0"), F.lit(":"), "dst").alias("step")).distinct()
    kids = durable(kids, "calls")
    level = walk = durable(roots.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)).withColumn("path", F.lit("")), "level")
    by_path = W.partitionBy("root").orderBy("path")
    for d in range(1, depth + 1):
        step = level.select("root", F.col("id").alias("src"), "path").join(kids, "src").select("root", "id", F.lit(d).alias("depth"), F.concat("path", F.lit("\u0001"), "step").alias("path"))
        level = durable(step.withColumn("r", F.row_number().over(by_path)).where(F.col("r") <= most).drop("r"), "level")
        if not level.limit(1).count():
            break
        walk = walk.unionByName(level)
    placed = walk.withColumn("position", (F.row_number().over(by_path) - 1).cast("bigint"))
    cut = F.max(F.col("position") >= most).over(W.partitionBy("root"))
    return placed.withColumn("truncated", cut).where(F.col("position") < most).select("root", "id", "depth", "position", "truncated")


def alias_targets(alias: DataFrame) -> DataFrame:
    """alias(old, new) -> old, target: where the chain of each old ends. Pointer doubling; a cycle has no target.

    A chain has at most as many hops as alias has rows, so doublings up to that length leave only cycles.
    """
    a = alias.select("old", F.col("new").alias("target"))
    live = alias.select(F.col("old").alias("target")).distinct()
    for _ in range(alias.count().bit_length()):
        if not a.join(live, "target", "left_semi").limit(1).count():
            break
        nxt = a.select(F.col("old").alias("target"), F.col("target").alias("jump"))
        a = durable(a.join(nxt, "target", "left").select("old", F.coalesce("jump", "target").alias("target")), "alias")
    return a.join(live, "target", "left_anti").select("old", "target")


def entry_points(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """symbols(id) that no call(dst) targets."""
    return symbols.join(calls.select(F.col("dst").alias("id")), "id", "left_anti")


def resolve_unique_suffix(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(name) -> the path that ends with it, if exactly one does. Suffixes are exploded, so the join is an equi-join."""
    tails = paths.select("path", F.explode(suffixes(F.col("path"))).alias("name"))
    hit = tails.join(wanted.select("name").distinct(), "name").groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    return wanted.select("name").distinct().join(hit.where("n = 1").select("name", "path"), "name", "left")
