"""Deterministic clustering over integer weights: propagation, folding into folders, anchors, plan repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..session import durable


def adjacency(imports: DataFrame) -> DataFrame:
    """imports(src, dst, w) -> a, b, w: the coupling of two nodes, both ways round, whoever imports whom. Linear in the edges."""
    own = imports.where("src <> dst")
    both = own.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(own.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def propagate(adj: DataFrame, seeds: DataFrame, sweeps: int = 2) -> DataFrame:
    """Synchronous sweeps: each unlabelled node takes the heaviest label around it (ties: least label); seeds stay."""
    labels = seeds.select("node", "label")
    fixed = seeds.select("node")
    for _ in range(sweeps):
        votes = adj.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        won = votes.groupBy("a").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")).select(F.col("a").alias("node"), "label")
        labels = seeds.select("node", "label").unionByName(won.join(fixed, "node", "left_anti"))
    return labels


def absorb_small(members: DataFrame, adj: DataFrame, least: int = 2) -> DataFrame:
    """members(member, dir), adj(a, b, w) -> member, dir: folders of fewer than ``least`` members join another.

    A small folder goes to the large one it is coupled to most (ties: least name), else to its nearest large
    ancestor below the root, else it stays. Targets are chosen among the folders as they were.
    """
    sizes = members.groupBy("dir").agg(F.count("*").alias("n"))
    small, large = sizes.where(F.col("n") < least).select("dir"), sizes.where(F.col("n") >= least).select("dir")
    out = members.join(small, "dir", "left_semi").select(F.col("member").alias("a"), "dir")
    into = members.join(large, "dir", "left_semi").select(F.col("member").alias("b"), F.col("dir").alias("target"))
    coupled = adj.join(out, "a").join(into, "b").groupBy("dir", "target").agg(F.sum("w").alias("w"))
    coupled = coupled.groupBy("dir").agg(F.min_by("target", F.struct(-F.col("w"), F.col("target"))).alias("by_coupling"))
    up = small.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("i", "target"))
    above = up.join(large.withColumnRenamed("dir", "target"), "target").groupBy("dir").agg(F.min_by("target", "i").alias("by_path"))
    moves = small.join(coupled, "dir", "left").join(above, "dir", "left").select("dir", F.coalesce("by_coupling", "by_path").alias("target"))
    return members.join(moves, "dir", "left").select("member", F.coalesce("target", "dir").alias("dir"))


def anchors(adj: DataFrame, groups: DataFrame) -> DataFrame:
    """group, anchor: the member with the most weight inside its group (ties: least name)."""
    a = groups.select(F.col("member").alias("a"), F.col("group").alias("ga"))
    b = groups.select(F.col("member").alias("b"), F.col("group").alias("gb"))
    inner = adj.join(a, "a").join(b, "b").where("ga = gb").groupBy("ga", "a").agg(F.sum("w").alias("w"))
    return inner.groupBy("ga").agg(F.min_by("a", F.struct(-F.col("w"), F.col("a"))).alias("anchor")).select(F.col("ga").alias("group"), "anchor")


#: Members and edges of the groups that one task may hold.
TASK_MEMBERS, TASK_EDGES = 20_000, 400_000
#: Tables of a row a group are broadcast up to this many groups.
MAX_BROADCAST = 10_000


def settle_in_order(members: DataFrame, edges: DataFrame, sweeps: int) -> DataFrame:
    """members(group, member), edges(group, a, b, w) -> group, member, label: in-place propagation in the order of the members' names, over all tasks.

    In a sweep a member takes the heaviest label around it, where lesser members have their new label and greater ones the old one. These
    equations have one solution, as each label depends on lesser members only. It is found by starting with the old labels and doing anew
    those members of which a lesser neighbour changed, until none did. A round costs what changed; a sweep takes as many rounds as its longest
    chain of changes has members. Groups that a sweep left as they were are done.
    """
    # labels of a round are small as files and large in memory: all joins are by shuffles, none is sent through the driver
    label = durable(members.select("group", "member", F.col("member").alias("label")), "labels")
    near = durable(edges.select("group", "a", "b", "w", (F.col("b") < F.col("a")).alias("lesser")), "near")
    done = None
    for _ in range(sweeps):
        todo, now = None, durable(label.select("group", "member", F.col("label").alias("was"), "label"), "labels")
        while True:
            own = near if todo is None else near.join(todo.hint("merge"), ["group", "a"], "left_semi")
            votes = own.join(now.select("group", F.col("member").alias("b"), "was", "label").hint("merge"), ["group", "b"]).withColumn("vote", F.when(F.col("lesser"), F.col("label")).otherwise(F.col("was")))
            won = votes.groupBy("group", "a", "vote").agg(F.sum("w").alias("w")).groupBy("group", "a").agg(F.min_by("vote", F.struct(-F.col("w"), F.col("vote"))).alias("won"))
            after = now.join(won.withColumnRenamed("a", "member").hint("merge"), ["group", "member"], "left").select("group", "member", "was", F.coalesce("won", "label").alias("label"), (F.col("won") != F.col("label")).alias("changed"))
            now = durable(after, "labels")
            moved = now.where("changed").select("group", F.col("member").alias("b"))
            if not moved.limit(1).count():
                break
            todo = durable(near.where("lesser").join(moved.hint("merge"), ["group", "b"], "left_semi").select("group", "a").distinct(), "todo")
            now = now.drop("changed")
            if not todo.limit(1).count():
                break
        changed = durable(now.where("label <> was").select("group").distinct(), "changed")
        now = now.select("group", "member", "label")
        still = durable(now.join(changed, "group", "left_anti"), "still")
        done = still if done is None else done.unionByName(still)
        label = durable(now.join(changed, "group", "left_semi"), "labels")
        near = near.join(changed, "group", "left_semi")
        if not changed.limit(1).count():
            return done
    return label if done is None else done.unionByName(label)


def communities(adj: DataFrame, groups: DataFrame, sweeps: int = 10, threshold: int = 12) -> DataFrame:
    """adj(a, b, w), groups(group, member) of strings -> group, member, community for every member.

    Groups of more than ``threshold`` members are split by propagation in key order, in place. A split with a
    community of one member, or of one community, is dropped: then all members have the least of them as their
    community. Groups within TASK_MEMBERS and TASK_EDGES are a task each; larger ones are settled by rounds of joins, with the same labels.
    No table of a row a member is sent through the driver, however small its files are.
    """
    from ..session import ship_package

    def run(members, edges):
        import pandas as pd

        nodes = sorted(members["member"])
        near: dict = {n: [] for n in nodes}
        for a, b, w in zip(edges["a"], edges["b"], edges["w"], strict=True):
            near[a].append((b, w))
        label = {n: n for n in nodes}
        for _ in range(sweeps):
            before = dict(label)
            for n in nodes:
                votes: dict = {}
                for b, w in near[n]:
                    votes[label[b]] = votes.get(label[b], 0) + w
                if votes:
                    label[n] = min(votes, key=lambda x: (-votes[x], x))
            if label == before:
                break
        return pd.DataFrame({"group": members["group"].iloc[0], "member": nodes, "label": [label[n] for n in nodes]})

    ship_package(adj.sparkSession)
    members = durable(groups.select(F.col("group").alias("group"), F.col("member").alias("member")), "members")
    g, h = members.select(F.col("member").alias("a"), "group").hint("merge"), members.select(F.col("member").alias("b"), F.col("group").alias("gb")).hint("merge")
    inner = durable(adj.join(g, "a").join(h, "b").where("`group` = gb").select("group", "a", "b", "w"), "inner")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.min("member").alias("least")).join(inner.groupBy("group").agg(F.count("*").alias("e")).hint("merge"), "group", "left")
    sizes = durable(sizes.select("group", "least", (F.col("n") <= threshold).alias("whole"), ((F.col("n") > TASK_MEMBERS) | (F.coalesce("e", F.lit(0)) > TASK_EDGES)).alias("large")), "sizes")
    few = sizes.count() <= MAX_BROADCAST
    by_group = lambda t: F.broadcast(t) if few else t.hint("merge")
    of = lambda t, which: t.join(by_group(sizes.where(which).select("group")), "group", "left_semi")
    parts = of(members, "not whole and not large").groupBy("group").cogroup(of(inner, "not whole and not large").groupBy("group")).applyInPandas(run, "group string, member string, label string")
    if sizes.where("large and not whole").limit(1).count():
        parts = parts.unionByName(settle_in_order(of(members, "not whole and large"), of(inner, "not whole and large"), sweeps))
    label = durable(parts, "labels")
    found = label.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg((F.count("*") > 1).alias("several"), (F.min("n") > 1).alias("full"))
    split = label.join(by_group(found.where("several and full").select("group")), "group", "left_semi")
    out = members.join(by_group(sizes.select("group", "least")), "group").join(split.hint("merge"), ["group", "member"], "left")
    return out.select("group", "member", F.coalesce("label", "least").alias("community"))
