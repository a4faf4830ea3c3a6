"""Sequential grouping operators against small hand-made and random cases."""

import random

from tessera.operators import clustering as cl
from tessera.operators import features as ft


def folded(spark, rows, adj, **kw):
    schema = "repo string, `group` string, key string, dir string, is_entry boolean"
    out = ft.fold(spark.createDataFrame(rows, schema), spark.createDataFrame([(*a,) for a in adj], "repo string, a string, b string, w long"), **kw).collect()
    return {(r["repo"], r["key"]): r["group"] for r in out}


def test_fold(spark):
    rows = [("r", "A", "a1", "x", True), ("r", "A", "a2", "x", False), ("r", "B", "b1", "y", False), ("r", "B", "b2", "y", False), ("r", "c", "c", "y/z", False), ("r", "d", "d", "q", False), ("r", "e", "e", "p", False), ("r", "f", "f", "p", False),
            ("r", "g", "g", "w", False), ("r", "h", "h", "v", True), ("s", "a1", "a1", "x", False)]
    adj = [("r", "d", "a1", 3), ("r", "a1", "d", 3), ("r", "d", "b1", 5), ("r", "b1", "d", 5), ("r", "h", "b2", 9), ("r", "b2", "h", 9)]
    got = folded(spark, rows, adj)
    assert got["r", "c"] == "B"  # the nearest folder above
    assert got["r", "d"] == "B"  # coupled most
    assert got["r", "e"] == got["r", "f"] == "e"  # a folder's leftovers combine
    assert got["r", "g"] == ft.TERMINAL and got["r", "h"] == "h"  # an entry group joins entry groups only, by coupling or folder
    assert got["s", "a1"] == "a1" and len(got) == len(rows)


def test_fold_keeps_every_module_and_the_cap(spark):
    rng = random.Random(2)
    rows = [(f"r{i % 3}", f"g{rng.randrange(60)}", f"k{i}", rng.choice(["a", "a/b", "c", "d/e/f", "."]), rng.random() < 0.1) for i in range(300)]
    adj = [(f"r{i}", f"k{a}", f"k{b}", rng.randrange(1, 5)) for i in range(3) for a, b in [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]]
    got = folded(spark, rows, adj, cap=10)
    assert len(got) == 300 and {k for _, k in got} == {r[2] for r in rows}
    for repo in ("r0", "r1", "r2"):
        assert len({g for (r, _), g in got.items() if r == repo}) <= 10 + 1


def propagated(members, edges, sweeps=10, threshold=12):
    """Member by member in key order, votes counted anew each time."""
    label = {m: m for m in members}
    if len(members) > threshold:
        for _ in range(sweeps):
            old = dict(label)
            for m in sorted(members):
                votes = {}
                for a, b, w in edges:
                    if a == m and b in label:
                        votes[label[b]] = votes.get(label[b], 0) + w
                if votes:
                    label[m] = sorted(votes, key=lambda x: (-votes[x], x))[0]
            if old == label:
                break
    sizes = [list(label.values()).count(x) for x in label.values()]
    return label if len(set(label.values())) > 1 and min(sizes) > 1 else dict.fromkeys(members, min(members))


def test_communities_keep_members_without_edges(spark, monkeypatch):
    rng = random.Random(7)
    groups = {g: [f"{g}{i:02d}" for i in range(n)] for g, n in (("a", 20), ("b", 5), ("c", 30), ("d", 16))}
    edges = {}
    for g, m in groups.items():
        half = len(m) // 2
        for x in range(len(m)):
            for y in range(len(m)):
                if x != y and (x < half) == (y < half) and rng.random() < 0.4 and not (g == "c" and x == 0):
                    edges[m[x], m[y]] = edges[m[y], m[x]] = rng.randrange(1, 4)
    rows = [(a, b, w) for (a, b), w in edges.items() if "c00" not in (a, b)]
    adj = spark.createDataFrame(rows, "a string, b string, w long")
    member = spark.createDataFrame([(g, k) for g, m in groups.items() for k in m], "group string, member string")
    got = {r["member"]: r["community"] for r in cl.communities(adj, member).collect()}
    want = {}
    for m in groups.values():
        want |= propagated(m, rows)
    assert got == want and len(got) == 71
    monkeypatch.setattr(cl, "TASK_MEMBERS", 1)  # by rounds of joins
    assert {r["member"]: r["community"] for r in cl.communities(adj, member).collect()} == want
    assert len({got[k] for k in groups["a"]}) > 1 and len({got[k] for k in groups["c"]}) == 1


def test_communities_send_no_members_through_the_driver(spark, monkeypatch):
    """Files of members are small and their rows many: joins by member shuffle, whatever the size of the files."""
    plans, plain = [], cl.durable
    monkeypatch.setattr(cl, "durable", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a))
    member = spark.createDataFrame([(g, f"{g}{i:02d}") for g in "ab" for i in range(20)], "group string, member string")
    adj = spark.createDataFrame([(f"{g}{i:02d}", f"{g}{j:02d}", 1) for g in "ab" for i in range(20) for j in range(20) if i != j and i // 10 == j // 10], "a string, b string, w long")
    out = cl.communities(adj, member)
    assert len({r["community"] for r in out.collect()}) == 4
    inner = next(p for p in plans if "gb" in p)
    last = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in inner and inner.count("SortMergeJoin") == 2 and "rightHint=(strategy=merge)" in last
    monkeypatch.setattr(cl, "MAX_BROADCAST", 1)  # as many groups as members
    plans.clear()
    assert sorted(map(tuple, cl.communities(adj, member).collect())) == sorted(map(tuple, out.collect())) and not any("Broadcast" in p for p in plans)


def test_one_large_group_settles_over_tasks(spark):
    """A group of 4,000 members and chains of changes, by joins and in place."""
    rng = random.Random(3)
    names = [f"m{i:04d}" for i in range(4000)]
    rows = {}
    for i in range(4000):
        for j in {i - 1 if i % 40 else i, rng.randrange(i // 40 * 40, i // 40 * 40 + 40), rng.randrange(4000) if i % 97 == 0 else i} - {i}:
            rows[names[i], names[j]] = rows[names[j], names[i]] = rng.randrange(1, 5)
    edges = spark.createDataFrame([("g", a, b, w) for (a, b), w in rows.items()], "group string, a string, b string, w long")
    members = spark.createDataFrame([("g", n) for n in names], "group string, member string")
    label, near = {n: n for n in names}, {n: [] for n in names}
    for (a, b), w in rows.items():
        near[a].append((b, w))
    for _ in range(2):
        for n in names:
            votes = {}
            for b, w in near[n]:
                votes[label[b]] = votes.get(label[b], 0) + w
            label[n] = min(votes, key=lambda x: (-votes[x], x)) if votes else label[n]
    got = cl.settle_in_order(members, edges, 2)
    assert {r["member"]: r["label"] for r in got.collect()} == label


def test_folding_looks_at_neighbours_only():
    """20,000 groups of one module and one large group: a step looks at what the group is coupled to and at its folder, not at all groups."""
    from time import perf_counter

    from tessera.operators import features

    n = 20_000
    rows = [(f"k{i}", f"k{i}", f"d{i % 500}/x", i % 50 == 0) for i in range(n)] + [("big", f"b{i}", f"d{i}/x", False) for i in range(500)]
    edges = [e for i in range(n) for e in ((f"k{i}", f"k{i * 7 % n}", 1), (f"k{i * 7 % n}", f"k{i}", 1)) if i * 7 % n != i]
    start = perf_counter()
    out = features._folded(features._Groups(rows, edges), 2, 32)
    assert sum(map(len, out.values())) == len(rows) and len(out) <= 32 and perf_counter() - start < 20


def test_grounding_looks_patterns_up_once(spark):
    """Each rule, and that what is read after the first pass over the texts needs no patterns."""
    texts = [
        "plain `kept`", "", "torn ` here `kept`", "[[f1]] and [[ f9 ]] `kept`", "`lost` here", "a some_name and `kept`", "your `kept`", "no name", "a.b and x/y.py, run_all() `kept`", "CamelCase `kept`",
        "a.b `kept`", "robust `lost`", "and/or `kept`", "A `kept`. B. C. D. E.",
    ]
    p = spark.createDataFrame([(i, "subsystem" if i == 13 else "lead", 0, t) for i, t in enumerate(texts)], "doc long, section string, idx int, text string")
    known = spark.createDataFrame([("kept",), ("kept",), ("a/b.py",)], "name string")
    handles, said = spark.createDataFrame([("f1",)], "handle string"), spark.createDataFrame([("CamelCase",)], "word string")
    out = ft.ground_paragraphs(p, known, handles, said=said)
    got = [r["verdict"] for r in out.orderBy("doc").collect()]
    assert got == ["kept", "G1", "G2", "G3", "G4", "G5", "G6", "G7", "G5", "kept", "kept", "G6", "kept", "G8"]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_folding_counts_the_modules_of_groups():
    """Modules of groups that are not small are one member by folder; what they fold into is that of a fold over modules. Groups of one folder are not searched one by one."""
    from time import perf_counter

    rng = random.Random(11)
    for _ in range(60):
        names = [f"k{i}" for i in range(40)]
        rows = [(rng.choice([f"g{rng.randrange(9)}", k, rng.choice(names)]), k, rng.choice(["a", "a/b", "c", "d/e/f", "."]), rng.random() < 0.1) for k in names]
        edges = [(rng.choice(names), rng.choice(names), rng.randrange(1, 4)) for _ in range(50)]
        want = {k: g for g, keys in ft._folded(ft._Groups(rows, edges), 2, 5).items() for k in keys}
        held = [g for g, *_ in rows]
        node = {k: k if held.count(g) < 2 or k in held else ft._WHOLE + g for g, k, _, _ in rows}
        groups = ft._Groups([r for r in rows if node[r[1]] == r[1]], [(node[a], node[b], w) for a, b, w in edges], [(g, d, 1, e) for g, k, d, e in rows if node[k] != k])
        to = {k: g for g, keys in ft._folded(groups, 2, 5).items() for k in keys}
        assert {k: to[node[k]] for k in names} == want
    n, start = 30_000, perf_counter()
    out = ft._folded(ft._Groups([(f"k{i}", f"k{i}", "d", False) for i in range(n)], [], [("big", "d", 5, False)]), 2, 32)
    assert len(out) == 1 and len(out["big"]) == n + 1 and perf_counter() - start < 10


def test_fold_keeps_modules_that_bear_the_name_of_a_group(spark):
    """Group b is large and holds a module named as the group a, which so has that module's folder once it joins; every module is returned once."""
    rows = [("r", "b", "a", "x", False), ("r", "b", "b1", "y", False), ("r", "b", "b2", "y", False), ("r", "a", "a1", "x", True), ("r", "a", "a2", "z", False), ("r", "s", "s", "y", None)]
    got = folded(spark, rows, [("r", "s", "a2", 1), ("r", "a2", "s", 1)], cap=2)
    assert got == {("r", "a"): "b", ("r", "b1"): "b", ("r", "b2"): "b", ("r", "a1"): "a", ("r", "a2"): "a", ("r", "s"): "a"}
