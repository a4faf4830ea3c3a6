"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A text's set is its distinct word shingles, hashed to 64 bits. The sketch keeps the k least
   values of one further hash. Texts with equal sets collapse to one node by a set fingerprint, so
   groups of copies never meet pairwise.
2. Inverted lists of retained values: a value that one node alone holds links nothing. Linked sets
   share at least ``floor`` of their retained values, so of each node only the rarest
   (size - floor + 1) values need lists, and nodes with fewer than ``floor`` shared values have
   no partner at all. Frequent values thus drop out unless most of a sketch is frequent.
3. In a list of up to ``small_list`` nodes every pair is a candidate. In a longer list each node meets
   ``hubs`` nodes of the list; what the hubs leave in different components gets exact lists of the
   rarest values of its full sets in ``_unresolved``, so no list is cut short.
4. The union's sketch estimates the similarity of each candidate and drops those far below the
   threshold; intersection and union of the full sets confirm the rest. A pair whose ends are
   already connected needs no check, as it cannot change a component.
5. Components come from alternating star contraction over tables; nothing goes to the driver.

A pair at the threshold is missed where its sketches share fewer than ``floor`` values: about one
in 10^6 for k = 64 (sets of at most k shingles are compared as they are).

Null texts and texts without words have an empty set and link with nothing. Each row is a node of
its own, also where doc_ids repeat or are null; the least row of a component is the one of least
(doc_id, text, other columns), nulls first. component_id is that row's doc_id, and so may be null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, ship_package
from .common import NULL_ID, as_utf8, durable, key_set_aside, map_batches, row_keys

K = 64
#: Node ids are broadcast to pick texts only up to this many (16 bytes each); beyond that the join shuffles.
MAX_BROADCAST_KEYS = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    w = as_utf8(text).translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = _word_hashes(w)
    n = max(len(w) - words + 1, 1)
    s = np.full(n, len(w) if len(w) < words else words, np.uint64)
    for j in range(min(words, len(w))):
        s = _mix(s * _MUL[j] + h[j : j + n])
    return np.unique(s)


def sketch_table(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """key, n (set size), print (fingerprint of the set), sketch (k least hashes, ascending) of keyed rows."""

    def run(keys, texts):
        n, prints, sketches = [], [], []
        for t in texts:
            s = shingle_set(t, words)
            n.append(len(s))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            m = _mix(s)
            sketches.append(np.sort(np.partition(m, k - 1)[:k] if len(m) > k else m).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["key", "n", "print", "sketch"])

    return map_batches(docs.select(F.col("__key").alias("key"), "text"), run, "key long, n long, print binary, sketch array<long>")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (least node reachable) of every node that has an edge (a, b), by alternating large and small stars."""
    e = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = durable(large.where("a <> b").distinct(), "large")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = durable(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        tops = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        done = not tops.limit(1).count() and not new.groupBy("a").count().where("count > 1").limit(1).count()
        forget(e, down)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Share of the union's sketch that both hold."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.isin(both, union, assume_unique=True).sum() / max(len(union), 1)


def _with_estimates(pairs: DataFrame, nodes: DataFrame, percent: int, k: int, slack: float) -> DataFrame:
    """a, b, est of the pairs whose sizes and sketches allow the threshold."""
    left = nodes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = nodes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    joined = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    joined = joined.select("a", "b", "s_a", "s_b")
    least = percent / 100 - slack

    def run(batches):
        for t in batches:
            est = []
            s_a, s_b = t.column("s_a"), t.column("s_b")
            for i in range(t.num_rows):
                x, y = (np.asarray(s[i].values).view(np.uint64) for s in (s_a, s_b))
                est.append(_estimate(x, y, k))
            est = np.array(est)
            ok = est >= least
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok)), pa.array(est[ok])], ["a", "b", "est"])

    ship_package(pairs.sparkSession)
    return joined.mapInArrow(run, "a long, b long, est double")


def _sized(keys: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it is small enough."""
    return F.broadcast(keys) if keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS else keys


def full_sets(keys: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """key, set (packed hashes) of the given nodes."""
    needed = docs.select(F.col("__key").alias("key"), "text").join(_sized(keys), "key", "left_semi")

    def sets(keys_, texts):
        return pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())], ["key", "set"])

    return map_batches(needed, sets, "key long, set binary")


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    joined = pairs.select("a", "b").join(full.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")

    def run(a, b, x, y):
        ok = []
        for p, q in zip(x, y, strict=True):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= percent * (len(s) + len(t) - both))
        keep = pa.array(ok, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

    return map_batches(joined.select("a", "b", "x", "y"), run, "a long, b long")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key, root for every node."""
    comp = components(links)
    return nodes.select("key").join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def _grouped(docs: DataFrame, words: int, percent: int, k: int = K, hubs: int = 3, small_list: int = 24) -> DataFrame:
    """key, n and root (least key of the component) of every keyed row of docs."""
    rows = durable(sketch_table(docs, words, k), "sketches")
    copies = durable(rows.where("n > 0").groupBy("print").agg(F.min("key").alias("rep"), F.count("*").alias("size")).where("size > 1").select("print", "rep"), "copies")
    named = durable(rows.join(_sized(copies), "print").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b")), "named")
    nodes = rows.where("n > 0").join(_sized(named.select(F.col("a").alias("key"))), "key", "left_anti").select("key", "n", "sketch")
    links = durable(near_links(nodes, docs, words, percent, k, hubs, small_list), "links")
    comp = components(links.unionByName(named))
    return rows.select("key", "n").join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "n", F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, hubs: int = 3, small_list: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id (doc_id of the component's least row) and kept (is that row) for every row of docs."""
    keyed, repeats = row_keys(docs.select("doc_id", "text"))
    out = _grouped(keyed, words, percent, k, hubs, small_list)
    if repeats:
        ids = keyed.select(F.col("__key").alias("key"), "doc_id")
        out = out.join(ids, "key").join(ids.select(F.col("key").alias("root"), F.col("doc_id").alias("component_id")), "root")
    else:
        real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
        out = out.withColumns({"doc_id": real("key"), "component_id": real("root")})
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("key") == F.col("root")).alias("kept"))


def near_links(nodes: DataFrame, docs: DataFrame, words: int, percent: int, k: int, hubs: int, small_list: int) -> DataFrame:
    """Confirmed links (a, b) between nodes of different sets, enough for all components."""
    slack = 2.4 / np.sqrt(k)  # six standard deviations of the estimate at 0.8
    floor = F.ceil(F.least("size", F.lit(k)) * (percent / 100 - slack))
    values = nodes.select("key", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "v").groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    few = held.withColumn("floor", F.greatest(floor, F.lit(1))).where("size(vs) >= floor").select("key", F.explode(F.slice("vs", F.lit(1), F.greatest(F.size("vs") - F.col("floor") + 1, F.lit(1)).cast("int"))).alias("x"))
    lists = durable(few.select("key", F.col("x.v").alias("v")), "lists")
    sizes = durable(lists.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    short = lists.join(_sized(sizes.where(F.col("n") <= small_list).select("v")), "v", "left_semi")
    within = short.groupBy("v").agg(F.array_sort(F.collect_list("key")).alias("m")).select("m", F.explode("m").alias("a")).select("a", F.explode(F.filter("m", lambda b: b < F.col("a"))).alias("b"))
    long = durable(lists.join(_sized(sizes.where(F.col("n") > small_list).select("v")), "v", "left_semi"), "long")
    pairs = within.unionByName(_hub_pairs(long, hubs)).distinct()
    scored = durable(_with_estimates(pairs, nodes, percent, k, slack), "scored")
    ends = scored.select(F.col("a").alias("key")).unionByName(scored.select(F.col("b").alias("key"))).unionByName(long.select("key")).distinct()
    full = durable(full_sets(durable(ends, "ends"), docs, words), "sets")
    # the likeliest partner of each node first; of the other pairs only those that still join two components
    best = scored.groupBy("a").agg(F.max(F.struct("est", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = durable(_confirm(best, full, percent), "confirmed")
    roots = durable(_roots(nodes, links), "roots")
    rest = _between(scored.select("a", "b").join(best, ["a", "b"], "left_anti"), roots)
    links = durable(links.unionByName(_confirm(rest, full, percent)), "confirmed")
    more = _unresolved(long, nodes, full, links, percent, k, slack)
    return links if more is None else links.unionByName(more)


def _hub_pairs(long: DataFrame, hubs: int) -> DataFrame:
    """Members of a quarter of the long lists with their list's hubs, the members of least hash.

    The hashes do not depend on the list, so lists with much the same members have the same hubs.
    """
    some = long.where(F.pmod("v", F.lit(4)) == 0)
    least = [F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"h{i}") for i in range(hubs)]
    picked = durable(some.groupBy("v").agg(*least).select("v", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(hubs)]))).alias("hub")), "hubs")
    joined = some.join(_sized(picked), "v").where("key <> hub")
    return joined.select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b"))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots."""
    a = roots.select(F.col("key").alias("a"), F.col("root").alias("r_a"))
    b = roots.select(F.col("key").alias("b"), F.col("root").alias("r_b"))
    return pairs.join(a, "a").join(b, "b").where("r_a <> r_b").select("a", "b")


def _rare_prefixes(full: DataFrame, percent: int) -> DataFrame:
    """key, n, c, v: the values of each set that a partner at the threshold must share one of, rarest first.

    c is how many of the set's values stand at v or after it in the common order (count, v). A value
    that one set alone holds comes first in that order and needs no row.
    """

    def explode(keys, sets):
        s = [np.frombuffer(x, np.int64) for x in sets]
        n = np.fromiter(map(len, s), np.int64, len(s))
        sid = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in sets]
        flat = [pa.array(np.repeat(np.asarray(c, np.int64), n)) for c in (keys, sid, n)]
        return pa.RecordBatch.from_arrays([*flat, pa.array(np.concatenate(s))], ["key", "sid", "n", "v"])

    values = durable(map_batches(full.select("key", "set"), explode, "key long, sid long, n long, v long"), "values")
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "v").groupBy("key", "sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    first = F.size("vs") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    rows = held.where(first > 0).select("key", "n", F.size("vs").alias("m"), F.posexplode(F.slice("vs", F.lit(1), first)).alias("i", "x"))
    return rows.select("key", "n", (F.col("m") - F.col("i")).alias("c"), F.col("x.v").alias("v"))


def _unresolved(long: DataFrame, nodes: DataFrame, full: DataFrame, links: DataFrame, percent: int, k: int, slack: float) -> DataFrame | None:
    """Links that hubs missed between members of one long list that lie in different components.

    These members get exact lists over their full sets. At the rarest value that two sets share, both
    can share no more than what follows it, so a pair goes on only if that reaches the threshold; texts
    that have a frequent passage in common but too much else of their own never meet. In each list the
    member with the least of its own comes first as a hub, then the pairs left between components.
    """
    roots = durable(_roots(nodes, links), "roots")
    placed = long.join(roots, "key")
    mixed = _mixed_lists(placed)
    left = durable(placed.join(mixed, "v", "left_semi").select("key").distinct(), "mixed")
    if not left.limit(1).count():
        return None
    rare = durable(_rare_prefixes(full.join(_sized(left), "key", "left_semi"), percent), "rare")
    fit = ((100 + percent) * F.least("c_a", "c_b") >= percent * (F.col("n_a") + F.col("n_b"))) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    side = lambda t: [F.col("key").alias(t), F.col("n").alias(f"n_{t}"), F.col("c").alias(f"c_{t}")]
    hub = rare.groupBy("v").agg(F.min_by(F.struct("key", "n", "c"), F.struct(F.col("n") / F.col("c"), "key")).alias("h"), F.count("*").alias("size")).where("size > 1").select("v", "h.*")
    near_hub = rare.select("v", *side("a")).join(_sized(durable(hub.select("v", *side("b")), "list-hubs")), "v").where(fit & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = durable(_confirm(_with_estimates(_between(near_hub, roots), nodes, percent, k, slack), full, percent), "hub-links")
    roots = durable(_roots(nodes, links.unionByName(found)), "roots")
    rest = rare.join(roots, "key")
    rest = durable(rest.join(_mixed_lists(rest), "v", "left_semi"), "open-lists")
    pairs = _fitting_pairs(rest, percent)
    return found.unionByName(_confirm(_with_estimates(pairs, nodes, percent, k, slack), full, percent))


def _mixed_lists(placed: DataFrame) -> DataFrame:
    """The values v of placed(v, root) whose members have different roots."""
    return _sized(durable(placed.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("v"), "mixed-lists"))


def _fitting_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots in a list of rest(v, key, n, c, root) that can reach the threshold by what follows the list's value.

    With r = (100 + percent) / percent a pair fits if neither size exceeds r * c - n of the other. The lesser
    set of a pair must thus allow its own size; texts of one template with much of their own do not, so
    such a list brings no rows to the join. The greater set must allow the least of the lesser ones.
    Sets are joined within a class of size, or with the next class.
    """
    room = F.floor((F.col("c") * (100 + percent)) / percent - F.col("n"))
    step = float(np.log(100 / percent) * 1.01 + 1e-9)
    sized = rest.withColumn("room", room).withColumn("class", F.floor(F.log("n") / step))
    lesser = durable(sized.where("room >= n"), "lesser")
    least = lesser.groupBy("v").agg(F.min("n").alias("least"))
    greater = durable(sized.join(_sized(durable(least, "least")), "v").where("room >= least and n >= least"), "greater")
    a = lesser.select("v", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("room").alias("room_a"), F.col("root").alias("r_a"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    b = greater.select("v", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("room").alias("room_b"), F.col("root").alias("r_b"), "class")
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    allowed = (F.col("room_a") >= F.col("n_b")) & (F.col("room_b") >= F.col("n_a")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    return a.join(b, ["v", "class"]).where((F.col("r_a") != F.col("r_b")) & once & allowed).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def dedup_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a lesser row."""
    docs, names = key_set_aside(docs)
    keyed, _ = row_keys(docs)
    kept = _grouped(keyed, words, percent).where("key = root").select(F.col("key").alias("__key"))
    return keyed.join(_sized(durable(kept, "kept")), "__key", "left_semi").select(*[F.col(f"`{now}`").alias(was) for was, now in names.items()])
