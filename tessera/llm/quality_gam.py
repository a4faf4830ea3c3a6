"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few dozen shape features (counts, ratios, repeats), never its id, language or
source. Features are binned; boosting runs over them in a cycle, and each step fits a shallow tree
on one feature's bins to the current residual and adds it, damped, to that feature's lookup table.
Then the pairs with the largest residual gain get tables of their own in the same way. A score is
the logistic of a sum of looked-up bins, added up vectorised for a whole Arrow batch.

Training takes at most ``max_rows`` labelled rows (those with the least hash of doc_id); scoring
covers every text, of any length. Null and empty texts have zero features and get a score too. Labels
whose quality is null are left out; several labels of one doc_id count as their maximum. Without labels
(or with one class only) every score is the smoothed share of label 1. Repeated rows are scored alike,
rows of null doc_id too, which no label covers; rows of equal hash are taken by doc_id. Other columns
are of no account, and an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, durable, map_batches, sliced

MAX_ROWS = 20_000
THRESHOLD = 0.3
#: Ids of labelled rows are broadcast only up to this many (8 bytes each); beyond that the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
_UPPER = np.array([65 <= i <= 90 for i in range(256)], float)
_CLASSES = np.stack([
    _UPPER, np.array([97 <= i <= 122 or i >= 128 for i in range(256)], float), np.array([48 <= i <= 57 for i in range(256)], float),
    *(np.array([chr(i) in s for i in range(256)], float) for s in ("#*$%&<>", "|", "!", ".,", "?;:", " \t", "\n", "(){}[]=\"'_/\\")), np.array([i >= 128 for i in range(256)], float),
])
N_FEATURES = 24


def features(text: str | None) -> np.ndarray:
    x = np.zeros(N_FEATURES, np.float32)
    data = as_utf8(text)
    if not data:
        return x
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    c = _CLASSES @ np.bincount(raw, minlength=256)
    words = data.split()
    k = len(words)
    x[0], x[1] = np.log1p(n), np.log1p(k)
    letters = max(c[0] + c[1], 1)
    x[2] = c[0] / letters
    x[3] = letters / n
    x[4:13] = c[2:11] / n
    x[13] = c[11] / n
    if k:
        count: dict[bytes, int] = {}
        for w in words:
            count[w] = count.get(w, 0) + 1
        x[14] = (n - c[8] - c[9]) / k
        x[15] = len(count) / k
        x[16] = max(count.values()) / k
        x[17] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
        x[18] = max(map(len, count)) / n
    lines = data.split(b"\n")
    x[19] = len(set(lines)) / len(lines)
    x[20] = np.log1p(max(map(len, lines)))
    x[21] = sum(s.endswith(b".") for s in lines) / len(lines)
    x[22] = len(lines) / (k + 1)
    x[23] = data.count(b"  ") / n
    return x


class Gam:
    """edges: bin borders by feature; tables: score by bin; pairs: ((i, j), borders, table)."""

    def __init__(self, base: float):
        self.base, self.edges, self.tables, self.pairs = base, [], [], []

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            s += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), (a, b), t in self.pairs:
            s += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    def score_one(self, x: np.ndarray) -> float:
        """The score of one row by walking its bins; for tests."""
        at = lambda borders, v: sum(b <= v for b in borders)
        s = self.base + sum(t[at(e, x[j])] for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)))
        s += sum(t[at(a, x[i]), at(b, x[j])] for (i, j), (a, b), t in self.pairs)
        return 1 / (1 + np.exp(-min(max(s, -30), 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, least: float, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree with few leaves, grown where the gain is largest."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max((*_best_cut(g[a:z], h[a:z], least), i) for i, (a, z) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, z = parts.pop(k)
        parts += [(a, a + at), (a + at, z)]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """A cut along one axis, then one along the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            total, value = 0.0, np.zeros_like(a)
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = a[part].sum(0), b[part].sum(0)
                gain, at = _best_cut(gs, hs, least)
                total += gain + gs.sum() ** 2 / (hs.sum() + 1)
                for q in (slice(0, at), slice(at, None)) if gain > 0 else (slice(0, None),):
                    value[part, q] = gs[q].sum() / (hs[q].sum() + 1)
            if total > best:
                best, out = total, value if axis == 0 else value.T
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 20, n_pairs: int = 4, rate: float = 0.15, bins: int = 32, least: float = 1.0) -> Gam:
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    m = Gam(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return m
    d = x.shape[1]
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    s = np.full(len(y), m.base)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-s))
            k = len(m.tables[j])
            step = rate * _shallow_tree(np.bincount(at[j], y - p, k), np.bincount(at[j], p * (1 - p), k), least)
            m.tables[j] += step
            s += step[at[j]]
    p = 1 / (1 + np.exp(-s))
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])) for j in range(d)]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cell[i] * b + cell[j], v, a * b).reshape(a, b)

    gain = {(i, j): float((grid(i, j, y - p) ** 2 / (grid(i, j, p * (1 - p)) + 1)).sum()) for i, j in combinations(range(d), 2)}
    chosen = sorted(gain, key=lambda ij: (-gain[ij], ij))[:n_pairs]
    m.pairs = [((i, j), (coarse[i], coarse[j]), np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), _, t in m.pairs:
            p = 1 / (1 + np.exp(-s))
            step = rate * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), least)
            t += step
            s += step[cell[i], cell[j]]
    return m


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features as packed 32-bit floats, for every row."""

    def run(ids, texts):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([features(t).tobytes() for t in texts], pa.binary())], ["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x binary")


def train(table: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """labels: doc_id, quality. The rows of least hash come to the driver; max_rows bounds them.

    A hash threshold goes before the ordering, so that what each task sends is a share of max_rows.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    n = known.count()
    if n > 2 * max_rows:
        known = known.where(F.col("h").cast("double") < F.lit(-(2.0**63) + 2.0**64 * 1.5 * max_rows / n))
    rows = table.join(known, "doc_id").orderBy("h", "doc_id", "x").limit(max_rows).select("x", "y").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, N_FEATURES).astype(float)
    return fit(x, np.array([int(r["y"] > 0) for r in rows], float))


def with_scores(table: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    """The columns keep of table, and score."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        a = np.frombuffer(b"".join(x), np.float32).reshape(-1, N_FEATURES).astype(float)
        return pd.Series(shared.value.score(a))

    from ..session import ship_package

    ship_package(table.sparkSession)
    return table.select(*keep, score("x").alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) for every row of docs; labels decides what is learned from."""
    table = durable(feature_table(docs), "features")
    return with_scores(table, train(table, labels, max_rows), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs whose score reaches threshold, with all their columns."""
    ids = durable(labels.where("quality is not null").select("doc_id").distinct(), "labelled")
    small = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    known = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    model = train(feature_table(known), labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in sliced(batches):
            if b.num_rows:
                x = np.stack([features(t) for t in b.column(at).to_pylist()]).astype(float)
                yield b.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
