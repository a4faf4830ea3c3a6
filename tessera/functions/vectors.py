"""Dense vectors as arrays, exact top-k search by matrix products, and the model-free hashing embedder."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 128
_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+")
_CACHE = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a norm is zero; null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero, so that their cosines are 0."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows as a matrix) of a list column, one pair for each length of its non-null rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        yield at, np.asarray(lists.take(pa.array(at)).flatten().fill_null(0)).astype(np.float64).reshape(len(at), n)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (-score, id); whatever ties with the last one takes part in the ordering."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k_of_batches(queries: list[tuple[np.ndarray, np.ndarray]], k: int, digits: int):
    """A function of Arrow batches (id, vec) -> (q, id, score): of each query, given as (numbers, unit rows) by length, the k best of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = None
        for b in batches:
            kind = b.schema.field("id").type
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for at, m in matrices(b.column("vec")):
                for numbers, rows in queries:
                    if rows.shape[1] != m.shape[1]:
                        continue
                    scores = np.round(unit_rows(m) @ rows.T, digits)
                    for j, q in enumerate(numbers.tolist()):
                        s, i = scores[:, j], ids[at]
                        if q in held:
                            s, i = np.concatenate([held[q][0], s]), np.concatenate([held[q][1], i])
                        best = best_rows(s, i, k)
                        held[q] = (s[best], i[best])
        if held:
            numbers = np.concatenate([np.full(len(s), q, np.int64) for q, (s, _) in held.items()])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([i for _, i in held.values()]), kind), pa.array(np.concatenate([s for s, _ in held.values()]))], ["q", "id", "score"])

    return run


def bucket(token: Column) -> Column:
    return (F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % DIM).cast("int")


def token_weight(token: Column) -> Column:
    """Twelfths: 12 plus the length up to 12."""
    return F.lit(12) + F.least(F.length(token), F.lit(12))


def hash_weights(text: str | None, seen: dict[str, int]) -> np.ndarray:
    """Weights of the buckets in twelfths: each token gives 12 plus its length up to 12, each pair of neighbours 3.

    A text without such tokens is split at white space instead. seen remembers tokens' buckets and is emptied when full.
    """
    tokens = _TOKEN.findall((text or "").lower()) or (text or "").lower().split()
    out = np.zeros(DIM, np.int64)
    if len(seen) > _CACHE:
        seen.clear()
    for t, n in Counter(tokens).items():
        if t not in seen:
            seen[t] = int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "big") % DIM
        out[seen[t]] += n * (12 + min(len(t), 12))
    if len(tokens) > 1:
        sha1 = hashlib.sha1
        heads = b"".join([sha1(f"{a} {b}".encode(), usedforsecurity=False).digest()[:4] for a, b in itertools.pairwise(tokens)])
        out += 3 * np.bincount(np.frombuffer(heads, ">u4") % DIM, minlength=DIM)
    return out
