"""Ranked lexical search over a bit-sliced index of impacts.

1. ``postings``: each task splits its texts into terms and writes, for each run of up to ``RUN_DOCS`` documents and each term,
   the places of its documents in the run, how often they hold it and how long they are.
2. Collection counts over all runs: documents with a term, their terms, and the documents that hold each term.
3. ``impact_index``: a posting's impact is a whole number. The index keeps, for each run and term, a bitmap of the run's documents
   for each bit of the impacts; words of 64 documents without the term are left out.
4. ``search``: the bitmaps of a question's terms are added as whole numbers are, bit by bit with carries, for all documents of a run and
   many questions at once. The best ``k`` are found from the most significant sum bitmap down: documents that have a bit
   which fewer than k have are in, those that lack one which more than k have are out. What is left at the
   end is tied, and lesser ids come first. A task keeps the best of its runs, and only these are shuffled.

Every document is looked at for every question, so results are exact. Postings are shuffled once by run, which has a bounded number
of documents whatever their terms, so a term that all documents hold gathers nowhere. Questions reach the executors in blocks of
``BLOCK_TERMS`` terms; the driver holds one block at a time. A worker holds one run: ``RUN_TERMS`` terms, or one document.

A null text has no terms; a document or an item without terms is in no result. Rows that repeat an id, or have none, are documents or
items of their own; a null doc_id sorts before others. Equal scores go by ascending doc_id. Other columns are of no account. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable, ship_package
from .common import sliced

TOP = 10
RUN_DOCS, RUN_TERMS = 16_384, 4_000_000
BLOCK_TERMS = 200_000
#: Bytes of the bitmaps that are added at a time.
_ADD_BYTES = 48_000_000
#: Terms of a question that are added at a time.
_ADD_TERMS = 256
#: A-Z lower-cased, letters, digits and all beyond ASCII kept, anything else a space. Works on UTF-8, as ASCII bytes are in no other character.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ROWS = "run long, term binary, doc_id array<long>, slot array<int>, tf array<int>, n array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(kind)))


def postings(docs: DataFrame, wanted: list[bytes] | None = None) -> DataFrame:
    """docs(doc_id, text) -> _ROWS: for each run one row without a term, which has its documents, and one for each term (of wanted, if given)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(run: int, ids: list, sizes: list[int], keys: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        n = np.array(sizes, np.int64)
        got, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
        slot, term = got % RUN_DOCS, got // RUN_DOCS
        last = np.flatnonzero(np.diff(term, append=-1))
        own = len(ids)
        ends = np.concatenate([[own], own + last + 1]) if len(got) else np.array([own])
        lead = np.arange(own)
        columns = [
            pa.array(np.full(len(ends), run)), pa.array([None, *(names[i] for i in term[last].tolist())], pa.binary()), pa.array([ids, *repeat(None, len(ends) - 1)], pa.list_(pa.int64())),
            _lists(np.concatenate([lead, slot]), ends, np.int32), _lists(np.concatenate([n, tf]), ends, np.int32), _lists(np.concatenate([n, n[slot]]), ends, np.int32),
        ]
        return pa.RecordBatch.from_arrays(columns, ["run", "term", "doc_id", "slot", "tf", "n"])

    def run(batches):
        from pyspark import TaskContext

        base, nth = TaskContext.get().partitionId() << 32, 0
        known = None if shared.value is None else {t: i for i, t in enumerate(shared.value)}
        ids, sizes, keys, numbers, total = [], [], [], known if known is not None else {}, 0
        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                terms = terms_of(text)
                if known is None:
                    for t in set(terms).difference(numbers):
                        numbers[t] = len(numbers)
                codes = np.fromiter(map(numbers.get, terms, repeat(-1)), np.int64, len(terms))
                keys.append(codes[codes >= 0] * RUN_DOCS + len(ids))
                ids.append(doc_id)
                sizes.append(len(terms))
                total += len(terms)
                if len(ids) == RUN_DOCS or total >= RUN_TERMS:
                    yield rows(base + nth, ids, sizes, keys, list(numbers))
                    ids, sizes, keys, numbers, total, nth = [], [], [], known if known is not None else {}, 0, nth + 1
        if ids:
            yield rows(base + nth, ids, sizes, keys, list(numbers))

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def impacts(w: int, tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    m = 10 + (90 * n * docs) // terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def bit_slices(slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of 64 places that hold a value above 0, and for each bit of the values a row of these words."""
    slot, value = slot[value > 0], value[value > 0]
    at, word = np.unique(slot >> 6, return_inverse=True)
    bits = int(value.max()).bit_length() if len(value) else 0
    flat = np.zeros((bits, len(at) * 64), np.uint8)
    flat[:, word * 64 + (slot & 63)] = (value >> np.arange(bits)[:, None]) & 1
    return at, np.packbits(flat, axis=1, bitorder="little").view("<u8")


def impact_index(posted: DataFrame, weights: DataFrame, docs: int, terms: int, few: bool) -> DataFrame:
    """postings() -> run, term, doc_id, at, bits: rows of terms in weights(term, w) as bitmaps, rows of a run together. few: weights may be broadcast."""

    def run(batches):
        for b in sliced(batches):
            names, ws, slots, tfs, ns = (b.column(c) for c in ("term", "w", "slot", "tf", "n"))
            at, bits = [], []
            for i, (name, w) in enumerate(zip(names.to_pylist(), ws.to_pylist(), strict=True)):
                if name is None:
                    at.append(None)
                    bits.append(None)
                    continue
                slot, tf, n = (x[i].values.to_numpy().astype(np.int64) for x in (slots, tfs, ns))
                a, s = bit_slices(slot, impacts(w, tf, n, docs, terms))
                at.append(a.astype(np.int32))
                bits.append(s.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("run"), names, b.column("doc_id"), pa.array(at, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))], ["run", "term", "doc_id", "at", "bits"])

    ship_package(posted.sparkSession)
    w = F.broadcast(weights) if few else weights
    rows = posted.where("term is not null").join(w, "term").unionByName(posted.where("term is null").withColumn("w", F.lit(0).cast("long")))
    together = rows.repartition("run").sortWithinPartitions("run")
    return together.select("run", "term", "doc_id", "slot", "tf", "n", "w").mapInArrow(run, "run long, term binary, doc_id array<long>, at array<int>, bits array<long>")


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of numbers whose bits stand in rows, least significant first."""
    out, carry = [], None
    for x, y in zip(a, b, strict=True):
        half = x ^ y
        out.append(half if carry is None else half ^ carry)
        carry = x & y if carry is None else (x & y) | (carry & half)
    return [*out, carry]


def sums(slices: np.ndarray, lists: np.ndarray) -> list[np.ndarray]:
    """slices[bit, term, word] added up for each row of lists (numbers of terms, 0 is a term of zeros): for each bit an array [question, word]."""
    parts = [s[lists] for s in slices]
    while parts[0].shape[1] > 1:
        parts = add([p[:, 0::2] for p in parts], [p[:, 1::2] for p in parts])
    return [p[:, 0] for p in parts]


def top_sets(bits: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """[question, word] bitmaps of the documents that are among the k best for certain, and of those that tie for the places left."""
    sure = np.zeros_like(bits[0])
    tied = np.bitwise_or.reduce(np.stack(bits))
    for s in reversed(bits):
        having = sure | (tied & s)
        n = np.bitwise_count(having).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(n <= k, having, sure)
        tied = np.where(n > k, tied & s, np.where(n < k, tied & ~s, 0))
    return sure, tied


def best_of_run(slices: dict[bytes, tuple[np.ndarray, np.ndarray]], ids: list, questions: list[list[bytes]], k: int):
    """(question, doc_id, score) of the k best of a run for each question; slices: term -> bit_slices()."""
    words = -(-len(ids) // 64)
    asked = [(q, own) for q, ts in enumerate(questions) if (own := [t for t in ts if t in slices])]
    widest = min(_ADD_TERMS, max((len(own) for _, own in asked), default=1))
    step = max(1, _ADD_BYTES // (8 * 36 * words * widest)) if words else 1
    for first in range(0, len(asked), step):
        part = asked[first : first + step]
        bits: list[np.ndarray] = []
        for c in range(0, max(len(own) for _, own in part), _ADD_TERMS):
            some = [own[c : c + _ADD_TERMS] for _, own in part]
            names = {t: i + 1 for i, t in enumerate(dict.fromkeys(t for own in some for t in own))}
            dense = np.zeros((max(1, *(len(slices[t][1]) for t in names)), len(names) + 1, words), np.uint64)
            for t, i in names.items():
                at, own_bits = slices[t]
                dense[: len(own_bits), i, at] = own_bits
            wide = 1 << (max(map(len, some)) - 1).bit_length()
            more = sums(dense, np.array([[names[t] for t in own] + [0] * (wide - len(own)) for own in some]))
            bits = add(*_alike(bits, more)) if bits else more
        if not bits:
            continue
        sure, tied = top_sets(bits, k)
        for i, (q, _) in enumerate(part):
            chosen = _places(sure[i])
            rest = _places(tied[i])
            if len(chosen) < k and len(rest):
                order = sorted(rest.tolist(), key=lambda s: (ids[s] is not None, ids[s]))[: k - len(chosen)] if len(rest) > k - len(chosen) else rest
                chosen = np.concatenate([chosen, np.array(order, np.int64)])
            score = sum(((b[i, chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j for j, b in enumerate(bits))
            for s, v in zip(chosen.tolist(), score.tolist(), strict=True):
                yield q, ids[s], v


def _alike(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list, list]:
    zero, depth = np.zeros_like((a or b)[0]), max(len(a), len(b))
    return a + [zero] * (depth - len(a)), b + [zero] * (depth - len(b))


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def search(index: DataFrame, questions: list[tuple[int | None, list[bytes]]], first: int, k: int = TOP) -> DataFrame:
    """impact_index() -> q (number of the question, from first), item_id, doc_id, score: the best k of each task at least."""
    shared = index.sparkSession.sparkContext.broadcast(questions)

    def run(batches):
        asked = [t for _, t in shared.value]
        wanted = {t for ts in asked for t in ts}
        best: dict[int, list] = {}
        now, slices, ids = None, {}, []

        def close():
            for q, doc_id, score in best_of_run(slices, ids, asked, k):
                best.setdefault(q, []).append((-score, doc_id is not None, doc_id or 0))
            for q, found in best.items():
                if len(found) > k:
                    best[q] = sorted(found)[:k]

        for b in sliced(batches):
            at, bits = b.column("at"), b.column("bits")
            for i, (number, name, own) in enumerate(zip(b.column("run").to_pylist(), b.column("term").to_pylist(), b.column("doc_id").to_pylist(), strict=True)):
                if number != now:
                    close()
                    now, slices, ids = number, {}, []
                if name is None:
                    ids = own
                elif name in wanted:
                    a = at[i].values.to_numpy()
                    slices[name] = a, bits[i].values.to_numpy().view(np.uint64).reshape(-1, max(1, len(a)))
        close()
        rows = [(first + q, shared.value[q][0], d if real else None, -s) for q, found in best.items() for s, real, d in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["q", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "q long, item_id long, doc_id long, score long")


def questions_of(items: DataFrame, id_column: str) -> DataFrame:
    """item_id and terms (distinct) of items(id_column, text)."""

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(terms_of(t))) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))], ["item_id", "terms"])

    ship_package(items.sparkSession)
    return items.select(F.col(id_column).cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<binary>").where("size(terms) > 0")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "item_id") -> DataFrame:
    """docs(doc_id, text), items(id_column, text) -> item_id, rank (int, from 1), doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = durable(questions_of(items, id_column), "questions")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    names = asked.select(F.explode("terms").alias("term")).distinct().limit(BLOCK_TERMS + 1).toArrow().column(0)
    few = len(names) <= BLOCK_TERMS
    posted = durable(postings(docs, [t.as_py() for t in names] if few else None), "postings")
    own = posted.where("term is null").select(F.size(F.filter("n", lambda x: x > 0)).alias("docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    n, total = own.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    df = posted.where("term is not null").groupBy("term").agg(F.sum(F.size("slot")).alias("df"))
    weights = df.select("term", F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).alias("w"))
    index = impact_index(posted, weights, n, max(1, total), few)
    if blocks > 1:
        index = durable(index, "impacts")
    parts = None
    for i in range(blocks):
        got = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == i)).toArrow().to_pylist()
        part = search(index, [(r["item_id"], r["terms"]) for r in got], i << 40, k)
        if blocks > 1:
            part = durable(part, "found")
        parts = part if parts is None else parts.unionByName(part)
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def brute_force(docs: list[tuple], items: list[tuple], k: int = TOP) -> list[tuple]:
    """The rows of ranked_search() by plain counting; for tests."""
    import math
    from collections import Counter

    held = [(i, Counter(terms_of(None if t is None else t.encode()))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * c.total() * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(None if text is None else text.encode())) if c[t])
            scores.append((-s, i is not None, i or 0))
        out += [(item, r, d if real else None, -s) for r, (s, real, d) in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return out
