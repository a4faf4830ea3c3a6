"""Removal of repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if some ``min_len``-byte string over it also starts earlier (smaller doc_id, or
same document and earlier start). The work is split so that equal strings meet:

1. Winnowing gives each ``min_len``-byte window one anchor (the least hash of its inner grams), a
   function of the window's own bytes; equal windows have equal anchors at equal offsets. The
   consecutive windows of one anchor and the text under them make a *piece*.
2. Anchors seen once cannot repeat. Of the others, verbatim equal pieces collapse to their earliest
   occurrence by partial aggregation, so copies never gather in a task.
3. Anchors with several different pieces go to blocks of bounded size. In a block, breadth-first
   backward extension on the Burrows-Wheeler transform settles common-prefix values 0, 1, 2, ... and
   stops at ``min_len``; rows with no boundary between them share ``min_len`` bytes. Anchors with
   more than ``hot_pieces`` pieces spread over many blocks; what is first in its block then meets
   the other blocks' firsts under a 128-bit window hash, again by partial aggregation.
4. Each document drops the windows of repeated anchors that are nobody's first occurrence.

Nulls count as empty texts, texts under ``min_len`` bytes keep everything, rows that repeat a doc_id
with the same text are one document and get the same result, rows that repeat a doc_id with other
text are ordered by text; a null doc_id sorts first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_utf8, durable, id_key, map_batches

GRAM = 24
#: Longest strings that winnowing in chunks of _CHUNK windows and the packed runs allow.
MAX_LEN = 30_000
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS_BITS = np.uint64(17)
_CHUNK = 100_000
#: Bits of a packed (start, number of windows) that hold the number, which is under min_len.
_RUN_BITS = 16
_RUN_MASK = (1 << _RUN_BITS) - 1
#: An anchor with more pieces than this is dealt over parts of this many when it meets its pieces.
JOIN_PIECES = 256
#: Hot anchors are broadcast only up to this many (16 bytes each); beyond that the join shuffles.
MAX_BROADCAST_HOT = 1_000_000
#: A Bloom filter of repeated anchors is sent to the executors only up to this many anchors (12 bits each).
BLOOM_MAX_ITEMS = 40_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h1 = _BYTE[b]
    h2 = h1[:-1] * _MUL[0] + h1[1:]
    h4 = h2[:-2] * _MUL[1] + h2[2:]
    h8 = h4[:-4] * _MUL[2] + h4[4:]
    h16 = h8[:-8] * _MUL[3] + h8[8:]
    return _mix(h16[: len(b) - GRAM + 1] * _MUL[4] + h8[16 : len(b) - GRAM + 17])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == w else np.minimum(x[: len(x) - (w - span)], x[w - span :])


def anchors(data: bytes, min_len: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, piece hash, first window, number of windows) for each piece of a text."""
    n = len(data) - min_len + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    h = _gram_hashes(np.frombuffer(data, np.uint8))
    w = min_len - GRAM + 1
    starts, runs, at = [], [], []
    low = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    for c in range(0, n, _CHUNK):
        part = h[c : min(c + _CHUNK, n) + w - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        pos = (_window_min(key, w) & low).astype(np.int64)
        s = np.concatenate(([0], np.flatnonzero(pos[1:] != pos[:-1]) + 1))
        starts.append(s + c)
        runs.append(np.diff(np.append(s, len(pos))))
        at.append(pos[s] + c)
    s, run, a = np.concatenate(starts), np.concatenate(runs), np.concatenate(at)
    last = s + run + min_len - 1 - GRAM
    ph = (a - s).astype(np.uint64) * _MUL[5] + run.astype(np.uint64) * _MUL[6]
    for i in range((2 * min_len) // GRAM + 1):
        ph = _mix(ph * _MUL[7] + h[np.minimum(s + GRAM * i, last)])
    return h[a], ph, s, run


def repeat_classes(blob: np.ndarray, ends: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the concatenated strings, and where a new class of equal ``min_len``-prefixes begins in it.

    blob: symbols, each string closed by its own symbol above 255; ends: places of those symbols.
    Common-prefix values come by increasing value: value v+1 belongs between the rows LF(i) and its
    predecessor if a boundary of value at most v lies between the two places of that symbol in the
    transform. Where the two places adjoin, only a boundary of value v on the row counts, so such rows
    are followed from the newest boundaries; the others are tested against all of them. Rows still
    without a boundary at ``min_len`` share that many symbols.
    """
    n = len(blob)
    head = 7  # symbols of nine bits in the first sort key
    symbol = np.minimum(blob, 256).astype(np.int64)
    to_end = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    key = symbol.copy()
    for i in range(1, head):
        key <<= 9
        key[: n - i] |= np.where(to_end[: n - i] >= i, symbol[i:], 0)
    closed = to_end < head
    order = np.argsort(key)
    at = np.flatnonzero(closed[order])
    order[at] = order[at][np.lexsort((order[at], key[order[at]]))]
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | closed[order][1:]
    step = head
    while True:
        number = np.cumsum(fresh) - 1
        rank = np.empty(n, np.int64)
        rank[order] = number
        if step >= min_len or number[-1] == n - 1:
            break
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        step *= 2
    sa = order
    bwt = symbol[sa - 1].astype(np.uint16)
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    boundary = np.zeros(n, bool)
    first = symbol[sa]
    boundary[0] = True
    boundary[1:] = (first[1:] != first[:-1]) | (first[1:] == 256)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    row, before = by_symbol[1:][same], by_symbol[:-1][same]
    live = ~boundary[lf[row]] & (bwt[row] != 256)
    row, before = row[live], before[live]
    # Next to its predecessor: a boundary reaches it only by lying on the row itself.
    adjacent = row == before + 1
    inside_run = np.zeros(n, bool)
    inside_run[row[adjacent]] = True
    apart = np.sort(row[~adjacent])
    prev = np.empty(n, np.int64)
    prev[row] = before
    apart_before = prev[apart]
    newest, gone = np.flatnonzero(boundary), 0
    for _ in range(1, min_len):
        reached = [newest[inside_run[newest]]]
        if len(apart):
            if len(apart) * 16 > n:
                seen = np.cumsum(boundary, dtype=np.int32)
                hit = np.take(seen, apart) != np.take(seen, apart_before)
            else:
                at = np.sort(newest)
                hit = np.searchsorted(at, apart, "right") != np.searchsorted(at, apart_before, "right")
            reached.append(apart[hit])
        newest = lf[np.concatenate(reached)]
        newest = newest[~boundary[newest]]
        if not len(newest):
            break
        boundary[newest] = True
        if len(apart):
            gone += int(np.count_nonzero(hit))
            if gone * 8 > len(apart):
                left = np.flatnonzero(~boundary[lf[apart]])
                apart, apart_before, gone = apart[left], apart_before[left], 0
    return sa, boundary


def first_windows(pieces: list[bytes], owner: np.ndarray, start: np.ndarray, min_len: int) -> list[np.ndarray]:
    """For each piece, which of its windows has no equal one at an earlier (owner, start) in the block."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    blob = np.empty(int(ends[-1]) + 1, np.int32)
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    blob[:] = flat
    blob[ends] = 256 + np.arange(len(pieces))
    sa, boundary = repeat_classes(blob, ends, min_len)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)[sa]
    offset = sa - begins[piece]
    cls = np.cumsum(boundary) - 1
    window = offset <= sizes[piece] - min_len
    cls, piece, offset = cls[window], piece[window], offset[window]
    order = np.lexsort((start[piece] + offset, owner[piece], cls))
    lead = np.ones(len(order), bool)
    lead[1:] = cls[order][1:] != cls[order][:-1]
    keep = order[lead]
    out = [np.zeros(int(n) - min_len + 1, bool) for n in sizes]
    base = np.cumsum([0, *map(len, out)])
    all_flags = np.zeros(base[-1], bool)
    all_flags[base[piece[keep]] + offset[keep]] = True
    return [all_flags[base[i] : base[i + 1]] for i in range(len(out))]


class _Bloom:
    """Split Bloom filter over anchor hashes, as packed bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        g = _mix(h * _MUL[8])
        return [(g + np.uint64(i) * (_mix(g) | np.uint64(1))) & mask for i in range(4)]

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for p in self.places(h, self.mask):
            ok &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def _bloom_of(repeated: DataFrame, items: int) -> _Bloom:
    """Bits are set by the executors, one bitmap a task, and joined by OR; the size is fixed by ``items``."""
    size = 1 << max(10, int(np.ceil(np.log2(items * 12 / 8))))
    mask = np.uint64(size * 8 - 1)

    def bits(batches):
        own = np.zeros(size, np.uint8)
        for b in batches:
            h = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            for p in _Bloom.places(h, mask):
                np.bitwise_or.at(own, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_pydict({"bits": [own.tobytes()]}, pa.schema([("bits", pa.binary())]))

    total = np.zeros(size, np.uint8)
    for row in repeated.select("fp").coalesce(4).mapInArrow(bits, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return _Bloom(total)


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) per document; where a doc_id repeats, keys number the distinct (doc_id, text)."""
    base = docs.select(id_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    if not base.groupBy("key").count().where("count > 1").limit(1).count():
        return base, None
    distinct = base.select("key", F.sha2("text", 256).alias("text_sha"), "text").distinct()
    ordered = distinct.orderBy("key", "text").withColumn("no", F.monotonically_increasing_id())
    texts = durable(ordered.select(F.col("key").alias("doc"), "text_sha", "text", F.col("no").alias("key")), "numbered")
    return texts.select("key", "text"), texts.select("doc", "text_sha", "key")


def suffix_dedup(docs: DataFrame, min_len: int = 100, block_bytes: int = 500_000, hot_pieces: int = 4096) -> DataFrame:
    """doc_id, n_bytes, spans (removed [start, end) runs of bytes) and kept (the other bytes), one row a document."""
    if not 2 * GRAM <= min_len <= MAX_LEN:
        raise ValueError(f"min_len must be {2 * GRAM} to {MAX_LEN}")
    spark = docs.sparkSession
    texts, numbers = _keyed(docs)
    data = texts.select("key", F.encode("text", "utf-8").alias("data"))

    def hashes(keys, blobs):
        h = [anchors(b, min_len)[0] for b in blobs]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], ["fp"])

    repeated = durable(map_batches(data, hashes, "fp long").groupBy("fp").count().where("count > 1").select("fp"), "anchors")
    items = repeated.count()
    bloom = spark.sparkContext.broadcast(_bloom_of(repeated, max(items, 64))) if items <= BLOOM_MAX_ITEMS else None

    def occurrences(keys, blobs):
        cols: list[list] = [[], [], [], [], []]
        for key, b in zip(keys, blobs, strict=True):
            fp, ph, s, run = anchors(b, min_len)
            if bloom is not None and len(fp):
                has = bloom.value.has(fp)
                fp, ph, s, run = fp[has], ph[has], s[has], run[has]
            if len(fp):
                order = np.lexsort((s, ph, fp))
                again = np.zeros(len(fp), bool)
                again[order[1:]] = (fp[order][1:] == fp[order][:-1]) & (ph[order][1:] == ph[order][:-1])
                for c, x in zip(cols, (fp.view(np.int64), ph.view(np.int64), np.full(len(fp), key, np.int64), (s << _RUN_BITS) | run, again), strict=True):
                    c.append(x)
        empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else e) for c, e in zip(cols, empty, strict=True)], ["fp", "ph", "key", "at", "again"])

    occ = durable(map_batches(data, occurrences, "fp long, ph long, key long, at long, again boolean"), "occurrences")
    once = occ.where("not again")
    variants = durable(once.groupBy("fp", "ph").agg(F.min("key").alias("key"), F.min_by("at", "key").alias("at")), "variants")
    by_fp = variants.groupBy("fp").agg(F.min("ph").alias("lo"), F.max("ph").alias("hi"), F.min("key").alias("key"), F.min_by("at", "key").alias("at"), F.count("*").alias("n"))
    settled = durable(by_fp, "settled")
    plain_first = settled.where("lo = hi").select("key", "at")
    # Anchors of many pieces meet them in parts, so that no task gets all pieces of one anchor.
    many = settled.where(F.col("n") > JOIN_PIECES).select("fp", F.ceil(F.col("n") / JOIN_PIECES).alias("n_parts"))
    many = F.broadcast(many) if many.limit(MAX_BROADCAST_HOT + 1).count() <= MAX_BROADCAST_HOT else many
    mixed = settled.where("lo <> hi").select("fp", F.when(F.col("n") > hot_pieces, F.ceil(F.col("n") / hot_pieces)).alias("parts"),
                                             F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / JOIN_PIECES).cast("int") - 1)).alias("part"))
    dealt = variants.join(many, "fp", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("ph"), F.col("n_parts")), F.lit(0)).cast("int")).drop("n_parts")
    pieces = durable(dealt.join(mixed, ["fp", "part"]).drop("part"), "pieces")
    n_pieces = pieces.count()
    first = plain_first
    if n_pieces:
        blocks = int(max(1, np.ceil(n_pieces * 1.4 * min_len / block_bytes)))
        placed = pieces.select(
            "key", "at", F.col("parts").isNotNull().alias("hot"),
            F.pmod(F.when(F.col("parts").isNull(), F.xxhash64("fp")).otherwise(F.xxhash64("fp", F.pmod(F.xxhash64("ph"), F.col("parts")))), F.lit(blocks)).alias("block"),
        )
        start, run = F.shiftright("at", _RUN_BITS), F.col("at").bitwiseAND(_RUN_MASK)
        routed = placed.join(data, "key").select("block", "hot", "key", start.alias("start"), F.substring("data", (start + 1).cast("int"), (run + min_len - 1).cast("int")).alias("piece"))

        def expand(pdf):
            import pandas as pd

            pdf = pdf.reset_index(drop=True)
            flags = first_windows(list(pdf["piece"]), pdf["key"].to_numpy(), pdf["start"].to_numpy(), min_len)
            rows: list[tuple] = []
            for key, s, hot_, piece, f in zip(pdf["key"], pdf["start"], pdf["hot"], pdf["piece"], flags, strict=True):
                if hot_:
                    rows += [(key, ((s + i) << _RUN_BITS) | 1, hashlib.blake2b(piece[i : i + min_len], digest_size=16).digest()) for i in np.flatnonzero(f).tolist()]
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
                    rows += [(key, ((s + a) << _RUN_BITS) | (z - a), None) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            return pd.DataFrame(rows, columns=["key", "at", "window"])

        expanded = durable(routed.groupBy("block").applyInPandas(expand, "key long, at long, window binary"), "expanded")
        across = expanded.where("window is not null").groupBy("window").agg(F.min(F.struct("key", "at")).alias("x")).select("x.key", "x.at")
        first = first.unionByName(expanded.where("window is null").select("key", "at")).unionByName(across)

    marks = occ.select("key", (F.col("at") * 2).alias("mark")).unionByName(first.select("key", (F.col("at") * 2 + 1).alias("mark")))
    joined = data.join(marks.groupBy("key").agg(F.collect_list("mark").alias("marks")), "key", "left")

    def cut(keys, blobs, marks_):
        lens, spans, kept = [], [], []
        for b, m in zip(blobs, marks_, strict=True):
            lens.append(len(b))
            if not m:
                spans.append([])
                kept.append(b)
                continue
            m = np.asarray(m, np.int64)
            s, run, is_first = m >> (_RUN_BITS + 1), (m >> 1) & _RUN_MASK, (m & 1) == 1
            gone = np.zeros(len(b) + 1, np.int32)
            for sign, pick in ((1, ~is_first), (-1, is_first)):
                np.add.at(gone, s[pick], sign)
                np.add.at(gone, s[pick] + run[pick], -sign)
            w = np.flatnonzero(np.cumsum(gone) > 0)
            cover = np.zeros(len(b) + 1, np.int32)
            np.add.at(cover, w, 1)
            np.add.at(cover, w + min_len, -1)
            dead = (np.cumsum(cover) > 0).view(np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], dead)))).tolist()
            pairs = list(zip(edge[::2], edge[1::2], strict=True))
            spans.append([{"start": a, "end": z} for a, z in pairs])
            kept.append(np.frombuffer(b, np.uint8)[dead[: len(b)] == 0].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lens, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    done = map_batches(joined.select("key", "data", "marks"), cut, "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    if numbers is None:
        return done.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "n_bytes", "spans", "kept")
    rows = docs.select(id_key().alias("doc"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha")).join(numbers, ["doc", "text_sha"]).select("doc", "key")
    return rows.join(done, "key").select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "spans", "kept")


def brute_force(rows: list[tuple], min_len: int = 100) -> dict:
    """doc_id -> (removed runs, kept bytes) by a table of all windows; for tests."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = as_utf8(text)
        gone = bytearray(len(b))
        for p in range(len(b) - min_len + 1):
            w = b[p : p + min_len]
            if w in seen:
                gone[p : p + min_len] = b"\1" * min_len
            seen.add(w)
        edge = [i for i in range(len(b) + 1) if (gone[i] if i < len(b) else 0) != (gone[i - 1] if i else 0)]
        out[doc] = (list(zip(edge[::2], edge[1::2], strict=True)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out
