"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A task packs its documents in one pass. It keeps how many partially filled windows it has at each fill level, and
puts a document where the sum of these counts squared grows least: into a window of some level, or into a new one.
Levels at powers of two are left out of the sum, as a sequence of such a length is never padded; of equal choices the
fullest window wins. So windows of awkward levels do not pile up, and documents of up to a window stay whole. A longer
document fills windows of its own, and what is left of it is placed like any document.

When a task has read its last document, the emptiest of its windows are poured into the fullest, a document being cut
where a window is full; what remains is less than a window and is cut at powers of two. Thus no sequence needs padding,
and all that is cut is in the windows that were open at the end, of which there are at most ``size``.

Nothing is shuffled: a task is run again from its own rows and gives the same sequences. It holds the tokens
of its open windows, at most ``size`` times ``size``, and of one document. A null text counts as empty, and an empty
text is its end-of-document token alone. Rows that repeat a doc_id or have none are documents of their own; other columns are
of no account; an empty table gives no rows. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import sliced

SIZE = 1024
END = 0
#: Chunks of text whose ids a worker remembers, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 40
#: Pieces in a batch of results.
_PIECES = 4096
_WS = " \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
#: Chunks between places where the tokenizer always starts anew: before a white space that something else follows, and between a letter and one of these marks.
_CHUNK = re.compile(f'[{_WS}]?[{_LETTER}]+(?![^.,;:!?)"{_WS}])|[{_WS}]?[^{_WS}]+|[{_WS}]+(?![^{_WS}])')
_CODERS: dict[int, Coder] = {}


class Coder:
    """Token ids of texts as little-endian unsigned 32-bit bytes. Words recur, so ids are remembered by chunk."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Chunks that are not remembered go to the tokenizer in one batch."""
        parts = [_CHUNK.findall(t) if t else [] for t in texts]
        new = list(set().union(*parts).difference(self.known))
        ids = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            parts = [[self.known.get(c, c) for c in p] for p in parts]  # what is about to be forgotten
            self.known = dict(zip(new, ids, strict=True))
            out = [b"".join([c if isinstance(c, bytes) else self.known[c] for c in p]) for p in parts]
        else:
            self.known.update(zip(new, ids, strict=True))
            out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for c in new:
            if len(c) > CACHE_CHARS:
                del self.known[c]
        return out


def coder(tokenizer_json: str) -> Coder:
    """The coder of this tokenizer; a worker keeps the last one."""
    key = hash(tokenizer_json)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(tokenizer_json)
    return _CODERS[key]


class Packer:
    """Windows of one task. A piece is (doc_id, start, ids as bytes, tokens of the document); closed windows leave by closed()."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        counted = np.ones(size + 1, np.int64)
        counted[[0, size, *(1 << i for i in range(size.bit_length()) if 1 << i <= size)]] = 0
        self.counted = counted
        self.windows: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.done: list[list[tuple]] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, size = len(ids) // 4, self.size
        whole = n - n % size
        for at in range(0, whole, size):
            self.done.append([(doc_id, at, ids[4 * at : 4 * (at + size)], n)])
        if whole < n:
            self.place((doc_id, whole, ids[4 * whole :], n))

    def place(self, piece: tuple) -> None:
        """Where the sum of squares grows least: leaving level h makes it smaller by 2N(h) - 1, coming to h + n larger by 2N(h + n) + 1."""
        n, size = len(piece[2]) // 4, self.size
        here, there = slice(0, size - n + 1), slice(n, size + 1)
        change = self.counted[there] * (2 * self.count[there] + 1) - self.counted[here] * (2 * self.count[here] - 1)
        level = np.flatnonzero(self.count[here])  # windows that can take it; level 0 is a new one
        best = int(level[::-1][np.argmin(change[level][::-1])]) if len(level) else 0
        if change[0] < change[best]:
            best = 0
        window = self.windows[best].pop() if best else []
        window.append(piece)
        if best:
            self.count[best] -= 1
        if best + n == size:
            self.done.append(window)
        else:
            self.windows[best + n].append(window)
            self.count[best + n] += 1

    def closed(self) -> list[list[tuple]]:
        out, self.done = self.done, []
        return out

    def finish(self) -> list[list[tuple]]:
        """What is still open, without padding: windows at powers of two as they are, the others poured together."""
        out = self.closed()
        open_ = []
        for level, windows in enumerate(self.windows):
            (open_ if self.counted[level] else out).extend(windows)
        self.__init__(self.size)
        lo, hi = 0, len(open_) - 1  # ordered by fill
        while lo < hi:
            gap = self.size - sum(len(p[2]) for p in open_[hi]) // 4
            while gap and lo < hi:
                taken = _cut(open_[lo], gap)
                open_[hi].extend(taken)
                gap -= sum(len(p[2]) for p in taken) // 4
                lo += not open_[lo]
            if not gap:
                out.append(open_[hi])
                hi -= 1
        if lo == hi:
            rest = open_[lo]
            while rest:
                n = sum(len(p[2]) for p in rest) // 4
                out.append(_cut(rest, 1 << n.bit_length() - 1))
        return out


def _cut(pieces: list[tuple], n: int) -> list[tuple]:
    """Takes pieces of up to n tokens together off the front, the last one cut if need be."""
    out = []
    while n and pieces:
        doc_id, start, ids, of = pieces[0]
        if len(ids) // 4 <= n:
            out.append(pieces.pop(0))
        else:
            out.append((doc_id, start, ids[: 4 * n], of))
            pieces[0] = (doc_id, start + n, ids[4 * n :], of)
        n -= len(out[-1][2]) // 4
    return out


def pack_documents(docs: DataFrame, tokenizer_json: str, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens (with the end token),
    sequence_id, offset in the sequence and, if keep_ids, the ids. Pieces of a sequence follow one another without gaps from 0.

    sequence_id holds the number of the task in its upper bits, so tasks number their sequences each for itself.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch(windows: list, first: int) -> pa.RecordBatch:
        rows, ids = [], []
        for i, w in enumerate(windows):
            at = 0
            for doc_id, start, b, of in w:
                rows.append((doc_id, start, len(b) // 4, zlib.crc32(b), of, first + i, at))
                ids.append(b)
                at += len(b) // 4
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))]
        if not keep_ids:
            return pa.RecordBatch.from_arrays(columns, names)
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids], dtype=np.int64)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), values)], [*names, "ids"])

    def run(batches):
        from pyspark import TaskContext

        number, packer, c = TaskContext.get().partitionId() << 40, Packer(size), coder(shared.value)
        for b in sliced(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), c.encode(b.column(1).to_pylist()), strict=True):
                packer.add(doc_id, ids + end)
                if len(packer.done) >= _PIECES // 4:
                    windows = packer.closed()
                    yield batch(windows, number)
                    number += len(windows)
        windows = packer.finish()
        for at in range(0, len(windows), _PIECES // 4):
            yield batch(windows[at : at + _PIECES // 4], number + at)

    ship_package(docs.sparkSession)
    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
