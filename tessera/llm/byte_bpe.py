"""Byte-level BPE encoding and decoding as monoid tree reductions.

A text is cut by the vocabulary's pattern; cuts are absolute, so joining the pieces' ids is plain
concatenation. Inside a piece the two halves are encoded recursively and joined: a window over the
border is encoded anew and widened until the token pair at each rim is one that the merges leave
alone. A row of tokens in which every neighbouring pair is left alone is the encoding, so tokens
outside the window stand. Decoding joins the tokens' bytes up a balanced tree.

Null counts as an empty text: no ids. Repeated rows, null ids and other columns are of no account;
a piece of any length is encoded in time near linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, map_batches

LEAF = 16
_NONE = 1 << 60
_CACHE_ITEMS = 400_000
_CODERS: dict[tuple[str, str], Coder] = {}


class Coder:
    def __init__(self, ranks: bytes, pattern: str):
        """ranks: the content of a rank file."""
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.windows: dict[tuple[int, ...], list[int]] = {}
        self.pieces = _Pieces(self)

    def leaf(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        ranks = self.ranks
        if len(data) > 40:
            return self._heap(data)
        cut = list(range(len(data) + 1))
        pair = [ranks.get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pair and (low := min(pair)) != _NONE:
            i = pair.index(low)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(data[cut[i] : cut[i + 2]], _NONE)
            if i:
                pair[i - 1] = ranks.get(data[cut[i - 1] : cut[i + 1]], _NONE)
        return [ranks[data[a:b]] for a, b in itertools.pairwise(cut)]

    def _heap(self, data: bytes) -> list[int]:
        """leaf() for long windows: a queue of pairs over a linked list."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, z = heapq.heappop(queue)
            mid = end[i]
            if mid == 0 or mid >= n or end[mid] != z:
                continue
            end[i], end[mid] = z, 0
            if z < n:
                before[z] = i
                if (r := ranks.get(data[i : end[z]])) is not None:
                    heapq.heappush(queue, (r, i, end[z]))
            b = before[i]
            if b >= 0 and (r := ranks.get(data[b:z])) is not None:
                heapq.heappush(queue, (r, b, z))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def window(self, tokens: tuple[int, ...]) -> list[int]:
        """The tokens' bytes encoded anew; short windows are remembered."""
        got = self.windows.get(tokens)
        if got is None:
            got = self.leaf(b"".join(map(self.tokens.__getitem__, tokens)))
            if len(tokens) <= 6:
                if len(self.windows) >= _CACHE_ITEMS:
                    self.windows.clear()
                self.windows[tokens] = got
        return got

    def alone(self, a: int, b: int) -> bool:
        return self.window((a, b)) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = self.window((*left[-i:], *right[:j]))
            sound_l = i >= len(left) or self.alone(left[-i - 1], window[0])
            sound_r = j >= len(right) or self.alone(window[-1], right[j])
            if sound_l and sound_r:
                return left[:-i] + window + right[j:]
            grow = 1 if i + j < 8 else i + j
            i, j = i if sound_l else min(i + grow, len(left)), j if sound_r else min(j + grow, len(right))

    def tree(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= LEAF:
            return self.leaf(data)
        mid = max(LEAF, n // 2 // LEAF * LEAF)
        return self.join(self.tree(data[:mid]), self.tree(data[mid:]))

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        parts = list(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        while len(parts) > 64:
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return b"".join(parts)


class _Pieces(dict):
    """Ids of pieces seen before; emptied when full, so its memory is bounded."""

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.coder.encode_piece(as_utf8(piece))).tobytes()
        if len(piece) <= 64:
            if len(self) >= _CACHE_ITEMS:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def coder(ranks: bytes, pattern: str, digest: str | None = None) -> Coder:
    """One coder a worker for each rank file (named by its digest) and pattern."""
    key = (digest or hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, as binary) and decoded (bytes), one row a document.

    The rank file is read by the driver and broadcast (its size does not depend on docs), so executors need no such file.
    With keep_ids False the two byte columns are replaced by their lowercase hex sha256, made where
    the bytes are, as ids_sha256 and decoded_sha256.
    """

    content = read_ranks(path)
    digest = hashlib.sha256(content).hexdigest()
    ranks = docs.sparkSession.sparkContext.broadcast(content)

    def run(ids, texts):
        c = coder(ranks.value, pattern, digest)
        coded = [c.encode(t) for t in texts]
        plain = [c.decode(x) for x in coded]
        n = [len(x) // 4 for x in coded]
        if keep_ids:
            cols, names = [pa.array(coded, pa.binary()), pa.array(plain, pa.binary())], ["ids", "decoded"]
        else:
            cols, names = [pa.array([hashlib.sha256(x).hexdigest() for x in col], pa.string()) for col in (coded, plain)], ["ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *cols], ["doc_id", "n_tokens", *names])

    last = "ids binary, decoded binary" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, n_tokens long, {last}")
