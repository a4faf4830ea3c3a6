"""Phrase collocation mining, each language for itself.

1. Words are counted. A phrase that occurs ``least`` times has only words that do; these get numbers, and the corpus is written once more as numbers,
   with all other words as borders.
2. If the first ``top`` of each language are wanted, a score is guessed that they reach. The counts of a phrase's words limit its score, and say how often it
   must occur for the guess. A count-min sketch of the phrases that are not ruled out, with at least four counters for each word of the corpus, gives an upper
   bound for each; it is a table of the counters in use, which tasks add to and Spark sums. A counter stays where its sum suffices for one of its phrases.
3. Candidates are phrases whose counter suffices, with their parts and the phrases that may hide them. Where ``top`` phrases of a language reach the guess
   when counted, it is done, as all that reach it are among them; for the others the guess is lowered, at last to nothing.
4. Candidates, in blocks of up to ``BLOCK_PATTERNS``, are compiled into one Aho-Corasick automaton. Each word is four letters, each place with letters of
   its own: these are the guards, so whole words match. Every task counts all its matches, overlapping ones too; the sums are exact, and those below ``least`` go.
5. Scores come from the exact counts by joins; arithmetic is decimal.

Counters that matter reach the executors in ranges of up to ``RANGE_COUNTERS``, one pass of the corpus each, and hashes and counts of frequent words up to
four times ``MAX_WORDS``. Beyond that, for longer phrases and without ``top``, texts are written with guards (`` w1 w2 ``, a line feed between pieces), each
length has a sketch, longer phrases are added only where their shorter parts are not ruled out, and all candidates are counted; up to ``MAX_WORDS`` frequent
words other words are borders there. So neither driver nor executor holds more than a block. No key gathers texts: all that is shuffled is summed per task first.

A null text has no words; a null lang is ``und``. Rows that repeat count as often as they occur; ids and other columns are of no account. Of equal
scores the larger count, then the lesser phrase in byte order, comes first. An empty table gives no rows. A word is told from another by a 64-bit hash
where a task counts or numbers its words, and a phrase where it lists its candidates.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable, ship_package
from .common import sliced

LEAST, LONGEST, TOP = 10, 3, 2000
MAX_WORDS = 1_000_000
RANGE_COUNTERS = 2_000_000
BLOCK_PATTERNS = 250_000
#: The score that the first phrases of a language are first sought above.
FIRST_LIMIT = 100_000
#: Phrases that a task sorts before it adds them to the sketch, and entries of a worker's tables.
_TOGETHER, _ENTRIES = 1_000_000, 200_000
#: A-Z lower-cased, a tab is a space, what ends a piece is a full stop, which is in no word. Works on UTF-8.
_FOLD = bytes(46 if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of texts that are looked at together.
_BYTES = 1 << 19
_AUTOMATA: dict[str, dict] = {}
_TABLES: dict[str, Table] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """Words and, as full stops, borders of pieces."""
    return text.translate(_FOLD).replace(b".", b" . ").split() if text else []


_BORDERS = {b"": 0, b"\n": 0, b".": 0}


class _Hashes(dict):
    """64-bit hashes of words; 0 for what is no word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _ENTRIES:
            self.clear()
            self.update(_BORDERS)
        self[word] = h = xxhash.xxh3_64_intdigest(word) or 1
        return h


_HASHES = _Hashes(_BORDERS)


def phrase_hashes(words: list[bytes], lang: str, longest: int) -> list[np.ndarray]:
    """For each length from 1: the hash of the phrase that starts at each place, 0 where a border is in it."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    real = h != 0
    mix = lambda x, y: (m := (x ^ y) * np.uint64(0x9E3779B97F4A7C15)) ^ (m >> np.uint64(29))
    x = mix(np.full(len(h), _HASHES[b"lang " + lang.encode()], np.uint64), h)
    out, ok = [np.where(real, x, 0)], real
    for n in range(2, longest + 1):
        x, ok = mix(x[:-1], h[n - 1 :]), ok[:-1] & real[n - 1 :]
        out.append(np.where(ok, x | np.uint64(1), 0))
    return out


class _Powers:
    """Powers of an odd number and of its inverse, and a number for each byte."""

    P = 0x9E3779B97F4A7C15
    letters = np.random.default_rng(12).integers(1, 2**63, 256, np.uint64)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (cls.P, pow(cls.P, -1, 2**64)))
            if n > 4 * _BYTES:  # one long word; not kept
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def word_places(texts: list[bytes], lang: str):
    """For parts of the texts: the folded bytes, and start, end and hash (64 bits, not 0) of each word. Between texts lies a border."""
    joined: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        if t is not None:
            joined.append(t)
            size += len(t)
        if joined and (t is None or size >= _BYTES):
            whole = b".".join([b"", *joined, b""]).translate(_FOLD)
            yield whole, *_places(whole, lang)
            joined, size = [], 0


def _places(whole: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(whole, np.uint8)
    in_word = (a != 32) & (a != 46)
    edges = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # some words at a time, as eight bytes are needed for each letter
        to = max(at + 1, int(np.searchsorted(end, start[at] + 2 * _BYTES)))
        base, stop = int(start[at]) - 1, int(end[to - 1])
        up, down = _Powers.upto(stop - base)
        sums = np.cumsum(_Powers.letters[a[base:stop]] * up[: stop - base])
        s, e = start[at:to] - base, end[at:to] - base
        h[at:to] = (sums[e - 1] - sums[s - 1]) * down[s] + (e - s).astype(np.uint64)
        at = to
    h = (h ^ np.uint64(_HASHES[b"lang " + lang.encode()])) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return start, end, h


def _by_lang(batches):
    """(lang, texts) of each slice of (lang, text as bytes)."""
    for b in sliced(batches, 1024):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        yield from texts.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> lang, word (binary), n of all words."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for lang, texts in _by_lang(batches):
            for whole, start, end, h in word_places(texts, lang):
                held.setdefault(lang, []).append((whole, start.astype(np.int32), end.astype(np.int32), h))
                size += len(h)
            if size >= 2 * _TOGETHER:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    def rows(held):
        for lang, parts in held.items():
            wholes, start, end, h = zip(*parts, strict=True)
            h = np.concatenate(h)
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else order
            n, at = np.diff(np.append(first, len(h))), np.sort(order[first])
            n = n[np.argsort(order[first])]
            part = np.searchsorted(np.cumsum([len(x) for x in start]), at, "right")
            words = [wholes[p][s:e] for p, s, e in zip(part.tolist(), np.concatenate(start)[at].tolist(), np.concatenate(end)[at].tolist(), strict=True)]
            for i in range(0, len(words), 10_000):
                some = words[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(n[i : i + 10_000].astype(np.int64))], ["lang", "word", "n"])

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def guarded(docs: DataFrame, known) -> DataFrame:
    """docs(lang, text) -> lang, text with a guard around every word and only pieces of several words; words not in known (a broadcast of lang -> words, counts, or of nothing) are borders."""

    def run(batches):
        sets: dict[str, set] = {}
        for lang, texts in _by_lang(batches):
            out = []
            if known.value is not None and lang not in sets:
                sets[lang] = set(known.value[lang][0]) if lang in known.value else set()
            for t in texts:
                if known.value is None:
                    kept = [b"\n" if w == b"." else w for w in words_of(t)]
                else:
                    own = sets[lang]
                    kept = [w if w in own else b"\n" for w in words_of(t)]
                whole = b"\n".join(p for p in (b" " + b" ".join(kept) + b" ").split(b"\n") if p.count(b" ") > 2)
                if whole:
                    out.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["lang", "text"])

    return docs.mapInArrow(run, "lang string, text string")


class Table:
    """Numbers of a sorted array, found by hashing with open addressing for many values at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))  # a free slot leads to this one, which no value equals
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """For each value its number, or -1."""
        at = self._home(values)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != values))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != values[todo])]
        return out


def table(key: str, numbers: np.ndarray) -> Table:
    """The table of these numbers; a worker keeps the last few."""
    if key not in _TABLES:
        if len(_TABLES) > 2:
            _TABLES.clear()
        _TABLES[key] = Table(numbers)
    return _TABLES[key]


def sketch(corpus: DataFrame, n: int, bits: int, shorter: np.ndarray | None) -> DataFrame:
    """bucket, count of the phrases of n words of guarded texts; shorter: the counters that phrases of n - 1 words must have, if they are known."""
    shared, key = corpus.sparkSession.sparkContext.broadcast(shorter), uuid.uuid4().hex
    shift = np.uint64(64 - bits)

    def run(batches):
        held, size = [], 0

        def rows():
            got, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]) >> shift, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(got.astype(np.int64)), pa.array(count.astype(np.int64))], ["bucket", "count"])

        for lang, texts in _by_lang(batches):
            hashes = phrase_hashes(b" \n ".join(texts).split(b" "), lang, n)
            ok = hashes[-1] != 0
            if shared.value is not None and len(ok):
                part = table(key, shared.value).find(hashes[-2] >> shift) >= 0
                ok &= part[:-1] & part[1:]
            held.append(hashes[-1][ok])
            size += len(held[-1])
            if size >= _TOGETHER:
                yield rows()
                held, size = [], 0
        yield rows()

    return corpus.mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def candidates(corpus: DataFrame, n: int, bits: int, heavy: np.ndarray) -> DataFrame:
    """lang, phrase: the phrases of n words whose counter is in heavy (sorted), each once."""
    shared, key = corpus.sparkSession.sparkContext.broadcast(heavy), uuid.uuid4().hex
    shift = np.uint64(64 - bits)

    def run(batches):
        seen: set[int] = set()
        for lang, texts in _by_lang(batches):
            words = b" \n ".join(texts).split(b" ")
            h = phrase_hashes(words, lang, n)[-1]
            at = np.flatnonzero(h)
            at = at[table(key, shared.value).find(h[at] >> shift) >= 0]
            own, first = np.unique(h[at], return_index=True)
            out = []
            for x, i in zip(own.tolist(), at[first].tolist(), strict=True):
                if x not in seen:
                    seen.add(x)
                    out.append(b" ".join(words[i : i + n]))
            if len(seen) > _ENTRIES:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["lang", "phrase"])

    return corpus.mapInArrow(run, "lang string, phrase string").distinct()


def automata(key: str, patterns: list[tuple[int, str, str]]) -> dict:
    """lang -> (automaton of the guarded phrases, their ids); a worker keeps those of the last block."""
    import ahocorasick

    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        out: dict[str, tuple] = {}
        for i, lang, phrase in patterns:
            a, ids = out.setdefault(lang, (ahocorasick.Automaton(), []))
            a.add_word(f" {phrase} ", len(ids))
            ids.append(i)
        for a, _ in out.values():
            a.make_automaton()
        _AUTOMATA[key] = out
    return _AUTOMATA[key]


def matches(corpus: DataFrame, patterns: list[tuple[int, str, str]]) -> DataFrame:
    """id, a: occurrences, overlapping ones too, of patterns(id, lang, phrase) in guarded texts of their language."""
    shared, key = corpus.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

    def run(batches):
        own = automata(key, shared.value)
        counts = {lang: np.zeros(len(ids), np.int64) for lang, (_, ids) in own.items()}
        for lang, texts in _by_lang(batches):
            if lang in own:
                for t in texts:
                    got = np.fromiter(map(itemgetter(1), own[lang][0].iter(t.decode())), np.int64)
                    if len(got) * 8 < len(counts[lang]):
                        np.add.at(counts[lang], got, 1)
                    else:
                        counts[lang] += np.bincount(got, minlength=len(counts[lang]))
        for lang, (_, ids) in own.items():
            some = np.flatnonzero(counts[lang])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[some]), pa.array(counts[lang][some])], ["id", "a"])

    langs = sorted({lang for _, lang, _ in patterns})
    return corpus.where(F.col("lang").isin(langs)).mapInArrow(run, "id long, a long").groupBy("id").agg(F.sum("a").alias("a"))


def _ranges(counters: DataFrame, total: int, bits: int):
    """(sorted numbers of counters, their counts), RANGE_COUNTERS at a time or about so, as hashes are even."""
    parts = max(1, -(-total // RANGE_COUNTERS))
    for i in range(parts):
        lo, hi = (i << bits) // parts, ((i + 1) << bits) // parts
        got = counters.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).toArrow()
        if len(got):
            bucket, count = (got.column(c).to_numpy() for c in ("bucket", "count"))
            order = np.argsort(bucket)
            yield bucket[order].astype(np.uint64), count[order]


class Corpus:
    """A corpus made ready: lang, word, n of all words; frequent words, and how many there are; bits of the sketch's counters."""

    def __init__(self, docs: DataFrame, least: int):
        self.rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        self.least = least
        self.words = durable(word_counts(self.rows), "words")
        self.frequent = self.words.where(F.col("n") >= least)
        self.n_frequent = self.frequent.count()
        total = self.words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.bits = min(62, max(16, math.ceil(math.log2(4 * total + 1))))

    def guard(self) -> None:
        """Writes the texts with guards; infrequent words are borders if the frequent ones are few."""
        known: dict[str, tuple[list, list]] = {}
        few = self.n_frequent <= MAX_WORDS
        if few:
            for r in self.frequent.toArrow().to_batches():
                for lang, word, n in zip(*(r.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                    own = known.setdefault(lang, ([], []))
                    own[0].append(word)
                    own[1].append(n)
        self.texts = durable(guarded(self.rows, self.rows.sparkSession.sparkContext.broadcast(known if few else None)), "guarded")

    def counters(self, n: int, shorter: np.ndarray | None = None) -> DataFrame:
        return durable(sketch(self.texts, n, self.bits, shorter).where(F.col("count") >= self.least), "counters")


def _counted(corpus: Corpus, listed: DataFrame) -> DataFrame | None:
    """lang, phrase, a of those of listed(lang, phrase) that occur often enough, block by block."""
    listed = durable(listed.withColumn("id", F.monotonically_increasing_id()).withColumn("h", F.pmod(F.xxhash64("lang", "phrase"), F.lit(1 << 40))), "listed")
    blocks = max(1, -(-listed.count() // BLOCK_PATTERNS))
    counts = None
    for i in range(blocks):
        got = listed.where((F.col("h") * blocks / (1 << 40)).cast("long") == i).select("id", "lang", "phrase").toArrow()
        patterns = list(zip(*(got.column(c).to_pylist() for c in range(3)), strict=True))
        if patterns:
            part = durable(matches(corpus.texts, patterns).where(F.col("a") >= corpus.least), "matches")
            counts = part if counts is None else counts.unionByName(part)
    return None if counts is None else durable(listed.select("id", "lang", "phrase").join(counts, "id").select("lang", "phrase", "a"), "counts")


def all_phrases(corpus: Corpus, longest: int) -> DataFrame | None:
    """lang, phrase, a of all phrases of 2 to longest words that occur often enough."""
    corpus.guard()
    shorter, found = None, None
    for n in range(2, longest + 1):
        counters = corpus.counters(n, shorter)
        some = counters.count()
        shorter = None
        for heavy, _ in _ranges(counters, some, corpus.bits):
            part = durable(candidates(corpus.texts, n, corpus.bits, heavy), "candidates")
            found = part if found is None else found.unionByName(part)
            shorter = heavy if some <= RANGE_COUNTERS else None
        if not some:
            break
    return None if found is None else _counted(corpus, found)


class Numbered:
    """A corpus as numbers of its frequent words, which are sorted by their hashes: lang, ids (32-bit; 0 is a border). names has each word's id, lang and word."""

    def __init__(self, corpus: Corpus):
        spark = corpus.rows.sparkSession
        hashed = durable(_with_hash(corpus.frequent), "hashed")
        got = hashed.select("h", "n").toArrow()
        h, n = (got.column(c).to_numpy() for c in ("h", "n"))
        h = h.view(np.uint64) if len(h) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.key = spark.sparkContext.broadcast(h[order]), uuid.uuid4().hex
        self.n_of = spark.sparkContext.broadcast(np.append(0, n[order]).astype(np.float64))
        self.names = durable(self._named(hashed), "names")
        self.texts = durable(self._encoded(corpus.rows), "numbered")
        self.least, self.bits = corpus.least, corpus.bits

    def _named(self, hashed: DataFrame) -> DataFrame:
        hashes = self.hashes

        def run(batches):
            for b in batches:
                at = np.searchsorted(hashes.value, b.column(2).to_numpy().view(np.uint64)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), b.column(1)], ["id", "lang", "word"])

        return hashed.select("lang", "word", "h").mapInArrow(run, "id int, lang string, word binary")

    def _encoded(self, rows: DataFrame) -> DataFrame:
        hashes, key = self.hashes, self.key

        def run(batches):
            for lang, texts in _by_lang(batches):
                for whole, start, _, h in word_places(texts, lang):
                    ids = table(key, hashes.value).find(h) + 1
                    stops = np.searchsorted(start, np.flatnonzero(np.frombuffer(whole, np.uint8) == 46))
                    ids = _pieces(np.insert(ids, stops[np.append(True, stops[1:] != stops[:-1])], 0))
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ids.tobytes()], pa.binary())], ["lang", "ids"])

        return rows.mapInArrow(run, "lang string, ids binary")

    def of(self, langs: list[str]) -> DataFrame:
        return self.texts.where(F.col("lang").isin(langs))


def _with_hash(words: DataFrame) -> DataFrame:
    """words(lang, word, n) with their hashes h."""

    def run(batches):
        for b in batches:
            h = np.zeros(b.num_rows, np.uint64)
            lang, word = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for one in set(lang):
                at = np.flatnonzero(lang == one)
                h[at] = np.concatenate([x[3] for x in word_places([word[i] for i in at.tolist()], one)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], ["lang", "word", "n", "h"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word binary, n long, h long")


def _pieces(ids: np.ndarray) -> np.ndarray:
    """ids without pieces of one word, and with one border after each piece."""
    real = np.concatenate([[False], ids > 0, [False]])
    real[1:-1] &= real[:-2] | real[2:]
    at = np.flatnonzero(real[1:-1] | real[:-2])
    return np.append(np.where(real[1:-1][at], ids[at], 0), 0).astype(np.int32)


def _numbers(batches):
    """(lang, ids) of each row of numbered texts."""
    for b in batches:
        for lang, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield lang, np.frombuffer(ids.as_buffer(), np.int32)


def _able(ids: np.ndarray, n_of: np.ndarray, size: int, limit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of 2 or 3 words start whose words leave a score of limit possible, and how often each must occur for it.

    A phrase occurs at most as often as any of its words, and its parts of several words as often as it does at least.
    """
    n, share = n_of[ids], limit * 1e-6 * (1 - 1e-9)
    first, last = n[: 1 - size], n[size - 1 :]
    a, high = np.minimum(first, last), np.maximum(first, last)
    if size == 3:
        a = np.minimum(a, n[1:-1])
    at = np.flatnonzero((a > 0) & (a >= share * high))
    need = share * high[at] if size == 3 else np.sqrt(share * first[at] * last[at])
    return at, np.maximum(least, np.ceil(need * (1 - 1e-9))).astype(np.int64)


def _codes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the phrases that start there."""
    x = (ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64)
    for y in [np.uint64(2)] if size == 2 else [np.uint64(3), ids[at + 2].astype(np.uint64) << np.uint64(20)]:
        x = (x ^ y) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def limited_sketch(corpus: Numbered, langs: list[str], limit: int) -> DataFrame:
    """bucket, count of the phrases of 2 and 3 words that may score limit, where the count suffices for one of the bucket's phrases."""
    n_of, least, shift = corpus.n_of, corpus.least, np.uint64(64 - corpus.bits)

    def run(batches):
        held, size = [], 0

        def rows():
            bucket, need = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(bucket)
            bucket, need = bucket[order], need[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            count = np.diff(np.append(first, len(bucket)))
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(np.minimum.reduceat(need, first))], ["bucket", "count", "need"])

        for _, ids in _numbers(batches):
            for words in (2, 3):
                at, need = _able(ids, n_of.value, words, limit, least)
                if len(at):
                    held.append((_codes(ids, at, words) >> shift, need))
                    size += len(at)
            if size >= _TOGETHER:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    counters = corpus.of(langs).mapInArrow(run, "bucket long, count long, need long").groupBy("bucket").agg(F.sum("count").alias("count"), F.min("need").alias("need"))
    return counters.where("count >= need").select("bucket", "count")


def limited_candidates(corpus: Numbered, langs: list[str], limit: int, numbers: np.ndarray, counts: np.ndarray) -> DataFrame:
    """lang, i, j, k (0: none): the phrases whose counters suffice for a score of limit, each once."""
    n_of, least, shift = corpus.n_of, corpus.least, np.uint64(64 - corpus.bits)
    shared, key = corpus.texts.sparkSession.sparkContext.broadcast((numbers, counts)), uuid.uuid4().hex

    def run(batches):
        seen: set[int] = set()
        for lang, ids in _numbers(batches):
            for size in (2, 3):
                at, need = _able(ids, n_of.value, size, limit, least)
                code = _codes(ids, at, size)
                found = table(key, shared.value[0]).find(code >> shift)
                ok = np.flatnonzero(found >= 0)
                ok = ok[shared.value[1][found[ok]] >= need[ok]]
                own, nth = np.unique(code[ok], return_index=True)
                new = [i for x, i in zip(own.tolist(), nth.tolist(), strict=True) if x not in seen]
                seen.update(own.tolist())
                yield _phrases(lang, ids, at[ok[new]], size)
            if len(seen) > _ENTRIES:
                seen.clear()

    return corpus.of(langs).mapInArrow(run, "lang string, i int, j int, k int").distinct()


def _phrases(lang: str, ids: np.ndarray, at: np.ndarray, size: int, **more: np.ndarray) -> pa.RecordBatch:
    third = ids[at + 2] if size == 3 else np.zeros(len(at), np.int32)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *map(pa.array, (ids[at], ids[at + 1], third, *more.values()))], ["lang", "i", "j", "k", *more])


def around(corpus: Numbered, langs: list[str], pairs: np.ndarray) -> DataFrame:
    """lang, i, j, k of the phrases of three words that hold one of the pairs (hashes) and occur often enough."""
    shared, key = corpus.texts.sparkSession.sparkContext.broadcast(np.unique(pairs)), uuid.uuid4().hex

    def run(batches):
        for lang, ids in _numbers(batches):
            chosen = table(key, shared.value).find(_codes(ids, np.arange(len(ids) - 1), 2)) >= 0
            real = ids > 0
            at = np.flatnonzero((chosen[:-1] | chosen[1:]) & real[:-2] & real[1:-1] & real[2:])
            _, nth, count = np.unique(_codes(ids, at, 3), return_index=True, return_counts=True)
            yield _phrases(lang, ids, at[nth], 3, n=count.astype(np.int64))

    return corpus.of(langs).mapInArrow(run, "lang string, i int, j int, k int, n long").groupBy("lang", "i", "j", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= corpus.least).drop("n")


def letters(ids: np.ndarray) -> str:
    """Four letters for each word. Each place has letters of its own: they are the guards, no match starts or ends inside a word."""
    x = ids.astype(np.uint32)
    return np.stack([x >> 18 & 63, x >> 12 & 63 | 64, x >> 6 & 63 | 128, x & 63 | 192], axis=-1).astype(np.uint8).tobytes().decode("latin-1")


def numbered_automaton(key: str, patterns: np.ndarray):
    """The automaton of phrases (rows of three numbers), as letters; a worker keeps that of the last block."""
    import ahocorasick

    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        a = ahocorasick.Automaton()
        for nth, (text, third) in enumerate(zip(map("".join, zip(*[iter(letters(patterns.ravel()))] * 12, strict=True)), patterns[:, 2].tolist(), strict=True)):
            a.add_word(text if third else text[:8], nth)
        a.make_automaton()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def numbered_matches(corpus: Numbered, langs: list[str], ids_of: np.ndarray, patterns: np.ndarray) -> DataFrame:
    """id, a: occurrences, overlapping ones too, of patterns (rows of three numbers)."""
    shared, key, n_of = corpus.texts.sparkSession.sparkContext.broadcast((ids_of, patterns)), uuid.uuid4().hex, corpus.n_of

    def run(batches):
        ids_of, patterns = shared.value
        own = numbered_automaton(key, patterns)
        used = np.zeros(len(n_of.value), bool)
        used[patterns.ravel()] = True
        used[0] = False
        counts = np.zeros(len(patterns), np.int64)
        for _, ids in _numbers(batches):
            text = letters(_pieces(np.where(used[ids], ids, 0)))  # words of no pattern are borders
            got = np.fromiter(map(itemgetter(1), own.iter(text)), np.int64)
            if len(got) * 8 < len(counts):
                np.add.at(counts, got, 1)
            else:
                counts += np.bincount(got, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids_of[some]), pa.array(counts[some])], ["id", "a"])

    return corpus.of(langs).mapInArrow(run, "id long, a long").groupBy("id").agg(F.sum("a").alias("a"))


def _numbered_counts(corpus: Numbered, langs: list[str], listed: DataFrame) -> DataFrame:
    """lang, phrase, a, own of those of listed(lang, i, j, k, own) that occur often enough, block by block."""
    listed = durable(listed.withColumn("id", F.monotonically_increasing_id()).withColumn("h", F.pmod(F.xxhash64("i", "j", "k"), F.lit(1 << 40))), "listed")
    blocks = max(1, -(-listed.count() // BLOCK_PATTERNS))
    counts = None
    for nth in range(blocks):
        got = listed.where((F.col("h") * blocks / (1 << 40)).cast("long") == nth).select("id", "i", "j", "k").toArrow()
        if len(got):
            patterns = np.stack([got.column(c).to_numpy() for c in "ijk"], axis=1)
            part = durable(numbered_matches(corpus, langs, got.column("id").to_numpy(), patterns).where(F.col("a") >= corpus.least), "matches")
            counts = part if counts is None else counts.unionByName(part)
    rows = listed.join(counts, "id")
    for c in "ijk":
        rows = rows.join(corpus.names.select(F.col("id").alias(c), F.col("word").cast("string").alias(f"{c}_")), c, "inner" if c != "k" else "left")
    return durable(rows.select("lang", F.concat_ws(" ", "i_", "j_", "k_").alias("phrase"), "a", "own"), "counts")


def first_phrases(corpus: Corpus, top: int, step: int = 8) -> DataFrame | None:
    """scored() of the first ``top`` phrases of each language, with some more.

    Phrases that may score FIRST_LIMIT are counted, with their parts and what may hold them. The languages in which ``top`` phrases do score it are done; for the
    others the limit is divided by ``step``, and in the end there is none.
    """
    if not corpus.n_frequent:
        return None
    numbered = Numbered(corpus)
    langs, limit, done = [r[0] for r in numbered.texts.select("lang").distinct().collect()], FIRST_LIMIT, None
    while langs:
        counters = durable(limited_sketch(numbered, langs, limit), "counters")
        found = None
        for heavy, counts in _ranges(counters, counters.count(), numbered.bits):
            part = durable(limited_candidates(numbered, langs, limit, heavy, counts), "candidates")
            found = part if found is None else found.unionByName(part)
        enough = {} if found is None else {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
        full = [x for x in langs if enough.get(x, 0) >= (top if limit else 1)]
        if full:
            own = found.where(F.col("lang").isin(full)).distinct()
            pair = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.lit(0).alias("k"))
            more = own.where("k > 0").select("lang", F.explode(F.array(pair("i", "j"), pair("j", "k"))).alias("p")).select("lang", "p.*")
            if limit:  # else all that occur often enough are among the candidates
                pairs = own.where("k = 0")
                parts = max(1, -(-pairs.count() // RANGE_COUNTERS))
                for nth in range(parts):
                    got = pairs.where(F.pmod(F.xxhash64("i", "j"), F.lit(parts)) == nth).select("i", "j").toArrow()
                    if len(got):
                        ids = np.stack([got.column(c).to_numpy() for c in "ij"], axis=1).ravel()
                        more = more.unionByName(around(numbered, full, _codes(ids, np.arange(0, len(ids), 2), 2)))
            listed = own.withColumn("own", F.lit(True)).unionByName(more.withColumn("own", F.lit(False))).groupBy("lang", "i", "j", "k").agg(F.max("own").alias("own"))
            counted = _numbered_counts(numbered, full, listed)
            rows = durable(scored(corpus, counted.where("own").drop("own"), counted.drop("own")).where(F.col("score") >= limit), "scored")
            n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
            full = [x for x in full if n.get(x, 0) >= top or not limit]
            rows = rows.where(F.col("lang").isin(full))
            done = rows if done is None else done.unionByName(rows)
        langs = [x for x in langs if x not in full] if limit else []
        limit = limit // step if limit >= 1000 else 0
    return done


def _part(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(corpus: Corpus, phrases: DataFrame, counted: DataFrame) -> DataFrame:
    """phrases(lang, phrase, a) that no longer phrase of counted(lang, phrase, a) hides: lang, phrase, a, l, r, score. counted has their parts of several words."""
    phrases, every = (t.withColumn("w", F.split("phrase", " ")) for t in (phrases, counted))
    single = corpus.frequent.select("lang", F.col("word").cast("string").alias("part"), F.col("n").alias("f"))
    several = counted.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.size("w").alias("of"), _part(F.col("w"), F.lit(1), F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.size("w")).alias("rest"))

    def looked_up(rows: DataFrame, part: str, name: str, alone: Column) -> DataFrame:
        """Words and longer parts have their counts in tables of their own."""
        of = lambda t: t.select("lang", F.col("part").alias(part), F.col("f").alias(name))
        return rows.where(alone).join(of(single), ["lang", part]).unionByName(rows.where(~alone).join(of(several), ["lang", part]))

    both = looked_up(looked_up(cuts, "first", "l", F.col("k") == 1), "rest", "r", F.col("of") - F.col("k") == 1)
    big = lambda c: F.col(c).cast("decimal(16,0)")
    each = both.withColumns({"a_": big("a"), "l_": big("l"), "r_": big("r")}).withColumn("score", F.expr("(a_ * a_ * cast(1000000 as decimal(7,0))) div (l_ * r_)"))
    best = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = every.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    inside = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    held = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True)))
    return kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """docs(lang, text) -> lang, rank (from 1), phrase, a, l, r, n, score of the first ``top`` phrases of each language, or of all."""
    corpus = Corpus(docs, least)
    if top is not None and longest == 3 and corpus.n_frequent <= 4 * MAX_WORDS:
        rows = first_phrases(corpus, top)
    else:
        counted = all_phrases(corpus, longest)
        rows = None if counted is None else scored(corpus, counted, counted)
    if rows is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = corpus.words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force(docs: list[tuple], least: int = LEAST, longest: int = LONGEST, top: int | None = TOP) -> list[tuple]:
    """The rows of collocations() of docs(lang, text) by plain counting; for tests."""
    f: dict[str, Counter] = {}
    for lang, text in docs:
        own = f.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            own.update(tuple(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        big = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        hidden = {p[i : i + k] for p, b in big.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 50 * own[p[i : i + k]]}
        rows = []
        for p, a in big.items():
            if p not in hidden:
                score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out
