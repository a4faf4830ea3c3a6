"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it
greedily into longest matches; the fewer phrases a letter needs, the better the language explains
it, and the fewest normalised phrases win (ties: the lesser language code). A step that has no
transition already leads to the next phrase's first state, so a whole batch of text, cut into blocks
that advance side by side, moves one character with one lookup; block borders cut no match. A letter
that a language's sample lacks is a phrase of its own there. Steps are a table where that takes at most
``DENSE_CELLS`` cells, and sorted keys for languages of more characters, with the same results.

The automata are fitted on a bounded sample: per language the ``docs_per_lang`` labelled documents
of least hash, up to ``chars_per_lang`` characters together, for the ``max_langs`` languages with the most
labelled documents. Prediction covers whole texts, of any length. Null texts and texts without letters are
``und`` with score 0. Without training rows everything is ``und``; an empty table gives no rows.
Repeated rows are judged alike; null ids and other columns are of no account.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from .common import sliced

SAMPLE_DOCS = 64
SAMPLE_CHARS = 30_000
MAX_LANGS = 256
DENSE_CELLS = 4_000_000
_BLOCK = 1024
_PASS = 4_000_000
_TOGETHER = 2_000_000
_MODELS: dict[int, Parsers] = {}


def letters_only(text: str) -> str:
    """Lower case; every other character than a letter is a space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: the transitions of each state. State 0 is the start."""
    nxt, link, size = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _openings(edges: list[dict[int, int]], width: int) -> np.ndarray:
    """The state after each symbol that opens a phrase. Symbol 0, a foreign letter, leads to the last state, which has no transitions."""
    root = np.full(width, len(edges) - 1, np.int32)
    for c, t in edges[0].items():
        root[c] = t
    return root


class _Dense:
    """Steps of one language as a table. Entry [state, symbol] is 2 * next state + 1 where the symbol opens a phrase."""

    def __init__(self, edges: list[dict[int, int]], width: int):
        self.width, root = width, _openings(edges, width)
        table = np.repeat((root * 2 + 1)[None, :], len(edges), axis=0)
        for s, d in enumerate(edges):
            for c, t in d.items():
                table[s, c] = t * 2
        self.table = table.ravel()

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table[state * self.width + symbol]


class _Sparse:
    """The same steps as sorted keys, for languages of many characters, whose table would be large and empty."""

    def __init__(self, edges: list[dict[int, int]], width: int):
        self.width = width
        rows = sorted((s * width + c, t) for s, d in enumerate(edges) for c, t in d.items())
        self.keys = np.array([*(k for k, _ in rows), np.iinfo(np.int64).max], np.int64)
        self.to = np.array([*(t for _, t in rows), 0], np.int32)
        self.root = _openings(edges, width)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at] * 2, self.root[symbol] * 2 + 1)


class Parsers:
    """Parsing automata of all languages. Every letter of any sample has a code; each language knows its own sample's letters."""

    def __init__(self, samples: dict[str, str], dense_cells: int = DENSE_CELLS):
        self.langs = sorted(samples)
        clean = [np.frombuffer(letters_only(samples[k]).encode("utf-32-le", "surrogatepass"), np.uint32) for k in self.langs]
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *clean]))
        self.code = np.zeros(0x110000, np.uint32)
        self.code[known] = np.arange(1, len(known) + 1)
        self.own, self.steps, self.start = [], [], []
        for points in clean:
            letters = np.unique(points)
            codes, width, own = self.code[points], len(known) + 1, None
            edges = [*automaton(codes.tolist()), {}]
            if len(edges) * width > dense_cells:  # a table for this language's letters alone, if that is small enough
                own = np.zeros(width, np.uint32)
                own[self.code[letters]] = np.arange(1, len(letters) + 1)
                edges = [{int(own[c]): t for c, t in d.items()} for d in edges]
                width = len(letters) + 1
            self.own.append(own)
            self.start.append(len(edges) - 1)
            self.steps.append((_Dense if len(edges) * width <= dense_cells else _Sparse)(edges, width))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, characters parsed by text).

        Blocks of all texts advance side by side, each as if a text began there. Then each block is parsed anew from
        where the block before it ended, until it comes to a state that it had at that place before; as states
        follow from one another, the rest of the block stands. This goes on until no block's start changes, so
        the phrases are those of one parse over the whole text.
        """
        codes = [self.code[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
        owner, rows, sizes = [], [], []
        for i, c in enumerate(codes):
            for a in range(0, len(c), _BLOCK):
                owner.append(i)
                rows.append(c[a : a + _BLOCK])
                sizes.append(len(rows[-1]))
        out = np.zeros((len(texts), len(self.langs)))
        if not rows:
            return out, np.zeros(len(texts))
        order = np.argsort(-np.array(sizes), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes_, owner_ = np.array(sizes)[order], np.array(owner)[order]
        # column of the block before, in the same text
        before = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(np.diff(owner) == 0) + 1
        before[place[same]] = place[same - 1]
        grid = np.zeros((int(sizes_[0]), len(rows)), np.uint32)
        for at, i in enumerate(order):
            grid[: len(rows[i]), at] = rows[i]
        live = np.searchsorted(-sizes_, -np.arange(1, len(grid) + 1), side="right")
        last = sizes_ - 1
        for k, (own, steps, first) in enumerate(zip(self.own, self.steps, self.start, strict=True)):
            symbols = grid if own is None else own[grid]
            trail = np.zeros(grid.shape, np.int32)  # 2 * state after each character + 1 where it opens a phrase
            state = np.full(len(rows), first, np.int32)
            opened = np.zeros(len(rows), np.int64)
            for step, n in enumerate(live):
                got = steps.step(state[:n], symbols[step, :n])
                trail[step, :n] = got
                opened[:n] += got & 1
                state[:n] = got >> 1
            start = np.full(len(rows), first, np.int32)
            while True:
                want = np.where(before >= 0, trail[last[before], before] >> 1, first)
                active = np.flatnonzero(want != start)
                if not len(active):
                    break
                start, state = want, want[active]
                for step in range(len(grid)):
                    inside = last[active] >= step
                    if not inside.all():
                        active, state = active[inside], state[inside]
                    if not len(active):
                        break
                    got, was = steps.step(state, symbols[step, active]), trail[step, active]
                    trail[step, active] = got
                    opened[active] += (got & 1) - (was & 1)
                    moved = (got >> 1) != (was >> 1)
                    active, state = active[moved], got[moved] >> 1
            np.add.at(out[:, k], owner_, opened)
        return out, np.bincount(owner_, sizes_, len(texts))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text, in passes of about _PASS characters, which bounds a worker's memory by its longest text."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= _PASS:
                out += self._predict(part)
                part, size = [], 0
        return out + self._predict(part)

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        clean = [letters_only(t) if t else "" for t in texts]
        count, size = self.phrases(clean)
        out = []
        for t, n, m in zip(clean, count, size, strict=True):
            if not self.langs or not t or t.isspace():
                out.append(("und", 0.0))
                continue
            rate = n / m
            best = int(np.argmin(rate))
            rest = float(np.min(np.delete(rate, best))) if len(rate) > 1 else 2 * float(rate[best])
            out.append((self.langs[best], rest / (rest + float(rate[best]))))
        return out


def _even_share(sizes: list[int], budget: int) -> int:
    """The most characters to take of each text so that all together stay within budget."""
    left = budget
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            return share
        left -= n
    return max(sizes, default=0)


def training_sample(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars_per_lang: int = SAMPLE_CHARS, max_langs: int = MAX_LANGS) -> dict[str, str]:
    """lang -> text: of each language the documents of least hash, the characters shared out evenly among them.

    What reaches the driver is bounded by max_langs (the languages with most labelled documents) times four times chars_per_lang.
    """
    rows = docs.where("text is not null and lang is not null and text <> ''").select("lang", F.xxhash64("doc_id", "lang").alias("h"), "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    limit = F.lit(-(2.0**63)) + F.lit(2.0**64 * 8 * docs_per_lang) / F.col("n")
    near = rows.join(F.broadcast(counts), "lang").where(F.col("h").cast("double") < limit)
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= docs_per_lang)
    most = F.ceil(F.lit(4 * chars_per_lang) / F.least("n", F.lit(docs_per_lang))).cast("int")
    texts: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "r").select("lang", F.substring("text", F.lit(1), F.least(most, F.lit(chars_per_lang))).alias("text")).collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    share = {k: _even_share(list(map(len, t)), chars_per_lang) for k, t in texts.items()}
    return {k: " ".join(x[: share[k]] for x in t) for k, t in texts.items()}


def parsers(key: int, samples: dict[str, str]) -> Parsers:
    """The parsers of the samples with this hash; a worker keeps the last ones."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Parsers(samples)
    return _MODELS[key]


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score for every row. samples: lang -> text; each worker builds the automata once."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = hash(tuple(sorted(samples.items())))

    def judged(ids: list, texts: list) -> pa.RecordBatch:
        got = parsers(key, shared.value).predict(texts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    def run(batches):
        """Arrow batches are gathered up to _TOGETHER characters, as a step costs much the same for few texts and for many."""
        ids, texts, size = [], [], 0
        for b in sliced(batches):
            ids += b.column(0).to_pylist()
            texts += (new := b.column(1).to_pylist())
            size += sum(len(t or "") for t in new)
            if size >= _TOGETHER:
                yield judged(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield judged(ids, texts)

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def brute_force(text: str | None, samples: dict[str, str]) -> tuple[str, float]:
    """The prediction for one text by searching longest matches as substrings; for tests."""
    t = letters_only(text or "")
    if not samples or not t.strip():
        return "und", 0.0
    rate = {}
    for lang in sorted(samples):
        corpus, at, n = letters_only(samples[lang]), 0, 0
        while at < len(t):
            size = 1
            while at + size < len(t) and t[at : at + size + 1] in corpus:
                size += 1
            at, n = at + size, n + 1
        rate[lang] = n / len(t)
    best = min(rate, key=lambda k: (rate[k], k))
    rest = min((r for k, r in rate.items() if k != best), default=2 * rate[best])
    return best, rest / (rest + rate[best])
