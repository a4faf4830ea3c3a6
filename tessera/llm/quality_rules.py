"""Quality rules: Viterbi decoding of a linear-chain conditional random field marks lines as content or boilerplate.

Every non-blank line gets shape features (length, punctuation, symbols, separators, digits, case,
repeats); one chain per text is decoded and the share of characters in content lines decides
retention. The chain's weights are fitted here by maximum likelihood on generated line sequences.
Before that a text fails the base rules if it has under 20 words, or over 30 % of its words lie
in 8-word windows that occur twice or more in it.

Words are maximal runs of non-white-space (space, \\x09-\\x0D). Null counts as a text without words.
Repeated rows, null ids and other columns are of no account; an empty table gives no rows; of equal
paths the one with content is taken. Time and memory are linear in a text's length.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, map_batches

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CONTENT_SHARE = 0.5
_SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 1 if chr(_c).isascii() and chr(_c).isupper() else 2 if chr(_c).isascii() and chr(_c).islower() or _c >= 128 else 3 if 48 <= _c <= 57 else 4 if _c in _SYMBOLS else 5 if _c in b".,;:" else 6 if _c in b"!?" else 7 if _c in b" \t\r\x0b\x0c" else 0
FEATURES = 16


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - 2:
        return 0
    span = 1
    while span < window:  # numbers of windows of span words, from those of half as many
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids = np.unique(pair, return_inverse=True)
        span *= 2
    hit = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_features(lines: list[bytes], again: list[bool]) -> np.ndarray:
    """One row of features for each line; all of them lie in 0..1."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer(b"".join(lines), np.uint8)
    owner = np.repeat(np.arange(len(lines)), sizes)
    counts = np.bincount(owner * 8 + _CLASS[flat], minlength=8 * len(lines)).reshape(-1, 8)
    n = np.maximum(sizes, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    x = np.zeros((len(lines), FEATURES))
    x[:, 0] = 1
    x[:, 1] = sizes < 25
    x[:, 2] = (sizes >= 25) & (sizes < 60)
    x[:, 3] = sizes >= 120
    x[:, 4] = np.minimum(1, 2.5 * counts[:, 4] / n)
    x[:, 5] = np.minimum(1, 4 * counts[:, 3] / n)
    x[:, 6] = (counts[:, 1] / letters > 0.5) & (letters > 4)
    x[:, 7] = (counts[:, 1] + counts[:, 2]) / n
    x[:, 8] = np.minimum(1, 20 * counts[:, 5] / n)
    x[:, 9] = [s.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for s in lines]
    words = [t.split() for t in lines]
    spaces = np.fromiter(map(len, words), np.int64, len(lines))
    bars = np.fromiter((s.count(b"|") + s.count(b">") + s.count(b"\xc2\xbb") for s in lines), np.int64, len(lines))
    x[:, 10] = np.minimum(1, bars / 3)
    x[:, 11] = again
    x[:, 12] = np.minimum(1, 10 * counts[:, 6] / n)
    x[:, 13] = np.minimum(1, 0.5 * counts[:, 4] / np.maximum(spaces, 1))
    x[:, 14] = np.minimum(1, bars / np.maximum(spaces, 1))
    x[:, 15] = [sum(map(bytes.__eq__, t, t[1:])) / max(len(t), 1) for t in words]
    return x


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best labels: 1 content, 0 boilerplate. emit: lines x 2."""
    e, (m00, m01, m10, m11) = emit.tolist(), move.ravel().tolist()
    a, b = e[0]
    back = []
    for x, y in e[1:]:
        p = a + m00 < b + m10
        q = a + m01 < b + m11
        back.append((p, q))
        a, b = x + (b + m10 if p else a + m00), y + (b + m11 if q else a + m01)
    s = int(b >= a)
    path = [s]
    for step in reversed(back):
        s = int(step[s])
        path.append(s)
    return path[::-1]


def _punctuated(rng: random.Random, words: list[str]) -> list[str]:
    return [x + rng.choice([".", ",", ""]) if i % 7 == 4 else x for i, x in enumerate(words)]


def _content_line(rng: random.Random, words: list[str]) -> str:
    """A sentence or more; now and then with a price, a percentage, a list mark or a heading mark."""
    w = _punctuated(rng, words)
    for _ in range(rng.choice([0, 0, 0, 1, 2]) if len(w) > 7 else 0):
        w[rng.randrange(len(w))] = rng.choice(["$5", "20%", "R&D", "C#", "1999", "(see", "3.5"])
    lead = rng.choice([""] * 9 + ["* ", "# ", "- "])
    return lead + " ".join(w).capitalize() + rng.choice([".", ".", ".", ".", "?", ""])


def _boilerplate_line(rng: random.Random, w: list[str], kind: int) -> str:
    """Menus, symbol litter, shouting, number rows, breadcrumbs, tag clouds and stuttered words of any length, half of them with a sentence's own marks."""
    if rng.random() < 0.5:
        w = _punctuated(rng, w)
        w[-1] += rng.choice([".", ""])
    if kind == 0:
        return rng.choice([" | ", " | ", " > ", " » ", " * "]).join(w)
    if kind == 1:
        tail, share = rng.sample(["###", "***", "%%%", "&&&", "$$$", "#", "*", "<>", "||"], 4), rng.choice([0.5, 0.7, 1.0])
        return " ".join(x + rng.choice(tail) if rng.random() < share else x for x in w)
    if kind == 2:
        return rng.choice(["!! ", "! ", " - "]).join(w).upper() + "!!"
    if kind == 3:
        return " ".join(x.capitalize() for x in w[:4])
    if kind == 6:
        return " ".join(x for x in w for _ in range(rng.randint(2, 8)))
    if kind == 4:
        return " ".join(str(rng.randint(0, 99999)) for _ in w)
    return rng.choice(["> ", "<", "# "]) + rng.choice([" > ", " #", " <> "]).join(w)


def _generated(rng: random.Random) -> tuple[list[bytes], list[int]]:
    """Lines and labels (1 content) of one text; both kinds of line come in all lengths, so length alone decides nothing."""
    word = lambda: "".join(rng.choice("etaoinshrdlucmfé") for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 9])))
    lines: list[bytes] = []
    labels: list[int] = []
    for _ in range(rng.randint(1, 4)):
        content, kind = rng.random() < 0.6, rng.randint(0, 6)
        for _ in range(rng.randint(1, 6)):
            w = [word() for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20, 30, 50, 80]))]
            labels.append(int(content))
            again = labels[-2:-1] == labels[-1:] and rng.random() < 0.1
            lines.append(lines[-1] if again else (_content_line(rng, w) if content else _boilerplate_line(rng, w, kind)).encode())
    return lines, labels


@lru_cache(maxsize=1)
def model(texts: int = 500, epochs: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent on the likelihood, with a small penalty on size."""
    rng = random.Random(11)
    data = []
    for _ in range(texts):
        lines, y = _generated(rng)
        data.append((line_features(lines, _again(lines)), np.array(y)))
    w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    size = {"w": np.zeros_like(w), "t": np.zeros_like(t)}  # running squares of each gradient, so that rare features learn as fast
    for epoch in range(epochs):
        rate = 0.1 / (1 + 0.2 * epoch)
        for x, y in data:
            e, n = x @ w, len(y)
            f, b = np.zeros((n, 2)), np.zeros((n, 2))
            f[0] = e[0]
            for i in range(1, n):
                f[i] = e[i] + np.logaddexp(f[i - 1, 0] + t[0], f[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                v = e[i + 1] + b[i + 1]
                b[i] = np.logaddexp(t[:, 0] + v[0], t[:, 1] + v[1])
            z = np.logaddexp(*f[-1])
            gw = x.T @ (np.eye(2)[y] - np.exp(f + b - z)) - 1e-3 * w
            gt = np.zeros((2, 2))
            for i in range(1, n):
                gt -= np.exp(f[i - 1][:, None] + t + (e[i] + b[i])[None, :] - z)
                gt[y[i - 1], y[i]] += 1
            for name, value, g in (("w", w, gw), ("t", t, gt)):
                size[name] = 0.99 * size[name] + 0.01 * g * g
                value += rate * g / np.sqrt(size[name] + 1e-3)
    return w, t


def _again(lines: list[bytes]) -> list[bool]:
    seen: set[bytes] = set()
    out = []
    for s in lines:
        out.append(s in seen)
        seen.add(s)
    return out


def judge(text: str | None, w: np.ndarray, t: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content share."""
    data = as_utf8(text)
    words = data.split()
    if not words:
        return 0, 0, sum(data.count(c) for c in _SYMBOLS), 0, 0, 0.0
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(c for c in range(256) if not 0x80 <= c < 0xC0)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [s for s in data.split(b"\n") if s and not s.isspace()]
    again = _again(lines)
    path = viterbi(line_features(lines, again) @ w, t)
    sizes = list(map(len, lines))
    share = sum(n for n, y in zip(sizes, path, strict=True) if y) / sum(sizes)
    return len(words), chars, symbols, sum(again), repeated_words(words), share


def quality_rules(docs: DataFrame, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept for every row."""
    w, t = model()

    def run(ids, texts):
        rows = [judge(x, w, t) for x in texts]
        cols = list(zip(*rows, strict=True))
        failed = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rows]
        kept = [not f and r[5] >= min_share for f, r in zip(failed, rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64()), pa.array(failed), pa.array(kept)],
                                          ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


_WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """The base counts straight from their definitions; for tests."""
    text = text or ""
    words = _WORD.findall(text)
    grams: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        grams.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    hit = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(WINDOW)}
    lines = [s for s in text.split("\n") if _WORD.search(s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
