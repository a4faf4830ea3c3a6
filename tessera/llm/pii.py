"""Personal data: base patterns plus a semi-Markov conditional random field over candidate segments.

The base finds emails, IPv4 addresses, payment cards and phone numbers by fixed patterns. The model
looks at zones (runs of white-space separated chunks that hold a digit or ``@``), cuts them into
atoms and scores whole segments of at most ``MAX_ATOMS`` atoms by features of the entire span
(digits, grouping, checksum, delimiters, borders). One dynamic programme per zone chooses segment
borders and types together. Spans of the model are added where they overlap no base span; base
spans always stay. The model is fitted here by maximum likelihood (forward-backward over segments)
on generated zones, never on the corpus.

Null and empty texts have no spans; repeated rows, null ids and other columns are of no account.
All scans are linear in the text, also in runs of one character.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sliced

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 16
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_MARK = re.compile(r"[0-9@]")
_NUMERIC = re.compile(r"[0-9+(][0-9 ().+-]*[0-9]")
_SPACE = re.compile(r"\s")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > done and not _LOCAL_END.match(text[a - 1]):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not text:
        return []
    found = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(KINDS[k], a, z) for a, k, z in sorted(found)]


def zones(text: str) -> list[tuple[int, int]]:
    """Runs of chunks with a digit or @, joined over single spaces."""
    out: list[tuple[int, int]] = []
    done = 0
    m = _MARK.search(text)
    while m:
        a = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        e = _SPACE.search(text, m.end())
        z = e.start() if e else len(text)
        if out and a == out[-1][1] + 1 and text[a - 1] == " ":
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
        done = z
        m = _MARK.search(text, z)
    return out


def segment_features(text: str, a: int, z: int) -> tuple[str, ...]:
    """Features of the whole span text[a:z] and its borders."""
    s = text[a:z]
    d = _digits(s)
    letters = any(c.isalpha() for c in s)
    f = ["bias", f"digits={min(len(d), 20)}", f"letters={letters}", f"first={_shape(s[0])}", f"last={_shape(s[-1])}"]
    f.append(f"left={_shape(text[a - 1]) if a else '^'}")
    f.append(f"right={_shape(text[z]) if z < len(text) else '$'}")
    if "@" in s:
        m = _emails(s)
        f.append(f"at={s.count('@') == 1 and len(m) == 1 and m[0] == (0, len(s))}")
    if not letters:
        groups = [len(g) for g in re.findall("[0-9]+", s)]
        seps = "".join(sorted(set(re.sub("[0-9]", "", s))))
        f.append(f"seps={seps[:6]}|{len(groups) if len(groups) < 7 else 'many'}")
        f.append("groups=" + "-".join(map(str, groups[:6])))
        if groups and len(groups) == 4 and seps == ".":
            f.append(f"octets={_octets(s)}")
        if 12 <= len(d) <= 19 and set(seps) <= {" ", "-"}:
            f.append(f"luhn={luhn(d)}")
        if "(" in s or ")" in s:
            f.append(f"round={bool(re.search('[(][0-9]{2,4}[)]', s))}")
    return tuple(f)


def _shape(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c if c in "+()-.@/:,_=" else "*"


def _segments(text: str, a: int, z: int) -> tuple[list[int], list[list[tuple[int, tuple[str, ...]]]]]:
    """Atom borders, and for each end atom the (start atom, features) of the candidate segments."""
    cuts = [a + m.start() for m in _ATOM.finditer(text[a:z])] + [z]
    ends: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in cuts]
    for e in range(1, len(cuts)):
        if text[cuts[e] - 1].isspace():
            continue
        for b in range(max(0, e - MAX_ATOMS), e):
            s = text[cuts[b] : cuts[e]]
            if _candidate(s):
                ends[e].append((b, segment_features(text, cuts[b], cuts[e])))
    return cuts, ends


def _candidate(s: str) -> bool:
    """Whether a segment may be an entity at all: an address, or 4 to 19 digits with punctuation between."""
    if s.count("@") == 1:
        return s[0].isalnum() and s[-1].isalpha()
    return bool(_NUMERIC.fullmatch(s)) and 4 <= sum(map(str.isdigit, s)) <= 19


def _lse(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def _fit(samples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.25) -> dict[str, list[float]]:
    """Stochastic gradient ascent on the conditional likelihood of the segmentations."""
    w: dict[str, list[float]] = {}
    prepared = []
    for text, gold in samples:
        cuts, ends = _segments(text, 0, len(text))
        prepared.append((cuts, ends, {(a, z): KINDS.index(k) for k, a, z in gold}))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for cuts, ends, gold in prepared:
            n = len(cuts)
            score = [[(b, f, [sum(w[x][k] for x in f if x in w) for k in range(4)]) for b, f in at] for at in ends]
            alpha = [0.0] * n
            for e in range(1, n):
                alpha[e] = _lse([alpha[e - 1], *(alpha[b] + v for b, _, s in score[e] for v in s)])
            beta = [0.0] * n
            into: list[list[tuple[int, list[float]]]] = [[] for _ in range(n)]
            for e, at in enumerate(score):
                for b, _, s in at:
                    into[b].append((e, s))
            for b in range(n - 2, -1, -1):
                beta[b] = _lse([beta[b + 1], *(beta[e] + v for e, s in into[b] for v in s)])
            for e, at in enumerate(score):
                for b, f, s in at:
                    right = gold.get((cuts[b], cuts[e]))
                    for k in range(4):
                        g = (right == k) - math.exp(min(0.0, alpha[b] + s[k] + beta[e] - alpha[-1]))
                        if abs(g) > 1e-4:
                            for x in f:
                                w.setdefault(x, [-1.0 if x == "bias" else 0.0] * 4)[k] += step * g
    return {x: [round(v, 4) for v in k] for x, k in w.items()}


def _generated(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 8)))
    kind = rng.choice(["email", "ip", "card", "phone", "phone", "phone", "", "", "", "", "", ""])
    if kind == "email":
        s = rng.choice(["", word() + ".", word() + "_"]) + word() + rng.choice(["", n(2)]) + "@" + word() + rng.choice(["", "-" + word()]) + "." + rng.choice(["com", "org", "net", "co.uk", "de"])
    elif kind == "ip":
        s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        body = rng.choice("3456") + n(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        s = sep.join(body[i : i + 4] for i in range(0, 16, 4))
    elif kind == "phone":
        a, b, c = str(rng.randint(2, 9)) + n(2), n(3), n(4)
        s = rng.choice([f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {n(3)} {n(3)} {n(3)}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"1 ({a}) {b}-{c}"])
    else:
        s = rng.choice([f"{rng.randint(1900, 2030)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(2)}:{n(2)}:{n(2)}", n(rng.randint(1, 19)), f"{n(1)}.{n(1)}.{n(2)}", f"{n(3)},{n(3)}", f"{n(3)}.{n(2)}", f"v{n(1)}.{n(2)}",
                        f"{rng.randint(256, 999)}.{n(2)}.{n(3)}.{rng.randint(300, 999)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{word()}{n(4)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(4)} {n(4)} {n(4)} {n(3)}", f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(4)}-{n(4)}-{n(4)}-{n(4)}", n(16), f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(2)}%", f"@{word()}", f"{word()}@",
                        f"{n(4)}-{n(4)}", f"{n(5)}-{n(4)}", f"ID-{n(6)}-{n(4)}", f"{n(1)} {n(2)} {n(3)} {n(4)}", f"{n(4)} {n(4)}", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}"])
        if 12 <= len(_digits(s)) <= 19 and luhn(_digits(s)):
            s = s[:-1] + str((int(s[-1]) + 1) % 10) if s[-1].isdigit() else s
    left, right = rng.choice(["", "", "(", '"', word() + " ", word() + " ", word() + ": "]), rng.choice(["", "", ".", ",", ")", " " + word(), " " + word()])
    text = left + s + right
    return text, [(kind, len(left), len(left) + len(s))] if kind else []


@lru_cache(maxsize=1)
def model() -> dict[str, list[float]]:
    rng = random.Random(7)
    return _fit([_generated(rng) for _ in range(1500)])


def decode(text: str, a: int, z: int, w: dict[str, list[float]]) -> list[tuple[str, int, int]]:
    """The best joint choice of borders and types in one zone."""
    cuts, ends = _segments(text, a, z)
    best, back = [0.0] * len(cuts), [None] * len(cuts)
    for e in range(1, len(cuts)):
        best[e] = best[e - 1]
        for b, f in ends[e]:
            for k in range(4):
                v = best[b] + sum(w[x][k] for x in f if x in w)
                if v > best[e]:
                    best[e], back[e] = v, (b, k)
    out, e = [], len(cuts) - 1
    while e > 0:
        if back[e]:
            b, k = back[e]
            out.append((KINDS[k], cuts[b], cuts[e]))
            e = b
        else:
            e -= 1
    return out[::-1]


def all_spans(text: str | None, w: dict[str, list[float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    if not text:
        return base, base
    taken = sorted((a, z) for _, a, z in base)
    added = []
    i = 0
    top = 0
    for a, z in zones(text):
        for k, s, e in decode(text, a, z, w):
            while i < len(taken) and taken[i][0] < e:
                top = max(top, taken[i][1])
                i += 1
            if top <= s:
                added.append((k, s, e))
    if not added:
        return base, base
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Overlapping spans become one mask, named after the first."""
    if not spans:
        return text
    out, done, open_kind, open_end = [], 0, None, 0
    for k, a, z in spans:
        if open_kind is not None and a < open_end:
            open_end = max(open_end, z)
            continue
        if open_kind is not None:
            out.append(f"[{open_kind.upper()}]")
            done = open_end
        out.append(text[done:a])
        open_kind, open_end = k, z
    return "".join(out) + f"[{open_kind.upper()}]" + text[open_end:]


_SPANS = "array<struct<kind: string, start: long, end: long>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (kind, start, end in code points), and masked, the text with each span replaced."""
    w = model()

    def run(ids, texts):
        base, spans, masked = [], [], []
        row = lambda x: [{"kind": k, "start": a, "end": z} for k, a, z in x]
        for t in texts:
            b, s = all_spans(t, w)
            base.append(row(b))
            spans.append(row(s))
            masked.append(mask(t, s))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base, kind), pa.array(spans, kind), pa.array(masked, pa.string())], ["doc_id", "base", "spans", "masked"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, base {_SPANS}, spans {_SPANS}, masked string")


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of text masked and n_chars (where there is one) counted anew; all columns stay."""
    w = model()
    names = docs.columns
    at = names.index("text")
    schema = docs.schema

    def run(batches):
        for b in sliced(batches):
            texts = [mask(t, all_spans(t, w)[1]) for t in b.column(at).to_pylist()]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    from ..session import ship_package

    ship_package(docs.sparkSession)
    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
