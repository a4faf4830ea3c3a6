"""The pipeline and personal data against plain Python, and their edge cases."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import byte_bpe, pii, quality_gam
from tessera.llm.queries import QUERIES, tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base_of(text):
    """The base spans straight from their patterns."""
    out = []
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
    ]
    for k, (kind, pattern, ok) in enumerate(checks):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


def test_base_spans_of_random_strings():
    rng = random.Random(1)
    pieces = ["a", "@", ".", "-", "+", "1", "22", "255", "256", " ", "(", ")", "4111 1111 1111 1111", "x@y.z", "10.0.0.1", "+1 (555) 123-4567", "é", "\n", "0", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == base_of(text), text


def test_pii_query_against_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = 0
    for r in QUERIES["op2_pii"](spark, SF).collect():
        base = base_of(texts[r["doc_id"]])
        found += len(base)
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        spans = [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]))) and len(spans) - len(base) == r["n_added"]
        added = [s for s in spans if s not in base]
        assert all(z <= a2 or z2 <= a for _, a, z in added for _, a2, z2 in spans if (a, z) != (a2, z2))
    assert found > 5


def _scored(text, a, z, w):
    """(start, end, kind, score) of every candidate segment of a zone."""
    cuts, ends = pii._segments(text, a, z)
    return cuts, [(b, e, k, sum(w[x][k] for x in f if x in w)) for e, at in enumerate(ends) for b, f in at for k in range(4)]


def test_decoder_against_all_segmentations():
    """The dynamic programme finds the best of all sets of disjoint segments with their types, by trying every one."""
    rng, w = random.Random(3), pii.model()
    marks = ["651", "555", "8500", "4111", "10", "0", "255", ".", "-", " ", "(", ")", "+1 ", "a", "@", "b.org", ":", "/"]
    texts = ["(651) 555-8500", "at 10:20:30", "4111-1111-1111-1112", "a1@b", "12.50 7", "+1 (651) 555-8500, 10.0.0.1", "651-555-8500 651 555 8501"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts += [pii._generated(rng)[0] for _ in range(200)]
    several = 0
    for text in texts:
        for a, z in pii.zones(text):
            cuts, segments = _scored(text, a, z, w)

            def sets(e, done):  # every set of disjoint segments, from the end
                if e <= 0:
                    yield 0.0, []
                    return
                yield from sets(e - 1, done)
                for b, end, k, v in done.get(e, ()):
                    yield from ((v + x, [(b, end, k), *rest]) for x, rest in sets(b, done))

            by_end = {}
            for seg in segments:
                if seg[3] > -1:  # a segment that takes away is in no best set
                    by_end.setdefault(seg[1], []).append(seg)
            if sum(map(len, by_end.values())) > 24:
                continue
            best = max(sets(len(cuts) - 1, by_end), key=lambda x: x[0])
            got = pii.decode(text, a, z, w)
            value = {(cuts[b], cuts[e], k): v for b, e, k, v in segments}
            assert abs(sum(value[s, e, pii.KINDS.index(k)] for k, s, e in got) - best[0]) < 1e-9, text
            several += len(got) > 0
    assert several > 30


def _digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def test_added_spans_on_planted_documents(spark):
    """Phones in forms that the base does not read, and numbers that are none, planted in documents: 7 forms and 9 forms, 40 of each."""
    rng, w = random.Random(12), pii.model()
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 100 and 3000").collect()]
    area = lambda: str(rng.randint(2, 9)) + _digits(rng, 2)
    n = lambda k: _digits(rng, k)
    phones = [lambda: f"({area()}) {n(3)}-{n(4)}", lambda: f"{area()}-{n(3)}-{n(4)}", lambda: f"1-{area()}-{n(3)}-{n(4)}", lambda: f"{area()}.{n(3)}.{n(4)}", lambda: f"{area()} {n(3)} {n(4)}", lambda: f"({area()}){n(3)}-{n(4)}", lambda: f"1 ({area()}) {n(3)}-{n(4)}"]
    others = [lambda: f"{rng.randint(1990, 2030)}-{n(2)}-{n(2)}", lambda: f"{n(2)}:{n(2)}:{n(2)}", lambda: f"{n(3)},{n(3)}.{n(2)}", lambda: f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"{n(1)}.{n(2)}.{n(1)}", lambda: n(6), lambda: f"{n(5)}-{n(4)}", lambda: f"{n(4)}-{n(4)}-{n(4)}", lambda: f"{n(2)}/{n(2)}"]
    hit = wrong = 0
    for i in range(40 * 16):
        form = (phones + others)[i % 16]
        text, s = rng.choice(prose), form()
        at = rng.choice([k for k, c in enumerate(text) if c == " "])
        base, spans = pii.all_spans(f"{text[:at]} {s}{text[at:]}", w)
        own = [x for x in spans if x[1] < at + 1 + len(s) and x[2] > at + 1]
        if form in phones:
            hit += ("phone", at + 1, at + 1 + len(s)) in own
        else:
            wrong += any(x not in base for x in own)
    assert hit >= 0.97 * 280 and wrong <= 0.01 * 360


def test_line_labels_against_all_sequences():
    """Viterbi's sequence is the best of all."""
    from tessera.llm import quality_rules as qr

    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        emit, move = rng.normal(size=(n, 2)) * 2, rng.normal(size=(2, 2))
        score = lambda y: sum(emit[i, c] for i, c in enumerate(y)) + sum(move[p, q] for p, q in zip(y, y[1:], strict=False))
        assert list(qr.viterbi(emit, move)) == list(max(itertools.product((0, 1), repeat=n), key=score))
    w, t = qr.model()
    lines = [b"home | about | contact", b"A long line of plain words that tells of something and goes on.", b"click here", b"home | about | contact"]
    x = qr.line_features(lines, qr._again(lines)) @ w
    best = max(itertools.product((0, 1), repeat=4), key=lambda y: sum(x[i, c] for i, c in enumerate(y)) + sum(t[p, q] for p, q in zip(y, y[1:], strict=False)))
    assert list(qr.viterbi(x, t)) == list(best)


def words5(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def item_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_pipeline_against_plain_python(spark):
    import tiktoken

    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = {r["doc_id"]: r["text"] for r in read("documents").collect()}
    model = quality_gam.train(quality_gam.feature_table(read("documents")), read("labels"))
    good = {i: t for i, t in docs.items() if model.score_one(quality_gam.features(t).astype(float)) >= quality_gam.THRESHOLD}
    sets = {i: words5(t or "") for i, t in good.items()}
    root = {i: i for i in good}
    for a in sorted(good):
        for b in sorted(good):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    single = {i: t for i, t in good.items() if root[i] == i}
    windows = set()
    for r in read("benchmark").collect():
        w = item_words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(x) for x in windows}
    held = lambda t: any(tuple(w[i : i + n]) in windows for w in [item_words(t)] for n in sizes for i in range(len(w) - n + 1))
    clean = {i: t for i, t in single.items() if not held(t)}
    assert len(docs) > len(good) > len(single) > len(clean) > 0
    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.coder(byte_bpe.read_ranks(path), pattern).ranks, special_tokens={})
    weights = pii.model()
    want = {}
    for i, t in clean.items():
        masked = pii.mask(t or "", pii.all_spans(t or "", weights)[1])
        want[i] = (enc.encode_ordinary(masked), masked)
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"]: (np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"]).decode()) for r in out}
    assert len(out) == len(got) and got == want and all(r["n_tokens"] == len(got[r["doc_id"]][0]) for r in out)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    """Nulls in any column, empty and very long texts, repeated rows, ties, extra columns and an empty table."""
    rng = random.Random(zlib.crc32(name.encode()))
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and"]) + str(rng.randrange(99)) for _ in range(n)) + "."
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))  # about a megabyte
    t = text(80)
    rows = [(1, t), (1, t), (2, text(70)), (2, text(70)), (None, text(60)), (None, text(60)), (None, None), (3, None), (4, ""), (5, " \n "), (6, long_), (7, "mail a.b@c.org now " + text(30))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, __text string"
    df = spark.createDataFrame([(i, x, None, None, len(x or ""), "r", None, None) for i, x in rows], schema)
    out = stage(spark, df, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == (["doc_id", "n_tokens", "ids", "decoded"] if last else df.columns)
    got = out.collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got)
    every = sorted((i is not None, i or 0) for i, _ in rows)
    if name == "near-dedup":
        assert ids == sorted([x for x in every if x != (True, 1)] + [(True, 1)])  # the two rows of id 1 are copies
    elif name == "quality classifier":
        assert set(ids) <= set(every) and len(ids) <= len(every)
    else:
        assert ids == every
    if name == "pii":
        assert [r["text"] for r in got if r["doc_id"] == 7][0].startswith("mail [EMAIL] now ") and all((r["text"] is None) == (r["doc_id"] in (3,) or (r["doc_id"] is None and r["n_chars"] == 0)) for r in got)
    assert stage(spark, df.limit(0), SF).count() == 0 and stage(spark, df.limit(0), SF).columns == out.columns
