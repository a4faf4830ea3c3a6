"""Packing against whole-text tokenization, plain counting and awkward rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, size=1024):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset), docs: doc_id -> ids. Padding in all."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r[0]].append(r)
        sequences[r[5]].append((r[6], r[2]))
    assert set(pieces) == set(docs)
    for doc, ids in docs.items():
        at = 0
        for _, start, length, crc, of, _, _ in sorted(pieces[doc], key=lambda r: r[1]):
            assert start == at and length > 0 and of == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_op13_on_documents(spark, whole):
    docs = {r["doc_id"]: whole(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [tuple(r) for r in QUERIES["op13_packing"](spark, SF).collect()]
    assert check(rows, docs) == 0
    cut = sum(n > 1 for d, n in collections.Counter(r[0] for r in rows).items() if len(docs[d]) <= 1024)
    assert cut < len(docs) / 2  # tiny tasks: what is open at their end is a large part


def test_seams_never_change_ids(whole, monkeypatch):
    rng = random.Random(5)
    coder = packing.Coder(open(PATH, encoding="utf-8").read())
    marks = ["a", "b ", " c", "  ", "\n", " \n ", "\t", "'s", "'ll x", "7", "é", " ", " ", "\x1c", "\x85", "。", "!!", " ?", "<|endoftext|>", "😀", "‍", "word", "mot,", 'Ünï"', "x)", "\u2003", "_"]
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 500)  # memory is cleared now and then
    for _ in range(400):
        texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(10)]
        for _ in range(2):  # also from memory
            for t, ids in zip(texts, coder.encode(texts), strict=True):
                assert [*np.frombuffer(ids, "<u4"), 0] == whole(t), repr(t)


def test_sum_of_squares_choice():
    """Every placement makes the counted sum of squares least, by trying all levels."""
    rng, p, size = random.Random(2), packing.Packer(64), 64
    free = {1, 2, 4, 8, 16, 32, 64}
    cost = lambda count: sum(n * n for h, n in count.items() if h not in free)
    placed = 0
    for i in range(3000):
        n = rng.choice([3, 7, 11, 20, 21, 33, rng.randrange(1, 64)])
        before = collections.Counter({h: int(c) for h, c in enumerate(p.count) if c})
        best = min(cost(before - collections.Counter([h]) + collections.Counter([h + n])) for h in [0, *before] if h + n <= size)
        p.add(i, bytes(4 * n))
        assert cost({h: int(c) for h, c in enumerate(p.count)}) == best
        placed += n
    assert int((p.count > 0).sum()) < 64 and all(len(w) == c for w, c in zip(p.windows, p.count, strict=True))
    done = p.finish()
    assert sum(len(x[2]) // 4 for w in done for x in w) == placed
    assert all((f := sum(len(x[2]) // 4 for x in w)) & (f - 1) == 0 for w in done)


def test_documents_stay_whole_in_the_long_run():
    rng, p = random.Random(3), packing.Packer()
    for i in range(20_000):
        p.add(i, bytes(4 * max(1, min(1024, int(rng.lognormvariate(5, 1))))))
    pieces = collections.Counter(x[0] for w in p.finish() for x in w)
    assert sum(n > 1 for n in pieces.values()) < 400  # 2 % of documents


def test_awkward_rows(spark, whole):
    long = "word " * 70_000 + "a" * 50_000
    texts = [None, "", " ", "x", "x", long, "<|endoftext|> y"]
    rows = [(i, t, 5, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, __key string").coalesce(1)
    json = open(PATH, encoding="utf-8").read()
    got = packing.pack_documents(df, json)
    assert check([tuple(r)[:7] for r in got.collect()], {i: whole(t) for i, t in enumerate(texts)}) == 0
    back = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["start"])):
        back[r["doc_id"]] += r["ids"]
    assert back[5] == whole(long)
    twice = df.selectExpr("cast(null as long) doc_id", "text")
    assert packing.pack_documents(twice, json).where("doc_id is not null").count() == 0
    assert sum(r["length"] for r in packing.pack_documents(twice, json).collect()) == sum(len(whole(t)) for t in texts)
    assert packing.pack_documents(df.limit(0), json).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, json, size=1000)
