"""Edge cases and brute-force comparisons of the training-data operators on small fixtures."""

import collections
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat_format, decontam, langid, near_dedup, pii, quality_gam, quality_rules, suffix_dedup, url_filter
from tessera.llm.queries import ORACLES, QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long"
RNG = random.Random(1)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]
TEXT = " ".join(RNG.choice(WORDS) for _ in range(120))
EDGE = [None, "", " \n ", "one", TEXT, TEXT, TEXT + " tail", "é" * 300, "a" * 20000, "1" * 400, "@" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, None, None, None, "k", 1) for i, t in enumerate(EDGE)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(spark, docs, empty):
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs, hot_pieces=2).collect()}
    assert got == suffix_dedup.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    twice = docs.where("doc_id in (4, 5)").union(docs.where("doc_id = 4"))
    assert sorted((r["doc_id"], len(r["spans"])) for r in suffix_dedup.suffix_dedup(twice).collect()) == [(4, 0), (4, 0), (5, 1)]


def test_suffix_dedup_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.suffix_dedup(d).collect()}
    want = suffix_dedup.brute_force([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
    assert got == {k: v[1] for k, v in want.items()}


def test_pii(docs, empty):
    w = pii.model()
    text = "mail a.b@c.org or +1 (743) 555-3824, ip 10.0.0.1 not 999.1.1.1, card 4111 1111 1111 1111, on 2024-01-15"
    base, spans = pii.all_spans(text, w)
    assert [k for k, _, _ in base] == ["email", "phone", "ip", "card"] and set(base) <= set(spans)
    assert ("phone", 5, 19) in pii.all_spans("call (651) 555-8500 now", w)[1]
    assert pii.all_spans("on 2024-01-15 at 10:20:30 paid 12.50 for 4 items", w)[1] == []
    assert pii.mask(text, spans).startswith("mail [EMAIL] or [PHONE], ip [IP] not ")
    assert pii.find_pii(docs).count() == len(EDGE) and pii.find_pii(empty).count() == 0
    assert pii.mask_documents(docs).columns == docs.columns and pii.mask_documents(docs).count() == len(EDGE)


def test_byte_bpe(docs, empty):
    import numpy as np
    import tiktoken

    path, pattern = tokenizer()
    c = byte_bpe.coder(byte_bpe.read_ranks(path), pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(2)
    for alphabet in ("ab", "the and ing", " \n\t", "éü日本", "-=#", "0123456789"):
        for n in (1, 7, 60, 900):
            s = "".join(rng.choice(alphabet) for _ in range(n))
            ids = c.encode(s)
            assert ids == np.array(enc.encode_ordinary(s), "<u4").tobytes() and c.decode(ids) == s.encode()
    rows = byte_bpe.bpe_round_trip(docs, path, pattern).collect()
    assert [bytes(r["decoded"]) for r in rows] == [(t or "").encode() for t in EDGE] and byte_bpe.bpe_round_trip(empty, path, pattern).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("x.com", "/en/", "block")], "host string, path string, verdict string")
    urls = [None, "", "nourl", "http://X.com/en/a?b", "https://a.x.com/en/", "http://y.com", "http://y.com/q", "http://y.com/q", "ftp://com/#f", "http://" + "a." * 500 + "net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"][:9], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("x.com", "/en/a", "x.com/en/", "block") and got[4] == ("a.x.com", "/en/", "x.com/en/", "block")
    assert got[5][2] is None and got[6][2] == got[7][2] == got[8][2] == "com/" and len(got) == len(urls)
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (None, 0, "user", "<|im_end|>"), (5, None, "user", "z")]
    convs = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, i string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat_format.format_chats(convs).collect()}
    assert set(got) == {1, 4, 5, None} and got[1] == (2, 2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert "< |im_end|>" in got[None][2] and chat_format.format_chats(convs.limit(0)).count() == 0


def test_chat_format_without_ids_and_of_many_turns(spark):
    import duckdb

    rng = random.Random(5)
    rows = [(None, i, "user", "hello") for i in range(40)] + [(None, 0, "user", "start"), (None, None, None, None), (None, 3, "user", f"only {1}")]
    rows += [(7, i, "user" if i % 2 else "assistant", f"turn {i} " * rng.randint(1, 4)) for i in range(3000)] + [(8, i, "user" if i % 2 else "assistant", None) for i in range(20)]
    rows += [(9, 0, "user", "start"), (9, 1, "assistant", "more"), (10, 0, "user", "hello"), (11, 0, None, ""), (12, 1, "user", "tie b"), (12, 1, "user", "tie a"), (12, 1, "assistant", "z")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(str, chat_format.format_chats(convs).collect()))
    pdf = convs.toPandas()
    pdf = pdf.astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", pdf)
    assert got == sorted(_row(["conv_id", "n_turns", "n_copies", "chat"], r) for r in con.execute(ORACLES["op5_chat_format"]).fetchall())
    assert len(got) == 7 and not any("user\\nstart<" in g and "conv_id=None" in g for g in got)


def test_decontam(spark, docs, empty):
    item = " ".join(TEXT.split()[30:45])
    items = spark.createDataFrame([(1, item), (2, "tail"), (3, None), (4, ""), (5, "not there")], "item_id long, text string")
    got = {(r["row"]["doc_id"], (r["row"]["text"] or "")[-4:]): r["hits"] for r in decontam.scan_documents(docs, items).collect()}
    hits = {k[0]: (h["n_hit"], h["items"]) for k, h in got.items() if h["n_hit"]}
    assert hits[4] == hits[5] == (15, ["1"]) and hits[6] == (16, ["1", "2"]) and len(hits) == 3
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(EDGE) - 3
    assert decontam.decontaminate(docs, items.limit(0)).count() == len(EDGE) and decontam.scan_documents(empty, items).count() == 0
    assert decontam.near_matches(docs, items).where("key in (4, 5, 6)").count() > 0


def brute_near(texts, items, window=10, distance=5, pivots=3):
    words = [(t or "").lower().split() for t in texts]
    count = collections.Counter(w for t in words for w in t)
    pairs = set()
    for item, text in items:
        w = text.split()
        for i in range(max(len(w) - window + 1, 1)):
            win = w[i : i + window]
            rare = sorted((count[x], x) for x in set(win) if count[x])[:pivots]
            alone = len(set(win)) == 1
            pairs |= {(a, b, int(alone and len(win) > 1), str(item)) for _, a in rare for _, b in rare if a < b or alone}
    near = lambda t, a, b, least: any(least <= abs(p - q) <= distance for p, x in enumerate(t) if x == a for q, y in enumerate(t) if y == b)
    return [sorted({i for a, b, least, i in pairs if near(t, a, b, least)}) for t in words]


def test_decontam_near_matches(spark):
    rng = random.Random(9)
    passage = [f"q{i}" for i in range(40)]
    changed = [w if i % 8 else "other" for i, w in enumerate(passage)]  # no ten words in a row are left
    inserted = [x for i, w in enumerate(passage) for x in ([w] if i % 8 else ["plus", w])]
    items = [(1, " ".join(["never", *passage[1:9], "seen"])), (2, " ".join(passage)), (3, "solo"), (4, "echo echo"), (5, " ".join(rng.choices(WORDS, k=30)))]
    texts = [" ".join(changed), " ".join(inserted), " ".join(passage), "a solo b", "echo x echo", "echo one two three four five six echo", None, "q1 far " + "x " * 9 + "q2"]
    texts += [" ".join(rng.choices(WORDS, k=80)) for _ in range(20)]
    ids = [0, None, None] + [7] * (len(texts) - 3)
    df = spark.createDataFrame(list(zip(ids, texts, range(len(texts)), strict=True)), "doc_id long, text string, n long")
    out = decontam.scan_documents(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r["row"]["n"]: r["hits"] for r in out}
    assert [got[i]["near"] for i in range(len(texts))] == brute_near(texts, items)
    assert got[0]["n_hit"] == got[1]["n_hit"] == 0 and got[2]["n_hit"] == 40
    assert got[0]["near"] == got[1]["near"] == got[2]["near"] == ["1", "2"] and got[3]["near"] == ["3"] and got[4]["near"] == ["4"] and got[5]["near"] == got[6]["near"] == got[7]["near"] == []


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(EDGE):
        r = got[i if i != 3 else None]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == quality_rules.brute_force(t)
    assert quality_rules.quality_rules(empty).count() == 0
    w, t = quality_rules.model()
    assert quality_rules.judge("\n".join(["Home | News | About | Login"] * 3 + ["x"]), w, t)[5] < 0.5 < quality_rules.judge((TEXT + ".\n") * 3, w, t)[5]


def brute_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_near_dedup(spark, docs, empty):
    rng = random.Random(4)
    base = TEXT.split()
    rows = [(i, t) for i, t in enumerate(EDGE)]
    for i in range(100, 160):  # one family, longer than small_list
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base[:60] + [rng.choice(WORDS) for _ in range(90)])) for i in range(200, 240)]  # a shared passage only
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, words=5).collect()}
    assert got == brute_components(rows, 5, 80)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id is null").count() == 1


def test_near_dedup_of_texts_with_one_long_passage(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = words(120), []
    for _ in range(90):  # from a few words of their own to nearly half of the text
        own = words(rng.choice([2, 5, 9, 12, 15, 20, 30, 45, 60, 90]))
        at = rng.randrange(len(own) + 1)
        texts.append(own[:at] + passage + own[at:])
    for _ in range(30):
        w = rng.choice(texts[:90])
        at = rng.randrange(len(w))
        texts.append(w[:at] + words(rng.randrange(1, 8)) + w[at:])
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 5, 80)


def test_near_dedup_where_ids_repeat_or_are_null(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, c, "x"), (7, a + " tail", "x"), (8, b + " tail", "x"), (9, d, "z"), (9, d, "y"), (9, e, "x"), (9, c + " tail", "x"), (10, text(), "x"), (None, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    kept = sorted(map(str, map(tuple, near_dedup.dedup_documents(df).collect())))
    lost = [(7, a + " tail", "x"), (8, b + " tail", "x"), (9, d, "z"), (9, c + " tail", "x")]
    assert kept == sorted(str(r) for r in rows if r not in lost)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(kept)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (7, 8, 10)} == {7: None, 8: None, 10: 10}


def test_quality_gam(spark, docs, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    score = {r["doc_id"]: r["score"] for r in quality_gam.quality_scores(d, learn).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((score[r["doc_id"]] >= 0.3) == (r["quality"] == 1) for r in held) >= 0.95 * len(held)
    none = quality_gam.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality_gam.quality_scores(empty, labels).count() == 0
    assert quality_gam.keep_good(docs, learn).columns == docs.columns


def test_langid(spark, docs, empty):
    out = QUERIES["op10_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    rows = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, {"en": "the cat sat on the mat", "fr": "le chat est sur la table"}).collect()}
    assert rows[0] == rows[1] == rows[2] == rows[9] == rows[10] == "und" and rows[4] in ("en", "fr")
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0 and langid.identify(empty, {"en": "x"}).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, df.select(names).collect())) == sorted(_row(names, r) for r in want.fetchall())


def _row(names, values):
    from pyspark.sql import Row

    return str(Row(*names)(*values))


def test_pipeline(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.4 * n < out.count() < n and out.where("n_tokens = 0").count() == 0


def test_quality_rules_agree_with_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(d).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    junk, good = ([r["kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(junk) > 20 and sum(junk) <= 0.2 * len(junk) and sum(good) >= 0.98 * len(good)


def test_line_labels_do_not_follow_length():
    w, t = quality_rules.model()
    litter = " ".join(x + "***" if i % 2 else x + "%%%" for i, x in enumerate(TEXT.split()))
    menu = " | ".join(TEXT.split()[:60])
    assert quality_rules.judge(litter, w, t)[5] == quality_rules.judge(menu, w, t)[5] == 0.0
    assert quality_rules.judge(TEXT + ".", w, t)[5] == 1.0
    assert quality_rules.judge("\n".join([TEXT + ".", menu, TEXT + "."]), w, t)[5] > 0.5


def test_langid_against_substring_search(spark):
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    han = "".join(chr(0x4E00 + i) for i in range(420))
    samples = {"en": draw("abcde ", 3000), "fr": draw("abcdéz ", 3000), "ja": draw(han[:400], 2000), "ru": draw("абвгд ", 500)}
    texts = [None, "", "12 3", "a", "é"] + [draw(a, n) for a in ("abcde ", "abcdéz ", "abxyz", "абж ", han) for n in (1, 50, 1023, 1024, 1025, 5000)]
    want = [langid.brute_force(t, samples) for t in texts]
    for cells in (langid.DENSE_CELLS, 0):
        got = langid.Parsers(samples, cells).predict(texts)
        assert [g[0] for g in got] == [x[0] for x in want] and all(abs(g[1] - x[1]) < 1e-12 for g, x in zip(got, want, strict=True))
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, samples).collect())
    assert rows == sorted((i // 2, *x) for i, x in enumerate(want))


def test_langid_of_a_very_long_text():
    samples = {"en": "the cat sat on the mat and the dog ", "fr": "le chat est sur la table et le chien "}
    assert [p[0] for p in langid.Parsers(samples).predict(["le chien est sur le chat " * 60_000, "the dog sat on the cat"])] == ["fr", "en"]


def test_langid_sample_is_shared_out(spark):
    rows = [(i, "x" * 50_000 if i == 0 else f"word{i} " * 20, "en") for i in range(40)] + [(99, "seul", "fr"), (100, None, "de"), (101, "z", None)]
    got = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars_per_lang=2000)
    assert set(got) == {"en", "fr"} and len(got["en"]) <= 2100 and sum(f"word{i} " in got["en"] for i in range(1, 40)) == 39 and got["fr"] == "seul"


def test_quality_gam_against_a_walk_of_its_tables(spark, docs):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality_gam.N_FEATURES)).astype(np.float32).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality_gam.fit(x, y)
    assert m.pairs and np.allclose(m.score(x), [m.score_one(r) for r in x], atol=1e-12)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality_gam.train(quality_gam.feature_table(d), labels)
    rows = docs.union(docs)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in quality_gam.quality_scores(rows, labels.limit(0)).collect())
    assert len(got) == 2 * len(EDGE)
    table = quality_gam.feature_table(rows)
    scores = sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 9)) for r in quality_gam.with_scores(table, m, ["doc_id"]).collect())
    want = [(i != 3, i if i != 3 else 0, round(m.score_one(quality_gam.features(t).astype(float)), 9)) for i, t in enumerate(EDGE)]
    assert scores == sorted(want * 2)


def test_quality_gam_training_rows_are_bounded(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    table = quality_gam.feature_table(d).cache()
    known = labels.where("quality is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "quality").join(table, "doc_id").orderBy("h", "doc_id").limit(50).collect()
    want = quality_gam.fit(np.frombuffer(b"".join(bytes(r["x"]) for r in known), np.float32).reshape(-1, quality_gam.N_FEATURES).astype(float), np.array([float(r["quality"]) for r in known]))
    got = quality_gam.train(table, labels, max_rows=50)
    assert all(np.array_equal(a, b) for a, b in zip(got.tables, want.tables, strict=True))


def test_byte_bpe_on_documents(spark):
    import hashlib

    import tiktoken

    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.coder(byte_bpe.read_ranks(path), pattern).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(enc.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_url_filter_judges_hot_urls_in_place(spark, monkeypatch):
    rules = spark.createDataFrame([("net", "/a/", "block"), ("x.net", "/", "allow"), ("com", "/a/", "block")], "host string, path string, verdict string")
    rng = random.Random(6)
    urls = [None] * 60 + ["http://x.net/a/b"] * 60 + [f"http://{rng.choice(['x.', 'y.', ''])}{rng.choice(['net', 'com', 'org'])}/{rng.choice(['a/', 'b/', ''])}{i}" for i in range(80)]
    pages = spark.createDataFrame([(i % 150, u, "old", i) for i, u in enumerate(urls)], "page_id long, url string, verdict string, n long")

    def want(u):
        host, path = url_parts(u)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in [("net", "/a/", "block"), ("x.net", "/", "allow"), ("com", "/a/", "block")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, "allow")

    for limit in (url_filter.FILTER_MAX_BYTES, 0):  # with the filter and without
        monkeypatch.setattr(url_filter, "FILTER_MAX_BYTES", limit)
        got = {r["n"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
        assert got == {i: want(u) for i, u in enumerate(urls)}


def url_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = rest.split("/", 1)[0].lower()
    return host, rest[len(host) :]


@pytest.mark.parametrize("min_len", [48, 279, 300, 400, 1000])
def test_suffix_dedup_of_long_strings(spark, min_len):
    rng = random.Random(min_len)
    draw = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [draw(3 * min_len) for _ in range(4)]
    texts = []
    for _ in range(60):
        s = rng.choice(shared)
        a = rng.randrange(len(s) // 2)
        texts.append(draw(rng.randrange(50)) + s[a : a + rng.randrange(min_len // 2, 2 * min_len)] + draw(rng.randrange(50)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(df, min_len, hot_pieces=8).collect()}
    assert got == suffix_dedup.brute_force(list(enumerate(texts)), min_len)
    assert any(x[0] for x in got.values())


def test_suffix_dedup_deals_hot_anchors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "JOIN_PIECES", 3)
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = draw(130)
    texts = [draw(rng.randrange(60)) + hot + draw(rng.randrange(60)) for _ in range(50)] + [None, "", draw(20_000) + hot]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.suffix_dedup(df, hot_pieces=8).collect()}
    assert got == {k: v[1] for k, v in suffix_dedup.brute_force(list(enumerate(texts))).items()}


def test_near_dedup_meets_few_rows_of_a_template(spark):
    """Pages of one template with too much of their own: no list of theirs makes pairs, whatever their number."""
    rng = random.Random(21)
    template = [f"t{i}" for i in range(120)]
    pages = [(i, " ".join(template[:60] + [f"own{i}x{j}" for j in range(21)] + template[60:])) for i in range(150)]
    close = [(1000 + i, " ".join(template[:60] + [f"few{i}x{j}" for j in range(5)] + template[60:])) for i in range(30)]
    made = []
    inner = near_dedup._fitting_pairs

    def counted(rest, percent):
        out = inner(rest, percent).cache()
        made.append((rest.count(), out.count()))
        return out

    near_dedup._fitting_pairs = counted
    try:
        for rows in (pages, pages + close):
            rng.shuffle(rows)
            got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
            assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 5, 80)
    finally:
        near_dedup._fitting_pairs = inner
    assert all(pairs <= 4 * rows for rows, pairs in made), made
    rest = spark.createDataFrame([(1, k, 137, 116, k) for k in range(200)], "v long, key long, n long, c long, root long")
    assert inner(rest, 80).count() == 0
    rest = spark.createDataFrame([(1, 1, 100, 100, 1), (1, 2, 120, 100, 2), (1, 3, 126, 101, 3), (1, 4, 90, 80, 4), (2, 5, 100, 100, 5)], "v long, key long, n long, c long, root long")
    fits = lambda x, y: 180 * min(x[1], y[1]) >= 80 * (x[0] + y[0]) and 100 * min(x[0], y[0]) >= 80 * max(x[0], y[0])
    sets = {1: (100, 100), 2: (120, 100), 3: (126, 101), 4: (90, 80)}
    assert {(r["a"], r["b"]) for r in inner(rest, 80).collect()} == {(a, b) for a in sets for b in sets if a > b and fits(sets[a], sets[b])}


def test_decontam_beyond_the_broadcast_limit(spark, monkeypatch):
    """One word is a third of the corpus and in every window; nothing is broadcast."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join("the" if rng.random() < 0.34 else rng.choice(words) for _ in range(n))
    items = [(i, text(14)) for i in range(8)] + [(8, "the the the")]
    docs = [(i, text(60) + (" " + items[i % 9][1] if i % 5 == 0 else "") + " " + text(20)) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    flat = lambda: sorted((r["row"]["doc_id"], r["hits"]["n_words"], r["hits"]["n_hit"], tuple(r["hits"]["items"]), tuple(r["hits"]["near"])) for r in decontam.scan_documents(d, b).collect())
    want = flat()
    monkeypatch.setattr(decontam, "MAX_BROADCAST_ROWS", 10)
    assert flat() == want and sum(r[2] > 0 for r in want) >= 12 and any(r[4] for r in want)


def test_a_column_named_like_the_key(spark):
    d = spark.createDataFrame([(1, TEXT, "x"), (2, TEXT, "y"), (3, "other words here", "z")], "doc_id long, text string, __KEY string")
    kept = near_dedup.dedup_documents(d)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect())) == [(1, TEXT, "x"), (3, "other words here", "z")]
    clean = decontam.decontaminate(d, spark.createDataFrame([(1, "other words here")], "item_id long, text string"))
    assert clean.columns == d.columns and sorted(r["__KEY"] for r in clean.collect()) == ["x", "y"]
