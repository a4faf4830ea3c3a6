"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. A test item
gives windows of ``window`` consecutive words (a shorter item, but not an empty one, is one window).

1. Collection counts of the items' words, over all documents, tell which words of a window are rare.
2. The index stores postings (term, document, position) of the words that are among the rarest
   ``pivots`` of some window. Lists of one term are never gathered: they stay rows.
3. A window's lists are intersected, rarest first, with positions shifted by the word's offset.
4. The surviving (document, start) pairs are compared with the whole window in the document: exact
   phrase matches.
5. Proximity matches: of each window the ``pivots`` rarest words that occur at all, any two of them
   within ``DISTANCE`` words of each other in a document. Three words of ten have two at most four
   places apart, so an exact window of three such words also matches here, and so does one with a word
   inserted. A window of one distinct word needs it once more within the distance, or once if it is
   one word long; a window of several of which one alone occurs has no match. These matches are
   returned beside the exact ones and leave a document as clean as it was.

Only the items' words, a table as large as the benchmark, are broadcast, and only up to
``MAX_BROADCAST_ROWS`` rows; beyond that the joins shuffle, and the rows of a word are dealt over ``SPLITS`` tasks. Null texts have no words. Rows that share a
doc_id, or have none, are judged each on their own text. Extra columns are of no account. Of words that
occur equally often the lesser one counts as rarer. An empty benchmark leaves every document clean, an
empty table of documents gives no rows. A text of any length is split whole; its row holds its words and
the places at which some window's rare words fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, key_set_aside, row_keys

WINDOW = 10
PIVOTS = 3
DISTANCE = 5
MAX_BROADCAST_ROWS = 200_000
SPLITS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def _met(large: DataFrame, small: DataFrame, rows: int, on: list[str], spread: list[str]) -> DataFrame:
    """large joined with small on ``on``. Beyond the broadcast limit each row of small goes to SPLITS places, and rows of large are dealt over these by the columns ``spread``, so that no frequent word is one task."""
    if rows <= MAX_BROADCAST_ROWS:
        return large.join(F.broadcast(small), on)
    dealt = large.withColumn("place", F.pmod(F.xxhash64(*spread), F.lit(SPLITS)).cast("int"))
    everywhere = small.withColumn("place", F.explode(F.array(*map(F.lit, range(SPLITS)))))
    return dealt.join(everywhere, [*on, "place"]).drop("place")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (number by content), words, n and item_id, one row for each window of each item."""
    w = items.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    rows = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, F.lit(window)))).alias("words"))
    return rows.select(F.xxhash64(F.concat_ws(" ", "words")).alias("win"), "words", F.size("words").alias("n"), "item_id").distinct()


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term, cf: occurrences in all documents of the given terms; terms that never occur are left out."""
    words = docs.select(F.posexplode(words_of(F.col("text"))).alias("pos", "term")) if n_terms > MAX_BROADCAST_ROWS else docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return _met(words, terms, n_terms, ["term"], ["pos"]).groupBy("term").agg(F.count("*").alias("cf"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term, key, pos: the index rows of the given terms in keyed rows."""
    words = docs.select(F.col("__key").alias("key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return _met(words, terms, n_terms, ["term"], ["key", "pos"]).select("term", "key", "pos")


def rare_terms(windows: DataFrame, counts: DataFrame, n_rows: int, pivots: int = PIVOTS) -> DataFrame:
    """win, term, off, nth: the rarest distinct words of each window that occurs at all, with an offset of each."""
    terms = windows.select("win", F.posexplode("words").alias("off", "term")).groupBy("win", "term").agg(F.min("off").alias("off"))
    with_cf = terms.join(_small(counts, n_rows), "term", "left")
    best = with_cf.groupBy("win").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "term", "off"))), 1, pivots).alias("p"))
    return best.where("p[0].cf > 0").select("win", F.size("p").alias("lists"), F.posexplode("p").alias("nth", "p")).select("win", "lists", "nth", "p.term", "p.off")


def near_pairs(windows: DataFrame, counts: DataFrame, n_rows: int, pivots: int = PIVOTS) -> DataFrame:
    """pair, t1, t2, least, win: every two of the rarest words of each window that occur, t1 <= t2, and their least distance."""
    terms = windows.select("win", "n", F.size(F.array_distinct("words")).alias("kinds"), F.explode(F.array_distinct("words")).alias("term"))
    best = terms.join(_small(counts, n_rows), "term").groupBy("win", "n", "kinds").agg(F.slice(F.array_sort(F.collect_list(F.struct("cf", "term"))), 1, pivots).alias("p"))
    first = best.select("win", "n", "kinds", F.col("p.term").alias("s"), F.posexplode("p.term").alias("i", "a"))
    others = F.when(F.col("kinds") == 1, F.col("s")).otherwise(F.slice("s", F.col("i") + 2, F.lit(pivots)))
    two = first.select("win", "n", "kinds", "a", F.explode(others).alias("b"))
    named = two.select("win", F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2"), F.when((F.col("kinds") == 1) & (F.col("n") > 1), 1).otherwise(0).alias("least"))
    return named.select(F.xxhash64("t1", "t2", "least").alias("pair"), "t1", "t2", "least", "win")


def near_hits(index: DataFrame, pairs: DataFrame, n_pairs: int, distance: int = DISTANCE) -> DataFrame:
    """key, pair: the pairs whose words stand within ``distance`` words of each other. Positions differ, so the next ``distance`` postings hold all of a posting's partners."""
    w = W.partitionBy("key").orderBy("pos")
    after = [F.struct(F.lead("pos", i).over(w).alias("pos"), F.lead("term", i).over(w).alias("term")) for i in range(1, distance + 1)]
    around = index.select("key", "pos", "term", F.array(F.struct("pos", "term"), *after).alias("xs")).select("key", "pos", "term", F.explode("xs").alias("x")).where(F.col("x.pos") - F.col("pos") <= distance)
    met = around.select("key", F.least("term", "x.term").alias("t1"), F.greatest("term", "x.term").alias("t2"), (F.col("x.pos") - F.col("pos")).alias("gap"))
    return _met(met, pairs.select("pair", "t1", "t2", "least").distinct(), n_pairs, ["t1", "t2"], ["key"]).where("gap >= least").select("key", "pair").distinct()


def _indexed(docs: DataFrame, items: DataFrame, window: int, pivots: int, near: bool) -> tuple:
    """windows, rare words of the windows and their number, pairs (if near) and their number, index of all these words."""
    windows = durable(item_windows(items, window), "windows")
    distinct = windows.select("win", "words", "n").distinct()
    terms = distinct.select(F.explode("words").alias("term")).distinct()
    n_terms = terms.count()
    counts = durable(term_counts(docs, terms, n_terms), "counts")
    rare = durable(rare_terms(distinct, counts, n_terms, pivots), "rare")
    names = rare.select("term")
    pairs = durable(near_pairs(distinct, counts, n_terms, pivots), "pairs") if near else None
    if near:
        names = names.unionByName(pairs.select(F.col("t1").alias("term"))).unionByName(pairs.select(F.col("t2").alias("term")))
    index = durable(postings(docs, names.distinct(), n_terms), "postings")
    return windows, rare, rare.count(), pairs, pairs.count() if near else 0, index


def phrase_matches(index: DataFrame, rare: DataFrame, n_rare: int, pivots: int = PIVOTS) -> DataFrame:
    """key, win, start of each place where all of a window's rare words stand at their offsets."""
    hits = None
    for nth in range(pivots):
        own = rare.where(F.col("nth") == nth).select("term", "win", "off", "lists")
        shifted = _met(index, own, n_rare, ["term"], ["key"]).select("key", "win", (F.col("pos") - F.col("off")).alias("start"), "lists").where("start >= 0")
        if hits is None:
            hits = shifted.distinct()
        else:
            done = hits.where(F.col("lists") <= nth)
            hits = hits.where(F.col("lists") > nth).join(shifted.drop("lists").distinct(), ["key", "win", "start"], "left_semi").unionByName(done)
    return hits.select("key", "win", "start")


def scan_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, pivots: int = PIVOTS, near: bool = True) -> DataFrame:
    """All columns of docs as row; n_words, n_hit, items (ids as sorted strings) and, of proximity matches, near (same) in a struct named hits."""
    docs, names = key_set_aside(docs)
    docs, _ = row_keys(docs)
    windows, rare, n_rare, pairs, n_pairs, index = _indexed(docs, items, window, pivots, near)
    found = phrase_matches(index, rare, n_rare, pivots)
    by_win = windows.groupBy("win").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    places = found.join(_small(by_win, windows.count()), "win").groupBy("key").agg(F.collect_list(F.struct(F.col("start"), F.col("n"), F.col("words"), F.col("items"))).alias("places"))
    kept = docs.select(F.struct(*[F.col(f"`{now}`").alias(was) for was, now in names.items()]).alias("row"), F.col("__key").alias("key"))
    if near:
        by_pair = durable(pairs.join(windows.select("win", F.col("item_id").cast("string").alias("item")), "win").select("pair", "item").distinct(), "pair-items")
        close = near_hits(index, pairs, n_pairs).join(_small(by_pair, by_pair.count()), "pair").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("near"))
        kept = kept.join(durable(close, "near"), "key", "left")
    joined = kept.join(places, "key", "left").withColumn("w", words_of(F.col("row.text")))
    true = F.filter(F.coalesce("places", F.array().cast(places.schema["places"].dataType)), lambda p: F.slice(F.col("w"), p["start"] + 1, p["n"]) == p["words"])
    exact = joined.withColumn("true", F.when(F.col("places").isNull(), F.lit(None)).otherwise(true))
    hit = F.size(F.array_distinct(F.flatten(F.transform("true", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda p: p["items"]))))
    none = F.array().cast(T.ArrayType(T.StringType()))
    clean = F.col("true").isNull() | (F.size("true") == 0)
    return exact.select("row", F.struct(
        F.size("w").cast("long").alias("n_words"), F.when(clean, F.lit(0)).otherwise(hit).cast("long").alias("n_hit"), F.when(clean, none).otherwise(ids).alias("items"),
        *([F.coalesce("near", none).alias("near")] if near else []),
    ).alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, pivots: int = PIVOTS) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns."""
    return scan_documents(docs, items, window, pivots, near=False).where("hits.n_hit = 0").select("row.*")


def near_matches(docs: DataFrame, items: DataFrame, distance: int = DISTANCE, window: int = WINDOW) -> DataFrame:
    """key (of row_keys), win: documents with a proximity match of each window."""
    docs, _ = row_keys(key_set_aside(docs)[0])
    _, _, _, pairs, n_pairs, index = _indexed(docs, items, window, PIVOTS, near=True)
    return near_hits(index, pairs, n_pairs, distance).join(_small(pairs.select("pair", "win"), n_pairs), "pair").select("key", "win").distinct()
