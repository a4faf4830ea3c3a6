"""A stored BM25 index: postings in blocks of documents, laid out by word, searched with block maxima and updated by block.

A block is a run of documents. A row holds one word's documents of a block, how often and where they have it and how long they are; its
greatest frequency and least length bound what the word can add to a score in that block. A search reads these bounds first, scores the
most promising blocks of each question, and then only blocks whose bound reaches the k-th best score so far. Texts are read when documents
come or change, never by a search. An update writes the blocks of changed documents anew, without them, and a block of what came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import durable, ship_package
from ..streaming.state_log import StateLog

K1, B = 1.2, 0.75
BLOCK_DOCS = 4096
BUCKETS = 32
#: Blocks of each question that are scored before the others are held against what they give.
FIRST_BLOCKS = 4
#: Questions' terms are broadcast up to this many.
MAX_BROADCAST = 10_000
POSTINGS = "block long, bucket int, word string, at array<int>, ids array<long>, tfs array<int>, dls array<int>, places array<array<int>>, max_tf int, min_dl int"
DOCS = "block long, at int, id long, dl int"


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _blocks(docs: DataFrame, batch: int) -> DataFrame:
    """docs(id, text) -> block, word, at, ids, tfs, dls, places; ``at`` is a document's number in its block. The row without a word has all documents of the block, which are in no order."""

    def rows(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts)
        ids, t = held.column("id").combine_chunks(), held.column("t")
        dls = pc.list_value_length(t).to_numpy().astype(np.int32)
        words = pc.list_flatten(t).dictionary_encode().unify_dictionaries().combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        code = words.indices.to_numpy(zero_copy_only=False)
        # tokens in order of word, document and place, as sorting keeps the order of those of a word
        order = np.argsort(code, kind="stable")
        code = code[order]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), dls)[order]
        place = (np.arange(len(order)) - np.repeat(np.cumsum(dls, dtype=np.int64) - dls, dls)).astype(np.int32)[order]
        new_word = np.diff(code, prepend=-1) != 0
        pair = np.flatnonzero(new_word | (np.diff(doc, prepend=-1) != 0))  # where a word's next document begins
        of_word = np.flatnonzero(new_word[pair])
        none, n = len(ids), len(pair)
        at = np.concatenate([np.arange(none, dtype=np.int32), doc[pair]])
        tf = np.concatenate([np.zeros(none, np.int32), np.diff(pair, append=len(order)).astype(np.int32)])
        lists = pa.array(np.concatenate([[0], none + of_word, [none + n]]), pa.int32())
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(none), pair, [len(order)]]), pa.int32()), pa.array(place))
        nested = [pa.array(at), ids.take(pa.array(at)), pa.array(tf), pa.array(dls[at]), each]
        word = pa.concat_arrays([pa.array([None], pa.string()), words.dictionary.cast(pa.string()).take(pa.array(code[pair[of_word]]))])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block)), word, *(pa.ListArray.from_arrays(lists, x) for x in nested)], ["block", "word", "at", "ids", "tfs", "dls", "places"])

    def run(batches):
        from pyspark import TaskContext

        block = (batch << 44) + (TaskContext.get().partitionId() << 20)
        parts, n = [], 0
        for b in batches:
            while b.num_rows:
                parts.append(b.slice(0, BLOCK_DOCS - n))
                b = b.slice(parts[-1].num_rows)
                n += parts[-1].num_rows
                if n == BLOCK_DOCS:
                    yield rows(block, parts)
                    parts, n, block = [], 0, block + 1
        if n:
            yield rows(block, parts)

    ship_package(docs.sparkSession)
    return docs.select(F.col("id").cast("long").alias("id"), tokens_of(F.col("text")).alias("t")).mapInArrow(run, "block long, word string, at array<int>, ids array<long>, tfs array<int>, dls array<int>, places array<array<int>>")


def _bounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"max_tf": F.array_max("tfs"), "min_dl": F.array_min("dls")})


class Bm25Index:
    """Updates are numbered from 0 on; an update that is run again writes the same."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.postings = StateLog(spark, f"{folder}/postings", "block", POSTINGS, partition="bucket")
        self.docs = StateLog(spark, f"{folder}/docs", "block", DOCS)

    def update(self, number: int, came: DataFrame, gone: DataFrame | None = None) -> None:
        """came(id, text) are new or changed documents, gone(id) have left. Ids are distinct."""
        fresh = durable(_blocks(came, number), "blocks")
        docs = fresh.where("word is null").select("block", F.explode(F.arrays_zip("at", "ids", "dls")).alias("x")).select("block", F.col("x.at").alias("at"), F.col("x.ids").alias("id"), F.col("x.dls").alias("dl"))
        added = fresh.where("word is not null")
        touched = fresh.select("block").distinct()
        if number:
            ids = came.select(F.col("id").cast("long").alias("id"))
            ids = ids.unionByName(gone.select(F.col("id").cast("long").alias("id"))) if gone is not None else ids
            before = self.docs.current(number - 1)
            gone_at = before.join(ids.distinct(), "id", "left_semi").groupBy("block").agg(F.collect_set("at").alias("at"))  # a block's documents at most
            # one flag for each place of the block: whether a document left is one look, however many left
            marks = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_DOCS - 1)), lambda i: F.array_contains(F.col("at"), i))
            dead = durable(gone_at.select("block", marks.alias("dead")), "dead")
            left = F.filter(F.arrays_zip("at", "ids", "tfs", "dls", "places"), lambda x: ~F.get(F.col("dead"), x["at"]))
            old = self.postings.current(number - 1).join(dead, "block").withColumn("x", left).where("size(x) > 0")
            added = added.unionByName(old.select("block", "word", *[F.col(f"x.{c}").alias(c) for c in ("at", "ids", "tfs", "dls", "places")]))
            docs = docs.unionByName(before.join(dead, "block").where(~F.get("dead", F.col("at"))).select("block", "at", "id", "dl"))
            touched = touched.unionByName(dead.select("block"))
        rows = _bounded(added).withColumn("bucket", _bucket(F.col("word"))).repartition("bucket").sortWithinPartitions("bucket", "word", "block")
        self.postings.write(number, touched, rows)
        self.docs.write(number, touched, docs)

    def search(self, queries: DataFrame, k: int, until: int) -> DataFrame:
        """queries(qid, text) -> qid, id, score, rank over the documents after update ``until``. A term of several words matches where they follow one another."""
        terms = queries.select("qid", F.explode(tx.lexical_terms(F.col("text"))).alias("term")).withColumn("words", tokens_of(F.col("term"))).where("size(words) > 0")
        terms = durable(terms.distinct(), "terms")
        few = terms.count() <= MAX_BROADCAST
        small = F.broadcast if few else (lambda rows: rows)
        n, avg_dl = self.docs.current(until).agg(F.count("*"), F.avg("dl")).first()
        words = terms.select(F.explode("words").alias("word")).distinct()
        stored = self.postings.current(until)
        if few:  # the layout by word is of use only if the plan knows the words
            known = [r["word"] for r in words.collect()]
            buckets = [r[0] for r in words.select(_bucket(F.col("word"))).distinct().collect()]
            stored = stored.where(F.col("bucket").isin(buckets) & F.col("word").isin(known))
        single = terms.where("size(words) = 1").select("qid", "term", F.col("words")[0].alias("word"))
        lists = stored.join(small(single.select("word", "term").distinct()), "word").select("term", "block", "ids", "tfs", "dls", "max_tf", "min_dl")
        if terms.where("size(words) > 1").limit(1).count():
            lists = lists.unionByName(durable(self._phrases(stored, terms, small), "phrases"))
        meta = lists.select("term", "block", "max_tf", "min_dl", F.size("ids").alias("n"))
        df = meta.groupBy("term").agg(F.sum("n").alias("df"))
        raw = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = durable(terms.select("qid", "term").join(small(df), "term").select("qid", "term", F.when(raw <= 0, 1e-6).otherwise(raw).alias("idf")), "asked")
        add = lambda tf, dl: F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(avg_dl or 1.0)))
        most = durable(meta.join(small(asked), "term").groupBy("qid", "block").agg(F.sum(add("max_tf", "min_dl")).alias("most")), "bounds")
        nth = most.withColumn("nth", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("most"), "block")))

        def scored(blocks: DataFrame) -> DataFrame:
            wanted = small(asked).join(blocks.select("qid", "block"), "qid")
            hits = lists.join(wanted, ["term", "block"]).select("qid", "idf", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("x")).select("qid", "idf", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"), F.col("x.dls").alias("dl"))
            return hits.groupBy("qid", "id").agg(F.round(F.sum(add("tf", "dl")), 6).alias("score"))

        best = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))).cast("bigint")).where(F.col("rank") <= k)
        first = durable(best(scored(nth.where(F.col("nth") <= FIRST_BLOCKS))), "first")
        bar = first.where(F.col("rank") == k).select("qid", F.col("score").alias("bar"))
        self.rest = durable(nth.where(F.col("nth") > FIRST_BLOCKS).join(bar, "qid", "left").where("bar is null or most + 1e-6 >= bar"), "rest")
        return best(first.drop("rank").unionByName(scored(self.rest)))

    @staticmethod
    def _phrases(stored: DataFrame, terms: DataFrame, small) -> DataFrame:
        """Lists of the terms of several words: a document counts the places from which all words follow one another."""
        parts = terms.where("size(words) > 1").select("term", F.size("words").alias("of"), F.posexplode("words").alias("off", "word")).distinct()
        at = stored.join(small(parts), "word").select("term", "of", "off", "block", F.explode(F.arrays_zip("ids", "dls", "places")).alias("x"))
        starts = at.select("term", "of", "block", F.col("x.ids").alias("id"), F.col("x.dls").alias("dl"), F.explode("x.places").alias("p"), "off").withColumn("start", F.col("p") - F.col("off"))
        whole = starts.groupBy("term", "of", "block", "id", "dl", "start").agg(F.count("*").alias("held")).where("held = of")
        docs = whole.groupBy("term", "block", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        lists = docs.groupBy("term", "block").agg(F.collect_list(F.struct("id", "tf", "dl")).alias("x"))  # a block's documents at most
        return _bounded(lists.select("term", "block", *[F.col(f"x.{c}").alias(c + "s") for c in ("id", "tf", "dl")]))
