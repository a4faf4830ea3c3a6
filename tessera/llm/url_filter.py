"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Each rule is a canonical ``host`` + ``path`` prefix. A URL's candidate keys are its host suffixes (as
many labels as the longest listed host has) times its path prefixes (of the lengths that are listed).
A blocked Bloom filter (one 512-bit block a key) drops nearly all candidates; what passes meets the
rules in an exact hash join, which removes false positives. The longest rule wins; a URL with
no rule gets ``default``.

Null URLs and URLs without ``://`` have empty host and path and get ``default``. Repeated and null
page ids are kept as they are; other columns are passed on. Of matching rules of equal length the one with
the longer host wins, then the greater key and verdict. An empty rule list gives ``default``, an empty table
no rows. A filter of over ``FILTER_MAX_BYTES`` is not sent: then all candidates go to the exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = 8  # 64-bit words in a block
_HASHES = 8
#: The filter is sent to the executors only up to this many bytes; beyond, candidates go to the join unfiltered.
FILTER_MAX_BYTES = 64_000_000
#: Rules are broadcast only up to this many rows.
RULES_MAX_BROADCAST = 100_000


def host_of(url: Column) -> Column:
    rest = F.expr("substring(url, locate('://', url) + 3)")
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(url, locate('://', url) + 3)")
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its bits within the block as (keys, hashes)."""
    u = h.astype(np.int64).view(np.uint64)
    block = (u >> np.uint64(32)) % np.uint64(blocks)
    low = u & np.uint64(0xFFFFFFFF)
    step = (u >> np.uint64(17)) | np.uint64(1)
    return block.astype(np.int64), ((low[:, None] + np.arange(_HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(64 * _WORDS)).astype(np.int64)


def build_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """Blocks as rows of 64-bit words. Executors set the bits and join them by OR; one row a used block reaches the driver."""

    def bits_of(batches):
        for pdf in batches:
            b, bits = _bits(pdf["h"].to_numpy(), blocks)
            words = np.zeros((len(b), _WORDS), np.uint64)
            at = np.arange(len(b))
            for i in range(_HASHES):
                words[at, bits[:, i] >> 6] |= np.uint64(1) << (bits[:, i] & 63).astype(np.uint64)
            yield pd.DataFrame({"block": b, **{f"w{i}": words[:, i].view(np.int64) for i in range(_WORDS)}})

    ship_package(keys.sparkSession)
    names = [f"w{i}" for i in range(_WORDS)]
    set_bits = keys.mapInPandas(bits_of, ", ".join(["block long", *(f"{w} long" for w in names)]))
    out = np.zeros((blocks, _WORDS), np.uint64)
    for r in set_bits.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]).collect():
        out[r["block"]] = np.array([r[w] for w in names], np.int64).view(np.uint64)
    return out


def _possible_keys(pages: DataFrame, keys: Column, listed: DataFrame, n: int) -> Column:
    """Of each row's candidate keys those that the Bloom filter lets through, in place; all of them if the filter would be too large to send."""
    blocks = max(16, int(np.ceil(n * 12 / (64 * _WORDS))))
    if blocks * _WORDS * 8 > FILTER_MAX_BYTES:
        return keys
    shared = pages.sparkSession.sparkContext.broadcast(build_filter(listed.select(F.xxhash64("key").alias("h")), blocks))

    @F.pandas_udf("array<boolean>")
    def possible(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        words = shared.value
        b, bits = _bits(np.concatenate(hashes.to_numpy()), len(words))
        hit = (((words[b[:, None], bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)) == 1).all(axis=1)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]))

    pairs = F.arrays_zip(keys.alias("k"), possible(F.transform(keys, lambda k: F.xxhash64(k))).alias("p"))
    return F.transform(F.filter(pairs, lambda x: x["p"]), lambda x: x["k"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict for every row; the page columns named like these are replaced.

    Every row is judged where it stands. Rows without a possible key take the default at once; the others are
    numbered, meet the rules in the hash join and are put together again by number, so neither a popular url
    nor a null one gathers in a task.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    listed = rules.select(F.col("host").alias("r_host"), F.col("verdict").alias("r_verdict"), F.length("path").alias("r_length"), F.concat("host", "path").alias("key")).where("key is not null")
    shape = listed.agg(F.count("*"), F.max(F.size(F.split("r_host", "[.]"))), F.collect_set("r_length")).first()
    n, labels, lengths = shape[0], shape[1] or 0, sorted(shape[2])
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    none = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not n:
        return row.select("row.*", "host", "path", *none)
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda m: m <= F.length("path")), lambda m: F.substring(F.col("path"), F.lit(1), m))
    keys = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    cand = row.withColumn("keys", keys)
    judged = durable(cand.select("row", "host", "path", _possible_keys(pages, F.col("keys"), listed, n).alias("keys"), F.monotonically_increasing_id().alias("no")), "urls")
    exact = F.broadcast(listed) if n <= RULES_MAX_BROADCAST else listed
    met = judged.where("size(keys) > 0").select("no", F.explode("keys").alias("key")).join(exact, "key")
    best = met.groupBy("no").agg(F.max(F.struct(F.length("key").alias("n"), F.length("r_host").alias("m"), "key", "r_verdict")).alias("b"))
    done = judged.where("size(keys) > 0").join(best, "no", "left").select("row.*", "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.r_verdict", F.lit(default)).alias("verdict"))
    return done.unionByName(judged.where("size(keys) = 0").select("row.*", "host", "path", *none))
