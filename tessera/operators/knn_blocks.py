"""Exact nearest neighbours of many questions: blocks of questions meet blocks of vectors, and bounds skip most of the work.

1. A bounded sample of vectors of each length serves as pivots. Every vector goes to its nearest pivot; vectors of one pivot, in order of
   their angle to it, are cut into blocks, each with the least and greatest angle. Equal vectors are cut like others.
2. Questions are dealt into blocks, each question with its angles to all pivots and the k-th best score that the sample alone gives it.
3. Blocks of one length meet. The angle between a question and a vector is at least the difference of their angles to a pivot, so a block
   whose best possible cosine is below what a question has already is skipped for it. The rest is a matrix product.
4. A task keeps the k best of each of its questions, and raises the bar as it goes; the best of all tasks are ranked.

The driver sees the sample and numbers alone. Question blocks are broadcast up to ``BROADCAST_BYTES``; beyond that blocks of both sides
are dealt over ``SPLITS`` places for each group of question blocks, so a join key never gathers a side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import durable, ship_package

PIVOTS, SAMPLE = 32, 512
#: Lengths of vectors, the most frequent first, that have pivots; blocks of others are met by all questions of their length.
MAX_LENGTHS = 16
BLOCK_ROWS, BLOCK_QUESTIONS = 2048, 512
BROADCAST_BYTES = 64_000_000
SPLITS = 16
#: Questions of which a task keeps the best before it hands them on.
_HELD = 100_000
DIGITS = 9
#: What rounding may add to a score.
_SLACK = 1e-8


def _sample(corpus: DataFrame) -> dict[int, np.ndarray]:
    """length -> unit rows of up to SAMPLE vectors of least hash; the first PIVOTS of them are the pivots."""
    rows = corpus.where("vec is not null and size(vec) > 0").select(F.size("vec").alias("dim"), F.xxhash64("id").alias("h"), "vec")
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MAX_LENGTHS)
    few = rows.join(F.broadcast(lengths.select("dim")), "dim").withColumn("nth", F.row_number().over(W.partitionBy("dim").orderBy("h"))).where(F.col("nth") <= SAMPLE).orderBy("dim", "h")
    out: dict[int, np.ndarray] = {}
    for _, m in vx.matrices(few.select("vec").toArrow().column("vec")):
        unit = vx.unit_rows(m)
        out[m.shape[1]] = unit[unit.any(axis=1)]
    return {n: m for n, m in out.items() if len(m)}


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def vector_blocks(corpus: DataFrame, sample: dict[int, np.ndarray]) -> DataFrame:
    """corpus(id, vec) -> dim, pivot (-1: none), lo, hi, ids, m: blocks of unit rows as bytes of doubles. Zero vectors have no pivot."""
    shared = corpus.sparkSession.sparkContext.broadcast(sample)
    kind = corpus.schema["id"].dataType.simpleString()

    def placed(batches):
        for b in batches:
            for at, m in vx.matrices(b.column("vec")):
                unit, n = vx.unit_rows(m), m.shape[1]
                pivot, angle = np.full(len(m), -1), np.zeros(len(m))
                if n in shared.value:
                    angles = _angles(unit, shared.value[n][:PIVOTS])
                    some = unit.any(axis=1)
                    pivot = np.where(some, angles.argmin(axis=1), -1)
                    angle = np.where(some, angles.min(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), n, np.int32)), pa.array(pivot.astype(np.int32)), pa.array(angle), b.column("id").take(pa.array(at)), pa.array([r.tobytes() for r in unit], pa.binary())], ["dim", "pivot", "angle", "id", "v"])

    def cut(batches):
        held: list[tuple] = []

        def block():
            key, angles, ids, rows = held[0][0], [r[1] for r in held], [r[2] for r in held], [r[3] for r in held]
            kind_of = pa.array(ids, id_type)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([min(angles)]), pa.array([max(angles)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), kind_of), pa.array([b"".join(rows)], pa.binary())], ["dim", "pivot", "lo", "hi", "ids", "m"])

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            for dim, pivot, angle, i, v in zip(*(b.column(c).to_pylist() for c in ("dim", "pivot", "angle", "id", "v")), strict=True):
                if held and (held[0][0] != (dim, pivot) or len(held) == BLOCK_ROWS):
                    yield block()
                    held = []
                held.append(((dim, pivot), angle, i, v))
        if held:
            yield block()

    ship_package(corpus.sparkSession)
    rows = corpus.where("vec is not null and size(vec) > 0").select("id", "vec").mapInArrow(placed, f"dim int, pivot int, angle double, id {kind}, v binary")
    order = ["dim", "pivot", "angle", "id"]
    parts = corpus.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartitionByRange(max(parts, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(cut, f"dim int, pivot int, lo double, hi double, ids array<{kind}>, m binary")


def question_blocks(queries: DataFrame, sample: dict[int, np.ndarray], k: int) -> DataFrame:
    """queries(q, qvec) -> dim, qs (numbers), qm (unit rows), angles (to all pivots), floors: the k-th best score within the sample, as bytes of doubles."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for b in batches:
            numbers = b.column("q").to_numpy()
            for at, m in vx.matrices(b.column("qvec")):
                for start in range(0, len(m), BLOCK_QUESTIONS):
                    unit, qs, n = vx.unit_rows(m[start : start + BLOCK_QUESTIONS]), numbers[at[start : start + BLOCK_QUESTIONS]], m.shape[1]
                    angles, floors = np.zeros((len(unit), 0)), np.full(len(unit), -2.0)
                    if n in shared.value:
                        own = shared.value[n]
                        angles = _angles(unit, own[:PIVOTS])
                        if len(own) >= k:
                            floors = np.partition(np.round(unit @ own.T, DIGITS), len(own) - k, axis=1)[:, len(own) - k]
                        floors = np.where(unit.any(axis=1), floors, -2.0)
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([qs.tolist()], pa.list_(pa.int64())), *(pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (unit, angles, floors))], ["dim", "qs", "qm", "angles", "floors"])

    return queries.select("q", "qvec").mapInArrow(run, "dim int, qs array<long>, qm binary, angles binary, floors binary")


def _best_of_pairs(k: int, with_bounds: bool):
    """Pairs of blocks -> q, id, score of the k best of a task; the last row has the numbers of (question, block) pairs that were met and skipped."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        met = skipped = 0
        id_type = None

        def rows():
            q = np.concatenate([np.zeros(0, np.int64), *(np.full(len(s), n, np.int64) for n, (s, _) in best.items())])
            ids = np.concatenate([i for _, i in best.values()]) if best else np.zeros(0, np.int64)
            score = np.concatenate([np.zeros(0), *(s for s, _ in best.values())])
            none = pa.nulls(len(q), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, id_type), pa.array(score), none, none], ["q", "id", "score", "met", "skipped"])

        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            for i in range(b.num_rows):
                n = b.column("dim")[i].as_py()
                m, q, angles, floors = (np.frombuffer(b.column(c)[i].as_buffer(), np.float64) for c in ("m", "qm", "angles", "floors"))
                m, q = m.reshape(-1, n), q.reshape(-1, n)
                qs, ids = np.asarray(b.column("qs")[i].values), b.column("ids")[i].values.to_numpy(zero_copy_only=False)
                pivot, lo, hi = (b.column(c)[i].as_py() for c in ("pivot", "lo", "hi"))
                live = np.arange(len(qs))
                if with_bounds and pivot >= 0:
                    at = angles.reshape(len(qs), -1)[:, pivot]
                    bar = np.array([best[x][0].min() if x in best and len(best[x][0]) == k else -2.0 for x in qs.tolist()])
                    most = np.cos(np.clip(np.maximum(at - hi, lo - at), 0, np.pi))
                    zero = ~q.any(axis=1)
                    live = np.flatnonzero((most + _SLACK >= np.maximum(bar, floors)) | zero)
                met, skipped = met + len(live), skipped + len(qs) - len(live)
                if not len(live):
                    continue
                scores = np.round(m @ q[live].T, DIGITS)
                for j, x in enumerate(qs[live].tolist()):
                    s, own = scores[:, j], ids
                    if x in best:
                        s, own = np.concatenate([best[x][0], s]), np.concatenate([best[x][1], own])
                    first = vx.best_rows(s, own, k)
                    best[x] = s[first], own[first]
            if len(best) > _HELD:
                yield rows()
                best = {}
        if id_type is not None:
            yield rows()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.float64()), pa.array([met]), pa.array([skipped])], ["q", "id", "score", "met", "skipped"])

    return run


def _met(corpus: DataFrame, numbered: DataFrame, k: int, with_bounds: bool) -> DataFrame:
    kind = corpus.schema["id"].dataType.simpleString()
    sample = _sample(corpus)
    blocks = vector_blocks(corpus, sample)
    asked = durable(question_blocks(numbered, sample, k), "question-blocks")
    n, size = asked.agg(F.count("*"), F.sum(F.length("qm") + F.length("angles"))).first()
    if (size or 0) <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(asked), "dim")
    else:
        groups = -(-size // BROADCAST_BYTES)
        place = F.pmod(F.xxhash64("dim", "pivot", "lo", "hi", F.get("ids", F.lit(0))), F.lit(SPLITS))
        left = blocks.withColumn("place", place).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(int(groups) - 1))))
        right = asked.withColumn("group", F.pmod(F.xxhash64("qs"), F.lit(groups)).cast("int")).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPLITS - 1).cast("long"))))
        pairs = left.join(right, ["dim", "group", "place"])
    columns = ["dim", "pivot", "lo", "hi", "ids", "m", "qs", "qm", "angles", "floors"]
    return pairs.select(*columns).mapInArrow(_best_of_pairs(k, with_bounds), f"q long, id {kind}, score double, met long, skipped long")


def _numbered(queries: DataFrame) -> DataFrame:
    """A number for each question, written once so that it stays."""
    asked = queries.where("qvec is not null and size(qvec) > 0").select(F.monotonically_increasing_id().alias("q"), "qid", "qvec")
    return durable(asked, "questions")


def knn_blocks(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """corpus(id, vec) x queries(qid, qvec) -> qid, id, score, rank: exact cosine, ties by id. Vectors of another length are invisible; a zero vector has score 0."""
    numbered = _numbered(queries)
    best = _met(corpus, numbered, k, True).where("q is not null").select("q", "id", "score")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc("id"))).cast("bigint")).where(F.col("rank") <= k)
    return ranked.join(numbered.select("q", "qid"), "q").select("qid", "id", "score", "rank")


def knn_report(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """met, skipped: pairs of a question and a block that were multiplied, and that bounds made needless."""
    return _met(corpus, _numbered(queries), k, True).agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
