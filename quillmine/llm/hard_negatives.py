"""Hard negatives by slots: rows of another label that score just below an anchor's positives.

Every positive of an anchor opens a window of scores.  The windows' upper limits cut the scores into disjoint slots,
highest first.  A task keeps the best rows of every anchor and slot over all its rows, so what it sends does not
grow with them.  A window's answer is the first of its own and all lower slots, read in descending order, above
its lower limit.  Anchors are taken in blocks of bounded size, each held against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import own_folder, written
from quillmine.session import ship_package

POSITIVES = 5
NEGATIVES = 3
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 50, 95
SCALE = 256.0
#: Components in a block of anchors: 16 MB that the driver reads and every task gets.
BLOCK = 1 << 21
#: Scores a task computes at a time.
SCORES = 1 << 21
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: float = SCALE) -> DataFrame:
    """``key, label, v``: rows that take part, components as ``floor(scale * x)``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    named = rows.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), F.when(~bad, v).alias("v"))
    return named.where("key IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")


class Block:
    """Anchors side by side: keys, labels, vectors padded with zeros, and their lengths."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]):
        self.keys, self.labels = keys, labels
        self.sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        self.matrix = padded(vectors, int(self.sizes.max(initial=0)))

    def scores(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Inner products (anchors x rows), and which pairs have vectors of one length."""
        sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        other = padded(vectors, self.matrix.shape[1])
        most = float(np.abs(self.matrix).max(initial=0)) * float(np.abs(other).max(initial=0)) * max(other.shape[1], 1)
        # doubles are exact up to 2^53
        out = (self.matrix.astype(float) @ other.T.astype(float)).astype(np.int64) if most < 2**53 else self.matrix @ other.T
        return out, self.sizes[:, None] == sizes[None, :]


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows; those longer than ``width`` are zeros, as no anchor has their length."""
    if vectors and all(len(v) == width for v in vectors):
        return np.stack(vectors)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        if len(v) <= width:
            out[i, :len(v)] = v
    return out


class Best:
    """The first ``k`` of every group by score descending, then key; ``least`` is what a newcomer must reach."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, np.iinfo(np.int64).min)
        self.group, self.score, self.key = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        new = score >= self.least[group]
        if not new.any():
            return
        group, score, key = (np.concatenate([old, some[new]]) for old, some in ((self.group, group), (self.score, score), (self.key, key)))
        order = np.lexsort((key, ~score, group))  # ~x falls as x rises, without overflow
        group, score, key = group[order], score[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        full = rank == self.k - 1
        self.least[group[full]] = score[full]
        kept = rank < self.k
        self.group, self.score, self.key = group[kept], score[kept], key[kept]


def _rows(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            lists = part.column("v")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            yield (part.column("key").to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False),
                   [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])


def _best_of(block, groups: int, k: int, choose: Callable):
    """Task: the best ``k`` of its rows by group; ``choose`` tells which pairs of a block belong to which group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits = block.value
        best = Best(groups, k)
        for keys, labels, vectors in _rows(batches, max(1, SCORES // max(len(anchors.keys), 1))):
            scores, comparable = anchors.scores(vectors)
            same = anchors.labels[:, None] == labels[None, :]
            for a, row, group in choose(scores, comparable, same, anchors.keys[:, None] == keys[None, :], limits):
                best.add(group, scores[a, row], keys[row])
        yield pa.record_batch([pa.array(best.group), pa.array(best.score), pa.array(best.key)], ["g", "score", "key"])

    return run


def _positives(scores, comparable, same, itself, _):
    a, row = np.nonzero(comparable & same & ~itself)
    yield a, row, a


def _negatives(scores, comparable, same, itself, limits):
    """One slot after the other: above the next upper limit, up to its own."""
    upper, lowest = limits
    fit = comparable & ~same & ~itself & (scores >= lowest[:, None])
    for slot in range(upper.shape[1]):
        below = scores <= upper[:, slot, None]
        if slot + 1 < upper.shape[1]:
            below &= scores > upper[:, slot + 1, None]
        a, row = np.nonzero(fit & below)
        yield a, row, a * upper.shape[1] + slot


def hundredths(score: np.ndarray, share: int) -> np.ndarray:
    """``floor(share * score / 100)`` without a product that passes 64 bits."""
    return share * (score // 100) + share * (score % 100) // 100


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every group over all tasks."""
    order = Window.partitionBy("g").orderBy(F.desc("score"), "key")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score is its inner product with the anchor after components became ``floor(scale * x)``; products must
    fit a long.  An anchor's positives are its first ``positives`` rows of the same label, for each of them the
    first ``negatives`` rows of another label with ``low * positive <= 100 * negative <= high * positive`` are
    returned.  Higher scores come first, then smaller keys.

    ``anchor`` is a condition on ``rows``.  Rows with a null key, label, vector or component, or one that is not
    finite, take no part.  Vectors of different lengths never meet.  Rows with the anchor's key are the anchor itself.
    Repeated rows count as often as they come, but equal anchors are one.  An anchor without positives, and a
    positive without negatives, give no rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    some = whole_vectors(rows, key, vector, label, scale)
    anchors = written(whole_vectors(rows.where(anchor), key, vector, label, scale).distinct(), "negatives-anchors")
    shape = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    blocks = -(-shape.n * max(shape.size or 1, 1) // BLOCK)
    folder = own_folder(spark, "negatives")
    for number in range(blocks):
        mine = anchors.where(F.pmod(F.xxhash64("key", "label", "v"), F.lit(blocks)) == number).collect()
        if mine:
            _of_block(some, mine, positives, negatives, low, high).write.mode("append").parquet(folder)
    return spark.read.schema(RESULT).parquet(folder) if blocks else spark.createDataFrame([], RESULT)


def _wide(name: str, factor: int) -> Column:
    return F.col(name).cast("decimal(19,0)") * F.lit(factor).cast("decimal(9,0)")


def _of_block(rows: DataFrame, mine: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    block = Block(np.array([r.key for r in mine]), np.array([r.label for r in mine]), [np.array(r.v, dtype=np.int64) for r in mine])
    n, schema = len(mine), "g bigint, score bigint, key bigint"
    told = context.broadcast((block, None))
    near = _first(rows.mapInArrow(_best_of(told, n, positives, _positives), schema), positives).orderBy("g", "at").collect()
    # as many rows as a block has anchors, times ``positives``
    score = np.full((n, positives), np.iinfo(np.int64).min)
    for r in near:
        score[r.g, r.at - 1] = r.score
    has = score > np.iinfo(np.int64).min
    upper = np.where(has, hundredths(np.where(has, score, 0), high), np.iinfo(np.int64).min)
    lower = np.where(has, -hundredths(np.where(has, -score, 0), low), np.iinfo(np.int64).max).min(axis=1)
    told = context.broadcast((block, (upper, lower)))
    found = rows.mapInArrow(_best_of(told, n * positives, negatives, _negatives), schema)
    best = _first(found, negatives).select(F.floor(F.col("g") / positives).alias("a"), (F.col("g") % positives).alias("slot"), "score", "key")
    # slots lie one below the other: in this order the scores fall
    step = F.struct("slot", (-F.col("score")).alias("fall"), "key")
    slots = best.groupBy("a").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    windows = rows.sparkSession.createDataFrame(
        [(r.g, int(block.keys[r.g]), r.at - 1, r.key, r.score) for r in near], "a bigint, anchor_id bigint, slot int, positive_id bigint, positive_score bigint")
    seen = F.slice(F.filter("steps", lambda s: s["slot"] >= F.col("at")), 1, negatives)
    met = windows.withColumnRenamed("slot", "at").join(slots, "a").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(seen).alias("rank", "step"))
    return met.select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("step.key").alias("negative_id"), "positive_score",
        (-F.col("step.fall")).alias("negative_score")).where(_wide("negative_score", 100) >= _wide("positive_score", low))
