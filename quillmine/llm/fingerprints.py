"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 code points sets the cut points, so they depend on the neighbouring
text alone and an insertion moves only the chunks it touches.  Cutting is normalised: up to the
usual chunk size a strict mask must match, beyond it a lax one, so sizes stay close to it.  A
document's fingerprint is the set of its chunks' digests, each weighted by the chunk's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmine.llm.common import without
from quillmine.session import ship_package

REACH = 32


@dataclass(frozen=True)
class Chunking:
    """Sizes in code points; below ``usual`` one position in 2**strict is a cut, then one in 2**lax."""

    least: int = 8
    usual: int = 32
    most: int = 128
    strict: int = 6
    lax: int = 3


def fingerprints(docs: DataFrame, text: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """``docs`` with ``fingerprint``: its chunks as array<struct<digest:bigint,weight:int>> by digest.

    A digest stands once, its weight sums the lengths of its chunks.  A null or empty text has the empty
    fingerprint; equal texts have equal ones.  Rows come back one for one; a column named
    ``fingerprint`` is replaced.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<struct<digest:bigint,weight:int>>")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"digest": d, "weight": w} for d, w in zip(*map(
                np.ndarray.tolist, fingerprint(t, chunking)), strict=True)])

    return without(docs, "fingerprint").withColumn("fingerprint", column(F.col(text)))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprint(text: str | None, chunking: Chunking = Chunking()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chunk digests of a text, ascending, and the length each stands for."""
    points = code_points(text)
    if len(points) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.array(cut_points(gear(points), chunking), dtype=np.int64)
    lengths = np.diff(starts, append=len(points))
    digests, first = np.unique(_digests(points, starts, lengths), return_inverse=True)
    return digests, np.bincount(first, weights=lengths).astype(np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every value."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear(points: np.ndarray) -> np.ndarray:
    """Gear hash at every position: each of the last 32 code points shifted left by its distance."""
    h = (_mixed(points) >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < REACH:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
        step *= 2
    return h


def cut_points(h: np.ndarray, chunking: Chunking) -> list[int]:
    """Where chunks start.  A cut follows a position whose top hash bits are all zero."""
    top = np.uint32(32)
    lax = np.flatnonzero(h >> (top - np.uint32(chunking.lax)) == 0) + 1
    strict = np.flatnonzero(h >> (top - np.uint32(chunking.strict)) == 0) + 1
    n, starts = len(h), [0]
    lax, strict = lax.tolist() + [n], strict.tolist() + [n]
    i = j = at = 0
    while True:
        while strict[i] < at + chunking.least and strict[i] < n:
            i += 1
        if strict[i] <= at + chunking.usual:
            cut = strict[i]
        else:
            while lax[j] <= at + chunking.usual and lax[j] < n:
                j += 1
            cut = min(lax[j], at + chunking.most)
        if cut >= n:
            return starts
        starts.append(cut)
        at = cut


def _digests(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit digest of every chunk: a polynomial over mixed code points, mixed with the length."""
    factors = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_mixed(points) * factors[place], starts)
    return _mixed(sums ^ _mixed(lengths)).view(np.int64)


def containment(a: tuple, b: tuple) -> float:
    """The share of ``a``'s weight whose chunks ``b`` has too; 1 if both are empty, 0 if one is."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(b[0], a[0])
    shared = b[0][np.minimum(at, len(b[0]) - 1)] == a[0]
    return float(np.minimum(a[1], b[1][np.minimum(at, len(b[0]) - 1)])[shared].sum() / a[1].sum())


def shown(print_: tuple) -> str:
    """``digest:weight`` in ascending digests, comma-joined, digests as 16 hex digits."""
    return ",".join(f"{d & 0xFFFFFFFFFFFFFFFF:016x}:{w}" for d, w in zip(print_[0].tolist(), print_[1].tolist(), strict=True))


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``docs`` partitioned by ranges of ``order``, each range followed by the row after its last one.

    Adds ``range`` and ``ahead``, true for rows that only complete a range: copies of the next range's first
    rows (of the table's first rows, for the last range).  Partitions are sorted by (range, ahead, order,
    text).  Texts move once, and only a row per range is copied.  Nulls of ``order`` come first, equal
    values lie in one range.  The bounds that reach the driver are one value per partition.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.col(order)
    found = docs.agg(
        F.min(at).alias("low"), F.max(at.isNull()).alias("nulls"),
        F.percentile_approx(at, [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("bounds"),
    ).first()
    bounds = sorted({b for b in found.bounds or [] if b > found.low})[: parts - 1]
    # every bound is a value of the table, so a range begins with the rows that equal its bound
    first = at.isNull() if found.nulls else at == F.lit(found.low)
    number = _place(at, bounds)
    copies = F.array(F.struct(number.alias("range"), F.lit(False).alias("ahead")))
    copies = F.when(first, F.array_append(copies, F.struct(F.lit(len(bounds)).alias("range"), F.lit(True).alias("ahead")))).when(
        at.isin(bounds) if bounds else F.lit(False),
        F.array_append(copies, F.struct((number - 1).alias("range"), F.lit(True).alias("ahead")))).otherwise(copies)
    ranged = without(docs, "range", "ahead").select("*", F.inline(copies))
    return ranged.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "ahead", order, text)


def _place(at, bounds: list):
    """How many of the ascending bounds do not exceed a value, found in two steps of about sqrt(n) looks."""
    if not bounds:
        return F.lit(0)
    width = int(len(bounds) ** 0.5) + 1
    tops = F.lit(bounds[::width])
    runs = F.array(*(F.lit(bounds[i:i + width]) for i in range(0, len(bounds), width)))
    block = F.size(F.filter(tops, lambda b: b <= at))
    within = F.size(F.filter(F.element_at(runs, F.greatest(block, F.lit(1))), lambda b: b <= at))
    return F.when(block == 0, 0).otherwise((block - 1) * width + within)


def next_likeness(docs: DataFrame, order: str = "doc_id", text: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """How fingerprints hold against an edit and against the neighbouring document.

    A document's edited text is its own with the last floor(n/4) code points replaced by the first as many
    (or all) of the next document in ``order``; after the last document comes the first.  Returns ``order``,
    ``n_chars``, ``edited_sha256``, both fingerprints as digest:weight lists, and the containment of the
    document's own fingerprint in the edited text's (``near_edited``) and the next document's
    (``near_next``).  A null text counts as empty.  One row per row, repeated rows follow each other.
    """
    ship_package(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], None
        for at, content, number, ahead in _rows(batches):
            row = (at, content, fingerprint(content, chunking), number)
            if held is not None and held[3] == number:
                out.append(_compared(held, row, chunking))
                if len(out) == 256:
                    yield _batch(out, schema)
                    out = []
            held = None if ahead else row
        if out:
            yield _batch(out, schema)

    clean = docs.select(F.col(order).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    given = T.StructType([T.StructField("at", clean.schema["at"].dataType)] + [
        T.StructField(n, T.LongType() if n == "n_chars" else T.DoubleType() if n.startswith("near") else T.StringType())
        for n in COMPARED[1:]])
    schema = to_arrow_schema(given)
    return with_next(clean, "at", "content").mapInArrow(run, given).withColumnRenamed("at", order)


COMPARED = ["at", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(*(part.column(n).to_pylist() for n in ("at", "content", "range", "ahead")), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _compared(own: tuple, following: tuple, chunking: Chunking) -> tuple:
    at, text, print_, _ = own
    cut = len(text) // 4
    edited = text[: len(text) - cut] + following[1][:cut]
    other = fingerprint(edited, chunking)
    digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
    return (at, len(text), digest, shown(print_), shown(other), containment(print_, other), containment(print_, following[2]))
