"""Exact dense search over a whole corpus, as blocks of questions against tiles of vectors.

Tiles are packed inside the partitions the vectors already lie in (no shuffle), blocks hold a
bounded number of questions, and both meet as ``blocks.meet`` describes.  A task keeps the best k
rows per question over all its tiles, and a window takes the global top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.operators.blocks import TopRows, block_count, block_of, meet


def _matrix(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.float64)
    for i, row in enumerate(rows):
        out[i] = row
    lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
    np.divide(out, lengths, out=out, where=lengths > 0)
    return out


def pack(df: DataFrame, key: str, vector: str, dims: int, rows: int = 4096) -> DataFrame:
    """Neighbouring rows as (keys, matrix bytes) tiles, L2-normalised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start:start + rows]
                matrix = _matrix(list(part["v"]), dims)
                yield pd.DataFrame({"keys": [part["k"].tolist()], "data": [matrix.tobytes()]})

    source = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    return source.mapInPandas(run, "keys array<long>, data binary")


def vector_topk(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    dims: int,
    block_rows: int = 1024,
    salts: int | None = None,
) -> DataFrame:
    """questions(query_id, embedding) against corpus(vec_id, embedding): top k by cosine."""
    n_blocks = block_count(questions.count(), block_rows)
    blocks = questions.withColumn("block", block_of(n_blocks)).groupBy("block").agg(
        F.collect_list(F.struct("query_id", F.col("embedding").cast("array<double>").alias("embedding"))).alias("asked")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        top = TopRows(k, ["rounded", "vec_id"], [False, True])
        for batch in batches:
            for block, keys, data, asked in zip(batch["block"], batch["keys"], batch["data"], batch["asked"]):
                if block not in made:
                    ids = np.array([row["query_id"] for row in asked], dtype=np.int64)
                    made[block] = ids, _matrix([row["embedding"] for row in asked], dims)
                ids, questions_of = made[block]
                tile = np.frombuffer(data, dtype=np.float64).reshape(len(keys), dims)
                scores = questions_of @ tile.T
                rounded = np.round(scores, 12)
                # everything that ties with the k-th best stays: keys decide over all tiles
                edge = -np.partition(-rounded, k - 1, axis=1)[:, k - 1:k] if len(keys) > k else -np.inf
                q, at = np.nonzero(rounded >= edge)
                top.add(pd.DataFrame({
                    "query_id": ids[q], "vec_id": np.asarray(keys)[at], "score": scores[q, at], "rounded": rounded[q, at],
                }))
        if top.parts:
            yield top.best().drop(columns="rounded")

    tiles = pack(corpus, "vec_id", "embedding", dims)
    met = meet(tiles, blocks, n_blocks, ("keys",), salts)
    local = met.select("block", "keys", "data", "asked").mapInPandas(
        run, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def vector_problems(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Rows whose vector is missing or has the wrong length."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    return df.filter(size != dims).select(key, size.alias("found"), F.lit(dims).alias("expected"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors, keys, "left_anti").select(*keys)


def vector_stats(vectors: DataFrame, page_col: str, vector: str = "embedding") -> DataFrame:
    return vectors.agg(
        F.count("*").alias("total_vectors"),
        F.countDistinct(page_col).alias("total_pages"),
        F.max(F.size(vector)).alias("dimension"),
    )


def centroids(vectors: DataFrame, group: str, dims: int) -> DataFrame:
    """Mean vector per group as one wide, map-side combined aggregation."""
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(dims)]
    return vectors.groupBy(group).agg(F.array(*means).alias("embedding"))
