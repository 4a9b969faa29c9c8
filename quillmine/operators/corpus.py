"""Exact lexical search of many questions over a whole corpus.

Same shape as the dense search: chunks are packed into tiles where they lie, questions into
bounded blocks, both meet as ``blocks.meet`` describes, and a task keeps the best k rows per
question over all its tiles.  What is shuffled grows with tasks x questions x k, not with the
matching (question, chunk) pairs, and no term becomes a join key, so a term that occurs
everywhere costs no more than its counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.operators.blocks import TopRows, block_count, block_of, meet
from quillmine.operators.retrieve import MAX_K

TILE_SCHEMA = (
    "urls array<string>, indexes array<long>, chunk_terms array<array<string>>, "
    "title_terms array<array<string>>, heading_terms array<array<string>>"
)
OUT_SCHEMA = (
    "query_id long, page_url string, chunk_index long, chunk_overlap double, title_overlap double, "
    "heading_overlap double, score double"
)
FOUND = pa.schema([
    ("query_id", pa.int64()), ("page_url", pa.string()), ("chunk_index", pa.int64()),
    *((name, pa.float64()) for name in ("chunk_overlap", "title_overlap", "heading_overlap", "score"))])
#: Hits listed at once while a tile's shares are counted.
CELLS = 1 << 20
SETS = ("chunk_terms", "title_terms", "heading_terms")


def pack_chunks(chunks: DataFrame, rows: int = 2048) -> DataFrame:
    """chunks(page_url, chunk_index, chunk_terms, title_terms, heading_terms) as tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, column) for column in part.columns], ["urls", "indexes", *SETS])

    return chunks.select("page_url", F.col("chunk_index").cast("long"), *SETS).mapInArrow(run, TILE_SCHEMA)


class _Block:
    """Terms of a block of questions as postings: term -> question numbers."""

    def __init__(self, asked):
        self.ids = np.array([row["query_id"] for row in asked], dtype=np.int64)
        self.sizes = np.array([max(1, len(row["query_terms"])) for row in asked], dtype=np.float64)
        postings: dict[str, list[int]] = {}
        for i, row in enumerate(asked):
            for term in row["query_terms"]:
                postings.setdefault(term, []).append(i)
        self.terms = pa.array(postings, pa.string())
        self.starts = np.zeros(len(postings) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in postings.values()], out=self.starts[1:])
        self.members = np.array([i for p in postings.values() for i in p], dtype=np.int64)

    def shares(self, term_sets: pa.ListArray) -> np.ndarray:
        """Matrix (chunk, question) of the share of question terms present.

        Terms stay in Arrow, and ``CELLS`` (chunk, question) hits are listed at once: frequent terms have many.
        """
        words = pc.list_flatten(term_sets)
        number = pc.index_in(words, value_set=self.terms.cast(words.type)).fill_null(-1).to_numpy()
        rows = pc.list_parent_indices(term_sets).to_numpy()[number >= 0]
        terms = number[number >= 0]
        n = len(self.ids)
        counts = np.zeros(len(term_sets) * n)
        degree = self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(degree)
        at = 0
        while at < len(terms):
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
            first = np.repeat(self.starts[terms[at:end]], degree[at:end])
            step = np.arange(len(first)) - np.repeat(ends[at:end] - degree[at:end] - done, degree[at:end])
            cell = np.repeat(rows[at:end].astype(np.int64), degree[at:end]) * n + self.members[first + step]
            low, high = int(rows[at]) * n, (int(rows[end - 1]) + 1) * n
            counts[low:high] += np.bincount(cell - low, minlength=high - low)
            at = end
        return counts.reshape(len(term_sets), n) / self.sizes


def corpus_topk(
    questions: DataFrame, chunks: DataFrame, k: int = MAX_K, block_rows: int = 512, salts: int | None = None
) -> DataFrame:
    """questions(query_id, query_terms): top k chunks of the corpus by lexical score > 0.

    Ties go to the smaller (page_url, chunk_index).
    """
    w = rules.LEXICAL_WEIGHTS
    n_blocks = block_count(questions.count(), block_rows)
    blocks = (
        questions.filter(F.size("query_terms") > 0)
        .withColumn("block", block_of(n_blocks))
        .groupBy("block").agg(F.collect_list(F.struct("query_id", "query_terms")).alias("asked"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, _Block] = {}
        top = TopRows(k, ["score", "page_url", "chunk_index"], [False, True, True])
        for batch in batches:
            for i, number in enumerate(batch["block"].to_pylist()):
                if number not in made:
                    made[number] = _Block(batch["asked"][i].as_py())
                block = made[number]
                keys = pa.table({"u": batch["urls"][i].values, "i": batch["indexes"][i].values})
                by_key = pc.sort_indices(keys, sort_keys=[("u", "ascending"), ("i", "ascending")], null_placement="at_end")
                chunk, title, heading = (block.shares(batch[s][i].values.take(by_key)) for s in SETS)
                score = chunk * w["chunk"] + title * w["title"] + heading * w["heading"]
                # rows are in key order, so a stable sort keeps it among equal scores
                best = np.argsort(-score, axis=0, kind="stable")[:k]
                cols = np.broadcast_to(np.arange(len(block.ids)), best.shape)
                at, q = best.ravel(), cols.ravel()
                keep = score[at, q] > 0
                at, q = at[keep], q[keep]
                names = keys.take(by_key.take(pa.array(at)))
                top.add(pd.DataFrame({
                    "query_id": block.ids[q], "page_url": names["u"].to_pandas(), "chunk_index": names["i"].to_pandas(),
                    "chunk_overlap": chunk[at, q], "title_overlap": title[at, q],
                    "heading_overlap": heading[at, q], "score": score[at, q],
                }))
        if top.parts:
            yield pa.RecordBatch.from_pandas(top.best(), schema=FOUND, preserve_index=False)

    met = meet(pack_chunks(chunks), blocks, n_blocks, ("urls", "indexes"), salts)
    local = met.select("block", "asked", "urls", "indexes", *SETS).mapInArrow(run, OUT_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_url", "chunk_index")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn(
        "has_terms", F.lit(True)
    )
