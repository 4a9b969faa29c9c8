"""Exact lexical search over a stored inverted index with score bounds.

Same result as ``corpus.corpus_topk``, which needs no index and scores every chunk: that is the way
for many questions over chunks without topics, where every range may hold a good match.

``index_chunks`` inverts chunks where they lie.  A range of a few hundred chunks gives one row per
term: the chunks that hold it, in which of their fields, and the most it adds to a score there.
A term that occurs everywhere thus has one short row in every range and is never one key's list.

A search joins the questions' terms with these bounds only; their sum is what a range can give a
question at best.  Each question's most promising ranges are opened first, the k-th best score in
them is its threshold, and a range whose bound stays below it is never opened.  The postings that
are read and moved are those of terms a question asks for in ranges worth opening.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.operators.blocks import block_count, block_of
from quillmine.operators.retrieve import MAX_K
from quillmine.session import cut_lineage

#: ``term`` is null in the one row of a range that names its chunks; ``fields`` are bits in the order of ``SETS``.
INDEX_SCHEMA = (
    "range string, term string, bound double, members array<int>, fields array<tinyint>, "
    "urls array<string>, indexes array<long>, signatures array<string>"
)
OPENED_SCHEMA = (
    "query_id long, range string, member int, chunk_overlap double, title_overlap double, heading_overlap double, score double"
)
SETS = ("chunk_terms", "title_terms", "heading_terms")
RANGE_ROWS = 512
#: Ranges that each question opens before it has a threshold.
FIRST = 2
#: Bounds are sums of doubles in any order; scores this close to the threshold count as reaching it.
SLACK = 1e-9


def index_chunks(chunks: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The inverted index of chunks(page_url, chunk_index, chunk_terms, title_terms, heading_terms).

    A range's name is drawn when it is made: write or checkpoint the result before it is read twice.
    Null term sets are empty.  ``content_signature``, where chunks have it, is kept once a range.
    """
    signature = F.col("content_signature") if "content_signature" in chunks.columns else F.lit(None).cast("string")
    w = rules.LEXICAL_WEIGHTS
    schema = pa.schema([
        ("range", pa.string()), ("term", pa.string()), ("bound", pa.float64()), ("members", pa.list_(pa.int32())), ("fields", pa.list_(pa.int8())),
        ("urls", pa.list_(pa.string())), ("indexes", pa.list_(pa.int64())), ("signatures", pa.list_(pa.string()))])
    gain = np.array([sum(v for bit, v in enumerate((w["chunk"], w["title"], w["heading"])) if field >> bit & 1) for field in range(8)])

    def invert(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # members are numbered in key order, so among equal scores the smaller number comes first
        order = pc.sort_indices(part, sort_keys=[("page_url", "ascending"), ("chunk_index", "ascending")], null_placement="at_start")
        part = part.take(order)
        name, size = uuid.uuid4().hex, part.num_rows
        seen = part["content_signature"].drop_null().unique()
        yield batch_of(
            1, range=pa.array([name]), urls=one_list(part["page_url"]), indexes=one_list(part["chunk_index"]), signatures=one_list(seen))
        words = pa.concat_arrays([pc.list_flatten(part[s]) for s in SETS]).dictionary_encode()
        member = np.concatenate([pc.list_parent_indices(part[s]).to_numpy() for s in SETS])
        bit = np.repeat(np.array([1, 2, 4], dtype=np.int8), [len(pc.list_flatten(part[s])) for s in SETS])
        code = words.indices.fill_null(-1).to_numpy()
        cell = code.astype(np.int64) * size + member
        order = np.argsort(cell, kind="stable")[np.count_nonzero(code < 0):]
        cell, bit = cell[order], bit[order]
        if not len(cell):
            return
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        cell, field = cell[first], np.bitwise_or.reduceat(bit, first)
        starts = np.flatnonzero(np.diff(cell // size, prepend=-1))
        offsets = pa.array(np.append(starts, len(cell)).astype(np.int32))
        yield batch_of(
            len(starts), range=pa.array([name] * len(starts)), term=words.dictionary.take(pa.array(cell[starts] // size)),
            bound=pa.array(np.maximum.reduceat(gain[field], starts)),
            members=pa.ListArray.from_arrays(offsets, pa.array((cell % size).astype(np.int32))),
            fields=pa.ListArray.from_arrays(offsets, pa.array(field)))

    def one_list(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from invert(batch.slice(at, rows))

    columns = ("page_url", F.col("chunk_index").cast("long"), *SETS, signature.alias("content_signature"))
    return chunks.select(*columns).mapInArrow(run, INDEX_SCHEMA)


def upper_bounds(asked: DataFrame, index: DataFrame, salts: int = 8) -> DataFrame:
    """``query_id, range, upper``: what a range can give a question at best, for ranges that hold one of its terms.

    A common term's ranges are dealt over ``salts`` parts; question terms, the smaller side, are repeated.
    """
    terms = asked.select("query_id", F.size("query_terms").alias("n"), F.explode("query_terms").alias("term")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bounds = index.filter(F.col("term").isNotNull()).select(
        "range", "term", "bound", F.pmod(F.xxhash64("range"), F.lit(salts)).cast("int").alias("salt"))
    return bounds.join(terms, ["term", "salt"]).groupBy("query_id", "range").agg((F.sum("bound") / F.first("n")).alias("upper"))


def first_ranges(upper: DataFrame, n: int = FIRST) -> DataFrame:
    """The ``n`` most promising ranges of each question: ``query_id, range``."""
    best = Window.partitionBy("query_id").orderBy(F.desc("upper"), "range")
    return upper.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n).select("query_id", "range")


def ranges_above(upper: DataFrame, opened: DataFrame, done: DataFrame, k: int) -> DataFrame:
    """The ranges not yet ``done`` whose bound reaches the k-th best score ``opened`` so far: ``query_id, range``."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    threshold = opened.select("query_id", "score", F.row_number().over(best).alias("place")).filter(
        F.col("place") <= k).filter(F.col("place") == k).select("query_id", F.col("score").alias("threshold"))
    left = upper.join(done, ["query_id", "range"], "left_anti").join(threshold, "query_id", "left")
    return left.filter(F.col("upper") >= F.coalesce("threshold", F.lit(0.0)) - SLACK).select("query_id", "range")


def open_ranges(asked: DataFrame, index: DataFrame, pairs: DataFrame, k: int, block_rows: int = 512, n_questions: int | None = None) -> DataFrame:
    """The best k chunks of every pair (query_id, range) with their scores, as ``OPENED_SCHEMA``.

    A range meets the questions that open it in blocks: a posting list travels once to each block that
    asks for its term, and a group is one range with at most about ``block_rows`` questions.
    """
    w = rules.LEXICAL_WEIGHTS
    weights = (w["chunk"], w["title"], w["heading"])
    n_blocks = block_count(asked.count() if n_questions is None else n_questions, block_rows)
    wanted = pairs.join(asked, "query_id").select(block_of(n_blocks).alias("block"), "range", "query_id", "query_terms")
    # both sides of the cogroup come from ``wanted``: these columns need identities of their own
    sought = wanted.select(
        F.col("block").alias("part"), F.col("range").alias("place"), F.explode("query_terms").alias("term")).distinct()
    known = index.join(asked.select(F.explode("query_terms").alias("term")).distinct(), "term", "left_semi")
    lists = known.select(F.col("range").alias("place"), "term", "members", "fields").join(sought, ["place", "term"])

    def score(key, questions: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, n = questions["query_id"].to_numpy(), len(questions)
        sizes = questions["query_terms"].map(len).to_numpy(dtype=np.float64)
        asking: dict[str, list[int]] = {}
        for i, terms in enumerate(questions["query_terms"]):
            for term in terms:
                asking.setdefault(term, []).append(i)
        cells, fields = [], []
        for term, members, field in zip(found["term"], found["members"], found["fields"], strict=True):
            who = np.array(asking[term])
            cells.append((members[:, None].astype(np.int64) * n + who).ravel())
            fields.append(np.repeat(field, len(who)))
        if not cells:
            return pd.DataFrame({"query_id": ids[:0], "range": "", "member": 0, **dict.fromkeys(
                ("chunk_overlap", "title_overlap", "heading_overlap", "score"), 0.0)})
        cell, field = np.concatenate(cells), np.concatenate(fields)
        height = int(cell.max()) // n + 1
        shares = [np.bincount(cell[field >> bit & 1 == 1], minlength=height * n).reshape(height, n) / sizes for bit in range(3)]
        total = shares[0] * weights[0] + shares[1] * weights[1] + shares[2] * weights[2]
        best = np.argsort(-total, axis=0, kind="stable")[:k]
        at, q = best.ravel(), np.broadcast_to(np.arange(n), best.shape).ravel()
        keep = total[at, q] > 0
        at, q = at[keep], q[keep]
        return pd.DataFrame({
            "query_id": ids[q], "range": key[1], "member": at.astype(np.int32), "chunk_overlap": shares[0][at, q],
            "title_overlap": shares[1][at, q], "heading_overlap": shares[2][at, q], "score": total[at, q]})

    return wanted.groupBy("block", "range").cogroup(lists.groupBy("part", "place")).applyInPandas(score, OPENED_SCHEMA)


def search_index(questions: DataFrame, index: DataFrame, k: int = MAX_K, block_rows: int = 512, salts: int = 8) -> DataFrame:
    """questions(query_id, query_terms): top k chunks of an indexed corpus by lexical score > 0.

    Ties go to the smaller (page_url, chunk_index).  ``index``: a written or checkpointed ``index_chunks``.
    Null and empty term lists find nothing.
    """
    terms = F.array_compact(F.array_distinct("query_terms"))
    asked = cut_lineage(questions.select("query_id", terms.alias("query_terms")).filter(F.size("query_terms") > 0))
    n = asked.count()
    upper = cut_lineage(upper_bounds(asked, index, salts))
    first = cut_lineage(first_ranges(upper))
    opened = cut_lineage(open_ranges(asked, index, first, k, block_rows, n))
    rest = open_ranges(asked, index, ranges_above(upper, opened, first, k), k, block_rows, n)
    keys = index.filter(F.col("term").isNull()).select("range", "urls", "indexes")
    named = opened.unionByName(rest).join(keys, "range").select(
        "query_id", F.col("urls")[F.col("member")].alias("page_url"), F.col("indexes")[F.col("member")].alias("chunk_index"),
        "chunk_overlap", "title_overlap", "heading_overlap", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_url", "chunk_index")
    return named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("has_terms", F.lit(True))
