"""Chunking, chunk statistics, embedding and signatures."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.operators.blocks import pieces

CHUNK_SCHEMA = (
    "page_url string, page_title string, source_type string, chunk_index long, "
    "total_chunks long, char_start long, char_end long, text string"
)


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; carry at most ``overlap`` into the next."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if held + len(piece) > size:
            joined = "".join(window).strip()
            if joined:
                yield joined
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    joined = "".join(window).strip()
    if joined:
        yield joined


def split_text(
    text: str,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
    separators: Sequence[str] = rules.CHUNK_SEPARATORS,
) -> list[str]:
    """Split at the coarsest separator present; pieces still too long go one level down."""
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[level], separators[level + 1:]
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in [head, *[mark + t for t in tail]] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        out.extend(_pack(short, size, overlap))
        short = []
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    out.extend(_pack(short, size, overlap))
    return out


def chunk_pages(
    pages: DataFrame,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pages to chunks, partition by partition, no shuffle.

    ``carry`` names page columns every chunk keeps, which saves a join back to the pages.

    A page is one row, so index, count and offsets come out of the same task.
    ``char_start`` is the running sum of (length - overlap), as callers expect it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "markdown"):
            rows = []
            for url, title, kind, markdown, *kept in batch.itertuples(index=False):
                if not markdown or not markdown.strip():
                    continue
                texts = split_text(markdown, size, overlap)
                start = 0
                for i, text in enumerate(texts):
                    rows.append((url, title, kind, i, len(texts), start, start + len(text), text, *kept))
                    start += len(text) - overlap
            yield pd.DataFrame(
                rows,
                columns=["page_url", "page_title", "source_type", "chunk_index", "total_chunks",
                         "char_start", "char_end", "text", *carry],
            )

    source = pages.select("page_url", "title", "source_type", "markdown", *carry)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[4:])
    return source.mapInPandas(run, CHUNK_SCHEMA + extra)


def chunk_offsets(chunks: DataFrame, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """Index, count and offsets for chunk texts that come as a table ordered by ``chunk_index``."""
    page = Window.partitionBy("page_url")
    before = page.orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text")
    start = F.coalesce(F.sum(length - overlap).over(before), F.lit(0))
    return chunks.select(
        "page_url",
        (F.row_number().over(page.orderBy("chunk_index")) - 1).cast("long").alias("chunk_index"),
        F.count("*").over(page).alias("total_chunks"),
        start.alias("char_start"),
        (start + length).alias("char_end"),
    )


def chunk_stats(baskets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk totals per question.  Pages are summed first, so only totals meet the basket."""
    per_page = chunks.groupBy("page_url").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )
    return (
        baskets.select("query_id", "page_url")
        .join(per_page, "page_url")
        .groupBy("query_id")
        .agg(F.sum("n").alias("total_chunks"), F.sum("chars").alias("total_chars"),
             F.count("*").alias("pages_count"))
        .withColumns(
            {
                "avg_chunk_size": F.floor(F.col("total_chars") / F.col("total_chunks")),
                "chunks_per_page": F.col("total_chunks") / F.col("pages_count"),
            }
        )
    )


def embedding_text(title: Column, source_type: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Title: "), title, F.lit("\nSource type: "), source_type, F.lit("\nContent:\n"), text
    )


class _Slots(dict):
    """Token to slot number, worked out once per token and worker."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        slot = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dims
        return slot


def hashed_counts(dims: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Default encoder: token counts in hashed slots, L2-normalised."""
    pattern = re.compile(r"[a-z0-9][a-z0-9._/-]*")
    slots = _Slots(dims)

    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = np.fromiter(map(slots.__getitem__, pattern.findall((text or "").lower())), dtype=np.int64)
            vec = np.bincount(found, minlength=dims).astype(np.float64)
            length = np.sqrt((vec * vec).sum())
            out.append((vec / length if length else vec).astype(np.float32))
        if len(slots) > 1_000_000:
            slots.clear()
        return pd.Series(out)

    return encode


def embed(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "embedding",
    encoder_factory: Callable[[], Callable[[pd.Series], pd.Series]] = hashed_counts,
) -> DataFrame:
    """Add an embedding column.  The factory runs once per worker, then serves all batches."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for batch in batches:
            yield model(batch)

    return df.withColumn(out_col, encode(F.col(text_col)))


def embed_questions(questions: DataFrame, **how) -> DataFrame:
    """Embed every distinct question once and hand the vector to its repeats."""
    signed = questions.withColumn("query_signature", query_signature(F.col("question")))
    once = signed.groupBy("query_signature").agg(F.first("question").alias("text"))
    vectors = embed(once, "text", **how).select("query_signature", "embedding")
    return signed.join(vectors, "query_signature")


def token_count(col: Column, counter: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Tokens of a text: length based by default, or by a caller's tokenizer."""
    if counter is None:
        return tx.token_estimate(col).cast("long")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return counter(texts)

    return count(tx.text_of(col))


def query_signature(question: Column) -> Column:
    return F.sha2(tx.strip(tx.text_of(question)), 256)


def corpus_signature(basket: DataFrame, pages: DataFrame) -> DataFrame:
    """One hash per question over the hashes of its pages in URL order.

    Each page is hashed once, where it lies; what is joined and collected is 64 characters a page, not
    its text.  So the value differs from a hash over the joined texts, as stored keys of this library do.
    """
    zero = F.lit("\x00")
    item = F.concat(F.col("page_url"), zero, F.col("title"), zero, F.col("source_type"), zero, F.col("markdown"), zero)
    hashed = pages.select("page_url", F.sha2(item, 256).alias("hash"))
    joined = basket.select("query_id", "page_url", "original_index").join(hashed, "page_url")
    listed = F.sort_array(F.collect_list(F.struct("page_url", "original_index", "hash")))
    return joined.groupBy("query_id").agg(
        F.sha2(F.array_join(F.transform(listed, lambda s: s["hash"]), ""), 256).alias("corpus_signature")
    )


def answer_cache_key(questions: DataFrame, basket: DataFrame, pages: DataFrame) -> DataFrame:
    """Cache key over the lower-cased question and the page hashes in (url, title) order."""
    page = F.struct(
        tx.web_strip(F.col("title")).alias("title"), tx.web_strip(F.col("page_url")).alias("url"),
        tx.web_strip(F.col("markdown")).alias("markdown"), F.col("source_type"),
    )
    order = F.concat_ws(" ", page["url"], page["title"])
    hashed = pages.select("page_url", order.alias("k"), F.sha2(F.to_json(page), 256).alias("hash"))
    listed = F.sort_array(F.collect_list(F.struct("k", "original_index", "hash")))
    grouped = (
        basket.select("query_id", "page_url", "original_index")
        .join(hashed, "page_url")
        .groupBy("query_id")
        .agg(F.transform(listed, lambda s: s["hash"]).alias("pages"))
    )
    question = tx.web_strip(F.lower("question")).alias("question")
    signature = F.to_json(F.struct(question, "pages"))
    return questions.join(grouped, "query_id").select(
        "query_id", F.concat(F.lit(rules.STORE_PREFIXES["diagram"]), F.sha2(signature, 256)).alias("cache_key")
    )
