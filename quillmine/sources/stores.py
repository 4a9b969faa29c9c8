"""Keyed stores as Parquet tables: pinned pages, corpus cache, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.functions import text as tx
from quillmine.functions import urls
from quillmine.operators.pages import content_signature


def pinned_pages(pinned: DataFrame, content: DataFrame) -> DataFrame:
    """Pinned list joined with page content; pages without content are dropped."""
    texts = content.select("id", tx.web_strip(tx.text_of(F.col("markdown"))).alias("markdown"))
    return pinned.join(texts.filter(F.col("markdown") != ""), "id").withColumn(
        "source_type", urls.source_type(F.col("url"))
    )


def new_pins(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched pages whose URL is not pinned yet."""
    return fetched.join(pinned.select("url").filter(F.length("url") > 0).distinct(), "url", "left_anti")


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def without_copies(pages: DataFrame) -> DataFrame:
    """Pages(page_url, markdown, ...) without repeats of a text; the smallest URL stays, once.

    Only (signature, URL) rows are grouped.  Texts that occur once pass an anti join with the
    signatures of the others; of those, the rows with the kept URL are reduced to one.  Signatures
    that repeat are few as a rule, so their list is broadcast at run time and the texts are not
    moved; a long list falls back to a shuffle.  Null URLs come last and are kept like any other; a null
    text is no copy of another.
    """
    return _one_each(_signed(pages)).select(*pages.columns)


def _signed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content_signature", content_signature(F.col("markdown")))


def _one_each(signed: DataFrame) -> DataFrame:
    """One row of every ``content_signature``, as ``without_copies`` describes; none is made anew here."""
    order = F.struct(F.col("page_url").isNull().alias("last"), F.col("page_url").alias("url"))
    repeated = signed.select("content_signature", order.alias("row")).groupBy("content_signature").agg(
        F.min("row").alias("keeper"), F.count("*").alias("n")
    ).filter(F.col("n") > 1)
    once = signed.join(repeated, "content_signature", "left_anti")
    again = signed.join(repeated, "content_signature").filter(F.col("page_url").eqNullSafe(F.col("keeper.url")))
    rest = again.dropDuplicates(["content_signature"])
    return once.select(*signed.columns).unionByName(rest.select(*signed.columns))


def unseen_pages(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pages whose text is not in the corpus table yet, one per signature.

    Only these are chunked and embedded; corpus(content_signature).
    """
    signed = _signed(pages)
    fresh = signed.join(corpus.select("content_signature").distinct(), "content_signature", "left_anti")
    return _one_each(fresh.select(*signed.columns))


def answer_records(
    stats: DataFrame, cited: DataFrame, conflicts: DataFrame
) -> DataFrame:
    """One nested record per question: statistics, citations and conflicts.

    Both lists are short by construction: selected pages and the top conflicts.
    """
    pages = cited.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("citation", "page_title", "page_url", "source_type"))).alias("citations")
    )
    clashes = conflicts.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "topic", "summary"))).alias("conflicts")
    )
    fields = [c for c in stats.columns if c != "query_id"]
    return (
        stats.select("query_id", F.struct(*fields).alias("stats"))
        .join(pages, "query_id", "left")
        .join(clashes, "query_id", "left")
    )
