"""Greedy page dedupe over two keys.

Pages are walked best first; one is dropped when its canonical URL or its content signature
was already *kept*.  A page dropped for its URL does not register its content, so two window
passes give a different answer.  Two forms:

* ``dedup_basket`` - the basket of a question has a fixed page limit, so its walk is a fold
  over one short array inside the JVM.
* ``dedup_rounds`` - groups of any size.  In each round a page is kept when it is the best of
  the undecided pages in both its URL group and its content group; whatever shares a key with
  a kept page goes.  Groups only ever meet in map-side combined aggregations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.operators.retrieve import ranked
from quillmine.session import cut_lineage, shared_folder


def walk_key() -> Column:
    """Best first: priority, length, then input order."""
    return F.struct(
        (-F.col("priority")).alias("p"), (-F.col("size_chars")).alias("s"), F.col("original_index").alias("i")
    )


def dedup_basket(profiles: DataFrame) -> DataFrame:
    """Profiles with ``outcome``: kept, duplicate URL or duplicate content, and ``walk`` order."""
    item = F.struct(walk_key().alias("k"), "page_url", "original_index",
                    F.col("canonical_url").alias("u"), F.col("content_signature").alias("c"))
    grouped = profiles.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    state = "struct<urls:array<string>,texts:array<string>,out:array<string>>"
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("urls"), none.alias("texts"), none.alias("out")).cast(state)

    def merge(acc: Column, row: Column) -> Column:
        by_url = (row["u"] != "") & F.array_contains(acc["urls"], row["u"])
        by_text = F.array_contains(acc["texts"], row["c"])
        keep = ~by_url & ~by_text
        outcome = F.when(by_url, "duplicate URL").when(by_text, "duplicate content").otherwise("kept")
        return F.struct(
            F.when(keep & (row["u"] != ""), F.array_append(acc["urls"], row["u"])).otherwise(acc["urls"]).alias("urls"),
            F.when(keep, F.array_append(acc["texts"], row["c"])).otherwise(acc["texts"]).alias("texts"),
            F.array_append(acc["out"], outcome).alias("out"),
        ).cast(state)

    walked = grouped.withColumn("out", F.aggregate("items", start, merge, lambda s: s["out"]))
    rows = walked.select("query_id", F.posexplode(F.arrays_zip("items", "out")).alias("walk", "r"))
    outcome = rows.select(
        "query_id", "walk", F.col("r.items.page_url").alias("page_url"),
        F.col("r.items.original_index").alias("original_index"), F.col("r.out").alias("outcome"),
    )
    return profiles.join(outcome, ["query_id", "page_url", "original_index"])


def dedup_rounds(
    profiles: DataFrame, group: str | None = None
) -> DataFrame:
    """Kept profiles for groups of any size and chains of any length.

    ``group`` names the column whose values are deduplicated apart; without it the whole table
    is one group.  ``page_id`` must be unique and is the last rank key.  Every round decides at
    least the best open page, so the rounds end; its winners are appended to a table in the shared
    folder.
    """
    scope = F.col(group).cast("string") if group else F.lit("")
    rank = F.struct(
        (-F.col("priority")).alias("p"), (-F.col("size_chars")).alias("s"),
        F.col("original_index").alias("i"), F.col("page_id").alias("id"),
    )
    # Pages without a URL never meet another one by URL.
    url_key = F.when(F.col("canonical_url") == "", F.concat(F.lit("\x00"), F.col("page_id").cast("string"))).otherwise(
        F.col("canonical_url")
    )
    open_rows = cut_lineage(
        profiles.select(
            "page_id", rank.alias("rank"),
            F.sha2(F.concat_ws("\x00", scope, url_key), 256).alias("url_key"),
            F.sha2(F.concat_ws("\x00", scope, "content_signature"), 256).alias("text_key"),
        )
    )
    folder = f"{shared_folder(profiles.sparkSession)}/dedup-{uuid.uuid4().hex}"
    while not open_rows.isEmpty():
        best_url = open_rows.groupBy("url_key").agg(F.min("rank").alias("best_url"))
        best_text = open_rows.groupBy("text_key").agg(F.min("rank").alias("best_text"))
        judged = open_rows.join(best_url, "url_key").join(best_text, "text_key")
        won = cut_lineage(
            judged.filter((F.col("rank") == F.col("best_url")) & (F.col("rank") == F.col("best_text")))
            .select("page_id", "url_key", "text_key")
        )
        won.select("page_id").write.mode("append").parquet(folder)
        # one winner per key, so these anti-joins have unique right sides
        open_rows = cut_lineage(
            open_rows.join(won.select("url_key"), "url_key", "left_anti").join(
                won.select("text_key"), "text_key", "left_anti"
            )
        )
    profiles.select("page_id").limit(0).write.mode("append").parquet(folder)
    kept = profiles.sparkSession.read.schema(profiles.select("page_id").schema).parquet(folder)
    return profiles.join(kept, "page_id", "left_semi")


def dedup_stats(walked: DataFrame, high: float = rules.HIGH_PRIORITY) -> DataFrame:
    """Counts per question from ``dedup_basket`` rows."""
    outcome = F.col("outcome")
    kept = outcome == "kept"
    label = F.concat(
        tx.page_label(F.col("title"), F.col("role"), F.col("source_type")), F.lit(" ("), outcome, F.lit(")")
    )
    totals = walked.groupBy("query_id").agg(
        F.count("*").alias("input_pages"), F.count_if(kept).alias("prepared_pages"),
        F.count_if(~kept).alias("deduped_pages"),
        F.count_if(outcome == "duplicate URL").alias("deduped_by_url"),
        F.count_if(outcome == "duplicate content").alias("deduped_by_content"),
        F.count_if(kept & (F.col("priority") >= high)).alias("high_priority_pages"),
    )
    per_type = walked.filter(kept).groupBy("query_id", "source_type").agg(F.count("*").alias("n"))
    types = per_type.groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source_type", F.col("n").cast("string")))), ", ")
        .alias("source_diversity_summary")
    )
    dropped = ranked(walked.filter(~kept), F.col("walk"), name="n").filter(F.col("n") <= 3)
    ignored = dropped.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("n", label.alias("l")))).alias("x")
    ).select("query_id", F.array_join(F.transform("x", lambda p: p["l"]), "; ").alias("ignored_pages_summary"))
    return (
        totals.join(types, "query_id", "left").join(ignored, "query_id", "left")
        .na.fill("", ["source_diversity_summary", "ignored_pages_summary"])
    )
