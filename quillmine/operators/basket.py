"""The basket of pinned pages, and benchmark run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import urls
from quillmine.operators.ranking import spread_row_number


def matching_pages(pinned: DataFrame, needle: str) -> DataFrame:
    """Pinned pages whose title, URL or host contains the text; a blank text keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return pinned
    haystack = F.lower(F.concat_ws(" ", "title", "url", urls.hostname(F.col("url"))))
    return pinned.filter(F.contains(haystack, F.lit(wanted)))


def pages_by_host(pinned: DataFrame, order_col: str, run_width: int = 100_000) -> DataFrame:
    """Pages with host, place within the host and host size.

    A host can hold a large share of all pages, so it is numbered in runs, not collected.
    """
    hosted = pinned.withColumns(
        {"host": urls.hostname(F.col("url")), "run": F.floor(F.col(order_col) / run_width)}
    )
    sizes = hosted.groupBy("host").agg(F.count("*").alias("host_pages"))
    return spread_row_number(hosted, ["host"], ["run"], [order_col], "place").drop("run").join(sizes, "host")


def toggled_pages(changes: DataFrame, url: str = "url", at: str = "ts", payload: tuple[str, ...] = ()) -> DataFrame:
    """Net basket from pin events: a second pin removes.  An odd number leaves the last page."""
    state = changes.groupBy(url).agg(
        F.count("*").alias("n"), F.max_by(F.struct(at, *payload), F.struct(at, *payload)).alias("last")
    )
    return state.filter(F.col("n") % 2 == 1).select(url, "last.*")


def purge(store: DataFrame, mode: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed count).  ``cache`` drops derived rows, ``all`` pages and pins too."""
    p = rules.STORE_PREFIXES
    prefixes = [p["fetched"], p["discovered"], p["diagram"]]
    gone: Column = F.lit(False)
    if mode == "all":
        prefixes.append(p["page"])
        gone = F.col(key) == rules.PINNED_KEY
    for prefix in prefixes:
        gone = gone | F.col(key).startswith(prefix)
    return store.filter(~gone), store.agg(F.count_if(gone).alias("removed_count"))


def bench_summary(runs: DataFrame, label: str = "label", order: str = "run") -> DataFrame:
    """Rounded means per case; server metrics skip zeros and nulls; labels of the latest run."""

    def mean(col: Column) -> Column:
        return F.floor(F.avg(col) + 0.5)

    server = ("server_ms", "retrieval_ms", "generation_ms", "ttft_ms")
    return runs.groupBy(label).agg(
        mean(F.col("client_ms")).alias("client_ms"),
        *[mean(F.nullif(F.col(c), F.lit(0.0))).alias(c) for c in server],
        F.max_by("provider", order).alias("provider"),
    )


