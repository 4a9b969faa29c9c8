"""Links of a page: filters, types, confidence, ranking and import.

Anchors are rows (src_url, anchor_index, url, link_text, parent_text, in_list, in_nav,
classes); every step below is a projection, a filter or one grouped step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.functions import urls
from quillmine.operators.ranking import spread_row_number


def content_links(anchors: DataFrame, nav_classes: Sequence[str] = rules.LINK_NAV_CLASSES) -> DataFrame:
    """Without navigation: by ancestor, by class part, by missing text."""
    classed = F.exists(F.split("classes", tx.WEB_SPACE_RUN), lambda c: tx.contains_any(c, nav_classes))
    return anchors.filter(~F.col("in_nav") & ~classed & (F.length(tx.web_strip(F.col("link_text"))) > 1))


def foreign_links(anchors: DataFrame) -> DataFrame:
    """Without links to the page itself and without generic targets."""
    return anchors.filter((F.col("url") != F.col("src_url")) & (F.col("type") != "generic"))


def link_context(
    parent: Column, link_text: Column, size: int = rules.LINK_CONTEXT_LENGTH, lead: int = rules.LINK_CONTEXT_BEFORE
) -> Column:
    """Snippet of the parent text around the link text, with dots where it is cut."""
    full, text = tx.web_strip(tx.text_of(parent)), tx.web_strip(tx.text_of(link_text))
    at = F.when(text == "", 0).otherwise(F.position(text, full) - 1)
    start = F.greatest(F.lit(0), at - lead)
    end = F.least(F.length(full), at + F.length(text) + (size - lead))
    snippet = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(full, start + 1, end - start),
        F.when(end < F.length(full), "...").otherwise(""),
    )
    return F.when(at < 0, F.substring(full, 1, size)).otherwise(snippet)


def link_confidence(
    link_text: Column,
    context: Column,
    in_list: Column,
    high: Sequence[str] = rules.LINK_HIGH_WORDS,
    medium: Sequence[str] = rules.LINK_MEDIUM_WORDS,
) -> Column:
    text, around = F.lower(link_text), F.lower(context)

    def has(words: Sequence[str]) -> Column:
        return tx.contains_any(around, words) | tx.contains_any(text, words)

    trimmed = tx.web_strip(link_text)
    telling = (F.length(trimmed) > 10) & ~F.lower(trimmed).isin(*rules.LINK_VAGUE_TEXTS)
    score = (
        F.when(has(high), 2).otherwise(0) + F.when(has(medium), 1).otherwise(0)
        + F.when(in_list, 1).otherwise(0) + F.when(telling, 1).otherwise(0)
    )
    return F.when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")


def link_title(link_text: Column, url: Column) -> Column:
    """Link text, else something readable from the URL."""
    path = urls.url_part(url, 5)
    key = F.regexp_extract(path, r"/browse/([A-Z]+-[0-9]+)", 1)
    tail = F.regexp_extract(path, r"/([^/]+)$", 1)
    decoded = F.coalesce(F.translate(F.try_url_decode(tail), "-_+", "   "), url)
    pair = F.regexp_extract(path, r"/([^/]+/[^/]+)", 1)
    from_url = (
        F.when(urls.url_part(url, 4) == "", url)
        .when(key != "", key).when(tail != "", decoded).when(pair != "", pair)
        .otherwise(urls.hostname(url))
    )
    return tx.or_else(tx.web_strip(tx.text_of(link_text)), from_url)


def describe(
    anchors: DataFrame,
    patterns: Mapping[str, Sequence[str]] = rules.LINK_TYPE_PATTERNS,
    high: Sequence[str] = rules.LINK_HIGH_WORDS,
) -> DataFrame:
    """Anchors to candidate links with type, context, confidence and title."""
    typed = content_links(anchors).withColumn("type", urls.link_type(F.col("url"), patterns))
    rows = foreign_links(typed).withColumn("context", link_context(F.col("parent_text"), F.col("link_text")))
    return rows.select(
        "src_url", "url", "anchor_index", "type", "context",
        link_title(F.col("link_text"), F.col("url")).alias("title"),
        link_confidence(F.col("link_text"), F.col("context"), F.col("in_list"), high).alias("confidence"),
    )


def score_of(names: Mapping[str, int], col: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(table, col)


def distinct_links(links: DataFrame) -> DataFrame:
    """One row per page and target: the most confident, the first on a tie.

    An aggregation, so copies of a link meet only after a map-side combine.
    """
    best = F.struct(score_of(rules.LINK_CONFIDENCE_ORDER, F.col("confidence")).alias("c"), (-F.col("anchor_index")).alias("i"))
    return links.groupBy("src_url", "url").agg(
        F.max_by(F.struct("title", "type", "context", "confidence"), best).alias("l"),
        F.min("anchor_index").alias("first_index"),
    ).select("src_url", "url", "l.*", "first_index")


def relevant_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("confidence").isin("high", "medium"))


def ranked_links(links: DataFrame, run_width: int = 100_000) -> DataFrame:
    """Order per page: confidence, then type, then first occurrence."""
    keyed = links.withColumns(
        {
            "by_confidence": -score_of(rules.LINK_CONFIDENCE_ORDER, F.col("confidence")),
            "by_type": -score_of(rules.LINK_TYPE_ORDER, F.col("type")),
            "run": F.floor(F.col("first_index") / run_width),
        }
    )
    coarse = ["by_confidence", "by_type", "run"]
    return spread_row_number(keyed, ["src_url"], coarse, ["first_index"], "rank").drop(*coarse)


def without_pinned(links: DataFrame, pinned: DataFrame) -> DataFrame:
    """Links whose target is not in the basket; pinned(url)."""
    return links.join(pinned.filter(F.length("url") > 0).select("url").distinct(), "url", "left_anti")


def import_batch(links: DataFrame, cap: int = rules.LINK_IMPORT_CAP) -> DataFrame:
    """First links per page up to the cap, flagged when more were there.

    The cap is the feature: the rest stays in the link table for the next import.
    """
    totals = links.groupBy("src_url").agg((F.count("*") > cap).alias("truncated"))
    place = Window.partitionBy("src_url").orderBy("first_index")
    head = links.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= cap)
    return head.join(totals, "src_url")


def link_summary(links: DataFrame) -> DataFrame:
    """Links and link types per page; there are five types at most."""
    return links.groupBy("src_url").agg(
        F.count("*").alias("n_links"), F.sort_array(F.collect_set("type")).alias("types")
    )
