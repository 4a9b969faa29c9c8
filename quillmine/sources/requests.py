"""Request JSON and page rows into the normalised tables.

pages(page_url, title, markdown, source_type, metadata), questions(query_id, question,
mode, diagram_type), basket(query_id, page_url, original_index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.functions import urls

PAGE_JSON = (
    "title STRING, url STRING, markdown STRING, source_type STRING, sourceType STRING, "
    "metadata STRING"
)
REQUEST_JSON = (
    "pages STRING, user_question STRING, userQuestion STRING, "
    "diagram_type STRING, diagramType STRING, mode STRING"
)


def html_pages(pages_raw: DataFrame) -> DataFrame:
    """Fetched rows that hold HTML."""
    return pages_raw.filter(F.length(tx.web_strip(tx.text_of(F.col("html")))) > 0)


def clean_source_type(source_type: Column, url: Column) -> Column:
    """Blank types are inferred from the URL, unknown ones become generic."""
    given = F.lower(tx.strip(tx.text_of(source_type)))
    known = F.when(given.isin(*rules.SOURCE_TYPES), given).otherwise("generic")
    return F.when(given == "", urls.source_type(url)).otherwise(known)


def clean_pages(pages: DataFrame) -> DataFrame:
    """Trim every string, fill title and source type; other columns pass."""
    url = tx.strip(tx.text_of(F.col("url")))
    return pages.withColumns(
        {
            "url": url,
            "title": tx.or_else(tx.strip(tx.text_of(F.col("title"))), urls.fallback_title(F.col("url"))),
            "markdown": tx.strip(tx.text_of(F.col("markdown"))),
            "source_type": clean_source_type(F.col("source_type"), F.col("url")),
        }
    )


def fallback_url(url: Column, title: Column, index: Column) -> Column:
    """Missing URLs get a local one from the title and the 1-based position."""
    number = index.cast("string")
    name = tx.or_else(tx.slug(tx.text_of(title)), F.concat(F.lit("page-"), number))
    made = F.concat(F.lit("local://"), name, F.lit("-"), number)
    return tx.or_else(tx.strip(tx.text_of(url)), made)


def prepare_pages(pages: DataFrame, index: str = "position") -> DataFrame:
    """Drop blank pages; positions count the dropped ones too."""
    title = tx.or_else(
        tx.strip(tx.text_of(F.col("title"))), F.concat(F.lit("Page "), F.col(index).cast("string"))
    )
    made_url = fallback_url(F.col("url"), F.col("title"), F.col(index))
    return pages.filter(tx.strip(tx.text_of(F.col("markdown"))) != "").withColumns(
        {
            "title": title,
            "url": made_url,
            "markdown": tx.strip(F.col("markdown")),
            "source_type": tx.or_else(
                F.lower(tx.strip(tx.text_of(F.col("source_type")))), urls.source_type(made_url)
            ),
        }
    )


def parse_requests(requests: DataFrame, json_col: str = "body", id_col: str = "query_id") -> DataFrame:
    """One row per request page, read leniently.

    Aliased keys are accepted, a non-list ``pages`` counts as empty, and requests above the
    page limit are flagged, not cut.
    """
    body = F.from_json(F.col(json_col), REQUEST_JSON)
    parsed = requests.select(F.col(id_col), body.alias("r")).select(
        id_col,
        tx.strip(tx.text_of(F.coalesce("r.user_question", "r.userQuestion"))).alias("question"),
        F.nullif(
            tx.strip(tx.text_of(F.coalesce("r.diagram_type", "r.diagramType"))), F.lit("")
        ).alias("diagram_type"),
        retrieval_mode(F.col("r.mode")).alias("mode"),
        F.coalesce(F.from_json("r.pages", "ARRAY<STRING>"), F.array().cast("array<string>")).alias("items"),
    )
    pages = parsed.select(
        id_col, "question", "diagram_type", "mode",
        (F.size("items") > rules.MAX_PAGES_PER_REQUEST).alias("rejected"),
        F.posexplode_outer("items").alias("pos", "item"),
    ).withColumn("p", F.from_json("item", PAGE_JSON))
    flat = pages.select(
        id_col, "question", "diagram_type", "mode", "rejected",
        (F.col("pos") + 1).alias("position"),
        F.col("p.title").alias("title"), F.col("p.url").alias("url"),
        F.col("p.markdown").alias("markdown"),
        F.coalesce("p.source_type", "p.sourceType").alias("source_type"),
        F.coalesce(
            F.from_json("p.metadata", "MAP<STRING,STRING>"),
            F.create_map().cast("map<string,string>"),
        ).alias("metadata"),
    )
    return clean_pages(flat)


def retrieval_mode(mode: Column) -> Column:
    low = F.lower(tx.strip(tx.text_of(mode)))
    return F.when(low.isin(*rules.RETRIEVAL_MODES), low).otherwise("answer")


def context_role(metadata: Column) -> Column:
    low = F.lower(tx.strip(tx.text_of(F.element_at(metadata, "context_role"))))
    return F.when(low.isin(*rules.CONTEXT_ROLES), low).otherwise("default")
