"""Page features, profiles and priorities.

Features that depend on the page alone are computed once per page, those of a question
once per question; only then are both joined through the basket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.functions import urls


def content_signature(markdown: Column) -> Column:
    return F.sha1(tx.strip(tx.collapse(F.lower(markdown))))


def heading_terms(markdown: Column) -> Column:
    """Terms of the first headings.  (?d): only a newline ends a line."""
    pattern = "(?d)" + rules.HEADING_PATTERN.replace(r"\s", rules.SPACE_CLASS)
    first = F.slice(tx.all_matches(markdown, pattern, 1), 1, rules.HEADING_LIMIT)
    return tx.token_set(F.array_join(first, " "))


def role_text(title: Column, url: Column, markdown: Column) -> Column:
    """What the role hints are looked for in."""
    return F.lower(F.concat_ws("\n", title, url, F.substring(markdown, 1, rules.ROLE_TEXT_CHARS)))


def document_role(
    text: Column, source_type: Column, hints: Mapping[str, Sequence[str]] = rules.DOCUMENT_ROLE_HINTS
) -> Column:
    """First role with a hint in ``text``; pass a materialised column, it is read many times."""
    role = F.when(source_type == "jira", "ticket").otherwise("generic")
    for name, words in reversed(list(hints.items())):
        role = F.when(tx.contains_any(text, words), F.lit(name)).otherwise(role)
    return role


def with_role(pages: DataFrame, hints: Mapping[str, Sequence[str]] = rules.DOCUMENT_ROLE_HINTS) -> DataFrame:
    """Pages with a ``role`` column.

    The hint text is its own projection: the optimizer keeps it apart because it is used more
    than once, so it is built once per row.
    """
    text = role_text(F.col("title"), F.col("page_url"), F.col("markdown"))
    return (
        pages.withColumn("role_text", text)
        .withColumn("role", document_role(F.col("role_text"), F.col("source_type"), hints))
        .drop("role_text")
    )


def page_features(pages: DataFrame, hints: Mapping[str, Sequence[str]] = rules.DOCUMENT_ROLE_HINTS) -> DataFrame:
    """Everything about a page that no question changes; the text itself is not carried on."""
    rows = with_role(pages, hints).withColumn("canonical_url", urls.canonical_url(F.col("page_url")))
    return rows.select(
        "page_url",
        "title",
        "source_type",
        F.length("markdown").cast("long").alias("size_chars"),
        "role",
        "canonical_url",
        content_signature(F.col("markdown")).alias("content_signature"),
        tx.token_set(F.col("title")).alias("title_terms"),
        heading_terms(F.col("markdown")).alias("heading_terms"),
        tx.token_set(F.col("canonical_url")).alias("url_terms"),
    )


def planner_mode(questions: DataFrame, basket: DataFrame) -> DataFrame:
    """(query_id, planner_mode, planner_note) from context roles, mode and page count."""
    facts = basket.groupBy("query_id").agg(
        F.max(F.col("context_role") == "compare_anchor").alias("anchored"),
        F.max(F.col("context_role") == "current_page").alias("current"),
        F.count("*").alias("n_pages"),
    )
    joined = questions.join(facts, "query_id", "left").withColumns(
        {
            "anchored": F.coalesce("anchored", F.lit(False)),
            "current": F.coalesce("current", F.lit(False)),
            "n_pages": F.coalesce("n_pages", F.lit(0)),
        }
    )
    asked = F.lower(tx.strip(tx.text_of(F.col("question"))))
    mode = F.col("mode")
    plan = (
        F.when(F.col("anchored"), "compare-current-vs-pinned")
        .when(F.col("current") & (mode == "critique"), "current-page-critique")
        .when(F.col("current") & (mode == "diagram"), "current-page-diagram")
        .when(F.col("current"), "current-page-summary")
        .when(mode == "diagram", "diagram-synthesis")
        .when(mode == "critique", "critique-review")
        .when(F.regexp_like(asked, F.lit("(?U)" + rules.COMPARE_PATTERN)), "cross-doc-compare")
        .when(F.col("n_pages") <= 1, "single-doc-focus")
        .otherwise("multi-doc-synthesis")
    )
    notes = F.create_map(*[F.lit(x) for pair in rules.PLANNER_NOTES.items() for x in pair])
    return joined.select("query_id", plan.alias("planner_mode")).withColumn(
        "planner_note", F.element_at(notes, F.col("planner_mode"))
    )


def weight(table: Mapping[str, Mapping[str, float]], mode: Column, key: Column) -> Column:
    """Weight looked up by mode and key, 1.0 when there is none."""
    pairs = [(f"{m}/{k}", w) for m, row in table.items() for k, w in row.items()]
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.element_at(lookup, F.concat(mode, F.lit("/"), key)), F.lit(1.0))


def page_profiles(
    questions: DataFrame, basket: DataFrame, features: DataFrame, planner: DataFrame
) -> DataFrame:
    """One row per basket entry with overlaps, weights and the clamped priority."""
    asked = questions.select(
        "query_id", "mode", "question", tx.token_set(F.col("question")).alias("query_terms")
    ).join(planner.select("query_id", "planner_mode"), "query_id")
    rows = basket.join(features, "page_url").join(asked, "query_id")
    terms = F.col("query_terms")
    rows = rows.withColumns(
        {
            "title_overlap": tx.overlap_share(terms, F.col("title_terms")),
            "heading_overlap": tx.overlap_share(terms, F.col("heading_terms")),
            "url_overlap": tx.overlap_share(terms, F.col("url_terms")),
            "source_weight": weight(rules.SOURCE_TYPE_WEIGHTS, F.col("mode"), F.col("source_type")),
            "role_weight": weight(rules.DOCUMENT_ROLE_WEIGHTS, F.col("mode"), F.col("role")),
        }
    )
    return rows.withColumn("priority", page_priority()).select(
        "query_id", "page_url", "original_index", "title", "source_type", "role", "context_role",
        "planner_mode", "mode", "priority", "title_overlap", "heading_overlap", "url_overlap",
        "source_weight", "role_weight", "canonical_url", "content_signature", "size_chars",
    )


def page_priority() -> Column:
    """Priority over the columns of a profile row."""
    shares = rules.PRIORITY_OVERLAP_WEIGHTS
    score = F.col("source_weight") * F.col("role_weight") + (
        F.col("title_overlap") * shares["title"]
        + F.col("heading_overlap") * shares["heading"]
        + F.col("url_overlap") * shares["url"]
    )
    key = F.lower(F.regexp_extract("question", "(?U)" + rules.ISSUE_KEY_PATTERN, 1))
    where = F.lower(F.concat_ws(" ", "title", "page_url"))
    named = (F.col("source_type") == "jira") & (key != "") & F.contains(where, key)
    score = score + F.when(named, rules.PRIORITY_ISSUE_KEY_BONUS).otherwise(0.0)
    for role, bonus in rules.PRIORITY_CONTEXT_BONUS.items():
        score = score + F.when(F.col("context_role") == role, bonus).otherwise(0.0)
    for prefix, bonus in rules.PRIORITY_FIRST_PAGE_BONUS.items():
        first = F.col("planner_mode").startswith(prefix) & (F.col("original_index") == 0)
        score = score + F.when(first, bonus).otherwise(0.0)
    low, high = rules.PRIORITY_RANGE
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def query_intent(question: Column, title: Column) -> Column:
    """What a question asks for and which pages it is about."""
    low = F.lower(question)
    asked = tx.web_strip(low)
    kind = (
        F.when(tx.contains_any(low, rules.DIAGRAM_WORDS), "diagram")
        .when(tx.contains_any(low, rules.CRITIQUE_WORDS), "critique")
        .otherwise("answer")
    )
    about_current = F.regexp_like(asked, F.lit(rules.CURRENT_PAGE_REFERENCE_PATTERN))
    compared = about_current & (
        F.regexp_like(asked, F.lit(rules.COMPARE_PATTERN))
        | F.regexp_like(asked, F.lit(rules.PINNED_REFERENCE_PATTERN))
    )
    scoped = (
        tx.contains_any(asked, rules.CURRENT_ONLY_PHRASES)
        | tx.contains_any(asked, rules.CURRENT_PAGE_PHRASES)
        | F.regexp_like(asked, F.lit(rules.CURRENT_PAGE_ACTION_PATTERN))
    )
    mode = F.when(compared, "compare-current-vs-pinned").when(scoped, "current-only").otherwise("default")
    by_kind = {
        "current-only": ("current-page-critique", "current-page-diagram", "current-page-summary"),
        "default": ("critique-review", "diagram-synthesis", "multi-doc-synthesis"),
    }

    def planned(names: Sequence[str]) -> Column:
        return F.when(kind == "critique", names[0]).when(kind == "diagram", names[1]).otherwise(names[2])

    plan = (
        F.when(mode == "compare-current-vs-pinned", mode)
        .when(mode == "current-only", planned(by_kind["current-only"]))
        .otherwise(planned(by_kind["default"]))
    )
    before, after = rules.COMPARE_QUESTION_TEMPLATE
    name = tx.web_strip(tx.or_else(title, F.lit("current page")))
    rewritten = F.when(compared, F.concat(F.lit(before), name, F.lit(after)))
    return F.struct(
        kind.alias("kind"), mode.alias("context_mode"), plan.alias("planner_mode"),
        rewritten.alias("rewritten_question"),
    )


def route_basket(intents: DataFrame, basket: DataFrame, current: DataFrame) -> DataFrame:
    """Pages each question really looks at.

    intents(query_id, context_mode), basket(query_id, page_url, original_index),
    current(query_id, current_url).  Only the current page, or the current page before the
    others as references, or the whole basket.  A comparison without another page falls back
    to the current page.  A current page that is not in the basket is added as read live.
    """
    asked = intents.select("query_id", "context_mode").join(
        current.select("query_id", "current_url"), "query_id", "left"
    )
    rows = basket.select("query_id", "page_url", "original_index").join(asked, "query_id")
    same = F.coalesce(urls.loose_url(F.col("page_url")) == urls.loose_url(F.col("current_url")), F.lit(False))
    rows = rows.withColumn("is_current", same)
    facts = rows.groupBy("query_id").agg(
        F.min(F.when(F.col("is_current"), F.col("original_index"))).alias("current_index"),
        F.count_if(~F.col("is_current")).alias("n_others"),
    )
    live = (
        asked.join(facts, "query_id")
        .filter(
            F.col("current_index").isNull()
            & F.col("current_url").isNotNull()
            & (F.col("context_mode") != "default")
        )
        .select("query_id", F.col("current_url").alias("page_url"), F.lit(-1).alias("original_index"),
                "context_mode", "current_url", F.lit(True).alias("is_current"))
    )
    routed = (
        rows.select("query_id", "page_url", "original_index", "context_mode", "current_url", "is_current")
        .unionByName(live)
        .join(facts, "query_id")
        .withColumn(
            "chosen",
            F.col("is_current") & (F.col("original_index") == F.coalesce("current_index", F.lit(-1))),
        )
    )
    mode, has_current = F.col("context_mode"), F.col("current_url").isNotNull()
    compare = (mode == "compare-current-vs-pinned") & has_current
    only = (mode == "current-only") & has_current
    role = (
        F.when(compare & (F.col("n_others") > 0), F.when(F.col("chosen"), "compare_anchor").otherwise("reference_context"))
        .when(compare | only, "current_page")
        .otherwise("default")
    )
    keep = (
        F.when(compare & (F.col("n_others") > 0), F.col("chosen") | ~F.col("is_current"))
        .when(compare | only, F.col("chosen"))
        .otherwise(True)
    )
    place = F.when(F.col("chosen") & (role != "default"), F.lit(-1)).otherwise(F.col("original_index"))
    return routed.filter(keep).select("query_id", "page_url", role.alias("context_role"), place.alias("place"))


def over_input_limit(basket: DataFrame, sizes: DataFrame, limit: int = rules.MAX_INPUT_TOKENS) -> DataFrame:
    """(query_id, total_chars, estimated_tokens, too_large) from page sizes alone."""
    total = basket.join(sizes.select("page_url", "size_chars"), "page_url").groupBy("query_id").agg(
        F.sum("size_chars").alias("total_chars")
    )
    estimate = F.floor(F.col("total_chars") / 4)
    return total.withColumns({"estimated_tokens": estimate, "too_large": estimate > limit})
