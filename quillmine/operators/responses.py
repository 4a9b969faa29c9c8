"""Mining stored model responses: JSON and text jobs over a responses table."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx

# Whatever ends a line for a Unicode-aware line splitter.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FENCED_JSON = r"(?i)```json" + rules.SPACE_CLASS + r"*([\s\S]+?)```"
FENCED_DIAGRAM = r"(?i)```mermaid" + rules.SPACE_CLASS + r"*([\s\S]+?)```"


def _parts(value) -> list[str]:
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, list):
        return [p for item in value for p in _parts(item)]
    if isinstance(value, dict):
        found = [p for key in ("text", "output_text", "content", "summary") for p in _parts(value.get(key))]
        refusal = str(value.get("refusal") or "").strip()
        return found + [refusal] if refusal else found
    return []


def response_text(message: Column) -> Column:
    """Text of a message JSON {content, additional_kwargs, response_metadata}.

    The nesting is arbitrary, so this is a pandas UDF.
    """

    @F.pandas_udf("string")
    def flatten(bodies: pd.Series) -> pd.Series:
        def one(body: str | None) -> str:
            try:
                message = json.loads(body or "null")
            except json.JSONDecodeError:
                return ""
            for key in ("content", "additional_kwargs", "response_metadata"):
                found = _parts(message.get(key)) if isinstance(message, dict) else []
                if found:
                    return "\n\n".join(found).strip()
            return ""

        return bodies.map(one)

    return flatten(message)


def is_json(text: Column) -> Column:
    """True for exactly one JSON value.

    The parser stops after the first value, so the text is parsed inside an array and inside an
    object: what follows a value cannot fit both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v": '), text, F.lit("}")))
    return in_array.isNotNull() & in_object.isNotNull()


def json_object(text: Column) -> Column:
    """JSON object text: from a json fence or the whole text, else from the outermost braces."""
    fenced = F.regexp_like(text, F.lit(FENCED_JSON))
    whole = tx.strip(F.when(fenced, F.regexp_extract(text, FENCED_JSON, 1)).otherwise(text))
    braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.when(is_json(whole), F.when(whole.startswith("{"), whole)).otherwise(
        F.when((braces != "") & is_json(braces), braces)
    )


def critique(responses: DataFrame, id_col: str = "response_id", text_col: str = "text") -> DataFrame:
    """Responses with their summary and the raw issue list."""
    body = F.from_json("body", "summary STRING, issues STRING")
    parsed = responses.withColumn("body", json_object(F.col(text_col))).withColumn("b", body)
    summary = tx.or_else(tx.strip(tx.text_of(F.col("b.summary"))), F.lit(rules.CRITIQUE_DEFAULTS["summary"]))
    return parsed.select(
        id_col,
        F.when(F.col("body").isNull(), tx.strip(F.col(text_col))).otherwise(summary).alias("summary"),
        F.from_json("b.issues", "ARRAY<STRING>").alias("items"),
    )


def issues(responses: DataFrame, id_col: str = "response_id", text_col: str = "text") -> DataFrame:
    """First five issues of a critique, normalised; incomplete ones are dropped."""
    fields = "title STRING, severity STRING, category STRING, evidence STRING, risk STRING, suggestion STRING, source_title STRING"
    rows = critique(responses, id_col, text_col).select(
        id_col, F.posexplode(F.slice("items", 1, rules.ISSUE_LIMIT)).alias("issue_index", "item")
    ).withColumn("i", F.from_json("item", fields))

    def field(name: str) -> Column:
        return tx.strip(tx.text_of(F.col(f"i.{name}")))

    base = rules.CRITIQUE_DEFAULTS
    severity = F.lower(field("severity"))
    return rows.filter(
        (field("title") != "") & (field("risk") != "") & (field("suggestion") != "")
    ).select(
        id_col, "issue_index", field("title").alias("title"),
        F.when(severity.isin(*rules.SEVERITIES), severity).otherwise(base["severity"]).alias("severity"),
        tx.or_else(field("category"), F.lit(base["category"])).alias("category"),
        tx.or_else(field("evidence"), F.lit(base["evidence"])).alias("evidence"),
        field("risk").alias("risk"), field("suggestion").alias("suggestion"),
        F.nullif(field("source_title"), F.lit("")).alias("source_title"),
    )


def suggestions(responses: DataFrame, id_col: str = "response_id", text_col: str = "text") -> DataFrame:
    """Bullets of the missing-information section with keywords and confidence."""
    ws = rules.SPACE_CLASS
    bullet = rf"(?md)-{ws}+([^-]+?){ws}+-{ws}+(.+?)$"
    line = rf"(?id)Keywords(?:{ws}+to{ws}+search)?:{ws}*(.+?)(?:\n|$)"
    text = F.col(text_col)
    words = F.filter(
        F.transform(F.split(F.regexp_extract(text, line, 1), "[,;]"), lambda v: tx.strip(v)), lambda w: w != ""
    )
    pairs = F.arrays_zip(tx.all_matches(text, bullet, 1).alias("topic"), tx.all_matches(text, bullet, 2).alias("reason"))
    rows = responses.filter(tx.contains_any(text, rules.SUGGESTION_MARKERS)).select(
        id_col, words.alias("words"), F.posexplode(pairs).alias("suggestion_index", "p")
    ).select(
        id_col, "suggestion_index", "words", tx.strip(F.col("p.topic")).alias("topic"),
        tx.strip(F.col("p.reason")).alias("why"),
    )
    specific = tx.contains_any(F.lower("topic"), rules.SUGGESTION_HIGH_WORDS) | tx.contains_any(
        F.lower("why"), rules.SUGGESTION_HIGH_WORDS
    )
    return rows.select(
        id_col, "suggestion_index", F.concat_ws(": ", "topic", "why").alias("reason"),
        F.when(F.size("words") > 0, F.col("words")).otherwise(F.array("topic")).alias("keywords"),
        F.when(specific, "high").when(F.length("why") > 30, "medium").otherwise("low").alias("confidence"),
    )


def strip_missing(text: Column) -> Column:
    """Cut the missing-information section; keep the text when nothing would be left."""
    ws = rules.WEB_SPACE_CLASS
    ruled = F.regexp_replace(text, rf"\n?---{ws}*\n?\x{{1f4a1}}[\s\S]*$", "")
    plain = F.regexp_replace(ruled, rf"\n?\x{{1f4a1}}{ws}*\*\*Missing Information:\*\*[\s\S]*$", "")
    return tx.or_else(tx.web_strip(plain), tx.web_strip(text))


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_END)


def diagram_type(code: Column, prefixes: Sequence[str] = rules.DIAGRAM_PREFIXES) -> Column:
    """Type named at the start of the first line; one pattern, so ``code`` is evaluated once."""
    named = F.regexp_extract(tx.strip(tx.text_of(code)), "^(" + "|".join(prefixes) + ")", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("unknown"))


def diagram_code(text: Column) -> Column:
    """Code of the diagram fence, else the whole text if its first line names a diagram type."""
    fenced = F.regexp_like(text, F.lit(FENCED_DIAGRAM))
    kept = F.filter(F.transform(lines_of(text), lambda s: F.rtrim(s, F.lit(rules.SPACE_CHARS))), lambda s: s != "")
    bare = tx.strip(F.array_join(kept, "\n"))
    return F.when(fenced, tx.strip(F.regexp_extract(text, FENCED_DIAGRAM, 1))).when(
        diagram_type(bare) != "unknown", bare
    )


def diagram_valid(code: Column) -> Column:
    lines = F.filter(F.transform(lines_of(tx.text_of(code)), lambda v: tx.strip(v)), lambda s: s != "")
    return (
        (diagram_type(code) != "unknown")
        & (F.size(lines) >= 2)
        & ~F.exists(lines, lambda s: s.startswith("```"))
    )


def diagram_summary(text: Column) -> Column:
    prose = F.regexp_replace(text, FENCED_DIAGRAM, "")
    return tx.or_else(
        tx.strip(F.regexp_replace(prose, "\n{3,}", "\n\n")), F.lit(rules.DIAGRAM_SUMMARY_DEFAULT)
    )


def latency_metrics(metadata: Column) -> Column:
    """Timings found at any depth of a metadata JSON text; nanoseconds become milliseconds."""

    def number(*keys: str) -> Column:
        names = "|".join(keys)
        found = F.regexp_extract(metadata, rf'"(?:{names})"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1)
        return F.nullif(found, F.lit("")).cast("double")

    def ms(ns: Column) -> Column:
        return F.bround(ns / 1_000_000, 0).cast("long")

    explicit = number("ttft_ms", "time_to_first_token_ms", "first_token_ms")
    total, evaluated = number("total_duration"), number("eval_duration")
    load, prompt = number("load_duration"), number("prompt_eval_duration")
    first = F.coalesce(load, F.lit(0.0)) + F.coalesce(prompt, F.lit(0.0))
    own = explicit.isNull()
    return F.struct(
        F.when(~own, "provider-ttft").when(total.isNotNull(), "ollama-provider").otherwise("wall-clock").alias("timing_source"),
        F.when(~own, F.bround(explicit, 0).cast("long")).when(first > 0, ms(first)).alias("ttft_ms"),
        F.when(own, ms(total)).alias("provider_total_latency_ms"),
        F.when(own, ms(evaluated)).alias("provider_eval_latency_ms"),
        F.when(own, ms(load)).alias("provider_load_latency_ms"),
        F.when(own, ms(prompt)).alias("provider_prompt_eval_latency_ms"),
    )


# --- titles, issues and suggestions against pages -------------------------------------


def plain_title(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(tx.text_of(title)), r"""[\[\]()"':]""", " ")
    return tx.web_strip(F.regexp_replace(bare, tx.WEB_SPACE_RUN, " "))


def titles_match(source: Column, current: Column) -> Column:
    """One title contains the other, or they share enough words."""
    a, b = plain_title(source), plain_title(current)
    words_a = F.array_distinct(tx.word_tokens(a, 3, rules.TITLE_STOP_WORDS))
    words_b = tx.word_tokens(b, 3, rules.TITLE_STOP_WORDS)
    # words_a is bound by an outer transform, else the inner lambda would rebuild it per word
    shared = F.element_at(
        F.transform(F.array(words_a), lambda known: F.size(F.filter(words_b, lambda w: F.array_contains(known, w)))), 1
    )
    least = F.least(F.size(words_a), F.size(words_b))
    enough = (least > 0) & (shared >= F.greatest(F.lit(2), F.ceil(least / 2)))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | enough)


def rank_issues(found: DataFrame, id_col: str = "response_id") -> DataFrame:
    """Issues for the page in ``page_title``: those that name it or no page, all if none does."""
    named = F.coalesce(F.col("source_title"), F.lit("")) != ""
    hit = named & titles_match(F.col("source_title"), F.col("page_title"))
    rows = found.withColumns({"title_hit": hit, "fits": ~named | hit})
    response = Window.partitionBy(id_col)
    kept = rows.withColumn("any_fits", F.max("fits").over(response)).filter(F.col("fits") | ~F.col("any_fits"))
    grade = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    order = response.orderBy(grade.desc(), F.col("title_hit").desc(), F.col("title"), F.col("issue_index"))
    return kept.withColumn("rank", F.row_number().over(order)).drop("fits", "any_fits")


def suggestion_terms(keywords: Column, reason: Column, min_length: int, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased distinct keywords and reason words that are long enough."""
    words = F.concat(keywords, F.split(reason, "[^a-zA-Z0-9]+"))
    low = F.transform(words, lambda w: tx.web_strip(F.lower(w)))
    return F.array_distinct(
        F.filter(low, lambda w: (F.length(w) >= min_length) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    )


def uncovered_suggestions(found: DataFrame, pinned: DataFrame, basket_col: str = "basket_id") -> DataFrame:
    """Suggestions no pinned page of their basket mentions; pinned(basket_id, title, url)."""
    phrases = F.filter(
        F.transform("keywords", lambda k: tx.web_strip(F.lower(k))), lambda k: F.length(k) >= 5
    )
    words = suggestion_terms(F.col("keywords"), F.col("reason"), 5, rules.SUGGESTION_STOP_WORDS)
    keys = ["response_id", "suggestion_index"]
    asked = found.select(basket_col, *keys, F.array_distinct(F.concat(phrases, words)).alias("terms"))
    pages = pinned.select(basket_col, F.lower(F.concat_ws(" ", "title", "url")).alias("page"))
    hit = F.exists("terms", lambda w: F.contains(F.col("page"), w))
    covered = asked.join(pages, basket_col).filter(hit).select(*keys).distinct()
    return found.join(covered, keys, "left_anti")


def links_for_suggestions(
    found: DataFrame, links: DataFrame, basket_col: str = "basket_id", top: int = 3
) -> DataFrame:
    """Best links of the same basket per suggestion by number of terms they contain."""
    keywords = F.transform("keywords", F.lower)
    words = suggestion_terms(F.array().cast("array<string>"), F.col("reason"), 4)
    asked = found.select(
        basket_col, "response_id", "suggestion_index", F.array_distinct(F.concat(keywords, words)).alias("terms")
    )
    offered = links.select(
        basket_col, "link_no", "url", F.lower(F.concat_ws(" ", "title", "url", "context")).alias("haystack")
    )
    score = F.size(F.filter("terms", lambda w: F.contains(F.col("haystack"), w)))
    scored = asked.join(offered, basket_col).select(
        "response_id", "suggestion_index", "link_no", "url", score.alias("score")
    ).filter(F.col("score") > 0)
    best = Window.partitionBy("response_id", "suggestion_index").orderBy(F.desc("score"), "link_no")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


# --- keep-lists -------------------------------------------------------------------


def keep_list(replies: DataFrame, counts: DataFrame, max_keep: int = rules.PREFILTER_MAX_KEEP) -> DataFrame:
    """Valid ids of a keep-list reply: whole numbers in range, distinct, the first ``max_keep``.

    replies(query_id, text), counts(query_id, n_chunks); gives (query_id, keep_ids, reason).
    """
    body = F.from_json(json_object(F.col("text")), "keep_chunk_ids STRING, reason STRING")
    rows = replies.join(counts, "query_id").withColumn("b", body).withColumn(
        "raw", F.from_json("b.keep_chunk_ids", "ARRAY<STRING>")
    )
    limit = F.least(F.lit(max_keep), F.col("n_chunks"))
    # numbers lose their fraction
    number = F.transform(
        F.coalesce("raw", F.array().cast("array<string>")),
        lambda v: tx.strip(v).try_cast("double").try_cast("bigint"),
    )
    valid = F.array_distinct(F.filter(number, lambda n: n.between(1, F.col("n_chunks"))))
    reason = tx.strip(tx.text_of(F.col("b.reason")))
    note = (
        F.when(F.col("b").isNull(), F.lit(rules.PREFILTER_NOTES["unparsed"]))
        .when(F.col("raw").isNull(), tx.or_else(reason, F.lit(rules.PREFILTER_NOTES["missing"])))
        .otherwise(reason)
    )
    return rows.select("query_id", F.slice(valid, 1, limit).alias("keep_ids"), note.alias("reason"))


def apply_keep_list(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Chunks(query_id, position, ...) on the list; an unusable list keeps all, flagged."""
    rows = chunks.join(kept.select("query_id", "keep_ids"), "query_id", "left")
    usable = F.coalesce(F.size("keep_ids"), F.lit(0)) > 0
    return (
        rows.withColumn("fallback_used", ~usable)
        .filter(~usable | F.array_contains("keep_ids", F.col("position").cast("bigint")))
        .drop("keep_ids")
    )


def diversify(kept: DataFrame, chunks: DataFrame, plans: DataFrame, max_keep: int = rules.PREFILTER_MAX_KEEP) -> DataFrame:
    """Keep-lists of comparisons and critiques get a chunk of a second page.

    chunks(query_id, position, page_url), plans(query_id, mode, planner_mode).
    """
    listed = chunks.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "page_url"))), lambda c: c["page_url"]).alias("pages")
    )
    rows = kept.join(listed, "query_id").join(plans, "query_id")
    ids = F.col("keep_ids")
    used = F.array_distinct(F.transform(ids, lambda i: F.col("pages")[(i - 1).cast("int")]))
    only = F.get(used, F.lit(0))
    other = F.array_min(
        F.filter(
            F.transform("pages", lambda p, i: F.when(~F.coalesce(p == only, F.lit(False)), (i + 1).cast("bigint"))),
            lambda n: n.isNotNull(),
        )
    )
    compare = F.col("planner_mode").startswith("compare")
    wanted = compare | (F.col("mode") == "critique")
    needs = (
        wanted & (F.size("pages") > 1) & (F.size(F.array_distinct("pages")) > 1)
        & (F.size(used) < 2) & other.isNotNull()
    )
    limit = F.least(F.lit(max_keep), F.size("pages"))
    longer = F.concat(ids, F.array(other))
    swapped = F.concat(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.array(other))
    changed = F.when(F.size(ids) < limit, longer).otherwise(swapped)
    note = F.when(compare, rules.PREFILTER_NOTES["compare"]).otherwise(rules.PREFILTER_NOTES["critique"])
    return rows.select(
        "query_id",
        F.when(needs, F.slice(F.array_distinct(changed), 1, limit)).otherwise(ids).alias("keep_ids"),
        F.when(needs, note).alias("adjustment"),
    )
