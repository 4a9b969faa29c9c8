"""Checked queries: page normalisation, classification and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine import rules
from quillmine.checks import duck as d
from quillmine.checks.registry import checked
from quillmine.functions import text as tx
from quillmine.functions import urls
from quillmine.operators import pages as pg
from quillmine.sources import requests as rq


def raw_pages(t):
    return t.raw_pages.withColumn(
        "metadata", F.create_map(F.lit("context_role"), F.col("context_role"))
    )


FALLBACK = """CASE WHEN {u} = '' THEN 'Untitled page'
  WHEN regexp_extract({p}, '([^/]*)$', 1) <> '' THEN regexp_extract({p}, '([^/]*)$', 1)
  WHEN {h} <> '' THEN {h} ELSE {u} END"""


def fallback_title_sql(url: str) -> str:
    u = d.strip(f"coalesce({url}, '')")
    bare = f"regexp_replace(regexp_replace({u}, '[?#].*$', '', 's'), ';[^/]*$', '')"
    path = f"rtrim(regexp_replace({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/')"
    host = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return FALLBACK.format(u=u, p=path, h=host)


CLEAN_TYPE = f"""CASE WHEN lower({d.strip("coalesce(source_type, '')")}) = '' THEN {d.source_type('url')}
  WHEN lower({d.strip('source_type')}) IN ('confluence', 'jira', 'generic') THEN lower({d.strip('source_type')})
  ELSE 'generic' END"""


@checked("page_clean", f"""
SELECT doc_id, {d.strip("coalesce(url, '')")} AS url,
  CASE WHEN {d.strip("coalesce(title, '')")} <> '' THEN {d.strip('title')} ELSE {fallback_title_sql('url')} END AS title,
  md5({d.strip("coalesce(markdown, '')")}) AS markdown_md5, {CLEAN_TYPE} AS source_type
FROM {{raw_pages}}""")
def page_clean(t):
    return rq.clean_pages(raw_pages(t)).select(
        "doc_id", "url", "title", F.md5("markdown").alias("markdown_md5"), "source_type"
    )


@checked("page_source_type", f"SELECT doc_id, {d.source_type('url')} AS source_type FROM {{raw_pages}}")
def page_source_type(t):
    return t.raw_pages.select("doc_id", urls.source_type(F.col("url")).alias("source_type"))


@checked("html_page_type", """
SELECT doc_id, CASE
  WHEN contains(u, 'atlassian.net/wiki') OR contains(u, 'confluence.com') OR contains(u, '/pages/viewpage.action')
       OR regexp_matches(u, '(?i)wiki[.]') THEN 'confluence'
  WHEN contains(u, 'atlassian.net/browse') OR contains(u, 'jira.com') OR regexp_matches(u, '(?i)jira[.]')
       OR regexp_matches(u, '(?i)/browse/[A-Z]+-[0-9]+') THEN 'jira' ELSE 'generic' END AS page_type
FROM (SELECT doc_id, coalesce(url, '') AS u FROM {raw_pages})
UNION ALL
SELECT page_id + 1000000000, 'generic' FROM {pages}""")
def html_page_type(t):
    kind = urls.page_type(tx.text_of(F.col("url"))).alias("page_type")
    return t.raw_pages.select("doc_id", kind).union(
        t.pages.select(F.col("page_id") + 1000000000, kind)
    )


@checked("page_fallback_title", f"""
SELECT doc_id, {fallback_title_sql('url')} AS from_url,
  CASE WHEN {d.strip("coalesce(title, '')")} <> '' THEN {d.strip('title')} ELSE 'Page ' || CAST(doc_id + 1 AS VARCHAR) END AS numbered
FROM {{raw_pages}}""")
def page_fallback_title(t):
    title = tx.strip(tx.text_of(F.col("title")))
    return t.raw_pages.select(
        "doc_id",
        urls.fallback_title(F.col("url")).alias("from_url"),
        tx.or_else(title, F.concat(F.lit("Page "), (F.col("doc_id") + 1).cast("string"))).alias("numbered"),
    )


SLUG = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-')"
FALLBACK_URL = f"""CASE WHEN {d.strip("coalesce(url, '')")} <> '' THEN {d.strip('url')}
  ELSE 'local://' || CASE WHEN {SLUG} = '' THEN 'page-' || CAST(position AS VARCHAR) ELSE {SLUG} END
       || '-' || CAST(position AS VARCHAR) END"""


@checked("page_fallback_url", f"""
SELECT doc_id, {FALLBACK_URL} AS url FROM (SELECT *, doc_id + 1 AS position FROM {{raw_pages}})""")
def page_fallback_url(t):
    return t.raw_pages.select(
        "doc_id", rq.fallback_url(F.col("url"), F.col("title"), F.col("doc_id") + 1).alias("url")
    )


@checked("page_drop_blank", f"""
SELECT doc_id, position, {FALLBACK_URL} AS url,
  CASE WHEN {d.strip("coalesce(title, '')")} <> '' THEN {d.strip('title')} ELSE 'Page ' || CAST(position AS VARCHAR) END AS title,
  CAST(length({d.strip('markdown')}) AS BIGINT) AS n_chars
FROM (SELECT *, doc_id + 1 AS position FROM {{raw_pages}})
WHERE {d.strip("coalesce(markdown, '')")} <> ''""")
def page_drop_blank(t):
    rows = t.raw_pages.withColumn("position", F.col("doc_id") + 1)
    return rq.prepare_pages(rows).select(
        "doc_id", "position", "url", "title", F.length("markdown").alias("n_chars")
    )


@checked("page_canonical_url", f"""
SELECT page_no AS row_id, {d.canonical('page_url')} AS canonical_url FROM {{near_pages}}
UNION ALL SELECT doc_id + 1000000000, {d.canonical('url')} FROM {{raw_pages}}
UNION ALL SELECT page_id + 2000000000, {d.canonical('url')} FROM {{pages}}""")
def page_canonical_url(t):
    return (
        t.near_pages.select(F.col("page_no").alias("row_id"), urls.canonical_url(F.col("page_url")).alias("canonical_url"))
        .union(t.raw_pages.select(F.col("doc_id") + 1000000000, urls.canonical_url(F.col("url"))))
        .union(t.pages.select(F.col("page_id") + 2000000000, urls.canonical_url(F.col("url"))))
    )


@checked("page_content_sig", f"""
SELECT page_no, sha1({d.strip(d.collapse('lower(markdown)'))}) AS content_signature FROM {{near_pages}}""")
def page_content_sig(t):
    return t.near_pages.select("page_no", pg.content_signature(F.col("markdown")).alias("content_signature"))


@checked("page_heading_terms", f"""
SELECT s_suppkey AS id, array_to_string(list_sort({d.heading_terms('markdown')}), '|') AS terms FROM {{policy_pages}}
UNION ALL
SELECT doc_id + 1000000000, array_to_string(list_sort({d.heading_terms("'# ' || replace(markdown, chr(10), chr(10) || '## ')")}), '|') FROM {{doc_pages}}""")
def page_heading_terms(t):
    marked = F.concat(F.lit("# "), F.replace(F.col("markdown"), F.lit("\n"), F.lit("\n## ")))
    return t.policy_pages.select(
        F.col("s_suppkey").alias("id"), F.sort_array(pg.heading_terms(F.col("markdown"))).alias("terms")
    ).union(
        t.doc_pages.select(F.col("doc_id") + 1000000000, F.sort_array(pg.heading_terms(marked)))
    )


@checked("page_role", f"""
SELECT page_url, {d.page_role('title', 'page_url', 'markdown', 'source_type')} AS role FROM {{policy_pages}}
UNION ALL SELECT page_url, {d.page_role('title', 'page_url', 'markdown', 'source_type')} FROM {{doc_pages}}""")
def page_role(t):
    columns = ["title", "page_url", "markdown", "source_type"]
    both = t.policy_pages.select(*columns).union(t.doc_pages.select(*columns))
    return pg.with_role(both).select("page_url", "role")


@checked("page_context_role", f"""
SELECT doc_id, CASE WHEN lower({d.strip("coalesce(context_role, '')")}) IN ({d.words(rules.CONTEXT_ROLES)})
  THEN lower({d.strip('context_role')}) ELSE 'default' END AS context_role FROM {{raw_pages}}""")
def page_context_role(t):
    return raw_pages(t).select("doc_id", rq.context_role(F.col("metadata")).alias("context_role"))


@checked("query_mode", """SELECT query_id, mode FROM {turn_questions}""")
def query_mode(t):
    return t.turn_questions.select("query_id", rq.retrieval_mode(F.col("raw_mode")).alias("mode"))


def questions(t):
    """Turns plus a wording that some rules react to."""
    lead = (
        F.when(F.col("query_id") % 3 == 0, "What is the difference between these? ")
        .when(F.col("query_id") % 7 == 0, "See DOC-12 versus others. ")
        .otherwise("")
    )
    return t.turn_questions.select("query_id", "mode", F.concat(lead, "question").alias("question"))


QUESTIONS = """asked AS (SELECT query_id, mode, CASE WHEN query_id % 3 = 0 THEN 'What is the difference between these? '
  WHEN query_id % 7 = 0 THEN 'See DOC-12 versus others. ' ELSE '' END || question AS question FROM {turn_questions})"""
PLANNER = r"""planner AS (SELECT a.query_id, CASE WHEN f.anchored THEN 'compare-current-vs-pinned'
    WHEN f.cur AND mode = 'critique' THEN 'current-page-critique'
    WHEN f.cur AND mode = 'diagram' THEN 'current-page-diagram'
    WHEN f.cur THEN 'current-page-summary'
    WHEN mode = 'diagram' THEN 'diagram-synthesis' WHEN mode = 'critique' THEN 'critique-review'
    WHEN regexp_matches(lower(question), '\b(compare|difference|different|diff|versus|vs\.?)\b') THEN 'cross-doc-compare'
    WHEN coalesce(f.n, 0) <= 1 THEN 'single-doc-focus' ELSE 'multi-doc-synthesis' END AS planner_mode
  FROM asked a LEFT JOIN (SELECT query_id, bool_or(context_role = 'compare_anchor') AS anchored,
      bool_or(context_role = 'current_page') AS cur, count(*) AS n FROM {turn_basket} GROUP BY 1) f USING (query_id))"""


@checked("query_planner_mode", f"""WITH {QUESTIONS}, {PLANNER} SELECT query_id, planner_mode FROM planner""")
def query_planner_mode(t):
    return pg.planner_mode(questions(t), t.turn_basket).select("query_id", "planner_mode")


PROFILES = f"""features AS (SELECT page_url, title, source_type, length(markdown) AS size_chars,
    {d.page_role('title', 'page_url', 'markdown', 'source_type')} AS role,
    {d.canonical('page_url')} AS canonical_url, sha1({d.strip(d.collapse('lower(markdown)'))}) AS content_signature,
    {d.token_set('title')} AS title_terms, {d.heading_terms('markdown')} AS heading_terms,
    {d.token_set(d.canonical('page_url'))} AS url_terms FROM {{doc_pages}}),
  shares AS (SELECT b.query_id, b.page_url, b.original_index, b.context_role, f.title, f.source_type, f.role,
    f.canonical_url, f.content_signature, f.size_chars, a.mode, a.question, p.planner_mode,
    {d.overlap('a.terms', 'f.title_terms')} AS title_overlap, {d.overlap('a.terms', 'f.heading_terms')} AS heading_overlap,
    {d.overlap('a.terms', 'f.url_terms')} AS url_overlap
    FROM {{turn_basket}} b JOIN features f USING (page_url)
    JOIN (SELECT *, {d.token_set('question')} AS terms FROM asked) a ON a.query_id = b.query_id
    JOIN planner p ON p.query_id = b.query_id),
  profiles AS (SELECT *, greatest(0.80, least(1.35,
      {d.weight(rules.SOURCE_TYPE_WEIGHTS, 'mode', 'source_type')} * {d.weight(rules.DOCUMENT_ROLE_WEIGHTS, 'mode', 'role')}
      + title_overlap * 0.20 + heading_overlap * 0.12 + url_overlap * 0.06
      + CASE WHEN source_type = 'jira' AND regexp_extract(question, '\\b([A-Z]{{2,}}-[0-9]+)\\b', 1) <> ''
          AND contains(lower(title || ' ' || page_url), lower(regexp_extract(question, '\\b([A-Z]{{2,}}-[0-9]+)\\b', 1))) THEN 0.14 ELSE 0 END
      + CASE context_role WHEN 'compare_anchor' THEN 0.18 WHEN 'current_page' THEN 0.16 WHEN 'reference_context' THEN 0.03 ELSE 0 END
      + CASE WHEN original_index <> 0 THEN 0 WHEN planner_mode LIKE 'compare%' THEN 0.08
             WHEN planner_mode LIKE 'current-page%' THEN 0.06 ELSE 0 END))::DOUBLE AS priority FROM shares)"""


def profiles(t):
    def make():
        asked = questions(t)
        planner = pg.planner_mode(asked, t.turn_basket)
        return pg.page_profiles(asked, t.turn_basket, pg.page_features(t.doc_pages), planner)

    return t.once("profiles", make)


@checked("page_profile", f"""WITH {QUESTIONS}, {PLANNER}, {PROFILES}
SELECT query_id, page_url, role, context_role, title_overlap::DOUBLE AS title_overlap,
  round(heading_overlap::DOUBLE, 6) AS heading_overlap, round(url_overlap::DOUBLE, 6) AS url_overlap,
  canonical_url, content_signature FROM profiles""".replace("title_overlap::DOUBLE AS", "round(title_overlap::DOUBLE, 6) AS"))
def page_profile(t):
    return profiles(t).select(
        "query_id", "page_url", "role", "context_role", "title_overlap", "heading_overlap",
        "url_overlap", "canonical_url", "content_signature",
    )


@checked("page_priority", f"""WITH {QUESTIONS}, {PLANNER}, {PROFILES}
SELECT query_id, page_url, round(priority, 6) AS priority FROM profiles""")
def page_priority(t):
    return profiles(t).select("query_id", "page_url", "priority")


# Wordings the intent rules react to, spread over all turns.
INTENT_QUESTION = """CASE (conv_id + turn) % 12 WHEN 0 THEN 'Compare this page with the rest. ' WHEN 2 THEN 'Review this  document: '
  WHEN 4 THEN 'Draw a flow chart. ' WHEN 6 THEN 'What is in this ticket and the basket? ' WHEN 8 THEN 'Explain ' ELSE '' END
  || text || CASE (conv_id + turn) % 8 WHEN 0 THEN ' in the current spec' ELSE '' END"""


@checked("query_intent", f"""
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, {INTENT_QUESTION} AS question, 'Talk ' || CAST(conv_id AS VARCHAR) AS title
           FROM {{conversations}} WHERE role = 'user'),
low AS (SELECT *, lower(question) AS lq FROM q),
flags AS (SELECT *, CASE WHEN {d.contains_any('lq', rules.DIAGRAM_WORDS)} THEN 'diagram'
    WHEN {d.contains_any('lq', rules.CRITIQUE_WORDS)} THEN 'critique' ELSE 'answer' END AS kind,
  regexp_matches(lq, {d.q(rules.CURRENT_PAGE_REFERENCE_PATTERN)}) AND (regexp_matches(lq, {d.q(rules.COMPARE_PATTERN)})
    OR regexp_matches(lq, {d.q(rules.PINNED_REFERENCE_PATTERN)})) AS compared,
  {d.contains_any('lq', rules.CURRENT_ONLY_PHRASES)} OR {d.contains_any('lq', rules.CURRENT_PAGE_PHRASES)}
    OR regexp_matches(lq, {d.q(rules.CURRENT_PAGE_ACTION_PATTERN)}) AS scoped FROM low)
SELECT query_id, kind, CASE WHEN compared THEN 'compare-current-vs-pinned' WHEN scoped THEN 'current-only' ELSE 'default' END AS context_mode,
  CASE WHEN compared THEN 'compare-current-vs-pinned'
       WHEN scoped THEN CASE kind WHEN 'critique' THEN 'current-page-critique' WHEN 'diagram' THEN 'current-page-diagram' ELSE 'current-page-summary' END
       ELSE CASE kind WHEN 'critique' THEN 'critique-review' WHEN 'diagram' THEN 'diagram-synthesis' ELSE 'multi-doc-synthesis' END END AS planner_mode,
  CASE WHEN compared THEN 'Compare the current page titled "' || title || '" against the other pinned pages. Highlight agreements, contradictions, missing context, and the most important differences.' END AS rewritten_question
FROM flags""")
def query_intent(t):
    rows = t.conversations.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.expr(INTENT_QUESTION).alias("question"),
        F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"),
    )
    return rows.select("query_id", pg.query_intent(F.col("question"), F.col("title")).alias("i")).select("query_id", "i.*")


ROUTE_CURRENT = """CASE WHEN query_id % 6 = 5 THEN 'https://live.example.org/now'
  WHEN query_id % 11 = 0 THEN NULL ELSE page_url || '/?tab=1#s' END"""


@checked("basket_route", f"""
WITH intents AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'current-only' ELSE 'compare-current-vs-pinned' END AS context_mode FROM {{turn_questions}}),
cur AS (SELECT query_id, {ROUTE_CURRENT} AS current_url FROM {{turn_basket}} WHERE original_index = 0),
rows1 AS (SELECT b.query_id, b.page_url, b.original_index, i.context_mode, c.current_url,
   coalesce(regexp_replace(c.current_url, '/*([?#].*)?$', '') = regexp_replace(b.page_url, '/*([?#].*)?$', ''), false) AS is_cur
   FROM {{turn_basket}} b JOIN intents i USING (query_id) JOIN cur c ON c.query_id = b.query_id),
facts AS (SELECT query_id, any_value(context_mode) AS mode, max(current_url) AS current_url, bool_or(is_cur) AS pinned_cur,
   count(*) FILTER (NOT is_cur) AS others FROM rows1 GROUP BY 1)
SELECT r.query_id, r.page_url, CASE WHEN mode = 'default' OR f.current_url IS NULL THEN 'default'
     WHEN mode = 'current-only' OR others = 0 THEN 'current_page' WHEN is_cur THEN 'compare_anchor' ELSE 'reference_context' END AS context_role,
   CASE WHEN is_cur AND mode <> 'default' THEN -1 ELSE r.original_index END::BIGINT AS place
FROM rows1 r JOIN facts f USING (query_id)
WHERE mode = 'default' OR f.current_url IS NULL OR is_cur OR (mode = 'compare-current-vs-pinned' AND others > 0)
UNION ALL
SELECT query_id, current_url, CASE WHEN mode = 'current-only' OR others = 0 THEN 'current_page' ELSE 'compare_anchor' END, -1
FROM facts WHERE mode <> 'default' AND current_url IS NOT NULL AND NOT pinned_cur""")
def basket_route(t):
    mode = (
        F.when(F.col("query_id") % 3 == 0, "default")
        .when(F.col("query_id") % 3 == 1, "current-only")
        .otherwise("compare-current-vs-pinned")
    )
    intents = t.turn_questions.select("query_id", mode.alias("context_mode"))
    current = t.turn_basket.filter("original_index = 0").select("query_id", F.expr(ROUTE_CURRENT).alias("current_url"))
    return pg.route_basket(intents, t.turn_basket, current)


@checked("url_loose", """
SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS loose FROM {pages}
UNION ALL SELECT doc_id + 1000000000, regexp_replace(regexp_replace(page_url, '[?#].*$', ''), '/+$', '') FROM {doc_pages}""")
def url_loose(t):
    return t.pages.select("page_id", urls.loose_url(F.col("url")).alias("loose")).union(
        t.doc_pages.select(F.col("doc_id") + 1000000000, urls.loose_url(F.col("page_url")))
    )


@checked("query_input_limit", """
SELECT query_id, CAST(sum(length(p.markdown)) AS BIGINT) AS total_chars,
  CAST(floor(sum(length(p.markdown)) / 4) AS BIGINT) AS estimated_tokens, floor(sum(length(p.markdown)) / 4) > 6000 AS too_large
FROM {turn_basket} b JOIN {doc_pages} p USING (page_url) GROUP BY 1""")
def query_input_limit(t):
    sizes = t.doc_pages.select("page_url", F.length("markdown").alias("size_chars"))
    return pg.over_input_limit(t.turn_basket, sizes, limit=6000)
