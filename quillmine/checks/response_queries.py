"""Checked queries: stored responses, evidence, dedupe, basket, stores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmine import rules
from quillmine.checks import duck as d
from quillmine.checks.registry import checked
from quillmine.functions import text as tx
from quillmine.functions import urls
from quillmine.operators import basket as bk
from quillmine.operators import dedup as dd
from quillmine.operators import evidence as ev
from quillmine.operators import pages as pg
from quillmine.operators import responses as rs
from quillmine.operators import titles
from quillmine.session import shared_folder
from quillmine.sources import requests as rq
from quillmine.sources import stores as st
from quillmine.streaming import jobs as sj

# --- responses ----------------------------------------------------------------------

MESSAGE = """CASE p_partkey % 5 WHEN 0 THEN '{"content": "  ' || p_name || ' "}'
  WHEN 1 THEN '{"content": [{"type": "text", "text": "' || p_name || '"}, " second ", {"summary": [{"text": "' || p_type || '"}], "refusal": "no"}]}'
  WHEN 2 THEN '{"content": "", "additional_kwargs": {"output_text": "' || p_brand || '"}}'
  WHEN 3 THEN '{"content": [], "response_metadata": {"content": {"text": ["' || p_name || '", "' || p_brand || '"]}}}'
  ELSE '{"content": null}' END"""


@checked("resp_text", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name
  WHEN 1 THEN p_name || chr(10) || chr(10) || 'second' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || 'no'
  WHEN 2 THEN p_brand WHEN 3 THEN p_name || chr(10) || chr(10) || p_brand ELSE '' END AS text FROM {part}""")
def resp_text(t):
    return t.part.select("p_partkey", rs.response_text(F.expr(MESSAGE)).alias("text"))


JSON_WHOLE = f"""{d.strip(f"CASE WHEN regexp_matches(text, {d.q(rs.FENCED_JSON)}) THEN regexp_extract(text, {d.q(rs.FENCED_JSON)}, 1) ELSE text END")}"""
JSON_BRACES = r"regexp_extract(text, '\{[\s\S]*\}')"
OBJECT = f"""CASE WHEN json_valid({JSON_WHOLE}) THEN CASE WHEN {JSON_WHOLE} LIKE '{{%' THEN {JSON_WHOLE} END
  WHEN {JSON_BRACES} <> '' AND json_valid({JSON_BRACES}) THEN {JSON_BRACES} END"""


@checked("resp_json", f"SELECT response_id, {OBJECT} AS body FROM {{responses}}")
def resp_json(t):
    return t.responses.select("response_id", rs.json_object(F.col("text")).alias("body"))


def get(name):
    return d.strip(f"coalesce(i->>'{name}', '')")


ISSUES = f"""raw AS (SELECT response_id, unnest(items) AS i, generate_subscripts(items, 1) - 1 AS issue_index FROM (
   SELECT response_id, (CASE WHEN json_type(body, '$.issues') = 'ARRAY' THEN CAST(body->'$.issues' AS JSON[]) END)[1:5] AS items FROM (
     SELECT response_id, {OBJECT} AS body FROM {{responses}}) WHERE body IS NOT NULL)),
issues AS (SELECT response_id, issue_index, {get('title')} AS title,
   CASE WHEN lower({get('severity')}) IN ('high', 'medium', 'low') THEN lower({get('severity')}) ELSE 'medium' END AS severity,
   coalesce(nullif({get('category')}, ''), 'other') AS category, coalesce(nullif({get('evidence')}, ''), 'Not explicitly quoted.') AS evidence,
   {get('risk')} AS risk, {get('suggestion')} AS suggestion, nullif({get('source_title')}, '') AS source_title FROM raw
  WHERE json_type(i) = 'OBJECT' AND {get('title')} <> '' AND {get('risk')} <> '' AND {get('suggestion')} <> '')"""


@checked("resp_issues", f"WITH {ISSUES} SELECT * FROM issues")
def resp_issues(t):
    return rs.issues(t.responses)


BULLET = r"(?m)-\s+([^-]+?)\s+-\s+(.+?)$"
SUGGESTIONS = f"""bullets AS (SELECT response_id, text, unnest(a) AS topic, unnest(b) AS why, generate_subscripts(a, 1) - 1 AS suggestion_index,
   list_filter(list_transform(regexp_split_to_array(regexp_extract(text, '(?i)Keywords(?:\\s+to\\s+search)?:\\s*(.+?)(?:\\n|$)', 1), '[,;]'), lambda w: trim(w)), lambda w: w <> '') AS words
  FROM (SELECT response_id, text, regexp_extract_all(text, '{BULLET}', 1) AS a, regexp_extract_all(text, '{BULLET}', 2) AS b FROM {{responses}}
        WHERE contains(text, '💡') OR contains(text, 'Missing Information'))),
suggestions AS (SELECT response_id, suggestion_index, trim(topic) || ': ' || trim(why) AS reason, CASE WHEN len(words) > 0 THEN words ELSE [trim(topic)] END AS keywords,
  CASE WHEN regexp_matches(lower(topic || ' ' || why), 'version|update|specific') THEN 'high' WHEN length(trim(why)) > 30 THEN 'medium' ELSE 'low' END AS confidence FROM bullets)"""


@checked("resp_suggestions", f"WITH {SUGGESTIONS} SELECT response_id, suggestion_index, reason, array_to_string(keywords, '|') AS keywords, confidence FROM suggestions")
def resp_suggestions(t):
    return rs.suggestions(t.responses)


@checked("resp_strip_missing", r"""
SELECT response_id, CASE WHEN trim(cut, e' \n') <> '' THEN trim(cut, e' \n') ELSE trim(text, e' \n') END AS text FROM (
  SELECT response_id, text, regexp_replace(regexp_replace(text, '\n?---\s*\n?💡[\s\S]*', ''), '\n?💡\s*\*\*Missing Information:\*\*[\s\S]*', '') AS cut FROM {responses})""")
def resp_strip_missing(t):
    return t.responses.select("response_id", rs.strip_missing(F.col("text")).alias("text"))


DIAGRAM = r"""diagram AS (SELECT response_id, text, CASE WHEN regexp_matches(text, '(?i)```mermaid') THEN trim(regexp_extract(text, '(?i)```mermaid\s*([\s\S]+?)```', 1), e' \n')
  WHEN regexp_matches(trim(text, e' \n'), '^(sequenceDiagram|flowchart|graph|classDiagram|stateDiagram|erDiagram|journey|gantt|pie|mindmap|timeline)')
  THEN trim(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: rtrim(s)), lambda s: s <> ''), chr(10)), e' \n') END AS code FROM {responses})"""


@checked("resp_diagram", rf"""WITH {DIAGRAM} SELECT response_id, code, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '(?i)```mermaid\s*[\s\S]+?```', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), e' \n'), ''),
  'Generated diagram based on the most relevant retrieved context.') AS summary FROM diagram""".replace("{{3,}}", "{3,}"))
def resp_diagram(t):
    return t.responses.select(
        "response_id", rs.diagram_code(F.col("text")).alias("code"), rs.diagram_summary(F.col("text")).alias("summary")
    )


@checked("resp_diagram_check", f"""WITH {DIAGRAM}, k AS (SELECT response_id, code, coalesce(nullif(regexp_extract(coalesce(code, ''),
   '^(sequenceDiagram|flowchart|graph|classDiagram|stateDiagram|erDiagram|journey|gantt|pie|mindmap|timeline)', 1), ''), 'unknown') AS kind FROM diagram)
SELECT response_id, kind, kind <> 'unknown' AND len(list_filter(string_split(code, chr(10)), lambda s: trim(s) <> '')) >= 2 AND NOT contains(code, '```') AS valid FROM k""")
def resp_diagram_check(t):
    code = rs.diagram_code(F.col("text"))
    return t.responses.select("response_id", rs.diagram_type(code).alias("kind"), rs.diagram_valid(code).alias("valid"))


METADATA = """CASE l_orderkey % 4 WHEN 0 THEN '{"response_metadata": {"total_duration": ' || CAST(l_partkey * 1000000 AS VARCHAR(20)) || ', "inner": [{"load_duration": ' || CAST(l_suppkey * 1000000 AS VARCHAR(20)) || '}]}, "additional_kwargs": {"prompt_eval_duration": 2000000}}'
  WHEN 1 THEN '{"additional_kwargs": {"x": {"ttft_ms": ' || CAST(l_partkey AS VARCHAR(20)) || '}}, "total_duration": 5}'
  WHEN 2 THEN '{"response_metadata": {"total_duration": "none", "eval_duration": ' || CAST(l_suppkey * 3000000 AS VARCHAR(20)) || '}}' ELSE '{}' END"""


@checked("resp_latency", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN k = 1 THEN 'provider-ttft' WHEN k = 0 THEN 'ollama-provider' ELSE 'wall-clock' END AS timing_source,
  CASE k WHEN 0 THEN l_suppkey + 2 WHEN 1 THEN l_partkey END AS ttft_ms, CASE WHEN k = 0 THEN l_partkey END AS provider_total_latency_ms,
  CASE WHEN k = 2 THEN l_suppkey * 3 END AS provider_eval_latency_ms, CASE WHEN k = 0 THEN l_suppkey END AS provider_load_latency_ms,
  CASE WHEN k = 0 THEN 2::BIGINT END AS provider_prompt_eval_latency_ms FROM (SELECT *, l_orderkey % 4 AS k FROM {{lineitem}})""")
def resp_latency(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", rs.latency_metrics(F.expr(METADATA)).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.*")


# --- issues and suggestions against pages ----------------------------------------------


def plain_title(x):
    return f"""trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[\\[\\]()"'':]', ' ', 'g'), '\\s+', ' ', 'g'))"""


def title_hit(a, b):
    pa, pb = plain_title(a), plain_title(b)
    wa, wb = f"list_distinct({d.word_tokens(pa, 3, rules.TITLE_STOP_WORDS)})", d.word_tokens(pb, 3, rules.TITLE_STOP_WORDS)
    return f"""({pa} <> '' AND {pb} <> '' AND (contains({pa}, {pb}) OR contains({pb}, {pa}) OR (len({wa}) > 0 AND len({wb}) > 0
      AND len(list_filter({wb}, lambda w: list_contains({wa}, w))) >= greatest(2, ceil(least(len({wa}), len({wb})) / 2)))))"""


@checked("title_match", f"SELECT response_id, issue_index, {title_hit('source_title', 'page_title')} AS hit FROM {{issue_rows}}")
def title_match(t):
    hit = rs.titles_match(F.col("source_title"), F.col("page_title"))
    return t.issue_rows.select("response_id", "issue_index", hit.alias("hit"))


@checked("title_join", f"""WITH a AS (SELECT DISTINCT source_title FROM {{issue_rows}}), b AS (SELECT DISTINCT page_title FROM {{issue_rows}})
SELECT source_title, page_title FROM a JOIN b ON {title_hit('source_title', 'page_title')}""")
def title_join(t):
    """Two tables of titles: those that issues name, and those of the pages."""
    named, pages = (t.issue_rows.select(c).distinct() for c in ("source_title", "page_title"))
    return titles.join_titles(named.select("source_title", F.col("source_title").alias("a")), pages.select("page_title", F.col("page_title").alias("b")),
                              "source_title", "a", "page_title", "b")


@checked("issue_rank", f"""
WITH h AS (SELECT *, coalesce(source_title, '') <> '' AND {title_hit('source_title', 'page_title')} AS hit FROM {{issue_rows}}),
f AS (SELECT *, coalesce(source_title, '') = '' OR hit AS fits, bool_or(coalesce(source_title, '') = '' OR hit) OVER (PARTITION BY response_id) AS some_fit FROM h)
SELECT response_id, issue_index, severity, hit AS title_hit, row_number() OVER (PARTITION BY response_id
  ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, hit DESC, title, issue_index) AS rank FROM f WHERE fits OR NOT some_fit""")
def issue_rank(t):
    return rs.rank_issues(t.issue_rows).select("response_id", "issue_index", "severity", "title_hit", "rank")


PINS = """(SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS basket_id, p_partkey AS link_no, 'Guide to ' || p_type AS title,
  'https://kb.example.org/' || replace(p_name, ' ', '-') || '/' || CAST(p_partkey AS VARCHAR(20)) AS url,
  'more about ' || p_brand || ' and limits' AS context FROM {part} WHERE p_size > 25)"""


def pins(t):
    return t.spark.sql("SELECT * FROM " + PINS.replace("{part}", t._sql("part")))


def based(df):
    return df.withColumn("basket_id", F.floor(F.col("response_id") / 10))


TERMS5 = f"""list_filter(list_transform(keywords || regexp_split_to_array(reason, '[^a-zA-Z0-9]+'), lambda w: lower(trim(w))),
  lambda w: length(w) >= 5 AND w NOT IN ({d.words(rules.SUGGESTION_STOP_WORDS)}))"""


@checked("suggest_exclude_covered", f"""WITH {SUGGESTIONS}
SELECT response_id, suggestion_index FROM (SELECT *, {TERMS5} || list_filter(list_transform(keywords, lambda w: lower(trim(w))), lambda w: length(w) >= 5) AS terms FROM suggestions) s
WHERE NOT EXISTS (SELECT 1 FROM {PINS} p, (SELECT unnest(s.terms) AS term) x WHERE p.basket_id = floor(s.response_id / 10) AND contains(lower(p.title || ' ' || p.url), x.term))""")
def suggest_exclude_covered(t):
    return rs.uncovered_suggestions(based(rs.suggestions(t.responses)), pins(t)).select("response_id", "suggestion_index")


@checked("suggest_match_links", f"""WITH {SUGGESTIONS}, s AS (SELECT response_id, suggestion_index, list_distinct(list_transform(keywords, lambda w: lower(w))
    || list_transform(list_filter(regexp_split_to_array(reason, '[^a-zA-Z0-9]+'), lambda w: length(w) >= 4), lambda w: lower(w))) AS terms FROM suggestions),
m AS (SELECT s.response_id, s.suggestion_index, p.link_no, p.url, len(list_filter(s.terms, lambda w: contains(lower(p.title || ' ' || p.url || ' ' || p.context), w))) AS score
  FROM s JOIN {PINS} p ON p.basket_id = floor(s.response_id / 10))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id, suggestion_index ORDER BY score DESC, link_no) AS rank FROM m WHERE score > 0) WHERE rank <= 3""")
def suggest_match_links(t):
    return rs.links_for_suggestions(based(rs.suggestions(t.responses)), pins(t))


# Keep-list replies: one per policy question.
REPLY = """CASE query_id % 5 WHEN 0 THEN '{"keep_chunk_ids": [3, 1, 3, 99, "2", "x"], "reason": " short "}'
  WHEN 1 THEN 'Sure: {"keep_chunk_ids": [4, 5, 6, 7, 8], "reason": ""}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"reason": "lost"}' ELSE '{"keep_chunk_ids": [2]}' END"""


def replies(t):
    return t.policy_chunks.select("query_id").distinct().withColumn("text", F.expr(REPLY))


def counts(t):
    return t.policy_chunks.groupBy("query_id").agg(F.count("*").alias("n_chunks"))


KEPT = """kept AS (SELECT query_id, list_filter(CASE query_id % 5 WHEN 0 THEN [3, 1, 2] WHEN 1 THEN [4, 5, 6, 7] WHEN 4 THEN [2] ELSE []::INTEGER[] END, lambda i: i <= n)::BIGINT[] AS keep_ids,
   CASE query_id % 5 WHEN 0 THEN 'short' WHEN 2 THEN 'Local prefilter did not return parseable JSON.' WHEN 3 THEN 'lost' ELSE '' END AS reason
  FROM (SELECT query_id, count(*) AS n FROM {policy_chunks} GROUP BY 1))"""


@checked("prefilter_keep", f"""WITH {KEPT} SELECT c.query_id, c.position, k.reason, len(k.keep_ids) = 0 AS fallback_used
FROM (SELECT query_id, position + 1 AS position FROM {{policy_chunks}}) c JOIN kept k USING (query_id) WHERE len(k.keep_ids) = 0 OR list_contains(k.keep_ids, c.position)""")
def prefilter_keep(t):
    kept = rs.keep_list(replies(t), counts(t))
    chunks = t.policy_chunks.withColumn("position", F.col("position") + 1)
    rows = rs.apply_keep_list(chunks, kept).join(kept.select("query_id", "reason"), "query_id")
    return rows.select("query_id", "position", "reason", "fallback_used")


# Two chunks per page, so a keep-list can sit on one page.
SIDES = "SELECT query_id, position + 1 AS position, 'p' || CAST(CAST(floor(position / 2) AS BIGINT) AS VARCHAR(20)) AS page_url FROM {policy_chunks}"
PICK = "CASE query_id % 4 WHEN 0 THEN {open}1, 2{close} WHEN 1 THEN {open}3, 4{close} WHEN 2 THEN {open}1, 3{close} ELSE {open}2{close} END"


@checked("prefilter_diversity", f"""WITH k AS (SELECT query_id, {PICK.format(open='[', close=']')} AS ids, count(*) AS n,
    query_id % 3 AS kind, query_id % 2 AS small FROM {{policy_chunks}} GROUP BY 1)
SELECT query_id, array_to_string(CASE WHEN kind = 2 OR query_id % 4 = 2 THEN ids WHEN query_id % 4 = 0 THEN [1, 3] WHEN query_id % 4 = 1 THEN [3, 1] ELSE [2, 3] END, '|') AS keep_ids,
  CASE WHEN kind = 2 OR query_id % 4 = 2 THEN NULL WHEN kind = 0 THEN {d.q(rules.PREFILTER_NOTES['compare'])} ELSE {d.q(rules.PREFILTER_NOTES['critique'])} END AS adjustment FROM k""")
def prefilter_diversity(t):
    chunks = t.spark.sql(SIDES.replace("{policy_chunks}", t._sql("policy_chunks")))
    base = chunks.select("query_id").distinct()
    kept = base.withColumn("keep_ids", F.expr(PICK.format(open="array(", close=")")).cast("array<bigint>"))
    plans = base.select(
        "query_id", F.expr("CASE query_id % 3 WHEN 1 THEN 'critique' ELSE 'answer' END").alias("mode"),
        F.expr("CASE query_id % 3 WHEN 0 THEN 'compare-current-vs-pinned' ELSE 'critique-review' END").alias("planner_mode"),
    )
    rows = rs.diversify(kept, chunks, plans, max_keep=2)
    return rows.select("query_id", F.col("keep_ids").cast("array<string>").alias("keep_ids"), "adjustment")


# --- evidence ---------------------------------------------------------------------------


def clean(x):
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), '[“”‘’`]', '\"', 'g'))"


BARE = """regexp_replace(regexp_replace(evidence, '^[\\s"''`-]+|[\\s"''`-]+$', '', 'g'), '(?i)\\b(paraphrased|paraphrase|approx\\.?|approximately)\\b:?', '', 'g')"""


def head_words(x, least, n):
    w = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return f"CASE WHEN len({w}) >= {least} THEN [array_to_string(({w})[1:{n}], ' ')] ELSE [] END"


FOUND = f"""list_filter(list_transform(regexp_extract_all(evidence, '["“](.+?)["”]', 1), lambda c: {clean('c')}), lambda c: length(c) >= 18)
  || CASE WHEN length(e) >= 18 THEN [e] ELSE [] END || CASE WHEN length(t) >= 12 THEN [t] ELSE [] END
  || CASE WHEN t <> '' AND e <> '' THEN [substr(t || '. ' || e, 1, 220)] ELSE [] END
  || list_filter(list_transform(regexp_split_to_array(e, '\\.\\s+|\\n+|•'), lambda c: {clean('c')}), lambda c: length(c) >= 24)
  || CASE WHEN length(r) >= 24 THEN [r] ELSE [] END || CASE WHEN length(s) >= 24 THEN [s] ELSE [] END
  || {head_words('e', 8, 12)} || {head_words('e', 14, 18)} || {head_words('t', 3, 8)}"""
CANDIDATES = f"""parts AS (SELECT response_id, issue_index, severity, title, evidence, risk, suggestion, {clean(BARE)} AS e, {clean('title')} AS t, {clean('risk')} AS r, {clean('suggestion')} AS s FROM {{issue_rows}}),
found AS (SELECT response_id, issue_index, {FOUND} AS cs FROM parts),
candidates AS (SELECT response_id, issue_index, candidate, row_number() OVER (PARTITION BY response_id, issue_index ORDER BY length(candidate) DESC, i) - 1 AS candidate_rank FROM (
  SELECT response_id, issue_index, candidate, min(i) AS i FROM (SELECT response_id, issue_index, unnest(cs) AS candidate, generate_subscripts(cs, 1) AS i FROM found) GROUP BY 1, 2, 3))"""
EXACT = """exact AS (SELECT * FROM (SELECT c.response_id, c.issue_index, c.candidate_rank, b.block_index, strpos(b.hay, lower(c.candidate)) - 1 AS "offset",
    row_number() OVER (PARTITION BY c.response_id, c.issue_index ORDER BY c.candidate_rank, b.block_index) AS rn
  FROM candidates c JOIN (SELECT response_id, block_index, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hay FROM {text_blocks}) b
    ON b.response_id = c.response_id AND length(c.candidate) >= 18 AND contains(b.hay, lower(c.candidate))) WHERE rn = 1)"""


@checked("evidence_candidates", f"WITH {CANDIDATES} SELECT * FROM candidates")
def evidence_candidates(t):
    return ev.candidates(t.issue_rows)


def exact(t):
    return ev.exact_matches(ev.candidates(t.issue_rows), t.text_blocks)


@checked("evidence_exact", f"""WITH {CANDIDATES}, {EXACT} SELECT response_id, issue_index, candidate_rank, CAST(block_index AS BIGINT) AS block_index, "offset" FROM exact""")
def evidence_exact(t):
    return exact(t).select("response_id", "issue_index", "candidate_rank", "block_index", "offset")


# Greedy use of blocks in issue order: three issues, so three steps.
CORPUS = f"array_to_string(list_filter([{clean('title')}, {clean('evidence')}, {clean('risk')}, {clean('suggestion')}], lambda p: p <> ''), '. ')"
# Only issues without an exact match are searched.
FUZZY = f"""asked AS (SELECT response_id, issue_index, list_distinct({d.word_tokens(CORPUS)}) AS tokens FROM {{issue_rows}}
  WHERE (response_id, issue_index) NOT IN (SELECT (response_id, issue_index) FROM exact)),
blocks AS (SELECT response_id, block_index, length({clean('text')}) AS n_chars, list_distinct({d.word_tokens(clean('text'))}) AS tokens FROM {{text_blocks}}),
scored AS (SELECT *, m / n + m * 0.03::DOUBLE - greatest(0, n_chars - 320) / 2000 AS score FROM (
  SELECT a.response_id, a.issue_index, b.block_index, b.n_chars, len(a.tokens) AS n, len(list_intersect(a.tokens, b.tokens)) AS m
  FROM asked a JOIN blocks b USING (response_id) WHERE len(a.tokens) >= 3 AND len(b.tokens) >= 4 AND b.n_chars BETWEEN 24 AND 900)
  WHERE m >= CASE WHEN n >= 10 THEN 4 ELSE 2 END AND m / n + m * 0.03::DOUBLE - greatest(0, n_chars - 320) / 2000 >= 0.24),
f1 AS (SELECT response_id, arg_min(block_index, (-score, block_index)) AS block_index, max(score) AS score FROM scored WHERE issue_index = 1 GROUP BY 1),
f2 AS (SELECT s.response_id, arg_min(s.block_index, (-s.score, s.block_index)) AS block_index, max(s.score) AS score FROM scored s LEFT JOIN f1 USING (response_id)
  WHERE s.issue_index = 2 AND s.block_index IS DISTINCT FROM f1.block_index GROUP BY 1),
f3 AS (SELECT s.response_id, arg_min(s.block_index, (-s.score, s.block_index)) AS block_index, max(s.score) AS score FROM scored s LEFT JOIN f1 USING (response_id) LEFT JOIN f2 USING (response_id)
  WHERE s.issue_index = 3 AND s.block_index IS DISTINCT FROM f1.block_index AND s.block_index IS DISTINCT FROM f2.block_index GROUP BY 1)"""


MATCHES = f"""{CANDIDATES}, {EXACT}, {FUZZY},
matches AS (SELECT response_id, CAST(issue_index AS BIGINT) AS issue_index, CAST(block_index AS BIGINT) AS block_index, 'exact' AS method FROM exact
  UNION ALL SELECT response_id, 1, block_index, 'fuzzy' FROM f1 UNION ALL SELECT response_id, 2, block_index, 'fuzzy' FROM f2
  UNION ALL SELECT response_id, 3, block_index, 'fuzzy' FROM f3)"""


@checked("evidence_fuzzy", f"WITH {MATCHES} SELECT response_id, issue_index, block_index, method FROM matches")
def evidence_fuzzy(t):
    """Exact matches, and fuzzy ones for the issues that have none."""
    return ev.evidence_matches(t.issue_rows, t.text_blocks)


@checked("evidence_summary", f"""WITH {MATCHES}
SELECT i.response_id, count(*) AS total_issues, count(m.method) AS matched_issues, count(m.method) FILTER (severity = 'high') AS matched_high,
  count(m.method) FILTER (severity = 'medium') AS matched_medium, count(m.method) FILTER (severity = 'low') AS matched_low
FROM {{issue_rows}} i LEFT JOIN matches m USING (response_id, issue_index) GROUP BY 1""")
def evidence_summary(t):
    return ev.evidence_summary(t.issue_rows, ev.evidence_matches(t.issue_rows, t.text_blocks))


# --- dedupe -------------------------------------------------------------------------------

NEAR = f"""near AS (SELECT *, {d.canonical('page_url')} AS canonical_url, sha1({d.strip(d.collapse('lower(markdown)'))}) AS content_signature,
  1.0 + CAST(page_no % 3 AS DOUBLE) / 10 AS priority, CAST(length(markdown) AS BIGINT) AS size_chars FROM {{near_pages}}),
walkable AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, size_chars DESC, original_index) AS step FROM near)"""
GREEDY = """walk AS (SELECT query_id, 0::BIGINT AS step, []::VARCHAR[] AS us, []::VARCHAR[] AS cs, []::VARCHAR[] AS outs FROM walkable GROUP BY 1
  UNION ALL SELECT w.query_id, w.step + 1, CASE WHEN p.outcome = 'kept' AND p.u <> '' THEN list_append(w.us, p.u) ELSE w.us END,
    CASE WHEN p.outcome = 'kept' THEN list_append(w.cs, p.c) ELSE w.cs END, list_append(w.outs, p.outcome)
  FROM (SELECT v.query_id, v.step, n.canonical_url AS u, n.content_signature AS c, CASE WHEN n.canonical_url <> '' AND list_contains(v.us, n.canonical_url) THEN 'duplicate URL'
      WHEN list_contains(v.cs, n.content_signature) THEN 'duplicate content' ELSE 'kept' END AS outcome
    FROM walk v JOIN walkable n ON n.query_id = v.query_id AND n.step = v.step + 1) p JOIN walk w ON w.query_id = p.query_id AND w.step = p.step),
outcomes AS (SELECT n.*, w.outs[n.step] AS outcome FROM walkable n JOIN (SELECT query_id, arg_max(outs, step) AS outs FROM walk GROUP BY 1) w USING (query_id))"""


def near_profiles(t):
    return t.near_pages.select(
        "query_id", "original_index", F.col("page_no").alias("page_id"), "page_url", "title", "source_type",
        urls.canonical_url(F.col("page_url")).alias("canonical_url"),
        pg.content_signature(F.col("markdown")).alias("content_signature"),
        (1.0 + (F.col("page_no") % 3).cast("double") / 10).alias("priority"),
        F.length("markdown").alias("size_chars"), F.lit("generic").alias("role"),
    )


@checked("page_dedup_greedy", f"WITH RECURSIVE {NEAR}, {GREEDY} SELECT query_id, page_no, outcome FROM outcomes")
def page_dedup_greedy(t):
    return dd.dedup_basket(near_profiles(t)).select("query_id", F.col("page_id").alias("page_no"), "outcome")


@checked("page_dedup_greedy_rounds", f"WITH RECURSIVE {NEAR}, {GREEDY} SELECT query_id, page_no FROM outcomes WHERE outcome = 'kept'")
def page_dedup_greedy_rounds(t):
    """The form for groups of any size, on the same rows."""
    return dd.dedup_rounds(near_profiles(t), "query_id").select("query_id", F.col("page_id").alias("page_no"))


STAT_LABEL = f"{d.shorten('title', 48)} || ' [generic/' || source_type || '] (' || outcome || ')'"


@checked("page_dedup_stats", f"""WITH RECURSIVE {NEAR}, {GREEDY},
kinds AS (SELECT query_id, string_agg(source_type || ':' || CAST(n AS VARCHAR), ', ' ORDER BY source_type) AS s FROM (SELECT query_id, source_type, count(*) AS n FROM outcomes WHERE outcome = 'kept' GROUP BY 1, 2) GROUP BY 1),
gone AS (SELECT query_id, string_agg({STAT_LABEL}, '; ' ORDER BY step) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step) AS n FROM outcomes WHERE outcome <> 'kept') WHERE n <= 3 GROUP BY 1)
SELECT o.query_id, count(*) AS input_pages, count(*) FILTER (outcome = 'kept') AS prepared_pages, count(*) FILTER (outcome <> 'kept') AS deduped_pages,
  count(*) FILTER (outcome = 'duplicate URL') AS deduped_by_url, count(*) FILTER (outcome = 'duplicate content') AS deduped_by_content,
  count(*) FILTER (outcome = 'kept' AND priority >= 1.12) AS high_priority_pages, any_value(k.s) AS source_diversity_summary, coalesce(any_value(g.s), '') AS ignored_pages_summary
FROM outcomes o JOIN kinds k USING (query_id) LEFT JOIN gone g ON g.query_id = o.query_id GROUP BY 1""")
def page_dedup_stats(t):
    return dd.dedup_stats(dd.dedup_basket(near_profiles(t)))


# --- basket, stores, bench ------------------------------------------------------------------


@checked("basket_filter", """SELECT id FROM {pinned} WHERE contains(lower(title || ' ' || url || ' ' || regexp_extract(url, '://([^/]*)', 1)), 'src1')""")
def basket_filter(t):
    return bk.matching_pages(t.pinned, " SRC1 ").select("id")


@checked("basket_by_host", """SELECT regexp_extract(url, '://([^/]*)', 1) AS host, id, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY doc_id) AS place,
  count(*) OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1)) AS host_pages FROM {pinned}""")
def basket_by_host(t):
    return bk.pages_by_host(t.pinned, "doc_id").select("host", "id", "place", "host_pages")


CHANGES = "SELECT 'https://example.org/u/' || CAST(user_id AS VARCHAR(20)) || '/' || event_type AS url, ts, event_id FROM {events}"


@checked("basket_toggle", f"SELECT url, arg_max(event_id, (ts, event_id)) AS event_id FROM ({CHANGES}) GROUP BY 1 HAVING count(*) % 2 = 1")
def basket_toggle(t):
    changes = t.spark.sql(CHANGES.replace("{events}", t._sql("events")))
    return bk.toggled_pages(changes, payload=("event_id",)).select("url", "event_id")


STORE = """SELECT CASE event_id % 6 WHEN 0 THEN 'fetched_' WHEN 1 THEN 'discovered_links_' WHEN 2 THEN 'page_' WHEN 3 THEN 'diagram_cache_' WHEN 4 THEN 'settings_' ELSE 'pinnedPages' END
  || CASE event_id % 6 WHEN 5 THEN '' ELSE CAST(event_id AS VARCHAR(20)) END AS key, event_id FROM {events}"""


@checked("basket_purge", f"""WITH s AS ({STORE})
SELECT 'cache' AS mode, event_id FROM s WHERE NOT regexp_matches(key, '^(fetched_|discovered_links_|diagram_cache_)')
UNION ALL SELECT 'all', event_id FROM s WHERE key LIKE 'settings%'
UNION ALL SELECT 'removed', count(*) FROM s WHERE regexp_matches(key, '^(fetched_|discovered_links_|diagram_cache_)')""")
def basket_purge(t):
    store = t.spark.sql(STORE.replace("{events}", t._sql("events")))
    cache, removed = bk.purge(store, "cache")
    everything, _ = bk.purge(store, "all")
    return (
        cache.select(F.lit("cache").alias("mode"), "event_id")
        .union(everything.select(F.lit("all"), "event_id"))
        .union(removed.select(F.lit("removed"), "removed_count"))
    )


@checked("bench_summary", """
SELECT label, CAST(floor(avg(client_ms) + 0.5) AS BIGINT) AS client_ms, CAST(floor(avg(nullif(server_ms, 0)) + 0.5) AS BIGINT) AS server_ms,
  CAST(floor(avg(nullif(retrieval_ms, 0)) + 0.5) AS BIGINT) AS retrieval_ms, CAST(floor(avg(nullif(generation_ms, 0)) + 0.5) AS BIGINT) AS generation_ms,
  CAST(floor(avg(nullif(ttft_ms, 0)) + 0.5) AS BIGINT) AS ttft_ms, arg_max(provider, run) AS provider FROM {bench_runs} GROUP BY 1""")
def bench_summary(t):
    return bk.bench_summary(t.bench_runs)


@checked("store_pinned", f"""SELECT p.id, p.url, {d.source_type('p.url')} AS source_type, md5({d.web_strip('c.markdown')}) AS markdown_md5
FROM {{pinned}} p JOIN {{pinned_content}} c USING (id) WHERE {d.web_strip('c.markdown')} <> ''""")
def store_pinned(t):
    return st.pinned_pages(t.pinned, t.pinned_content).select("id", "url", "source_type", F.md5("markdown").alias("markdown_md5"))


def fresh_table(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@checked("sink_pinned_append", """SELECT url, title FROM {pinned} UNION ALL
SELECT page_url, title FROM {doc_pages} WHERE page_url NOT IN (SELECT url FROM {pinned})""")
def sink_pinned_append(t):
    """The table after the append, read back."""
    path = fresh_table(t, "pinned")
    st.append(t.pinned.select("url", "title"), path)
    fetched = t.doc_pages.select(F.col("page_url").alias("url"), "title")
    st.append(st.new_pins(t.spark.read.parquet(path), fetched), path)
    return t.spark.read.parquet(path)


SIG = f"sha1({d.strip(d.collapse('lower(markdown)'))})"


@checked("sink_corpus_cache", f"""SELECT {SIG} AS content_signature, min(page_url) AS page_url FROM {{near_pages}}
WHERE {SIG} NOT IN (SELECT {SIG} FROM {{doc_pages}} WHERE source_type = 'confluence') GROUP BY 1""")
def sink_corpus_cache(t):
    """Pages whose text is new, one per text, also where texts share a URL."""
    known = t.doc_pages.filter("source_type = 'confluence'").select(pg.content_signature(F.col("markdown")).alias("content_signature"))
    path = fresh_table(t, "corpus")
    st.append(known, path)
    pages = t.near_pages.select("page_url", "markdown")
    return st.unseen_pages(pages, t.spark.read.parquet(path)).select("content_signature", "page_url")


# Some requests repeat their pages often enough to break the page limit.
REQUEST_PAGES = """SELECT b.*, p.markdown, k, row_number() OVER (PARTITION BY query_id ORDER BY k, original_index) AS position,
  count(*) OVER (PARTITION BY query_id) AS n_pages FROM {turn_basket} b JOIN {doc_pages} p USING (page_url), (SELECT unnest([0, 1, 2, 3]) AS k) r
WHERE k = 0 OR query_id % 5 = 0"""


@checked("src_requests_json", f"""
SELECT b.query_id, {d.strip('q.question')} AS question, q.mode, b.position, 'T' || CAST(b.original_index AS VARCHAR) AS title, b.page_url AS url, md5({d.strip('b.markdown')}) AS markdown_md5,
  CASE b.original_index % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'generic' ELSE {d.source_type('b.page_url')} END AS source_type, b.context_role, b.n_pages > 20 AS rejected
FROM ({REQUEST_PAGES}) b JOIN {{turn_questions}} q USING (query_id)""")
def src_requests_json(t):
    """Requests rebuilt as JSON with the key aliases clients send, then parsed."""
    page = F.to_json(F.struct(
        F.concat(F.lit(" T"), F.col("original_index").cast("string")).alias("title"), F.col("page_url").alias("url"),
        "markdown",
        F.when(F.col("original_index") % 3 == 0, " JIRA").alias("source_type"),
        F.when(F.col("original_index") % 3 == 1, "blog").alias("sourceType"),
        F.struct("context_role").alias("metadata"),
    ))
    copies = F.when(F.col("query_id") % 5 == 0, F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0)))
    rows = t.turn_basket.join(t.doc_pages.select("page_url", "markdown"), "page_url").withColumn("k", F.explode(copies))
    grouped = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("k", "original_index", page.alias("p")))).alias("x"))
    body = F.concat(
        F.lit('{"pages": ['), F.array_join(F.transform("x", lambda s: s["p"]), ", "), F.lit('], '),
        F.expr("substring(to_json(named_struct('userQuestion', question, 'mode', raw_mode)), 2)"),
    )
    requests = grouped.join(t.turn_questions, "query_id").select("query_id", body.alias("body"))
    return rq.parse_requests(requests).select(
        "query_id", "question", "mode", "position", "title", "url", F.md5("markdown").alias("markdown_md5"), "source_type",
        F.col("metadata")["context_role"].alias("context_role"), "rejected",
    )


@checked("fn_provider_alias", f"""
SELECT o_orderkey, CASE lower(trim(p)) WHEN '' THEN 'openai' WHEN 'local' THEN 'ollama' WHEN 'gateway' THEN 'openai' WHEN 'hybrid_local_cloud' THEN 'hybrid' ELSE lower(trim(p)) END AS provider,
  CASE lower(trim(p)) WHEN '' THEN 'openai' WHEN 'local' THEN 'local' WHEN 'gateway' THEN 'openai' ELSE lower(trim(p)) END AS embedding,
  CASE lower(trim(p)) WHEN 'xhigh' THEN 'high' WHEN 'low' THEN 'low' ELSE '' END AS effort
FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' Local ' WHEN 2 THEN 'GATEWAY' WHEN 3 THEN 'hybrid_local_cloud' WHEN 4 THEN 'xHigh' WHEN 5 THEN 'low' ELSE o_orderstatus END AS p FROM {{orders}})""")
def fn_provider_alias(t):
    name = F.expr("CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' Local ' WHEN 2 THEN 'GATEWAY' WHEN 3 THEN 'hybrid_local_cloud' WHEN 4 THEN 'xHigh' WHEN 5 THEN 'low' ELSE o_orderstatus END")
    return t.orders.select(
        "o_orderkey", tx.provider_alias(name).alias("provider"), tx.embedding_provider_alias(name).alias("embedding"),
        tx.reasoning_effort_alias(name).alias("effort"),
    )


@checked("fn_tokens", f"SELECT doc_id, array_to_string({d.tokens('text')}, '|') AS tokens FROM {{documents}}")
def fn_tokens(t):
    return t.documents.select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@checked("fn_tokens_alnum", f"SELECT doc_id, array_to_string({d.word_tokens('text')}, '|') AS tokens FROM {{documents}}")
def fn_tokens_alnum(t):
    return t.documents.select("doc_id", tx.word_tokens(F.col("text")).alias("tokens"))


@checked("fn_shorten", f"SELECT doc_id, {d.shorten('text', 160)} AS short FROM {{documents}}")
def fn_shorten(t):
    return t.documents.select("doc_id", tx.shorten(F.col("text"), 160).alias("short"))


@checked("fn_slug", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {documents}")
def fn_slug(t):
    return t.documents.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@checked("fn_sigmoid_unit", """SELECT event_id, round(CASE WHEN value / 10 - 3 BETWEEN 0 AND 1 THEN value / 10 - 3 ELSE 1 / (1 + exp(-(value / 10 - 3))) END, 6) AS unit FROM {events}""")
def fn_sigmoid_unit(t):
    return t.events.select("event_id", tx.sigmoid_unit(F.col("value") / 10 - 3).alias("unit"))


@checked("fn_hostname", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM {pages}")
def fn_hostname(t):
    return t.pages.select("page_id", urls.hostname(F.col("url")).alias("host"))


@checked("fn_label", f"SELECT doc_id, {d.shorten('text', 48)} || ' [' || lang || '/' || source || ']' AS label FROM {{documents}}")
def fn_label(t):
    return t.documents.select("doc_id", tx.page_label(F.col("text"), F.col("lang"), F.col("source")).alias("label"))


# --- streams ---------------------------------------------------------------------------------


def fetches(t):
    return t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("seq"))


TTL = """WITH RECURSIVE f AS (SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS key, ts, event_id AS seq FROM {events}),
chain AS (SELECT key, arg_min(seq, (ts, seq)) AS seq, min(ts) AS ts FROM f GROUP BY 1
  UNION ALL SELECT key, seq, ts FROM (SELECT f.key, f.seq, f.ts, row_number() OVER (PARTITION BY f.key ORDER BY f.ts, f.seq) AS rn
    FROM chain c JOIN f ON f.key = c.key AND f.ts >= c.ts + INTERVAL 24 HOUR) WHERE rn = 1)
SELECT key, seq FROM chain"""


@checked("stream_ttl_cache", TTL)
def stream_ttl_cache(t):
    return sj.ttl_batch(fetches(t)).select("key", "seq")


def through_stream(t, rows, job, name):
    """Rows written as files, read as a stream, through the stateful job and back."""
    place = fresh_table(t, name)
    rows.write.parquet(f"{place}/in")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", sj.STATE_STORE)
    source = t.spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    query = job(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{place}/out")


@checked("stream_ttl_cache_state", TTL)
def stream_ttl_cache_state(t):
    """The stateful streaming job over the same fetches."""
    rows = fetches(t).withColumn("value", F.lit(""))
    return through_stream(t, rows, sj.ttl_stream, "ttl").select("key", "seq")


# Visits: every event three times, with short pauses, so bursts form.
COOL = """WITH RECURSIVE v AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, ts + to_seconds(k * 2) AS ts, event_id * 10 + k AS seq
  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM {events})),
o AS (SELECT *, row_number() OVER w AS n, lag(value) OVER w AS before FROM v WINDOW w AS (PARTITION BY key ORDER BY ts, seq)),
walk AS (SELECT key, n, value, ts, seq, ts AS last, true AS taken FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.n, o.value, o.ts, o.seq, CASE WHEN o.value <> o.before OR o.ts >= w.last + INTERVAL 5 SECOND THEN o.ts ELSE w.last END,
    o.value <> o.before OR o.ts >= w.last + INTERVAL 5 SECOND FROM walk w JOIN o ON o.key = w.key AND o.n = w.n + 1)
SELECT key, value, seq FROM walk WHERE taken"""


def visits(t):
    k = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("k")
    rows = t.events.select("user_id", "event_type", "ts", "event_id", k)
    return rows.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 2_000_000).alias("ts"),
        (F.col("event_id") * 10 + F.col("k")).alias("seq"),
    )


@checked("stream_cooldown", COOL)
def stream_cooldown(t):
    return sj.cooldown_batch(visits(t)).select("key", "value", "seq")


@checked("stream_cooldown_state", COOL)
def stream_cooldown_state(t):
    """The stateful streaming job over the same visits."""
    return through_stream(t, visits(t), sj.cooldown_stream, "cooldown").select("key", "value", "seq")


@checked("stream_ingest", """SELECT url AS page_url FROM {pages}""")
def stream_ingest(t):
    """The pages table as a file stream through cleaning and link scan; the cleaned URLs come back."""
    out = fresh_table(t, "ingest")
    # a pattern, as a stream takes a single file by no other name; the table may be a file or a folder of files
    source = t.spark.readStream.schema(t.pages.schema).parquet(f"{t.folder}/pages.parque[t]")
    sj.ingest(source.select("url", "html"), out, f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/pages_clean").select("page_url")
