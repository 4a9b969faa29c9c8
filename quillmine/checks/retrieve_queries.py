"""Checked queries: chunking, embedding, retrieval, scoring and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine import rules
from quillmine.checks import duck as d
from quillmine.checks.page_queries import PLANNER, PROFILES, QUESTIONS, profiles, questions
from quillmine.checks.registry import checked
from quillmine.functions import text as tx
from quillmine.functions import vectors as vx
from quillmine.operators import chunks as ch
from quillmine.operators import pages as pg
from quillmine.operators import retrieve as rt
from quillmine.operators import select as sl
from quillmine.operators import vectors as vs

# --- chunking -----------------------------------------------------------------


@checked("chunk_split")
def chunk_split(t):
    return ch.chunk_pages(t.doc_pages).select("page_url", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


@checked("chunk_corpus", f"""
SELECT page_url, true AS placed, true AS sized, true AS first, true AS last, true AS numbered,
  CASE WHEN length(markdown) <= 1000 THEN md5(text) END AS whole FROM (SELECT *, {d.strip('markdown')} AS text FROM {{doc_pages}}) WHERE text <> ''""")
def chunk_corpus(t):
    """What holds for the chunks of every page: each stands in the page and fits, they begin and end with it.

    A page that fits one chunk comes out whole.
    """
    texts = t.doc_pages.select("page_url", "markdown", tx.strip(F.col("markdown")).alias("whole"))
    rows = ch.chunk_pages(t.doc_pages).join(texts, "page_url")
    at, n = F.col("chunk_index"), F.col("total_chunks")
    kept = F.length("markdown") <= rules.CHUNK_SIZE
    return rows.groupBy("page_url").agg(
        F.every(F.contains("whole", "text")).alias("placed"),
        F.every(F.length("text").between(1, rules.CHUNK_SIZE)).alias("sized"),
        F.every((at > 0) | F.startswith("whole", "text")).alias("first"),
        F.every((at < n - 1) | F.endswith("whole", "text")).alias("last"),
        (F.count("*") == F.max("total_chunks")).alias("numbered"),
        F.max(F.when(kept, F.md5("text"))).alias("whole"),
    )


@checked("chunk_offsets", """
SELECT page_url, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY page_url) AS total_chunks,
  CAST(coalesce(sum(length(text) - 200) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
  CAST(coalesce(sum(length(text) - 200) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS char_end
FROM {line_chunks} WINDOW w AS (PARTITION BY page_url ORDER BY chunk_index)""")
def chunk_offsets(t):
    return ch.chunk_offsets(t.line_chunks)


@checked("chunk_stats", """
SELECT b.query_id, count(*) AS total_chunks, CAST(sum(length(c.text)) AS BIGINT) AS total_chars,
  count(DISTINCT c.page_url) AS pages_count, CAST(floor(sum(length(c.text)) / count(*)) AS BIGINT) AS avg_chunk_size,
  round(count(*)::DOUBLE / count(DISTINCT c.page_url), 6) AS chunks_per_page
FROM {turn_basket} b JOIN {line_chunks} c USING (page_url) GROUP BY 1""")
def chunk_stats(t):
    return ch.chunk_stats(t.turn_basket, t.line_chunks)


@checked("chunk_embed_text", """
SELECT page_url, chunk_index, md5('Title: ' || page_title || chr(10) || 'Source type: ' || source_type || chr(10) || 'Content:' || chr(10) || text) AS text_md5
FROM {line_chunks}""")
def chunk_embed_text(t):
    text = ch.embedding_text(F.col("page_title"), F.col("source_type"), F.col("text"))
    return t.line_chunks.select("page_url", "chunk_index", F.md5(text).alias("text_md5"))


@checked("embed_batch", """
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._/-]*')) AS tok FROM {documents}),
counts AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 64 AS slot, count(*)::DOUBLE AS n FROM toks GROUP BY ALL)
SELECT doc_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM counts""")
def embed_batch(t):
    rows = ch.embed(t.documents.select("doc_id", "text"))
    flat = rows.select("doc_id", F.posexplode("embedding").alias("slot", "weight"))
    return flat.filter("weight > 0").select("doc_id", F.col("slot").cast("bigint"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


@checked("token_count", """
SELECT page_url, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM {line_chunks} GROUP BY 1""")
def token_count(t):
    return t.line_chunks.groupBy("page_url").agg(F.sum(ch.token_count(F.col("text"))).alias("tokens"))


@checked("corpus_signature", """
SELECT query_id, sha256(string_agg(sha256(page_url || chr(0) || title || chr(0) || source_type || chr(0) || markdown || chr(0)), '' ORDER BY page_url)) AS corpus_signature
FROM {turn_basket} JOIN {doc_pages} USING (page_url) GROUP BY 1""")
def corpus_signature(t):
    return ch.corpus_signature(t.turn_basket, t.doc_pages)


@checked("query_signature", f"SELECT query_id, sha256({d.strip('question')}) AS query_signature FROM {{turn_questions}}")
def query_signature(t):
    return t.turn_questions.select("query_id", ch.query_signature(F.col("question")).alias("query_signature"))


@checked("answer_cache_key", f"""
SELECT query_id, 'diagram_cache_' || sha256('{{"question":' || to_json(any_value({d.web_strip('lower(question)')})) || ',"pages":['
  || string_agg('"' || sha256('{{"title":' || to_json(title) || ',"url":' || to_json(url) || ',"markdown":' || to_json(md) || ',"source_type":' || to_json(source_type) || '}}') || '"',
     ',' ORDER BY url || ' ' || title) || ']}}') AS cache_key
FROM (SELECT b.query_id, q.question, {d.web_strip('p.title')} AS title, {d.web_strip('p.page_url')} AS url, {d.web_strip('p.markdown')} AS md, p.source_type
      FROM {{turn_basket}} b JOIN {{doc_pages}} p USING (page_url) JOIN {{turn_questions}} q ON q.query_id = b.query_id) GROUP BY 1""")
def answer_cache_key(t):
    return ch.answer_cache_key(t.turn_questions, t.turn_basket, t.doc_pages)


# --- vectors --------------------------------------------------------------------

DIMS = 64
CENTROIDS = "c AS (SELECT label, {} AS q FROM {{embeddings}} GROUP BY 1)".format(
    "[" + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(DIMS)) + "]"
)


def centroids(t):
    return vs.centroids(t.embeddings, "label", DIMS)


@checked("vec_normalize", """
SELECT vec_id, unnest(range(len(embedding))) AS place, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(length2))), 5) AS value
FROM (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS length2 FROM {embeddings})""")
def vec_normalize(t):
    """Every value of every vector, after scaling it by three."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = t.embeddings.select("vec_id", F.posexplode(vx.normalize(scaled)).alias("place", "value"))
    return rows.select("vec_id", "place", F.round("value", 5).alias("value"))


@checked("vec_cosine", f"""
WITH {CENTROIDS} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS similarity
FROM {{embeddings}} JOIN c USING (label)""")
def vec_cosine(t):
    mean = centroids(t).withColumnRenamed("embedding", "q")
    rows = t.embeddings.join(mean, "label")
    return rows.select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))


@checked("vec_validate", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS found, CAST(CASE label WHEN 3 THEN 32 ELSE 64 END AS BIGINT) AS expected
FROM (SELECT vec_id, label, CASE label WHEN 4 THEN embedding[1:32] ELSE embedding END AS embedding FROM {embeddings})
WHERE len(embedding) <> 64
UNION ALL SELECT doc_id, -1, 64 FROM {documents} WHERE doc_id NOT IN (SELECT vec_id FROM {embeddings})""")
def vec_validate(t):
    cut = F.when(F.col("label") == 4, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    bad = vs.vector_problems(t.embeddings.withColumn("embedding", cut), "vec_id", "embedding", DIMS)
    ids = t.documents.select(F.col("doc_id").alias("vec_id"))
    lost = vs.missing_vectors(ids, t.embeddings, ["vec_id"]).select("vec_id", F.lit(-1), F.lit(DIMS))
    return bad.union(lost)


@checked("vec_topk", f"""
WITH {CENTROIDS}, r AS (SELECT label2 AS query_id, vec_id, score, row_number() OVER (PARTITION BY label2 ORDER BY round(score, 12) DESC, vec_id) AS rank
  FROM (SELECT c2.label2, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c2.q) AS score FROM {{embeddings}} e
        CROSS JOIN (SELECT label, q FROM c) c2 (label2, q)))
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 20""")
def vec_topk(t):
    asked = centroids(t).select(F.col("label").cast("long").alias("query_id"), "embedding")
    found = vs.vector_topk(asked, t.embeddings, k=rt.MAX_K, dims=DIMS)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@checked("vec_store_stats", """
SELECT count(*) AS total_vectors, count(DISTINCT label) AS total_pages, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM {embeddings}""")
def vec_store_stats(t):
    return vs.vector_stats(t.embeddings, "label")


# --- candidates -------------------------------------------------------------------

# Each step of the oracle chain, in order.
STEPS = {
    "asked": QUESTIONS, "planner": PLANNER, "profiles": PROFILES,
    "pairs": f"""pairs AS (SELECT p.query_id, p.page_url, c.chunk_index, p.original_index, p.title_overlap, p.heading_overlap,
      len(q.terms) > 0 AS has_terms, {d.overlap('q.terms', 'c.terms')} AS chunk_overlap
      FROM profiles p JOIN (SELECT query_id, {d.token_set('question')} AS terms FROM asked) q USING (query_id)
      JOIN (SELECT page_url, chunk_index, {d.token_set('text')} AS terms FROM {{line_chunks}}) c ON c.page_url = p.page_url)""",
    "lexical": """lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_index, chunk_index) AS rank
      FROM (SELECT *, (chunk_overlap * 0.7 + title_overlap * 0.2 + heading_overlap * 0.1)::DOUBLE AS score FROM pairs WHERE has_terms) WHERE score > 0) WHERE rank <= 20)""",
    "hybrid": """hybrid AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank) FROM (
      SELECT * REPLACE ((score * 0.72 + chunk_overlap * 0.20 + title_overlap * 0.08)::DOUBLE AS score) FROM lexical))""",
    "quality": """quality AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, priority DESC, rank) AS rank) FROM (
      SELECT h.* REPLACE ((h.score * p.priority + (p.title_overlap * 0.08 + p.heading_overlap * 0.05)
        + CASE WHEN h.chunk_index = 0 AND p.role IN ('prd', 'spec', 'design', 'api') THEN 0.02 ELSE 0 END)::DOUBLE AS score), p.priority, p.source_type, p.title
      FROM hybrid h JOIN profiles p USING (query_id, page_url)))""",
    "filtered": """filtered AS (SELECT * EXCLUDE (any_strong, rank), NOT any_strong AS weak_match, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
      SELECT *, bool_or(score > 0.22) OVER (PARTITION BY query_id) AS any_strong FROM quality) WHERE score > 0.22 OR (NOT any_strong AND rank <= 5))""",
}


def chain(upto: str, body: str) -> str:
    names = list(STEPS)
    return "WITH " + ",\n".join(STEPS[n] for n in names[: names.index(upto) + 1]) + "\n" + body


def lexical(t):
    def make():
        pairs = rt.score_pairs(questions(t), profiles(t), rt.chunk_terms(t.line_chunks))
        return rt.lexical_candidates(pairs)

    return t.once("lexical", make)


@checked("lex_score", chain("pairs", """
SELECT query_id, page_url, chunk_index, round(CASE WHEN has_terms THEN chunk_overlap * 0.7 + title_overlap * 0.2 + heading_overlap * 0.1 ELSE 0 END::DOUBLE, 6) AS score FROM pairs"""))
def lex_score(t):
    pairs = rt.score_pairs(questions(t), profiles(t), rt.chunk_terms(t.line_chunks))
    return pairs.select("query_id", "page_url", "chunk_index", rt.lexical_score().alias("score"))


SCORE = "SELECT query_id, page_url, chunk_index, rank, round(score, 6) AS score FROM "
SCORED = ("query_id", "page_url", "chunk_index", "rank", "score")


@checked("lex_topk", chain("lexical", SCORE + "lexical"))
def lex_topk(t):
    return lexical(t).select(*SCORED)


def dense(t):
    """Cosine of hashed counts for the conversations whose number is even."""
    vectors = ch.embed(t.line_chunks.select("page_url", "chunk_index", "text"))
    asked = ch.embed_questions(questions(t)).filter(F.col("mode") != "critique")
    return rt.dense_candidates(asked, t.turn_basket, vectors)


# Unit vectors of 32-bit floats, as the encoder gives them.
HASHED = """SELECT {key}, list((CASE WHEN length > 0 THEN w / length ELSE 0 END)::FLOAT::DOUBLE ORDER BY slot) AS v FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS length FROM (SELECT {key}, slot, coalesce(n, 0)::DOUBLE AS w FROM
  (SELECT {key}, unnest(range(64)) AS slot FROM {src}) LEFT JOIN
  (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n FROM
     (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9._/-]*')) AS tok FROM {src}) GROUP BY ALL) USING ({key}, slot))) GROUP BY {key}"""
DENSE = f"""cv AS ({HASHED.format(key='page_url, chunk_index', src='{line_chunks}', text='text')}),
qv AS ({HASHED.format(key='query_id', src="(SELECT * FROM asked WHERE mode <> 'critique')", text='question')}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_index, chunk_index) AS rank FROM (
  SELECT b.query_id, b.page_url, b.original_index, c.chunk_index,
    round(CASE WHEN list_sum(c.v) = 0 OR list_sum(q.v) = 0 THEN 0 ELSE list_cosine_similarity(c.v, q.v) END, 12) AS score
  FROM {{turn_basket}} b JOIN qv q USING (query_id) JOIN cv c USING (page_url))) WHERE rank <= 20)"""


@checked("cand_route", chain("lexical", "").rstrip() + f""", {DENSE}
SELECT query_id, page_url, chunk_index, round(score, 6) AS score, 'dense+hybrid' AS strategy FROM dense
UNION ALL SELECT query_id, page_url, chunk_index, round(score, 6), 'lexical-fallback' FROM lexical WHERE query_id NOT IN (SELECT query_id FROM dense)""")
def cand_route(t):
    routed = rt.route_candidates(dense(t), lexical(t))
    return routed.select("query_id", "page_url", "chunk_index", "score", "strategy")


@checked("cand_priority_fallback", chain("profiles", """
, pages1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, title_overlap DESC, heading_overlap DESC, original_index) AS pr FROM profiles
   WHERE query_id NOT IN (SELECT query_id FROM asked WHERE mode = 'answer')),
 rows1 AS (SELECT p.query_id, p.page_url, c.chunk_index, greatest(0.12, p.priority * 0.1) AS score,
   row_number() OVER (PARTITION BY p.query_id ORDER BY pr, c.chunk_index) AS rank FROM pages1 p JOIN {line_chunks} c USING (page_url) WHERE c.chunk_index < 2)
SELECT query_id, page_url, chunk_index, round(score::DOUBLE, 6) AS score, rank FROM rows1 WHERE rank <= 12"""))
def cand_priority_fallback(t):
    asked = questions(t)
    have = asked.filter("mode = 'answer'").select("query_id")
    return rt.priority_fallback(asked, have, profiles(t), t.line_chunks, 12).select(
        "query_id", "page_url", "chunk_index", "score", "rank"
    )


@checked("score_hybrid", chain("hybrid", SCORE + "hybrid"))
def score_hybrid(t):
    return rt.hybrid_scores(lexical(t)).select(*SCORED)


# A pair model that SQL can repeat: it sees nothing but the lengths of the two texts.
MODEL = "((length(question) * 37 + length(pair_text) * 11) % 2000 - 1000) / 100.0"


def pair_lengths(question, text):
    return ((question.str.len() * 37 + text.str.len() * 11) % 2000 - 1000) / 100.0


@checked("score_rerank", chain("hybrid", f"""
, m AS (SELECT h.*, {MODEL} AS m FROM hybrid h JOIN asked a USING (query_id) JOIN (SELECT page_url, chunk_index, 'Title: ' || page_title || chr(10) || 'Source type: '
    || source_type || chr(10) || 'Chunk ' || (chunk_index + 1) || ' of ' || total_chunks || chr(10) || 'Content:' || chr(10) || text AS pair_text FROM {{line_chunks}}) c USING (page_url, chunk_index)),
 n AS (SELECT *, CASE WHEN m BETWEEN 0 AND 1 THEN m ELSE 1 / (1 + exp(-m)) END AS u FROM m),
 x AS (SELECT * REPLACE (CASE WHEN rank <= 12 THEN u * 0.8 + score * 0.2 ELSE score END AS score) FROM n)
SELECT query_id, page_url, chunk_index, round(score::DOUBLE, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY rank > 12, CASE WHEN rank <= 12 THEN round(score, 12) END DESC NULLS LAST, rank) AS rank FROM x"""))
def score_rerank(t):
    hybrid = t.once("hybrid", lambda: rt.hybrid_scores(lexical(t)))
    scored = rt.model_scores(hybrid, questions(t), t.line_chunks, pair_lengths)
    return rt.rerank_scores(scored, F.col("model_score")).select(*SCORED)


@checked("score_page_quality", chain("quality", SCORE + "quality"))
def score_page_quality(t):
    return rt.page_quality_scores(rt.hybrid_scores(lexical(t)), profiles(t)).select(*SCORED)


def filtered(t):
    def make():
        scored = rt.page_quality_scores(rt.hybrid_scores(lexical(t)), profiles(t))
        return rt.threshold(scored)

    return t.once("filtered", make)


@checked("cand_threshold", chain("filtered", "SELECT query_id, page_url, chunk_index, rank, weak_match, round(score, 6) AS score FROM filtered"))
def cand_threshold(t):
    return filtered(t).select(*SCORED, "weak_match")


@checked("cap_page", chain("profiles", """
SELECT query_id, page_url, CAST(least(CASE WHEN priority >= 1.18 THEN 4 WHEN priority >= 1.04 THEN 3 ELSE 2 END, 3) AS BIGINT) AS page_cap FROM profiles"""))
def cap_page(t):
    return profiles(t).select("query_id", "page_url", rt.page_caps(F.col("priority"), F.lit(3)).alias("page_cap"))


SOURCE_CAPS = """SELECT query_id, source_type, CAST(CASE WHEN any_value(planner_mode) LIKE 'compare%' THEN CASE WHEN count(*) <= 2 THEN 2 ELSE 3 END
  WHEN any_value(planner_mode) LIKE 'current-page%' THEN 2 WHEN count(*) <= 3 THEN 3 ELSE 4 END AS BIGINT) AS source_cap
  FROM profiles WHERE query_id IN (SELECT query_id FROM profiles GROUP BY 1 HAVING count(DISTINCT source_type) > 1) GROUP BY 1, 2"""


@checked("cap_source", chain("profiles", SOURCE_CAPS))
def cap_source(t):
    return rt.source_caps(profiles(t))


MODELS = {"openai": ("small", "large"), "ollama": ("gemma", "coder"), "anthropic": ("one", "one")}
PROVIDER = "CASE query_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' WHEN 2 THEN 'anthropic' ELSE 'hybrid' END"
POLICY = f"""plans AS (SELECT query_id, mode, planner_mode, {PROVIDER} AS provider, mode <> 'answer' AS reasoning,
    planner_mode LIKE 'compare%' AS cmp, planner_mode LIKE 'current-page%' OR planner_mode LIKE 'single-doc%' AS focus
  FROM asked JOIN planner USING (query_id)),
policy AS (SELECT query_id, planner_mode, provider, CASE WHEN reasoning THEN 'reasoning' ELSE 'summary' END AS model_route,
  CASE WHEN provider = 'ollama' THEN CASE WHEN reasoning THEN 'coder' ELSE 'gemma' END WHEN provider = 'anthropic' THEN 'one'
       WHEN reasoning THEN 'large' ELSE 'small' END AS target_model,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 'ollama-summary-tight' WHEN provider = 'ollama' THEN 'ollama-reasoning-balanced'
       WHEN reasoning AND provider <> 'anthropic' THEN 'reasoning-route-balanced' ELSE 'default-shared-context' END AS policy_name,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 12 WHEN provider = 'ollama' THEN 14 WHEN reasoning AND provider <> 'anthropic' THEN 16 ELSE 20 END::BIGINT AS max_candidates,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 5 WHEN provider = 'ollama' THEN CASE WHEN cmp THEN 6 ELSE 7 END
       WHEN reasoning AND provider <> 'anthropic' THEN CASE WHEN cmp THEN 7 ELSE 8 END END::BIGINT AS max_total_chunks,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 2 ELSE 3 END::BIGINT AS max_chunks_per_page,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 5200 WHEN provider = 'ollama' THEN CASE WHEN cmp THEN 6800 ELSE 7600 END
       WHEN reasoning AND provider <> 'anthropic' THEN CASE WHEN cmp THEN 10000 ELSE 12000 END
       ELSE 100000 - CASE mode WHEN 'critique' THEN 6500 WHEN 'diagram' THEN 7000 ELSE 6000 END END::BIGINT AS max_input_tokens,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 2 WHEN provider = 'ollama' THEN 3 WHEN reasoning AND provider <> 'anthropic' THEN 3 END::BIGINT AS max_stitched_chunks,
  CASE WHEN provider = 'ollama' THEN 1 WHEN cmp THEN 1 WHEN focus THEN 2 ELSE 1 END::BIGINT AS edge_radius,
  CASE WHEN provider = 'ollama' AND NOT reasoning THEN 1 WHEN focus THEN 2 ELSE 1 END::BIGINT AS bridge_gap FROM plans)"""


def policy(t):
    asked = questions(t)
    plans = pg.planner_mode(asked, t.turn_basket).join(asked.select("query_id", "mode"), "query_id")
    return rt.budget_policy(plans.withColumn("provider", F.expr(PROVIDER)), MODELS)


@checked("budget_policy", chain("planner", "").rstrip() + f", {POLICY} SELECT * FROM policy")
def budget_policy(t):
    return policy(t)


# --- selection --------------------------------------------------------------------

BUDGET = 900  # small enough to make the token limit bite on line chunks


def capped(t):
    sizes = t.line_chunks.select("page_url", "chunk_index", "total_chunks", "source_type", "page_title",
                                 ch.token_count(F.col("text")).alias("tokens"))
    limits = policy(t).withColumn("max_input_tokens", F.lit(BUDGET))
    return sl.with_caps(filtered(t).join(sizes, ["page_url", "chunk_index"]), limits, rt.source_caps(profiles(t)))


CAPPED = f"""{POLICY}, sizes AS (SELECT page_url, chunk_index, total_chunks, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM {{line_chunks}}),
scaps AS ({SOURCE_CAPS}),
capped AS (SELECT f.query_id, f.rank, f.page_url, f.chunk_index, f.source_type, f.title, f.score, f.priority, s.tokens, s.total_chunks,
  least(CASE WHEN f.priority >= 1.18 THEN 4 WHEN f.priority >= 1.04 THEN 3 ELSE 2 END, p.max_chunks_per_page) AS page_cap,
  coalesce(c.source_cap, 1000) AS source_cap, coalesce(p.max_total_chunks, 1000) AS chunk_cap
  FROM filtered f JOIN sizes s USING (page_url, chunk_index) JOIN policy p ON p.query_id = f.query_id
  LEFT JOIN scaps c ON c.query_id = f.query_id AND c.source_type = f.source_type)"""
# The walk as a recursive query: step 1..n is the first pass, n+1..2n the second.
WALK = f"""walk AS (
  SELECT query_id, 0::BIGINT AS step, max(rank)::BIGINT AS n, []::BIGINT[] AS taken, []::VARCHAR[] AS pages, []::VARCHAR[] AS kinds, 0::BIGINT AS used
  FROM capped GROUP BY 1
  UNION ALL
  SELECT w.query_id, w.step + 1, w.n,
    CASE WHEN ok THEN list_append(w.taken, r) ELSE w.taken END, CASE WHEN ok THEN list_append(w.pages, page_url) ELSE w.pages END,
    CASE WHEN ok THEN list_append(w.kinds, source_type) ELSE w.kinds END, w.used + CASE WHEN ok THEN tokens ELSE 0 END
  FROM (SELECT v.*, c.rank AS r, c.page_url, c.source_type, c.tokens,
      NOT list_contains(v.taken, c.rank) AND (len(v.taken) = 0 OR (len(v.taken) < c.chunk_cap
        AND len(list_filter(v.pages, lambda x: x = c.page_url)) < CASE WHEN v.step < v.n THEN 1 ELSE c.page_cap END
        AND len(list_filter(v.kinds, lambda x: x = c.source_type)) < c.source_cap AND v.used + c.tokens <= {BUDGET})) AS ok
    FROM walk v JOIN capped c ON c.query_id = v.query_id AND c.rank = v.step % v.n + 1 WHERE v.step < 2 * v.n) w),
chosen AS (SELECT query_id, unnest(taken) AS rank, generate_subscripts(taken, 1)::BIGINT AS select_rank FROM walk WHERE step = 2 * n),
selected AS (SELECT c.*, h.select_rank FROM capped c JOIN chosen h USING (query_id, rank))"""


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql[5:]


@checked("select_budget", recursive(chain("filtered", "").rstrip() + f", {CAPPED}, {WALK} SELECT query_id, page_url, chunk_index, select_rank FROM selected"))
def select_budget(t):
    return sl.select_budget(capped(t)).select("query_id", "page_url", "chunk_index", "select_rank")


# The steps after selection start from what it chose.
PICKED = f"{WALK}, picked AS (SELECT * FROM selected)"


def picked(t):
    return t.once("picked", lambda: sl.select_budget(capped(t)))


BRIDGES = """bridges AS (SELECT query_id, page_url, unnest(range(chunk_index + 1, nxt)) AS chunk_index, 0 AS strategy_rank, nxt - chunk_index - 1 AS distance,
   greatest(score, nscore) AS anchor_score, chunk_index AS anchor_index, 0 AS offs FROM (
  SELECT s.*, lead(s.chunk_index) OVER w AS nxt, lead(s.score) OVER w AS nscore, p.bridge_gap FROM picked s JOIN policy p USING (query_id)
  WINDOW w AS (PARTITION BY s.query_id, s.page_url ORDER BY s.chunk_index)) WHERE nxt - chunk_index - 1 BETWEEN 1 AND bridge_gap)"""
NEAR = """near AS (SELECT s.query_id, s.page_url, s.chunk_index + o AS chunk_index, 1 AS strategy_rank, abs(o) AS distance, s.score AS anchor_score,
   s.chunk_index AS anchor_index, o AS offs FROM picked s JOIN policy p USING (query_id), (SELECT unnest(range(-2, 3)) AS o) r
  WHERE o <> 0 AND abs(o) <= p.edge_radius AND s.chunk_index + o BETWEEN 0 AND s.total_chunks - 1
    AND NOT EXISTS (SELECT 1 FROM picked x WHERE x.query_id = s.query_id AND x.page_url = s.page_url AND x.chunk_index = s.chunk_index + o))"""
QUEUE = """queue AS (SELECT q.*, s.tokens, g.page_rank, g.priority FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_url, chunk_index
     ORDER BY strategy_rank, anchor_index, abs(offs), offs) AS rn FROM (SELECT * FROM bridges UNION ALL SELECT * FROM near)) WHERE rn = 1) q
  JOIN sizes s USING (page_url, chunk_index)
  JOIN (SELECT query_id, page_url, min(select_rank) AS page_rank, any_value(priority) AS priority FROM picked GROUP BY 1, 2) g ON g.query_id = q.query_id AND g.page_url = q.page_url)"""
STITCH_WALK = f"""q2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strategy_rank, page_rank, -priority, -anchor_score, distance, chunk_index) AS spot FROM queue),
swalk AS (
  SELECT q.query_id, 0::BIGINT AS step, max(q.spot)::BIGINT AS n, []::BIGINT[] AS taken, any_value(u.used)::BIGINT AS used FROM q2 q
    JOIN (SELECT query_id, sum(tokens) AS used FROM picked GROUP BY 1) u USING (query_id) GROUP BY 1
  UNION ALL
  SELECT v.query_id, v.step + 1, v.n, CASE WHEN ok THEN list_append(v.taken, v.step + 1) ELSE v.taken END, v.used + CASE WHEN ok THEN v.tokens ELSE 0 END
  FROM (SELECT w.*, c.tokens, len(w.taken) < coalesce(p.max_stitched_chunks, 1000) AND w.used + c.tokens <= {2 * BUDGET} AS ok
    FROM swalk w JOIN q2 c ON c.query_id = w.query_id AND c.spot = w.step + 1 JOIN policy p ON p.query_id = w.query_id) v),
added AS (SELECT q.query_id, q.page_url, q.chunk_index, q.tokens, CASE q.strategy_rank WHEN 0 THEN 'bridge' ELSE 'adjacent' END AS strategy
  FROM q2 q JOIN (SELECT query_id, unnest(taken) AS spot FROM swalk WHERE step = n) s USING (query_id, spot))"""
ORDERED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN stitched THEN page_rank ELSE select_rank END, chunk_index) AS position FROM (
  SELECT *, min(select_rank) OVER (PARTITION BY query_id, page_url) AS page_rank, bool_or(strategy <> 'selected') OVER (PARTITION BY query_id) AS stitched FROM (
    SELECT query_id, page_url, chunk_index, tokens, select_rank, 'selected' AS strategy FROM picked
    UNION ALL SELECT query_id, page_url, chunk_index, tokens, NULL, strategy FROM added)))"""


def after(*parts: str, body: str) -> str:
    return recursive(chain("filtered", "").rstrip() + ", " + ", ".join(parts) + " " + body)


@checked("stitch_bridge", after(CAPPED, PICKED, BRIDGES, body="""
SELECT query_id, page_url, chunk_index, CAST(distance AS BIGINT) AS distance, round(anchor_score, 6) AS anchor_score FROM bridges"""))
def stitch_bridge(t):
    return sl.stitch_bridges(picked(t), policy(t)).select("query_id", "page_url", "chunk_index", "distance", "anchor_score")


@checked("stitch_adjacent", after(CAPPED, PICKED, NEAR, body="""
SELECT query_id, page_url, chunk_index, CAST(distance AS BIGINT) AS distance, CAST(offs AS BIGINT) AS "offset", round(anchor_score, 6) AS anchor_score FROM near"""))
def stitch_adjacent(t):
    return sl.stitch_neighbours(picked(t), policy(t)).select(
        "query_id", "page_url", "chunk_index", "distance", "offset", "anchor_score"
    )


def added(t):
    sizes = t.line_chunks.select("page_url", "chunk_index", ch.token_count(F.col("text")).alias("tokens"))
    limits = policy(t).withColumn("max_input_tokens", F.lit(2 * BUDGET))
    chosen = picked(t)
    return sl.stitch_select(sl.stitch_queue(chosen, limits), chosen, limits, sizes)


@checked("stitch_select", after(CAPPED, PICKED, BRIDGES, NEAR, QUEUE, STITCH_WALK, body="SELECT query_id, page_url, chunk_index, tokens, strategy FROM added"))
def stitch_select(t):
    return added(t)


def final(t):
    return t.once("final", lambda: sl.stitch_order(picked(t), added(t)))


@checked("stitch_order", after(CAPPED, PICKED, BRIDGES, NEAR, QUEUE, STITCH_WALK, ORDERED, body="""
SELECT query_id, page_url, chunk_index, strategy, position FROM ordered"""))
def stitch_order(t):
    return final(t).select("query_id", "page_url", "chunk_index", "strategy", "position")


LABEL = f"{d.shorten('title', 48)} || ' [' || role || '/' || source_type || ']'"


@checked("select_summary", after(CAPPED, PICKED, body=f"""
, labels AS (SELECT query_id, page_url, {LABEL} AS label FROM profiles),
 used AS (SELECT query_id, page_url, min(select_rank) AS spot FROM picked GROUP BY 1, 2),
 left_out AS (SELECT query_id, page_url, min(rank) AS spot FROM filtered f WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.query_id = f.query_id AND u.page_url = f.page_url) GROUP BY 1, 2),
 a AS (SELECT query_id, string_agg(label, '; ' ORDER BY spot) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS n FROM used JOIN labels USING (query_id, page_url)) WHERE n <= 4 GROUP BY 1),
 b AS (SELECT query_id, string_agg(label || ' (lower-ranked)', '; ' ORDER BY spot) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS n FROM left_out JOIN labels USING (query_id, page_url)) WHERE n <= 3 GROUP BY 1)
SELECT a.query_id, a.s AS selected_sources_summary, coalesce(b.s, '') AS omitted_sources_summary FROM a LEFT JOIN b USING (query_id)"""))
def select_summary(t):
    chosen = picked(t).withColumn("position", F.col("select_rank"))
    return sl.selection_summary(chosen, filtered(t), profiles(t))


def stats(t):
    found = lexical(t).withColumns({"strategy": F.lit("lexical-fallback"), "no_match": F.lit(False)})
    return sl.retrieval_stats(policy(t), found, filtered(t), final(t), t.turn_basket)


STATS = """stats AS (SELECT p.query_id, p.planner_mode, p.policy_name, i.input_pages, l.candidates_found, f.filtered_by_similarity, f.weak, coalesce(s.avg_similarity, 0) AS avg_similarity,
   r.retrieved_chunks, r.selected_chunk_tokens, r.selected_pages, r.stitched, r.bridged
 FROM policy p JOIN (SELECT query_id, count(*) AS retrieved_chunks, sum(tokens) AS selected_chunk_tokens, count(DISTINCT page_url) AS selected_pages,
     count(*) FILTER (strategy <> 'selected') AS stitched, count(*) FILTER (strategy = 'bridge') AS bridged FROM ordered GROUP BY 1) r USING (query_id)
 JOIN (SELECT query_id, count(*) AS input_pages FROM {turn_basket} GROUP BY 1) i USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) AS candidates_found FROM lexical GROUP BY 1) l USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) AS filtered_by_similarity, bool_or(weak_match) AS weak FROM filtered GROUP BY 1) f USING (query_id)
 LEFT JOIN (SELECT query_id, avg(score) AS avg_similarity FROM filtered JOIN ordered USING (query_id, page_url, chunk_index) GROUP BY 1) s USING (query_id))"""


@checked("retrieval_stats", after(CAPPED, PICKED, BRIDGES, NEAR, QUEUE, STITCH_WALK, ORDERED, STATS, body="""
SELECT query_id, planner_mode, policy_name AS context_budget_policy, input_pages, candidates_found, filtered_by_similarity, weak AS similarity_fallback_used,
  round(avg_similarity, 6) AS avg_similarity, retrieved_chunks, CAST(selected_chunk_tokens AS BIGINT) AS selected_chunk_tokens, selected_pages,
  stitched AS stitched_chunks_added, bridged AS stitched_bridge_chunks_added FROM stats"""))
def retrieval_stats(t):
    return stats(t).select(
        "query_id", "planner_mode", "context_budget_policy", "input_pages", "candidates_found",
        "filtered_by_similarity", "similarity_fallback_used", "avg_similarity", "retrieved_chunks",
        "selected_chunk_tokens", "selected_pages", "stitched_chunks_added", "stitched_bridge_chunks_added",
    )


# A compact stats table for the confidence rules: everything from basket and turns.
FACTS = """SELECT q.query_id, q.question, q.mode, b.n AS input_pages, q.query_id % 3 AS selected_pages, q.query_id % 7 + 1 AS candidates_found,
  CASE q.query_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 ELSE 0.4 END AS avg_similarity, q.query_id % 11 = 0 AS retrieval_no_match_fallback_used,
  q.query_id % 5 = 0 AS similarity_fallback_used, CASE q.query_id % 2 WHEN 0 THEN 'lexical-fallback' ELSE 'dense+hybrid' END AS retrieval_strategy
FROM {turn_questions} q JOIN (SELECT query_id, count(*) AS n FROM {turn_basket} GROUP BY query_id) b ON b.query_id = q.query_id"""


def facts(t):
    from quillmine.checks.inputs import _REF

    return t.spark.sql(_REF.sub(lambda m: t._sql(m.group(1)), FACTS)).withColumn("avg_similarity", F.col("avg_similarity").cast("double"))


N = rules.CONFIDENCE_NOTES
HINT = f"CASE WHEN len({d.tokens('question')}) = 0 THEN '' ELSE ' that explicitly mentions ' || array_to_string(({d.tokens('question')})[1:3], ', ') END"
NEXT = f"""CASE WHEN input_pages >= 3 AND selected_pages <= 1 THEN {d.q(rules.NEXT_STEPS['tighten'])}
  WHEN mode = 'critique' THEN 'Pin acceptance criteria, QA notes, or edge-case details' || {HINT} || ' before retrying.'
  WHEN mode = 'diagram' THEN 'Pin an architecture, API, or flow document' || {HINT} || ' before asking for a diagram again.'
  ELSE 'Pin a more direct PRD, spec, or source page' || {HINT} || ', or rephrase the question using the document''s own terms.' END"""


@checked("confidence", f"""
WITH facts AS ({FACTS}), r AS (SELECT *, list_filter([CASE WHEN retrieval_no_match_fallback_used THEN {d.q(N['no_match'])} END,
   CASE WHEN similarity_fallback_used THEN {d.q(N['weak_scores'])} WHEN avg_similarity > 0 AND avg_similarity < 0.28 THEN {d.q(N['weak_average'])} END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN retrieval_strategy = 'lexical-fallback' THEN {d.q(N['lexical'])} END,
   CASE WHEN input_pages >= 3 AND selected_pages <= 1 THEN {d.q(N['single_page'])} END, CASE WHEN candidates_found <= 3 THEN {d.q(N['few'])} END], lambda x: x IS NOT NULL) AS soft FROM facts)
SELECT query_id, len(hard) > 0 OR len(soft) >= 2 AS low_confidence, CASE WHEN len(hard) > 0 OR len(soft) >= 2 THEN 'low' ELSE 'normal' END AS confidence_level,
  CASE WHEN len(hard) > 0 OR len(soft) >= 2 THEN 'Answer may be incomplete. ' || array_to_string((CASE WHEN len(hard) > 0 THEN hard ELSE soft END)[1:2], ' ') END AS confidence_note FROM r""")
def confidence(t):
    rows = facts(t)
    return sl.confidence(rows.drop("question", "mode"), rows).drop("confidence_next_step")


@checked("confidence_next_step", f"WITH facts AS ({FACTS}) SELECT query_id, {NEXT} AS advice FROM facts")
def confidence_next_step(t):
    single = (F.col("input_pages") >= 3) & (F.col("selected_pages") <= 1)
    return facts(t).select("query_id", sl.next_step(F.col("question"), F.col("mode"), single).alias("advice"))


def readable(t):
    """Picked chunks with their texts, in order of choice."""
    texts = t.line_chunks.select("page_url", "chunk_index", "text")
    return picked(t).join(texts, ["page_url", "chunk_index"]).withColumn("position", F.col("select_rank"))


TEXTS = """texts AS (SELECT s.*, c.text, c.page_title FROM picked s JOIN {line_chunks} c USING (page_url, chunk_index))"""


@checked("citations", after(CAPPED, PICKED, TEXTS, body="""
SELECT query_id, page_url, any_value(page_title) AS page_title, any_value(source_type) AS source_type,
  row_number() OVER (PARTITION BY query_id ORDER BY min(select_rank)) AS citation FROM texts GROUP BY 1, 2"""))
def citations(t):
    return sl.citations(readable(t))


@checked("context_text", after(CAPPED, PICKED, TEXTS, body="""
SELECT query_id, md5(string_agg('[CHUNK ' || CAST(select_rank AS VARCHAR) || ' - ' || upper(source_type) || ']' || chr(10) || 'Source: ' || page_title || chr(10) || 'URL: ' || page_url
  || chr(10) || 'Section: Part ' || CAST(chunk_index + 1 AS VARCHAR) || ' of ' || CAST(total_chunks AS VARCHAR) || chr(10) || chr(10) || text || chr(10),
  chr(10) || '---' || chr(10) || chr(10) ORDER BY select_rank)) AS context_md5, 'chunks' AS kind FROM texts GROUP BY 1
UNION ALL
SELECT query_id, md5(string_agg('[SOURCE ' || CAST(original_index + 1 AS VARCHAR) || ': ' || upper(source_type) || ']' || chr(10) || 'Title: ' || title || chr(10) || 'URL: ' || page_url
  || chr(10) || chr(10) || markdown || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY original_index)), 'pages'
FROM {turn_basket} JOIN {doc_pages} USING (page_url) GROUP BY 1"""))
def context_text(t):
    def digest(df, kind):
        return df.select("query_id", F.md5("context").alias("context_md5"), F.lit(kind).alias("kind"))

    return digest(sl.context_text(readable(t)), "chunks").union(
        digest(sl.page_context_text(t.turn_basket, t.doc_pages), "pages")
    )


@checked("prefilter_excerpts", after(CAPPED, PICKED, TEXTS, body=f"""
SELECT query_id, md5(string_agg('[' || CAST(select_rank AS VARCHAR) || '] source=' || page_title || ' type=' || source_type || ' section=' || CAST(chunk_index + 1 AS VARCHAR)
  || '/' || CAST(total_chunks AS VARCHAR) || ' text=' || substr({d.strip(d.collapse('text'))}, 1, 420), chr(10) ORDER BY select_rank)) AS excerpts_md5 FROM texts GROUP BY 1"""))
def prefilter_excerpts(t):
    return sl.prefilter_excerpts(readable(t)).select("query_id", F.md5("excerpts").alias("excerpts_md5"))


@checked("cost_estimate", """
SELECT o_orderkey, round(o_custkey * 40 / 1000000 * pin, 4) AS input_cost, round(o_orderkey * 20 / 1000000 * pout, 4) AS output_cost,
  round(o_custkey * 40 / 1000000 * pin + o_orderkey * 20 / 1000000 * pout, 4) AS total_cost, 'USD' AS currency
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 2.5 ELSE 3.0 END AS pin, CASE o_orderkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 10.0 ELSE 15.0 END AS pout FROM {orders})""")
def cost_estimate(t):
    provider = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'ollama' WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' ELSE 'other' END")
    cost = sl.cost_estimate(provider, F.col("o_custkey") * 40, F.col("o_orderkey") * 20)
    return t.orders.select("o_orderkey", cost.alias("c")).select("o_orderkey", "c.*")
