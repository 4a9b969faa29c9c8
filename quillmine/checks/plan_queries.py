"""Checked queries: whole paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.checks import duck as d
from quillmine.checks.page_queries import questions
from quillmine.checks.registry import checked
from quillmine.functions import text as tx
from quillmine.operators import corpus as cp
from quillmine.operators import postings as po
from quillmine.plans import answer as an


def passages(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


CORPUS_TOPK = f"""
WITH q AS (SELECT item_id AS query_id, {d.token_set('text')} AS terms FROM {{benchmark}}),
c AS (SELECT page_url, chunk_index, {d.token_set('text')} AS terms, {d.token_set('page_title')} AS titles FROM {{line_chunks}}),
qt AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q),
hits AS (SELECT page_url, chunk_index, query_id, any_value(n) AS n, count(*) AS m FROM (SELECT page_url, chunk_index, unnest(terms) AS term FROM c) JOIN qt USING (term) GROUP BY 1, 2, 3),
thits AS (SELECT page_url, query_id, any_value(n) AS n, count(*) AS m FROM (SELECT DISTINCT page_url, unnest(titles) AS term FROM c) JOIN qt USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, page_url, chunk_index, m / n AS chunk_overlap, coalesce(t.m / t.n, 0) AS title_overlap,
   (m / n * 0.7::DOUBLE + coalesce(t.m / t.n, 0) * 0.2::DOUBLE + 0.0::DOUBLE * 0.1::DOUBLE) AS score FROM (
     SELECT c.page_url, c.chunk_index, x.query_id, coalesce(h.m, 0) AS m, x.n FROM (SELECT page_url, chunk_index, query_id, n FROM hits
        UNION SELECT c.page_url, c.chunk_index, th.query_id, th.n FROM thits th JOIN c USING (page_url)) x JOIN c USING (page_url, chunk_index)
        LEFT JOIN hits h ON h.page_url = x.page_url AND h.chunk_index = x.chunk_index AND h.query_id = x.query_id) b
   LEFT JOIN (SELECT page_url AS pu, query_id AS qi, n AS tn, m AS tm FROM thits) tt ON tt.pu = b.page_url AND tt.qi = b.query_id
   LEFT JOIN thits t ON t.page_url = b.page_url AND t.query_id = b.query_id)
SELECT query_id, rank, page_url, chunk_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_url, chunk_index) AS rank FROM s) WHERE rank <= 20
""".replace("m / n AS chunk_overlap", "b.m / b.n AS chunk_overlap").replace("(m / n * 0.7", "(b.m / b.n * 0.7").replace("SELECT query_id, page_url, chunk_index, b.m", "SELECT b.query_id, b.page_url, b.chunk_index, b.m")


def corpus_rows(t):
    asked = passages(t).select("query_id", tx.token_set(F.col("question")).alias("query_terms"))
    rows = t.line_chunks.select(
        "page_url", "chunk_index", tx.token_set(F.col("text")).alias("chunk_terms"),
        tx.token_set(F.col("page_title")).alias("title_terms"), F.array().cast("array<string>").alias("heading_terms"),
    )
    return asked, rows


@checked("lex_topk_corpus", CORPUS_TOPK)
def lex_topk_corpus(t):
    return cp.corpus_topk(*corpus_rows(t)).select("query_id", "rank", "page_url", "chunk_index", "score")


@checked("lex_topk_index", CORPUS_TOPK)
def lex_topk_index(t):
    """The same search over a stored inverted index."""
    from quillmine.checks.response_queries import fresh_table
    from quillmine.sources import stores as st

    asked, rows = corpus_rows(t)
    path = fresh_table(t, "postings")
    st.append(po.index_chunks(rows), path)
    index = t.spark.read.schema(po.INDEX_SCHEMA).parquet(path)
    return po.search_index(asked, index).select("query_id", "rank", "page_url", "chunk_index", "score")


@checked("corpus_search")
def corpus_search(t):
    return an.search_corpus(passages(t), t.doc_pages)


@checked("answer_path")
def answer_path(t):
    """Statistics and confidence of every question over its basket, whole texts chunked."""
    result = an.answer_questions(questions(t), t.turn_basket, t.doc_pages)
    return result.stats.join(result.confidence, "query_id")


@checked("sink_results")
def sink_results(t):
    """Nested answer records, written and read back."""
    from quillmine.checks.response_queries import fresh_table
    from quillmine.sources import stores as st

    result = an.answer_questions(questions(t), t.turn_basket, t.doc_pages)
    path = fresh_table(t, "answers")
    st.append(result.records(), path)
    rows = t.spark.read.parquet(path)
    return rows.select("query_id", "stats.retrieved_chunks", F.size("citations").alias("n_citations"),
                       F.col("citations")[0]["page_url"].alias("first_page"))
