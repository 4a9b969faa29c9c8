"""From questions and pages to selected, cited and checked context, as one job.

    questions + basket + pages -> profiles -> dedupe -> chunks -> candidates -> scores
        -> selection -> stitching -> statistics, citations, conflicts, context

Stages that feed several later ones are checkpointed to the shared folder.  They are small:
a profile per basket row, twenty candidates per question.  Chunk texts are read again only
for the chunks that were selected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.operators import chunks as ch
from quillmine.operators import conflicts as cf
from quillmine.operators import corpus as cp
from quillmine.operators import dedup as dd
from quillmine.operators import pages as pg
from quillmine.operators import postings as po
from quillmine.operators import retrieve as rt
from quillmine.operators import select as sl
from quillmine.session import cut_lineage
from quillmine.sources import stores as st

MODELS = {"openai": ("summary", "summary"), "ollama": ("summary", "reasoning"), "anthropic": ("summary", "summary")}


@dataclass(frozen=True)
class Answer:
    """Tables of one run, keyed by query_id."""

    profiles: DataFrame
    dedup: DataFrame
    chunk_stats: DataFrame
    candidates: DataFrame
    filtered: DataFrame
    final: DataFrame
    stats: DataFrame
    summary: DataFrame
    confidence: DataFrame
    citations: DataFrame
    conflicts: DataFrame
    context: DataFrame
    rejected: DataFrame

    def records(self) -> DataFrame:
        stats = self.stats.join(self.confidence, "query_id").join(self.summary, "query_id")
        return st.answer_records(stats, self.citations, self.conflicts)


def answer_questions(
    questions: DataFrame,
    basket: DataFrame,
    pages: DataFrame,
    *,
    provider: str = "openai",
    models: dict[str, tuple[str, str]] | None = None,
    encoder_factory: Callable | None = None,
    pair_model: Callable | None = None,
    token_counter: Callable | None = None,
    policies: dict[str, dict] = rules.BUDGET_POLICIES,
    max_pages: int | None = None,
) -> Answer:
    """Run the whole path for a table of questions.

    questions(query_id, question, mode), basket(query_id, page_url, original_index,
    context_role), pages(page_url, title, markdown, source_type).  Without an encoder the
    lexical route is taken, as it is when a question has no embedding.

    ``pair_model``: ``(questions, chunk texts) -> scores`` over pandas series, asked for the best
    candidates of each question only.
    ``policies``: the limits by policy; each question gets as many candidates as its policy says.
    ``max_pages``: a request with more pages is refused as a whole and reported in ``rejected``, as
    the request parser does with ``rules.MAX_PAGES_PER_REQUEST``; by default none is.
    """
    sizes = basket.groupBy("query_id").agg(F.count("*").alias("n_pages"))
    rejected = sizes.filter(F.col("n_pages") > max_pages) if max_pages is not None else sizes.limit(0)
    if max_pages is not None:
        questions = questions.join(rejected, "query_id", "left_anti")
        basket = basket.join(rejected, "query_id", "left_anti")
    most = rt.largest_k(policies)

    planner = pg.planner_mode(questions, basket)
    walked = cut_lineage(dd.dedup_basket(pg.page_profiles(questions, basket, pg.page_features(pages), planner)))
    profiles = walked.filter(F.col("outcome") == "kept").drop("outcome", "walk")
    # one row of terms per page, so this is the semi join with the pages kept
    used = pages.select("page_url", "title", "source_type", "markdown").join(rt.asked_terms(questions, profiles), "page_url")
    chunks = ch.chunk_pages(used, carry=("asked",))
    # one Python pass over the texts; everything below reads keys, sizes and the terms that a question can meet
    index = cut_lineage(chunks.select(
        "page_url", "chunk_index", "total_chunks", "source_type", "page_title",
        F.length("text").alias("n_chars"), ch.token_count(F.col("text"), token_counter).alias("tokens"),
        rt.kept_terms(F.col("text"), F.col("asked")).alias("chunk_terms"),
    ))
    terms = index.select("page_url", "chunk_index", "chunk_terms")

    plans = planner.join(questions.select("query_id", "mode"), "query_id").withColumn("provider", F.lit(provider))
    policy = cut_lineage(rt.budget_policy(plans, models or MODELS, policies=policies))

    lexical = rt.lexical_candidates(rt.score_pairs(questions, profiles, terms), most)
    if encoder_factory is None:
        routed = lexical.select(
            "query_id", "page_url", "chunk_index", "original_index", "score", "rank"
        ).withColumn("strategy", F.lit("lexical-fallback"))
    else:
        vectors = ch.embed(
            chunks.select("page_url", "chunk_index",
                          ch.embedding_text(F.col("page_title"), F.col("source_type"), F.col("text")).alias("text")),
            encoder_factory=encoder_factory,
        )
        asked = ch.embed_questions(questions, encoder_factory=encoder_factory)
        routed = rt.route_candidates(rt.dense_candidates(asked, profiles, vectors, most), lexical)
    limit = policy.select("query_id", "max_candidates")
    # read twice, for the candidates and for the questions without any
    routed = cut_lineage(routed.join(limit, "query_id").filter(F.col("rank") <= F.col("max_candidates")).drop("max_candidates"))
    spare = rt.priority_fallback(questions, routed, profiles, index, most).withColumn("strategy", F.lit("lexical-fallback"))
    found = routed.withColumn("no_match", F.lit(False)).unionByName(
        spare.join(limit, "query_id").filter(F.col("rank") <= F.col("max_candidates")).drop("max_candidates")
        .withColumn("no_match", F.lit(True))
    )
    candidates = cut_lineage(rt.with_overlaps(found, questions, profiles, terms))
    scored = rt.hybrid_scores(candidates)
    if pair_model is not None:
        scored = cut_lineage(scored)
        wanted = scored.filter(F.col("rank") <= rules.RERANK_TOP).select("page_url").distinct()
        read = ch.chunk_pages(pages.join(wanted, "page_url", "left_semi"))
        scored = rt.rerank_scores(rt.model_scores(scored, questions, read, pair_model), F.col("model_score")).drop("model_score")
    filtered = cut_lineage(rt.threshold(rt.page_quality_scores(scored, profiles)))

    sizes = index.select("page_url", "chunk_index", "total_chunks", "source_type", "page_title", "tokens")
    rows = filtered.join(sizes, ["page_url", "chunk_index"])
    selected = cut_lineage(sl.select_budget(sl.with_caps(rows, policy, rt.source_caps(profiles))))
    added = sl.stitch_select(sl.stitch_queue(selected, policy), selected, policy, sizes.select("page_url", "chunk_index", "tokens"))
    final = cut_lineage(sl.stitch_order(selected, added))

    # only pages with a selected chunk are read and cut once more
    shown = ch.chunk_pages(pages.join(final.select("page_url").distinct(), "page_url", "left_semi"))
    texts = shown.select("page_url", "chunk_index", "total_chunks", "source_type", "page_title", "text")
    readable = cut_lineage(final.join(texts, ["page_url", "chunk_index"]))
    claims = cut_lineage(cf.claims(cf.sentences(readable)))
    # a row per question, read by itself and for its confidence
    stats = cut_lineage(sl.retrieval_stats(policy, candidates, filtered, final, basket))
    totals = index.groupBy("page_url").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    chunk_stats = profiles.select("query_id", "page_url").join(totals, "page_url").groupBy("query_id").agg(
        F.sum("n").alias("total_chunks"), F.sum("chars").alias("total_chars"), F.count("*").alias("pages_count")
    )
    return Answer(
        profiles=profiles, dedup=dd.dedup_stats(walked), chunk_stats=chunk_stats, candidates=candidates,
        filtered=filtered, final=final, stats=stats,
        summary=sl.selection_summary(final, filtered, profiles),
        confidence=sl.confidence(stats, questions), citations=sl.citations(readable),
        conflicts=cf.top_conflicts(cf.pairs(claims), claims), context=sl.context_text(readable),
        rejected=rejected,
    )


def corpus_rows(pages: DataFrame) -> DataFrame:
    """What a search reads of a corpus: chunk keys and term sets, with the page's content signature."""
    signed = pages.withColumns(
        {"heading_terms": pg.heading_terms(F.col("markdown")), "content_signature": pg.content_signature(F.col("markdown"))}
    )
    # heading terms travel with the page through the splitter: no join back
    return ch.chunk_pages(signed, carry=("heading_terms", "content_signature")).select(
        "content_signature", "page_url", "chunk_index", tx.token_set(F.col("text")).alias("chunk_terms"),
        tx.token_set(F.col("page_title")).alias("title_terms"), "heading_terms",
    )


def extend_corpus(pages: DataFrame, path: str) -> DataFrame:
    """Add the pages whose text is new to the stored corpus at ``path`` and return it.

    Pages seen before are neither cut nor tokenised again.  The folder is made when missing.
    """
    spark = pages.sparkSession
    fresh = st.unseen_pages(pages, spark.read.parquet(path)) if stored(spark, path) else st.without_copies(pages)
    rows = corpus_rows(fresh)
    st.append(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def extend_index(pages: DataFrame, path: str) -> DataFrame:
    """Add the pages whose text is new to the stored inverted index at ``path`` and return it.

    One table holds postings, chunk keys and the signatures of the texts, so an extension is one append: a
    failed one leaves nothing half indexed.  Of the stored rows only the signatures, once a range, are read.
    Rows of a file lie by term, which lets a reader skip pages of the file.
    """
    spark = pages.sparkSession
    if stored(spark, path):
        seen = spark.read.schema(po.INDEX_SCHEMA).parquet(path).filter("term IS NULL").select(
            F.explode("signatures").alias("content_signature"))
        fresh = st.unseen_pages(pages, seen)
    else:
        fresh = st.without_copies(pages)
    st.append(po.index_chunks(corpus_rows(fresh)).sortWithinPartitions("term", "range"), path)
    return spark.read.schema(po.INDEX_SCHEMA).parquet(path)


def stored(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def search_rows(questions: DataFrame, rows: DataFrame, k: int = rt.MAX_K) -> DataFrame:
    """The best chunks of a corpus, given as ``corpus_rows``, per question: lexical top k, hybrid
    score, threshold and the place of the page among the citations."""
    return cited(cp.corpus_topk(asked_terms(questions), rows, k))


def search_stored(questions: DataFrame, index: DataFrame, k: int = rt.MAX_K) -> DataFrame:
    """``search_rows`` over the index that ``extend_index`` keeps."""
    return cited(po.search_index(asked_terms(questions), index, k))


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", tx.token_set(F.col("question")).alias("query_terms"))


def cited(found: DataFrame) -> DataFrame:
    kept = rt.threshold(rt.hybrid_scores(found))
    first = F.min("rank").over(Window.partitionBy("query_id", "page_url"))
    placed = kept.withColumn("first_rank", first)
    citation = F.dense_rank().over(rt.per_query().orderBy("first_rank"))
    return placed.select(
        "query_id", "page_url", "chunk_index", "rank", "score", "weak_match", citation.alias("citation")
    )


def search_corpus(questions: DataFrame, pages: DataFrame, k: int = rt.MAX_K) -> DataFrame:
    """``search_rows`` over a table of pages without its copies."""
    return search_rows(questions, corpus_rows(st.without_copies(pages)), k)
