"""Candidates and scores.

The only pass that touches every (question, chunk) pair of the baskets carries term sets,
not texts, and scores a pair in the row where the join makes it.  What is shuffled after
that is four numbers per pair, cut to the top k before the exchange by the partial window
limit.  Every later stage works on at most twenty rows per question.

A candidate row is (query_id, page_url, chunk_index, score, rank, ...): ``rank`` is the
place after the stage that made it and breaks ties in the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.functions import vectors as vx

def largest_k(policies: dict[str, dict] = rules.BUDGET_POLICIES) -> int:
    """The most candidates any policy of the table allows; a question's own policy cuts further."""
    return max(values["max_candidates"] for values in policies.values())


MAX_K = largest_k()
#: Question terms that a page hands to each of its chunks at most, and questions whose terms are collected for it.
ASKED_TERMS = 256
ASKED_BY = 64


def per_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(per_query().orderBy(*order)))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """Chunk keys with their term sets; the text stays behind."""
    return chunks.select("page_url", "chunk_index", tx.token_set(F.col("text")).alias("chunk_terms"))


def query_terms(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", tx.token_set(F.col("question")).alias("query_terms"))


def asked_terms(questions: DataFrame, profiles: DataFrame, most: int = ASKED_TERMS) -> DataFrame:
    """(page_url, asked): the terms that the questions of a page's baskets ask for, in one string; one row per page.

    Overlaps count question terms only, so no other term of the page's chunks needs to be kept.  ``asked`` is null
    for a page with more than ``most`` such terms or ``ASKED_BY`` questions: its chunks keep all of theirs.
    """
    met = profiles.select("query_id", "page_url").join(query_terms(questions), "query_id")
    # a page of a million baskets passes on a few questions only
    some = met.withColumn("n", F.row_number().over(Window.partitionBy("page_url").orderBy("query_id"))).filter(F.col("n") <= ASKED_BY + 1)
    found = some.groupBy("page_url").agg(F.count("*").alias("by"), F.array_distinct(F.flatten(F.collect_list("query_terms"))).alias("terms"))
    few = (F.col("by") <= ASKED_BY) & (F.size("terms") <= most)
    return found.select("page_url", F.when(few, F.array_join("terms", " ")).alias("asked"))


def kept_terms(text: Column, asked: Column) -> Column:
    """Term set of a chunk without the terms that ``asked_terms`` leaves out."""
    terms = tx.token_set(text)
    return F.when(asked.isNull(), terms).otherwise(F.array_intersect(terms, F.split(asked, " ")))


def score_pairs(questions: DataFrame, profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (question, chunk) pair of the baskets with its term overlap."""
    asked = profiles.select(
        "query_id", "page_url", "original_index", "title_overlap", "heading_overlap"
    ).join(query_terms(questions), "query_id")
    return asked.join(terms, "page_url").select(
        "query_id", "page_url", "chunk_index", "original_index", "title_overlap", "heading_overlap",
        tx.overlap_share(F.col("query_terms"), F.col("chunk_terms")).alias("chunk_overlap"),
        (F.size("query_terms") > 0).alias("has_terms"),
    )


def lexical_score() -> Column:
    """No question terms give overlaps of 0 and so a score of 0."""
    w = rules.LEXICAL_WEIGHTS
    return (
        F.col("chunk_overlap") * w["chunk"] + F.col("title_overlap") * w["title"]
        + F.col("heading_overlap") * w["heading"]
    )


def top_candidates(scored: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """Best ``max_k`` chunks per question; corpus order breaks ties."""
    return ranked(scored, F.desc("score"), F.col("original_index"), F.col("chunk_index")).filter(
        F.col("rank") <= max_k
    )


def lexical_candidates(pairs: DataFrame, max_k: int = MAX_K) -> DataFrame:
    scored = pairs.filter(F.col("has_terms")).withColumn("score", lexical_score())
    return top_candidates(scored.filter(F.col("score") > 0), max_k)


def dense_candidates(
    question_vectors: DataFrame, basket: DataFrame, chunk_vectors: DataFrame, max_k: int = MAX_K
) -> DataFrame:
    """Exact cosine top-k inside each basket.

    Vectors get unit length once per question and once per chunk, so a pair costs one product.  Scores are
    rounded to 12 digits: equal texts then tie, whatever the order of a sum, and corpus order breaks the tie.
    """
    asked = basket.select("query_id", "page_url", "original_index").join(
        question_vectors.select("query_id", vx.normalize(F.col("embedding")).alias("q")), "query_id"
    )
    unit = chunk_vectors.select("page_url", "chunk_index", vx.normalize(F.col("embedding")).alias("c"))
    scored = asked.join(unit, "page_url").select(
        "query_id", "page_url", "chunk_index", "original_index", F.round(vx.dot_batches(F.col("q"), F.col("c")), 12).alias("score")
    )
    return top_candidates(scored, max_k)


def route_candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Dense rows where a question has any, else its lexical rows, labelled.

    Both lists are cut to the top k already, so a window over their union decides; an anti join
    would compute the dense side twice.
    """
    columns = ["query_id", "page_url", "chunk_index", "original_index", "score", "rank"]
    both = dense.select(*columns).withColumn("strategy", F.lit("dense+hybrid")).unionByName(
        lexical.select(*columns).withColumn("strategy", F.lit("lexical-fallback"))
    )
    is_dense = F.col("strategy") == "dense+hybrid"
    return both.withColumn("any_dense", F.max(is_dense).over(per_query())).filter(
        is_dense | ~F.col("any_dense")
    ).drop("any_dense")


def priority_fallback(
    questions: DataFrame, candidates: DataFrame, profiles: DataFrame, chunks: DataFrame, max_k: int = MAX_K
) -> DataFrame:
    """First chunks of the best pages, for the questions that have no candidate."""
    empty = questions.select("query_id").join(
        candidates.select("query_id").distinct(), "query_id", "left_anti"
    )
    pages = ranked(
        profiles.join(empty, "query_id", "left_semi"),
        F.desc("priority"), F.desc("title_overlap"), F.desc("heading_overlap"), F.col("original_index"),
        name="page_rank",
    )
    first = chunks.filter(F.col("chunk_index") < rules.FALLBACK_CHUNKS_PER_PAGE).select("page_url", "chunk_index")
    shape = rules.FALLBACK_SCORE
    rows = pages.join(first, "page_url").select(
        "query_id", "page_url", "chunk_index", "original_index", "page_rank",
        F.greatest(F.lit(shape["floor"]), F.col("priority") * shape["share"]).alias("score"),
    )
    return (
        ranked(rows, F.col("page_rank"), F.col("chunk_index"))
        .filter(F.col("rank") <= max_k)
        .drop("page_rank")
    )


def with_overlaps(candidates: DataFrame, questions: DataFrame, profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates with the overlaps the later scores need; candidates are the small side."""
    if "chunk_overlap" in candidates.columns:
        return candidates
    asked = candidates.join(query_terms(questions), "query_id")
    shares = profiles.select("query_id", "page_url", "title_overlap", "heading_overlap")
    # terms end here: the next join moves numbers
    return (
        asked.join(terms, ["page_url", "chunk_index"])
        .withColumn("chunk_overlap", tx.overlap_share(F.col("query_terms"), F.col("chunk_terms")))
        .withColumn("has_terms", F.size("query_terms") > 0)
        .drop("query_terms", "chunk_terms")
        .join(shares, ["query_id", "page_url"], "left")
    )


def hybrid_scores(candidates: DataFrame) -> DataFrame:
    """Blend the base score with the overlaps; without question terms it stays."""
    w = rules.HYBRID_WEIGHTS
    blend = (
        F.col("score") * w["base"] + F.col("chunk_overlap") * w["chunk"] + F.col("title_overlap") * w["title"]
    )
    scored = candidates.withColumn("score", F.when(F.col("has_terms"), blend).otherwise(F.col("score")))
    return ranked(scored, F.desc("score"), F.col("rank"))


def rerank_scores(candidates: DataFrame, model_score: Column | None, top: int = rules.RERANK_TOP) -> DataFrame:
    """Blend a pair model into the best rows; the rest keep their place behind them."""
    if model_score is None:
        return candidates
    w = rules.RERANK_WEIGHTS
    head = F.col("rank") <= top
    mixed = tx.sigmoid_unit(model_score) * w["model"] + F.col("score") * w["prior"]
    scored = candidates.withColumn("score", F.when(head, mixed).otherwise(F.col("score")))
    return ranked(scored, F.desc(head), F.when(head, F.col("score")).desc_nulls_last(), F.col("rank"))


def pair_text(title: Column, source_type: Column, index: Column, total: Column, text: Column) -> Column:
    """What a pair model reads for one chunk."""
    return F.concat(
        F.lit("Title: "), title, F.lit("\nSource type: "), source_type, F.lit("\nChunk "),
        (index + 1).cast("string"), F.lit(" of "), total.cast("string"), F.lit("\nContent:\n"), text,
    )


def pair_scorer(scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """Wrap a caller's ``(questions, texts) -> scores`` as a Column function."""

    @F.pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        return scorer(question, text)

    return score


def model_scores(
    candidates: DataFrame, questions: DataFrame, chunks: DataFrame,
    scorer: Callable[[pd.Series, pd.Series], pd.Series], top: int = rules.RERANK_TOP,
) -> DataFrame:
    """Candidates with ``model_score`` for the best ``top`` rows of each question, null behind them.

    chunks(page_url, chunk_index, total_chunks, page_title, source_type, text).  Question and chunk
    texts are joined to those rows alone, and the caller's ``(questions, texts) -> scores`` runs once
    over each pair, batch by batch.
    """
    keys = ["query_id", "page_url", "chunk_index"]
    read = pair_text(F.col("page_title"), F.col("source_type"), F.col("chunk_index"), F.col("total_chunks"), F.col("text"))
    texts = chunks.select("page_url", "chunk_index", read.alias("pair_text"))
    head = candidates.filter(F.col("rank") <= top).select(*keys)
    pairs = head.join(texts, ["page_url", "chunk_index"]).join(questions.select("query_id", "question"), "query_id")
    scored = pairs.select(*keys, pair_scorer(scorer)(F.col("question"), F.col("pair_text")).alias("model_score"))
    return candidates.join(scored, keys, "left")


def page_quality_scores(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Weight by page priority; rows without a profile keep their score."""
    w = rules.PAGE_QUALITY_WEIGHTS
    facts = profiles.select(
        "query_id", "page_url", "priority", "role",
        F.col("title_overlap").alias("p_title"), F.col("heading_overlap").alias("p_heading"),
    )
    rows = candidates.drop("priority", "role").join(facts, ["query_id", "page_url"], "left")
    adjusted = F.col("score") * F.col("priority") + (
        F.col("p_title") * w["title"] + F.col("p_heading") * w["heading"]
    )
    lead = (F.col("chunk_index") == 0) & F.col("role").isin(*rules.LEAD_CHUNK_ROLES)
    adjusted = F.when(lead, adjusted + w["lead_chunk"]).otherwise(adjusted)
    scored = rows.withColumn(
        "score", F.when(F.col("priority").isNull(), F.col("score")).otherwise(adjusted)
    ).drop("p_title", "p_heading")
    return ranked(
        scored, F.desc("score"), F.coalesce("priority", F.lit(1.0)).desc(), F.col("rank")
    )


def threshold(candidates: DataFrame, least: float = rules.SIMILARITY_THRESHOLD) -> DataFrame:
    """Rows above the threshold, or the best five where a question has none."""
    strong = F.col("score") > least
    some = F.max(strong).over(per_query())
    kept = candidates.withColumn("weak_match", ~some).filter(
        strong | (F.col("weak_match") & (F.col("rank") <= rules.SIMILARITY_FALLBACK_COUNT))
    )
    return ranked(kept, F.col("rank"))


# --- limits -----------------------------------------------------------------


def page_caps(priority: Column, policy_cap: Column) -> Column:
    cap = F.lit(rules.PAGE_CAP_DEFAULT)
    for least, value in reversed(rules.PAGE_CAP_STEPS):
        cap = F.when(priority >= least, value).otherwise(cap)
    return F.least(cap, policy_cap)


def source_caps(profiles: DataFrame) -> DataFrame:
    """(query_id, source_type, source_cap); no rows for questions with one source type."""
    counts = profiles.groupBy("query_id", "planner_mode", "source_type").agg(F.count("*").alias("n_pages"))
    mode, n = F.col("planner_mode"), F.col("n_pages")
    cap = (
        F.when(mode.startswith("compare"), F.when(n <= 2, 2).otherwise(3))
        .when(mode.startswith("current-page"), 2)
        .otherwise(F.when(n <= 3, 3).otherwise(4))
    )
    return (
        counts.withColumn("n_types", F.count("*").over(per_query()))
        .filter(F.col("n_types") > 1)
        .select("query_id", "source_type", cap.alias("source_cap"))
    )


def budget_policy(
    plans: DataFrame,
    models: dict[str, tuple[str, str]],
    hybrid_cloud: str = "openai",
    policies: dict[str, dict] = rules.BUDGET_POLICIES,
) -> DataFrame:
    """Limits per question.

    plans(query_id, mode, planner_mode, provider); models: provider -> (summary, reasoning).
    Limits are literals in CASE branches: the policy table is a handful of fixed values.
    """
    mode, plan, provider = F.col("mode"), F.col("planner_mode"), F.col("provider")
    route = F.when(mode.isin("critique", "diagram"), "reasoning").otherwise("summary")
    compare = plan.startswith("compare")
    focus = plan.startswith("current-page") | plan.startswith("single-doc")
    cloud = F.when(provider == "hybrid", hybrid_cloud).otherwise(provider)

    def model(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for name, pair in models.items() for x in (name, pair[i])])
        return F.element_at(table, cloud)

    target = F.when(route == "reasoning", model(1)).otherwise(model(0))
    name = (
        F.when((provider == "ollama") & (route == "summary"), "ollama-summary-tight")
        .when(provider == "ollama", "ollama-reasoning-balanced")
        .when((route == "reasoning") & (model(1) != model(0)), "reasoning-route-balanced")
        .otherwise("default-shared-context")
    )

    def limit(key: str) -> Column:
        out = F.lit(None).cast("int")
        for policy, values in policies.items():
            out = F.when(F.col("policy_name") == policy, F.lit(values[key]).cast("int")).otherwise(out)
        return out

    def either(flag: Column, key: str, other: str) -> Column:
        return F.when(flag, limit(other)).otherwise(limit(key))

    reserve = F.element_at(
        F.create_map(*[F.lit(x) for pair in rules.RESERVE_TOKENS.items() for x in pair]), mode
    )
    return plans.withColumns({"model_route": route, "target_model": target, "policy_name": name}).select(
        "query_id", "planner_mode", "policy_name", "provider", "model_route", "target_model",
        limit("max_candidates").alias("max_candidates"),
        either(compare, "max_total_chunks", "max_total_chunks_compare").alias("max_total_chunks"),
        limit("max_chunks_per_page").alias("max_chunks_per_page"),
        F.coalesce(
            either(compare, "max_input_tokens", "max_input_tokens_compare"),
            F.lit(rules.MAX_INPUT_TOKENS) - reserve,
        ).cast("long").alias("max_input_tokens"),
        limit("max_stitched_chunks").alias("max_stitched_chunks"),
        F.coalesce(
            limit("stitch_edge_radius"), F.when(compare, 1).when(focus, 2).otherwise(1)
        ).alias("edge_radius"),
        F.coalesce(
            either(focus, "stitch_max_bridge_gap", "stitch_max_bridge_gap_focus"),
            F.when(focus, 2).otherwise(1),
        ).alias("bridge_gap"),
    )
