"""Budgeted selection, neighbour stitching and what is reported about them.

Selection is sequential by nature, but its input is the candidate list of one question, at
most twenty rows, so it runs as a fold over one sorted array inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.operators.retrieve import page_caps, per_query, ranked

ITEM = "struct<rank:int,page_url:string,source_type:string,tokens:bigint,page_cap:int,source_cap:int>"
STATE = f"struct<taken:array<{ITEM}>,later:array<{ITEM}>,used:bigint>"


def with_caps(candidates: DataFrame, policy: DataFrame, caps: DataFrame) -> DataFrame:
    """Candidates with their page cap, source cap and the limits of their question."""
    limits = policy.select("query_id", "max_total_chunks", "max_chunks_per_page", "max_input_tokens")
    rows = candidates.join(limits, "query_id").join(caps, ["query_id", "source_type"], "left")
    return rows.withColumn("page_cap", page_caps(F.col("priority"), F.col("max_chunks_per_page")))


def select_budget(rows: DataFrame) -> DataFrame:
    """Chosen rows with ``select_rank``, their order of choice.

    First pass: the best row always, then at most one chunk per page.  Second pass: what was
    put off, under the page caps.  A row that does not fit is skipped, not a stop.
    """
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), "page_url", "source_type",
        F.col("tokens").cast("long").alias("tokens"),
        F.greatest(F.lit(1), F.col("page_cap")).cast("int").alias("page_cap"),
        # greatest() skips nulls, and no source cap means no limit
        F.when(F.col("source_cap").isNotNull(), F.greatest(F.lit(1), F.col("source_cap"))).cast("int").alias("source_cap"),
    )
    grouped = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.first("max_total_chunks").alias("chunk_cap"),
        F.first("max_input_tokens").alias("budget"),
    )
    none = F.array().cast(f"array<{ITEM}>")
    start = F.struct(none.alias("taken"), none.alias("later"), F.lit(0).cast("long").alias("used")).cast(STATE)

    def count(taken: Column, field: str, row: Column) -> Column:
        return F.size(F.filter(taken, lambda t: t[field] == row[field]))

    def allowed(state: Column, row: Column, page_cap: Column) -> Column:
        taken = state["taken"]
        return (
            (F.size(taken) < F.coalesce("chunk_cap", F.size("items")))
            & (count(taken, "page_url", row) < page_cap)
            & (count(taken, "source_type", row) < F.coalesce(row["source_cap"], F.size("items")))
            & (state["used"] + row["tokens"] <= F.col("budget"))
        )

    def step(page_cap, forced):
        def merge(state: Column, row: Column) -> Column:
            take = allowed(state, row, page_cap(row))
            if forced:
                take = take | (F.size(state["taken"]) == 0)
            return F.struct(
                F.when(take, F.concat(state["taken"], F.array(row))).otherwise(state["taken"]).alias("taken"),
                F.when(take, state["later"]).otherwise(F.concat(state["later"], F.array(row))).alias("later"),
                (state["used"] + F.when(take, row["tokens"]).otherwise(F.lit(0).cast("long"))).alias("used"),
            ).cast(STATE)

        return merge

    first = grouped.withColumn("first", F.aggregate("items", start, step(lambda row: F.lit(1), True)))
    second = first.withColumn(
        "done", F.aggregate("first.later", F.col("first"), step(lambda row: row["page_cap"], False))
    )
    chosen = second.select("query_id", F.posexplode("done.taken").alias("pos", "row")).select(
        "query_id", F.col("row.rank").alias("rank"), (F.col("pos") + 1).alias("select_rank")
    )
    return rows.join(chosen, ["query_id", "rank"])


# --- stitching: selected(query_id, page_url, chunk_index, total_chunks, select_rank, score, priority, tokens)


def stitch_bridges(selected: DataFrame, policy: DataFrame) -> DataFrame:
    """Chunks in small gaps between two selected chunks of a page."""
    page = Window.partitionBy("query_id", "page_url").orderBy("chunk_index")
    pairs = selected.withColumns(
        {
            "next_index": F.lead("chunk_index").over(page),
            "next_score": F.lead("score").over(page),
        }
    ).join(policy.select("query_id", "bridge_gap"), "query_id")
    gap = F.col("next_index") - F.col("chunk_index") - 1
    return pairs.filter(gap.between(1, F.col("bridge_gap"))).select(
        "query_id", "page_url",
        F.explode(F.sequence(F.col("chunk_index") + 1, F.col("next_index") - 1)).alias("chunk_index"),
        F.lit(0).alias("strategy_rank"), gap.cast("long").alias("distance"),
        F.greatest("score", "next_score").alias("anchor_score"),
        F.col("chunk_index").alias("anchor_index"), F.lit(0).cast("long").alias("offset"),
    )


def stitch_neighbours(selected: DataFrame, policy: DataFrame) -> DataFrame:
    """Unselected chunks within the edge radius of a selected one."""
    around = selected.join(policy.select("query_id", "edge_radius"), "query_id").withColumn(
        "offset", F.explode(F.sequence(-F.col("edge_radius"), F.col("edge_radius")))
    )
    place = F.col("chunk_index") + F.col("offset")
    near = around.filter(
        (F.col("offset") != 0) & (place >= 0) & (place < F.col("total_chunks"))
    ).select(
        "query_id", "page_url", place.alias("chunk_index"), F.lit(1).alias("strategy_rank"),
        F.abs("offset").cast("long").alias("distance"), F.col("score").alias("anchor_score"),
        F.col("chunk_index").alias("anchor_index"), F.col("offset").cast("long").alias("offset"),
    )
    return near.join(
        selected.select("query_id", "page_url", "chunk_index"), ["query_id", "page_url", "chunk_index"], "left_anti"
    )


def stitch_queue(selected: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per chunk to add: the strategy that queued it first."""
    queued = stitch_bridges(selected, policy).unionByName(stitch_neighbours(selected, policy))
    order = F.struct("strategy_rank", "anchor_index", F.abs("offset").alias("a"), F.col("offset").alias("o"))
    best = queued.groupBy("query_id", "page_url", "chunk_index").agg(
        F.min_by(F.struct("strategy_rank", "distance", "anchor_score"), order).alias("b")
    )
    pages = selected.groupBy("query_id", "page_url").agg(
        F.min("select_rank").alias("page_rank"), F.first("priority").alias("priority")
    )
    return best.join(pages, ["query_id", "page_url"]).select(
        "query_id", "page_url", "chunk_index", "page_rank", "priority", "b.*"
    )


def stitch_select(queue: DataFrame, selected: DataFrame, policy: DataFrame, sizes: DataFrame) -> DataFrame:
    """Queue entries that fit; sizes(page_url, chunk_index, tokens).

    Too large ones are skipped; a skipped one does not end the walk.
    """
    rows = queue.join(sizes, ["page_url", "chunk_index"])
    item = F.struct(
        "strategy_rank", "page_rank", (-F.coalesce("priority", F.lit(1.0))).alias("p"),
        (-F.col("anchor_score")).alias("s"), "distance", "chunk_index", "page_url",
        F.col("tokens").cast("long").alias("tokens"),
    )
    used = selected.groupBy("query_id").agg(F.sum("tokens").cast("long").alias("used"))
    grouped = (
        rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
        .join(used, "query_id")
        .join(policy.select("query_id", "max_stitched_chunks", "max_input_tokens"), "query_id")
    )
    state = "struct<taken:array<int>,at:int,used:bigint>"
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"), F.col("used")).cast(state)

    def merge(acc: Column, row: Column) -> Column:
        fits = (
            F.size(acc["taken"]) < F.coalesce("max_stitched_chunks", F.size("items"))
        ) & (acc["used"] + row["tokens"] <= F.col("max_input_tokens"))
        return F.struct(
            F.when(fits, F.concat(acc["taken"], F.array(acc["at"]))).otherwise(acc["taken"]).alias("taken"),
            (acc["at"] + 1).alias("at"),
            (acc["used"] + F.when(fits, row["tokens"]).otherwise(F.lit(0).cast("long"))).alias("used"),
        ).cast(state)

    done = grouped.withColumn("taken", F.aggregate("items", start, merge, lambda s: s["taken"]))
    return done.select("query_id", "items", F.explode("taken").alias("i")).select(
        "query_id", F.col("items")[F.col("i")].alias("row")
    ).select(
        "query_id", "row.page_url", "row.chunk_index", "row.tokens",
        F.when(F.col("row.strategy_rank") == 0, "bridge").otherwise("adjacent").alias("strategy"),
    )


def stitch_order(selected: DataFrame, added: DataFrame) -> DataFrame:
    """Final reading order.

    With additions: pages in order of first selection, chunks by index.  A question without
    additions keeps its order of selection.
    """
    both = selected.select(
        "query_id", "page_url", "chunk_index", "tokens", "select_rank", F.lit("selected").alias("strategy")
    ).unionByName(
        added.select("query_id", "page_url", "chunk_index", "tokens", "strategy").withColumn(
            "select_rank", F.lit(None).cast("int")
        )
    )
    page = Window.partitionBy("query_id", "page_url")
    placed = both.withColumns(
        {
            "page_rank": F.min("select_rank").over(page),
            "stitched": F.max(F.col("strategy") != "selected").over(per_query()),
        }
    )
    by_page = F.when(F.col("stitched"), F.col("page_rank")).otherwise(F.col("select_rank"))
    return ranked(placed, by_page, F.col("chunk_index"), name="position").drop("page_rank")


# --- reports ------------------------------------------------------------------


def selection_summary(final: DataFrame, candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Labels of the first four used pages and the three best unused ones."""
    label = tx.page_label(F.col("title"), F.col("role"), F.col("source_type"))
    labels = profiles.select("query_id", "page_url", label.alias("label"))
    used = final.groupBy("query_id", "page_url").agg(F.min("position").alias("at"))
    unused = (
        candidates.groupBy("query_id", "page_url").agg(F.min("rank").alias("at"))
        .join(used, ["query_id", "page_url"], "left_anti")
    )

    def listed(pages: DataFrame, n: int, suffix: str, name: str) -> DataFrame:
        top = ranked(pages.join(labels, ["query_id", "page_url"]), F.col("at"), name="n").filter(F.col("n") <= n)
        parts = F.sort_array(F.collect_list(F.struct("n", F.concat("label", F.lit(suffix)).alias("l"))))
        return top.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["l"]), "; ").alias(name))

    every = final.select("query_id").distinct()
    return (
        every.join(listed(used, 4, "", "selected_sources_summary"), "query_id", "left")
        .join(listed(unused, 3, " (lower-ranked)", "omitted_sources_summary"), "query_id", "left")
        .na.fill("", ["selected_sources_summary", "omitted_sources_summary"])
    )


def retrieval_stats(
    policy: DataFrame, candidates: DataFrame, filtered: DataFrame, final: DataFrame, basket: DataFrame
) -> DataFrame:
    """One row per question with the counts of every stage.

    candidates and filtered carry ``strategy`` and ``weak_match``; final comes from
    ``stitch_order``.  Each stage is reduced to one row per question before the joins.
    """
    key = ["query_id", "page_url", "chunk_index"]
    asked = basket.groupBy("query_id").agg(F.count("*").alias("input_pages"))
    found = candidates.groupBy("query_id").agg(
        F.count("*").alias("candidates_found"),
        F.max("strategy").alias("retrieval_strategy"),
        F.max(F.col("no_match")).alias("retrieval_no_match_fallback_used"),
    )
    kept = filtered.groupBy("query_id").agg(
        F.count("*").alias("filtered_by_similarity"),
        F.max("weak_match").alias("similarity_fallback_used"),
    )
    scores = filtered.select(*key, "score").join(final.select(*key), key).groupBy("query_id").agg(
        F.avg("score").alias("avg_similarity")
    )
    result = final.groupBy("query_id").agg(
        F.count("*").alias("retrieved_chunks"),
        F.sum("tokens").alias("selected_chunk_tokens"),
        F.countDistinct("page_url").alias("selected_pages"),
        F.count_if(F.col("strategy") != "selected").alias("stitched_chunks_added"),
        F.count_if(F.col("strategy") == "bridge").alias("stitched_bridge_chunks_added"),
    )
    stats = policy.select(
        "query_id", "planner_mode", F.col("policy_name").alias("context_budget_policy"),
        F.col("model_route").alias("context_budget_model_route"),
        F.col("max_candidates").alias("context_budget_candidate_cap"),
        F.col("max_total_chunks").alias("context_budget_chunk_cap"),
        F.col("max_chunks_per_page").alias("context_budget_page_cap"),
        F.col("max_input_tokens").alias("context_budget_tokens"),
        F.when(F.col("bridge_gap") > 0, "bridge+adjacent").otherwise("adjacent").alias("stitching_mode"),
    )
    for part in (asked, found, kept, scores, result):
        stats = stats.join(part, "query_id", "left")
    return stats.filter(F.col("retrieved_chunks").isNotNull()).withColumns(
        {
            "avg_similarity": F.coalesce("avg_similarity", F.lit(0.0)),
            "stitching_applied": F.col("stitched_chunks_added") > 0,
            "similarity_threshold": F.lit(rules.SIMILARITY_THRESHOLD),
        }
    )


def confidence(stats: DataFrame, questions: DataFrame) -> DataFrame:
    """low_confidence, level, note and advice from a stats row."""
    notes = rules.CONFIDENCE_NOTES
    avg = F.col("avg_similarity")
    single = (F.col("input_pages") >= 3) & (F.col("selected_pages") <= 1)

    def present(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(notes[n])) for c, n in pairs]))

    weak = F.col("similarity_fallback_used")
    hard = present(
        (F.col("retrieval_no_match_fallback_used"), "no_match"),
        (weak, "weak_scores"),
        (~weak & (avg != 0) & (avg < rules.LOW_SIMILARITY), "weak_average"),
    )
    soft = present(
        (F.col("retrieval_strategy") == "lexical-fallback", "lexical"),
        (single, "single_page"),
        (F.col("candidates_found") <= 3, "few"),
    )
    rows = stats.join(questions.select("query_id", "question", "mode"), "query_id").withColumns(
        {"hard": hard, "soft": soft}
    )
    low = (F.size("hard") > 0) | (F.size("soft") >= 2)
    reasons = F.slice(F.when(F.size("hard") > 0, F.col("hard")).otherwise(F.col("soft")), 1, 2)
    note = F.concat(F.lit(notes["prefix"]), F.array_join(reasons, " "))
    return rows.select(
        "query_id", low.alias("low_confidence"),
        F.when(low, "low").otherwise("normal").alias("confidence_level"),
        F.when(low, note).alias("confidence_note"),
        F.when(low, next_step(F.col("question"), F.col("mode"), single)).alias("confidence_next_step"),
    )


def next_step(question: Column, mode: Column, single: Column) -> Column:
    """Advice after a weak retrieval, with the first three question terms."""
    texts = rules.NEXT_STEPS
    terms = F.slice(tx.tokens(tx.text_of(question)), 1, 3)
    hint = F.when(F.size(terms) > 0, F.concat(F.lit(texts["hint"]), F.array_join(terms, ", "))).otherwise("")
    advice = F.concat(F.lit(texts["answer"][0]), hint, F.lit(texts["answer"][1]))
    for name in ("diagram", "critique"):
        advice = F.when(mode == name, F.concat(F.lit(texts[name][0]), hint, F.lit(texts[name][1]))).otherwise(advice)
    return F.when(single, F.lit(texts["tighten"])).otherwise(advice)


def citations(final: DataFrame) -> DataFrame:
    """Pages of the used chunks in first-seen order; final carries title and source type."""
    pages = final.groupBy("query_id", "page_url").agg(
        F.min("position").alias("first_position"), F.first("page_title").alias("page_title"),
        F.first("source_type").alias("source_type"),
    )
    return ranked(pages, F.col("first_position"), name="citation").drop("first_position")


def context_text(final: DataFrame) -> DataFrame:
    """Numbered context document per question; final carries the chunk texts."""
    number = ranked(final, F.col("position"), name="n")
    part = F.concat(
        F.lit("[CHUNK "), F.col("n").cast("string"), F.lit(" - "), F.upper("source_type"), F.lit("]\nSource: "),
        F.col("page_title"), F.lit("\nURL: "), F.col("page_url"), F.lit("\nSection: Part "),
        (F.col("chunk_index") + 1).cast("string"), F.lit(" of "), F.col("total_chunks").cast("string"),
        F.lit("\n\n"), F.col("text"), F.lit("\n"),
    )
    return _joined(number, part, "\n---\n\n", "context")


def page_context_text(basket: DataFrame, pages: DataFrame) -> DataFrame:
    """The same from whole pages, in basket order."""
    rows = ranked(basket.select("query_id", "page_url", "original_index").join(pages, "page_url"), F.col("original_index"), name="n")
    part = F.concat(
        F.lit("[SOURCE "), F.col("n").cast("string"), F.lit(": "), F.upper("source_type"), F.lit("]\nTitle: "),
        F.col("title"), F.lit("\nURL: "), F.col("page_url"), F.lit("\n\n"), F.col("markdown"), F.lit("\n"),
    )
    return _joined(rows, part, "\n---\n\n", "context")


def prefilter_excerpts(final: DataFrame, max_chars: int = rules.PREFILTER_CHARS) -> DataFrame:
    """Numbered one-line previews for a keep-list model."""
    size = max(rules.PREFILTER_MIN_CHARS, max_chars)
    preview = F.substring(tx.strip(tx.collapse(F.col("text"))), 1, size)
    part = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] source="), F.col("page_title"), F.lit(" type="),
        F.col("source_type"), F.lit(" section="), (F.col("chunk_index") + 1).cast("string"), F.lit("/"),
        F.col("total_chunks").cast("string"), F.lit(" text="), preview,
    )
    return _joined(ranked(final, F.col("position"), name="n"), part, "\n", "excerpts")


def _joined(rows: DataFrame, part: Column, sep: str, name: str) -> DataFrame:
    """Parts of a question joined in order; a question holds its selected chunks only."""
    listed = F.sort_array(F.collect_list(F.struct("n", part.alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda p: p["t"]), sep).alias(name))


def cost_estimate(provider: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """USD by provider price; unknown providers cost what the default one does."""

    def price(i: int) -> Column:
        out = F.lit(rules.PRICES_PER_MILLION["anthropic"][i])
        for name, prices in rules.PRICES_PER_MILLION.items():
            out = F.when(provider == name, F.lit(prices[i])).otherwise(out)
        return out

    cost_in = input_tokens / 1_000_000 * price(0)
    cost_out = output_tokens / 1_000_000 * price(1)
    return F.struct(
        F.bround(cost_in, 4).alias("input_cost"), F.bround(cost_out, 4).alias("output_cost"),
        F.bround(cost_in + cost_out, 4).alias("total_cost"), F.lit("USD").alias("currency"),
    )
