"""Finding the text blocks an issue talks about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as tx
from quillmine.session import cut_lineage

# Search limits
EXACT_MIN_CHARS = 18
PART_MIN_CHARS = 24
BLOCK_CHARS = (24, 900)
BLOCK_MIN_TOKENS = 4
ISSUE_MIN_TOKENS = 3
FUZZY_LEAST = 0.24
KEY = ["response_id", "issue_index"]


def search_text(col: Column) -> Column:
    """Whitespace collapsed, fancy quotes plain."""
    flat = F.regexp_replace(tx.text_of(col), tx.WEB_SPACE_RUN, " ")
    return tx.web_strip(F.regexp_replace(flat, "[“”‘’`]", '"'))


def collapsed(col: Column) -> Column:
    return tx.web_strip(F.lower(F.regexp_replace(tx.text_of(col), tx.WEB_SPACE_RUN, " ")))


def candidates(issues: DataFrame) -> DataFrame:
    """Search strings per issue, longest first; (response_id, issue_index, candidate_rank, candidate)."""
    bare = F.regexp_replace(F.col("evidence"), r"""^[\s"'`-]+|[\s"'`-]+$""", "")
    bare = F.regexp_replace(bare, r"(?i)\b(paraphrased|paraphrase|approx\.?|approximately)\b:?", "")
    rows = issues.select(
        *KEY, F.col("evidence").alias("raw"), search_text(bare).alias("e"), search_text(F.col("title")).alias("t"),
        search_text(F.col("risk")).alias("r"), search_text(F.col("suggestion")).alias("s"),
    ).withColumns({f"{c}_words": F.filter(F.split(c, " "), lambda w: w != "") for c in ("e", "t")})

    def long_enough(col: Column, n: int) -> Column:
        return F.when(F.length(col) >= n, F.array(col)).otherwise(F.array())

    def head(words: str, least: int, n: int) -> Column:
        return F.when(F.size(words) >= least, F.array(F.array_join(F.slice(words, 1, n), " "))).otherwise(F.array())

    quoted = F.filter(
        F.transform(tx.all_matches(F.col("raw"), '["“](.+?)["”]', 1), search_text),
        lambda c: F.length(c) >= EXACT_MIN_CHARS,
    )
    parts = F.filter(
        F.transform(F.split("e", r"\.\s+|\n+|•"), search_text), lambda c: F.length(c) >= PART_MIN_CHARS
    )
    both = F.when((F.col("t") != "") & (F.col("e") != ""), F.array(F.substring(F.concat_ws(". ", "t", "e"), 1, 220))).otherwise(F.array())
    found = F.concat(
        quoted, long_enough(F.col("e"), EXACT_MIN_CHARS), long_enough(F.col("t"), 12), both, parts,
        long_enough(F.col("r"), PART_MIN_CHARS), long_enough(F.col("s"), PART_MIN_CHARS),
        head("e_words", 8, 12), head("e_words", 14, 18), head("t_words", 3, 8),
    )
    numbered = F.transform(
        F.array_distinct(found), lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))
    )
    return rows.select(*KEY, F.posexplode(F.sort_array(numbered)).alias("candidate_rank", "x")).select(
        *KEY, "candidate_rank", F.col("x.c").alias("candidate")
    )


def exact_matches(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """First candidate that occurs in a block of its page, with block and offset.

    blocks(response_id, block_index, text).  Kept by a map-side combined minimum.
    """
    needles = found.select(*KEY, "candidate_rank", collapsed(F.col("candidate")).alias("needle")).filter(
        F.length("needle") >= EXACT_MIN_CHARS
    )
    hay = blocks.select("response_id", "block_index", collapsed(F.col("text")).alias("hay"))
    # both sides grow with the responses: no estimate may have one of them broadcast
    hits = needles.join(hay.hint("merge"), "response_id").withColumn("at", F.position("needle", "hay")).filter(F.col("at") > 0)
    first = hits.groupBy(*KEY).agg(F.min(F.struct("candidate_rank", "block_index", "at", "needle")).alias("m"))
    return first.select(
        *KEY, "m.candidate_rank", "m.block_index", (F.col("m.at") - 1).alias("offset"), "m.needle"
    )


def fuzzy_scores(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Scored (issue, block) pairs that share enough tokens."""
    corpus = F.array_join(
        F.filter(F.array(*[search_text(F.col(c)) for c in ("title", "evidence", "risk", "suggestion")]), lambda p: p != ""),
        ". ",
    )
    asked = issues.select(*KEY, F.array_distinct(tx.word_tokens(search_text(corpus))).alias("tokens")).filter(
        F.size("tokens") >= ISSUE_MIN_TOKENS
    )
    flat = blocks.select("response_id", "block_index", search_text(F.col("text")).alias("text"))
    usable = (
        flat.filter(F.length("text").between(*BLOCK_CHARS))
        .select("response_id", "block_index", F.length("text").alias("n_chars"),
                F.array_distinct(tx.word_tokens(F.col("text"))).alias("block_tokens"))
        .filter(F.size("block_tokens") >= BLOCK_MIN_TOKENS)
    )
    matched = F.size(F.array_intersect("tokens", "block_tokens"))
    rows = asked.join(usable.hint("merge"), "response_id").select(
        *KEY, "block_index", "n_chars", F.size("tokens").alias("n_tokens"), matched.alias("matched")
    )
    needed = F.when(F.col("n_tokens") >= 10, 4).otherwise(2)
    score = (
        F.col("matched") / F.col("n_tokens") + F.col("matched") * 0.03
        - F.greatest(F.lit(0), F.col("n_chars") - 320) / 2000
    )
    return rows.filter(F.col("matched") >= needed).withColumn("score", score).filter(F.col("score") >= FUZZY_LEAST)


def fuzzy_matches(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Best block per issue, each block used once, in issue order.

    The n-th issue of a response can lose at most n-1 blocks to earlier ones, so its best n
    rows decide; only those reach the fold.
    """
    order = Window.partitionBy("response_id").orderBy("issue_index")
    numbered = issues.withColumn("turn", F.row_number().over(order))
    scored = fuzzy_scores(numbered, blocks).join(numbered.select(*KEY, "turn").hint("merge"), KEY)
    best = Window.partitionBy(*KEY).orderBy(F.desc("score"), "block_index")
    head = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= F.col("turn"))
    item = F.struct("turn", "n", "block_index", "issue_index", "score")
    grouped = head.groupBy("response_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    state = "struct<turns:array<int>,blocks:array<bigint>,taken:array<int>,at:int>"
    ints, longs = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    start = F.struct(ints.alias("turns"), longs.alias("blocks"), ints.alias("taken"), F.lit(0).alias("at")).cast(state)

    def merge(acc: Column, row: Column) -> Column:
        free = ~F.array_contains(acc["turns"], row["turn"]) & ~F.array_contains(
            acc["blocks"], row["block_index"].cast("bigint")
        )

        def grown(field: str, value: Column) -> Column:
            return F.when(free, F.array_append(acc[field], value)).otherwise(acc[field]).alias(field)

        return F.struct(
            grown("turns", row["turn"]), grown("blocks", row["block_index"].cast("bigint")), grown("taken", acc["at"]),
            (acc["at"] + 1).alias("at"),
        ).cast(state)

    taken = grouped.withColumn("taken", F.aggregate("items", start, merge, lambda s: s["taken"]))
    return taken.select("response_id", "items", F.explode("taken").alias("i")).select(
        "response_id", F.col("items")[F.col("i")].alias("m")
    ).select("response_id", "m.issue_index", "m.block_index", "m.score")


def evidence_matches(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """(response_id, issue_index, block_index, method): exact where a candidate occurs, else fuzzy.

    Fuzzy search is tried only for issues without an exact match, so these never take a block from
    each other; exact matches do not use blocks up.
    """
    exact = cut_lineage(exact_matches(candidates(issues), blocks).select(*KEY, "block_index"))
    rest = issues.join(exact.select(*KEY).hint("merge"), KEY, "left_anti")
    fuzzy = fuzzy_matches(rest, blocks).select(*KEY, "block_index")
    return exact.withColumn("method", F.lit("exact")).unionByName(fuzzy.withColumn("method", F.lit("fuzzy")))


def evidence_summary(issues: DataFrame, matched: DataFrame) -> DataFrame:
    """Per response: issues, matches and matches by severity."""
    hits = matched.select(*KEY).distinct().withColumn("hit", F.lit(True))
    rows = issues.select(*KEY, "severity").join(hits.hint("merge"), KEY, "left")
    hit = F.coalesce("hit", F.lit(False))
    return rows.groupBy("response_id").agg(
        F.count("*").alias("total_issues"), F.count_if(hit).alias("matched_issues"),
        *[F.count_if(hit & (F.col("severity") == s)).alias(f"matched_{s}") for s in ("high", "medium", "low")],
    )
