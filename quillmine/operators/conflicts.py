"""Contradicting claims between the pages of one question.

Input rows are the selected chunks of a question (at most the candidate limit), so the
claims of a question are few.  Claims meet only through a shared subject token.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx

SENTENCE_END = r"(?<=[.!?])" + rules.SPACE_CLASS + r"+|\n+"


def sentences(selected: DataFrame) -> DataFrame:
    """selected(query_id, position, page_url, page_title, text) to candidate sentences."""
    low, high = rules.CONFLICT_SENTENCE_CHARS
    parts = selected.select(
        "query_id", "position", "page_url", "page_title",
        F.posexplode(F.split("text", SENTENCE_END)).alias("pos", "raw"),
    ).select(
        "query_id", "position", "pos", "page_url", "page_title",
        tx.collapse(tx.strip(F.col("raw"))).alias("sentence"),
    )
    kept = parts.filter(
        F.length("sentence").between(low, high)
        & ~F.substring("sentence", 1, 1).isin("#", "[")
    ).withColumn("tokens", tx.token_set(F.col("sentence")))
    return kept.filter(F.size("tokens") >= rules.CONFLICT_MIN_TOKENS)


def topic_of(tokens: Column, topics: Mapping[str, Sequence[str]] = rules.CONFLICT_TOPICS) -> Column:
    """First topic that shares a token, else null."""
    topic = F.lit(None).cast("string")
    for name, words in reversed(list(topics.items())):
        topic = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])), F.lit(name)).otherwise(topic)
    return topic


def values_of(sentence: Column, patterns: Sequence[str] = rules.CONFLICT_VALUE_PATTERNS) -> Column:
    """Distinct value phrases in pattern order."""
    found = F.concat(*[tx.all_matches(sentence, "(?iU)" + p) for p in patterns])
    return F.array_distinct(F.transform(found, lambda v: tx.collapse(F.lower(tx.strip(v)))))


def claims(found: DataFrame, topics: Mapping[str, Sequence[str]] = rules.CONFLICT_TOPICS) -> DataFrame:
    """Sentences that state a value about a topic and a subject, numbered per question."""
    rows = found.withColumn("topic", topic_of(F.col("tokens"), topics)).filter(F.col("topic").isNotNull())
    rows = rows.withColumn("vals", values_of(F.col("sentence"))).filter(F.size("vals") > 0)
    words = F.create_map(*[x for n, ws in topics.items() for x in (F.lit(n), F.array(*[F.lit(w) for w in ws]))])
    subject = F.array_except(
        F.array_except("tokens", F.element_at(words, F.col("topic"))),
        tx.token_set(F.array_join("vals", " ")),
    )
    order = Window.partitionBy("query_id").orderBy("position", "pos")
    return rows.withColumn("subject_tokens", subject).filter(F.size("subject_tokens") > 0).select(
        "query_id", "page_url", "page_title", "sentence", "topic",
        F.array_join("vals", "|").alias("value_key"), F.array_join("vals", " / ").alias("values_text"),
        "subject_tokens", F.row_number().over(order).alias("claim_no"),
    )


def pairs(stated: DataFrame) -> DataFrame:
    """First conflicting claim pair per (page pair, topic), with the shared subject."""
    keyed = stated.select(
        "query_id", "topic", "claim_no", "page_url", "value_key", F.explode("subject_tokens").alias("token")
    )
    left = keyed.select(
        "query_id", "topic", "token", F.col("claim_no").alias("a_no"), F.col("page_url").alias("a_url"),
        F.col("value_key").alias("a_key"),
    )
    right = keyed.select(
        "query_id", "topic", "token", F.col("claim_no").alias("b_no"), F.col("page_url").alias("b_url"),
        F.col("value_key").alias("b_key"),
    )
    met = left.join(right, ["query_id", "topic", "token"]).filter(
        (F.col("a_no") < F.col("b_no")) & (F.col("a_url") != F.col("b_url")) & (F.col("a_key") != F.col("b_key"))
    )
    shared = met.groupBy("query_id", "topic", "a_no", "b_no", "a_url", "b_url").agg(
        F.sort_array(F.collect_set("token")).alias("shared")
    )
    enough = F.when(F.col("topic") == "status", rules.STATUS_MIN_SHARED).otherwise(1)
    return (
        shared.filter(F.size("shared") >= enough)
        .groupBy("query_id", "topic", F.least("a_url", "b_url").alias("low_url"), F.greatest("a_url", "b_url").alias("high_url"))
        .agg(F.min(F.struct("a_no", "b_no", "shared")).alias("p"))
        .select("query_id", "topic", "p.a_no", "p.b_no", "p.shared")
    )


def topic_name(topic: Column) -> Column:
    return F.initcap(F.translate(topic, "_", " "))


def top_conflicts(found: DataFrame, stated: DataFrame, top: int = rules.CONFLICT_TOP) -> DataFrame:
    """Strongest conflicts per question with evidence and a summary sentence."""
    best = Window.partitionBy("query_id").orderBy(F.size("shared").desc(), "a_no", "b_no")
    head = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    def side(name: str) -> DataFrame:
        return stated.select(
            "query_id", F.col("claim_no").alias(f"{name}_no"), F.col("page_title").alias(f"source_{name}_title"),
            tx.shorten(F.col("sentence"), rules.CONFLICT_EVIDENCE_CHARS).alias(f"source_{name}_evidence"),
            F.col("values_text").alias(f"{name}_values"),
        )

    rows = head.join(side("a"), ["query_id", "a_no"]).join(side("b"), ["query_id", "b_no"])
    name = topic_name(F.col("topic"))
    summary = F.concat(
        name, F.lit(" looks inconsistent for "), F.array_join(F.slice("shared", 1, 3), ", "), F.lit(": "),
        F.col("source_a_title"), F.lit(" says "), F.col("a_values"), F.lit(", while "),
        F.col("source_b_title"), F.lit(" says "), F.col("b_values"), F.lit("."),
    )
    return rows.select(
        "query_id", "rank", name.alias("topic"), summary.alias("summary"),
        "source_a_title", "source_a_evidence", "source_b_title", "source_b_evidence",
    )
