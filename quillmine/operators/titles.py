"""Fuzzy join of two tables of titles: containment, or enough shared words.

No pair is met without something rare in common.  Words are ordered from the rarest on; of two titles that share
enough words the shorter has one of them among its first, as must the longer, so titles meet on those words only.
A title that lies inside another meets it on the rarest of its letter grams.  Both are equi-joins; the full rule is
then checked pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.operators.responses import plain_title, titles_match

#: Letters of a gram; shorter titles meet others as they are.
GRAM = 4


def join_titles(left: DataFrame, right: DataFrame, left_id: str, left_title: str, right_id: str, right_title: str) -> DataFrame:
    """``left_id, right_id``: every pair whose titles match, once.

    Ids name titles: rows that repeat an id repeat its title.  Null and blank titles match nothing; titles without
    words can still contain each other.
    """
    a = _titles(left, left_id, left_title)
    b = _titles(right, right_id, right_title)
    near = _sharing_words(a, b).unionByName(_inside(a, b)).unionByName(
        _inside(b, a).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = near.join(a.select(F.col("id").alias("a"), F.col("title").alias("source")), "a").join(
        b.select(F.col("id").alias("b"), F.col("title").alias("current")), "b")
    return both.where(titles_match(F.col("source"), F.col("current"))).select(F.col("a").alias(left_id), F.col("b").alias(right_id))


def _titles(rows: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """One row per id: the title, its plain form and its words."""
    named = rows.select(F.col(id_col).alias("id"), F.col(title_col).alias("title")).dropDuplicates(["id"])
    plain = plain_title(F.col("title"))
    return named.where("id IS NOT NULL AND title IS NOT NULL").withColumn("plain", plain).where("plain <> ''").withColumn(
        "words", tx.word_tokens(F.col("plain"), 3, rules.TITLE_STOP_WORDS))


def _ordered(titles: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, word, at, size, repeats``: words from the rarest on, their number, and whether any repeats."""
    counted = titles.select("id", F.explode("words").alias("word")).join(counts, "word")
    sorted_words = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("order"))
    return sorted_words.select(
        "id", F.size("order").alias("size"), (F.size(F.array_distinct("order")) < F.size("order")).alias("repeats"),
        F.posexplode("order.word").alias("at", "word"))


def _sharing_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that may share ``max(2, half the words of the shorter)`` words.

    A word of ``b`` counts as often as it stands there, so it must be among the first of ``b``; if no word of ``b``
    repeats, the same holds for ``a``.
    """
    once = a.withColumn("words", F.array_distinct("words"))
    counts = once.select(F.explode("words").alias("word")).unionByName(b.select(F.explode("words").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    x = _ordered(once, counts).select(F.col("id").alias("a"), "word", F.col("at").alias("ax"), F.col("size").alias("sx"))
    y = _ordered(b, counts).select(F.col("id").alias("b"), "word", F.col("at").alias("ay"), F.col("size").alias("sy"), "repeats")
    # two words at least are shared, so the most common word of a title without repeats leads nowhere
    y = y.where(F.col("ay") <= F.col("sy") - 2)
    least = F.greatest(F.lit(2), F.ceil(F.least("sx", "sy") / 2))
    met = x.join(y, "word").where((F.col("ay") <= F.col("sy") - least) & (F.col("repeats") | (F.col("ax") <= F.col("sx") - least)))
    return met.select("a", "b").distinct()


def _grams(text: str, size: Column) -> Column:
    """All substrings of so many letters."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(F.col(text), i, size))


def _inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``a, b``: pairs where the plain title of ``inner`` (b) lies in that of ``outer`` (a)."""
    size = F.least(F.length("plain"), F.lit(GRAM))
    needles = inner.select("id", "plain", size.alias("size")).select("id", "plain", "size", F.explode(F.array_distinct(_grams("plain", F.col("size")))).alias("gram"))
    sizes = F.sequence(F.lit(1), F.least(F.length("plain"), F.lit(GRAM)))
    hay = outer.select("id", F.col("plain").alias("hay"), F.explode(sizes).alias("size"), "plain")
    hay = hay.select("id", "hay", F.explode(F.array_distinct(_grams("plain", F.col("size")))).alias("gram"))
    often = hay.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = needles.join(often, "gram", "left").groupBy("id", "plain").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    # a gram that no title holds leaves no partner
    found = hay.join(rarest.where("r.n > 0").select(F.col("id").alias("b"), "plain", F.col("r.gram").alias("gram")), "gram")
    return found.where(F.contains("hay", "plain")).select(F.col("id").alias("a"), "b")
