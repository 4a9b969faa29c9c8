import random

from pyspark.sql import functions as F

from quillmine.operators import titles
from quillmine.operators.responses import titles_match


def test_join_equals_the_rule_over_all_pairs(spark):
    rng = random.Random(5)
    words = ["report", "data", "data", "limits", "the", "api", "retry", "timeout", "guide", "to", "é", "v2", "[draft]", "plan", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 7)))) for i in range(160)]
    rows += [(200, None), (201, ""), (202, "  () "), (203, "a"), (204, "ap"), (205, "REPORT: data"), (206, "data data"), (207, "imeou"), (None, "data report"), (205, "REPORT: data")]
    left = spark.createDataFrame(rows, "id bigint, title string")
    right = spark.createDataFrame([(i, t[::-1] if i and i % 9 == 0 and t else t) for i, t in rows], "no bigint, name string")
    got = [tuple(r) for r in titles.join_titles(left.withColumn("word", F.lit(1)), right.withColumn("id", F.lit(2)), "id", "title", "no", "name").collect()]
    want = left.crossJoin(right).where("id IS NOT NULL AND no IS NOT NULL").where(titles_match(F.col("title"), F.col("name"))).select("id", "no").distinct()
    assert sorted(got) == sorted(tuple(r) for r in want.collect())
    assert len(got) > 1000
    assert titles.join_titles(left.limit(0), right, "id", "title", "no", "name").count() == 0


def test_titles_meet_on_something_rare(spark):
    """All titles share two common words; only those that share a rare word too are met."""
    rows = [(i, f"the report about topic{i // 2} and item{i} alpha{i} beta{i}") for i in range(200)]
    left = titles._titles(spark.createDataFrame(rows, "id bigint, title string"), "id", "title")
    met = titles._sharing_words(left, left)
    assert met.count() == 400
    assert titles._inside(left, left).count() == 200
