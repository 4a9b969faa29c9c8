from collections import Counter

from quillmine.sources.stores import unseen_pages, without_copies

SCHEMA = "page_url string, markdown string, extra int"


def kept(df):
    return Counter((r.page_url, r.markdown) for r in without_copies(df).collect())


def test_each_text_stays_once_under_its_smallest_url(spark):
    rows = [("u1", "same", 1), ("u1", "same", 1), ("u2", "same", 2), ("u2", "another", 3)]
    assert kept(spark.createDataFrame(rows, SCHEMA)) == {("u1", "same"): 1, ("u2", "another"): 1}


def test_null_urls_and_texts(spark):
    rows = [(None, "a", 1), ("u", "a", 2), (None, "b", 3), (None, "b", 4), (None, None, 5), ("v", None, 6), ("w", "", 7), ("x", "c", 8), ("x", "d", 9)]
    got = kept(spark.createDataFrame(rows, SCHEMA))
    assert got[("u", "a")] == 1 and got[(None, "a")] == 0 and got[(None, "b")] == 1
    assert got[("x", "c")] == got[("x", "d")] == 1
    assert sum(got.values()) == 7  # a null text is no copy of another


def test_unseen_pages_keep_their_columns(spark):
    rows = spark.createDataFrame([("u1", "a", 1), ("u2", "a", 2), ("u3", "b", 3)], SCHEMA)
    first = unseen_pages(rows.limit(1), spark.createDataFrame([], "content_signature string"))
    assert first.columns == ["page_url", "markdown", "extra", "content_signature"]
    assert sorted(r.page_url for r in unseen_pages(rows, first.select("content_signature")).collect()) == ["u3"]


def test_signatures_are_not_made_anew_above_the_join(spark):
    rows = spark.createDataFrame([("u1", "a b"), ("u2", "A  b"), ("u3", "c")], "page_url string, markdown string")
    known = spark.createDataFrame([], "content_signature string")
    plan = unseen_pages(rows, known)._jdf.queryExecution().optimizedPlan().toString()
    # three readings and their filters for nulls; made anew above the join it was 11 times
    assert plan.count("sha1(") <= 7
