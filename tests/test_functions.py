import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.functions import urls
from quillmine.functions import vectors as vx


def rows(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = df.select("i", *[c.alias(n) for n, c in columns.items()]).sort("i").collect()
    return [tuple(r)[1:] for r in out]


TEXTS = [None, "", "  \t\n", " x y 　", "A b\n\nC", "😀 astral ok", "x" * 999, "x" * 1000, "x" * 1001,
         "The API/v2 spec-1.2 is at docs._x; how to USE it?"]


def test_whitespace_is_unicode_aware(spark):
    got = rows(spark, TEXTS, s=tx.strip(tx.text_of(F.col("v"))), c=tx.collapse(tx.strip(tx.text_of(F.col("v")))))
    assert got == [((t or "").strip(), " ".join((t or "").split())) for t in TEXTS]


def test_tokens_keep_order_and_drop_stop_words(spark):
    got = rows(spark, TEXTS[-1:], t=tx.tokens(F.col("v")))
    assert got == [(["api/v2", "spec-1.2", "docs._x"],)]


def test_shorten_and_counts(spark):
    got = rows(spark, ["a" * 12, "aaa bbb ccc", None], s=tx.shorten(F.col("v"), 9), n=tx.token_estimate(F.col("v")))
    assert got == [("aaaaaaaa…", 3), ("aaa bbb…", 3), ("", 0)]


def test_urls(spark):
    cases = {
        "HTTPS://Docs.Example.org//A//b/;v=1?q=2#f": "https://docs.example.org/a/b",
        "https://example.org": "https://example.org/",
        "https://under_score.example.org/x y|z/": "https://under_score.example.org/x y|z",
        "Some Note/": "some note",
        "": "",
    }
    got = rows(spark, list(cases), c=urls.canonical_url(F.col("v")))
    assert [g[0] for g in got] == list(cases.values())


def test_both_source_type_orders_are_kept(spark):
    url = ["https://team.atlassian.net/wiki/browse/KEY-1", "https://jira.example.org/wiki.html", None]
    got = rows(spark, url, a=urls.source_type(F.col("v")), b=urls.page_type(tx.text_of(F.col("v"))))
    assert got == [("jira", "confluence"), ("jira", "confluence"), ("generic", "generic")]


def test_provider_aliases(spark):
    got = rows(spark, [" Local ", None, "xhigh", "other"], p=tx.provider_alias(F.col("v")), e=tx.reasoning_effort_alias(F.col("v")))
    assert got == [("ollama", ""), ("openai", ""), ("xhigh", "high"), ("other", "")]


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = df.select(vx.normalize(F.col("a")), vx.cosine(F.col("a"), F.col("b")), vx.dot_batches(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [([0.0, 0.0], 0.0, 0.0), ([0.6, 0.8], 1.0, 25.0)]


def test_sigmoid_unit(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (3.5,)], "x double")
    got = [r[0] for r in df.select(tx.sigmoid_unit(F.col("x"))).collect()]
    want = [0.0, 1.0, 1 / (1 + math.exp(2)), 1 / (1 + math.exp(-3.5))]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=40))
def test_token_set_matches_plain_python(spark, texts):
    import re

    want = []
    for text in texts:
        found = [t for t in re.findall(rules.TOKEN_PATTERN, text.lower()) if len(t) >= 3 and t not in rules.QUERY_STOP_WORDS]
        want.append(sorted(set(found)))
    got = rows(spark, texts, t=F.sort_array(tx.token_set(F.col("v"))))
    assert [g[0] for g in got] == want
