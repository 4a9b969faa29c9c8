import hashlib
import re
from collections import Counter

import pytest

from quillmine.llm import decontaminate as dc
from quillmine.llm.queries import op3_decontamination
from tests.llm.conftest import SF, clashing, edge_rows

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    """(id, words, hit words, item ids) by looking at every window of every item in every document."""
    sought = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                sought.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    lengths = {len(k) for k in sought}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := sought.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"), (2, "Short ITEM"), (3, "de"), (4, None), (5, "  ..,, "),
    (6, "la la la la la la la la la la la la"), (7, "short item"), (10, "É vrai 12 to the of and in a is it"), (11, "never seen anywhere qqqq"),
]
TEXTS = [
    "The quick, brown-fox jumps over the lazy dog and runs away from the big bad wolf", "the quick brown fox jumps over the lazy dog",
    "x the quick brown fox jumps over the lazy dog and y the quick brown fox jumps over the lazy dog and runs",
    "short item short item", "de", "DE la", "la " * 30, "é vrai 12 to the of and in a is it", "É VRAI 12 to the of and in a is it", None, "", "short\x00item",
    "the quick brown fox jumps over the lazy cat and runs away from the big bad wolf",
]


@pytest.mark.parametrize("rare", [1, 2, 3])
def test_windows_by_brute_force(spark, monkeypatch, rare):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (3, TEXTS[3]), (None, TEXTS[2]), (4, "another de under one id")]
    frame = clashing(spark.createDataFrame(docs, "doc_id bigint, text string"), "term", "items", "n_hit", "pos", "doc")
    items = clashing(spark.createDataFrame(ITEMS, "item_id bigint, text string"), "terms", "n", "word")
    kept = dc.occurrences
    monkeypatch.setattr(dc, "occurrences", lambda index, phrases, scratch: kept(index, phrases, rare, scratch))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in dc.with_hits(frame, items).collect())
    assert got == brute(docs, ITEMS)


def brute_near(docs, items, size=10, misses=1, slop=1):
    """(id, words in proximity matches, item ids) by looking at every window at every place of every document."""
    out = []
    for key, text in docs:
        w, parts, found = words(text), set(), set()
        for item, told in items:
            b = words(told)
            for i in range(len(b) - size + 1):
                for s in range(-slop - size, len(w)):
                    met = {(o, p) for o in range(size) for p in range(s + o, s + o + slop + 1) if 0 <= p < len(w) and w[p] == b[i + o]}
                    if len({o for o, _ in met}) >= size - misses:
                        parts |= {p for _, p in met}
                        found.add(str(item))
        out.append((key, len(parts), tuple(sorted(found))))
    return Counter(out)


NEAR = [
    "the quick brown fox jumps over the lazy cat and runs away from the big bad wolf", "the quick brown fox jumps over a lazy dog and",
    "quick brown fox jumps over the very lazy dog and runs", "x quick brown fox jumps over the dog and runs away y", "the quick red fox jumps under the lazy dog and runs",
    "brown fox jumps over the lazy dog and runs", "the the quick brown fox jumps over over the lazy dog", "la la la la x la la la la la",
    "the quick brown one fox jumps over two the lazy dog and", "É vrai 12 to the of and in a was it", "from the big bad wolf", "quick brown fox jumps over the lazy dog and",
]


@pytest.mark.parametrize("misses, slop", [(1, 1), (0, 0), (0, 1), (2, 0), (3, 2)])
def test_proximity_by_brute_force(spark, misses, slop):
    docs = [(i, t) for i, t in enumerate(TEXTS + NEAR)] + [(0, TEXTS[0]), (None, NEAR[0]), (4, "another text under one id")]
    frame = clashing(spark.createDataFrame(docs, "doc_id bigint, text string"), "n_near", "near_items", "line", "s", "at")
    rows = dc.with_hits(frame, spark.createDataFrame(ITEMS, "item_id bigint, text string"), near=True, misses=misses, slop=slop).collect()
    assert Counter((r.doc_id, r.n_near, tuple(r.near_items)) for r in rows) == brute_near(docs, ITEMS, misses=misses, slop=slop)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows) == brute(docs, ITEMS)


def test_a_word_changed_or_put_in_in_every_ten_is_near(spark):
    words_ = [f"w{i}" for i in range(400)]
    changed = " ".join("other" if i % 10 == 5 else w for i, w in enumerate(words_))
    added = " ".join(f"{w} other" if i % 10 == 5 else w for i, w in enumerate(words_))
    docs = spark.createDataFrame([(1, changed), (2, added), (3, "clean " * 400)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words_))], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_near, r.near_items) for r in dc.with_hits(docs, items, near=True).collect()}
    assert got[1] == (0, 360, ["7"]) and got[2][1:] == (400, ["7"]) and got[3] == (0, 0, [])


def test_windows_too_short_for_the_misses_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        dc.with_hits(docs, docs.withColumnRenamed("doc_id", "item_id"), near=True, size=3, misses=2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert [r.n_hit for r in dc.with_hits(docs, items.limit(0)).collect()] == [0]
    assert [(r.n_near, r.near_items) for r in dc.with_hits(docs, items.limit(0), near=True).collect()] == [(0, [])]
    assert dc.with_hits(docs.limit(0), items).count() == 0
    assert dc.with_hits(docs.limit(0), items, near=True).count() == 0


def test_query(spark, folder, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter()
    for (key, n, hit, found), times in brute([t for t in texts if t[0] is not None], items).items():
        want[key, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += times
    rows = op3_decontamination(spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
    assert any(r.contaminated for r in rows)


def test_stretches_are_never_broadcast(spark):
    # they grow with the documents; the index meets them by sorting at every size
    index = spark.createDataFrame([(t, 1, t) for t in range(12)], "term bigint, doc bigint, pos int")
    lines = spark.createDataFrame([(5, list(range(12)))], "line bigint, terms array<bigint>")
    found = dc.near_places(index, lines)
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.pos for r in found.collect()} == set(range(12))


def test_words_after_a_leading_gap(spark):
    docs = spark.createDataFrame([(1, "..one Two"), (2, "one two"), (3, ""), (4, None), (5, "É ONE é")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("one", 1), ("two", 2), ("é", 3), ("É", 4), ("", 5)], "word string, term bigint")
    keys = {r.k: r.doc_id for r in docs.select("doc_id", dc.row_key("doc_id", "text").alias("k")).collect()}
    got = sorted((keys[r.doc], r.pos, r.term) for r in dc.postings(docs, terms).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (5, 0, 4), (5, 1, 1), (5, 2, 3)]


def test_keys_are_made_once_a_text_and_not_once_a_word(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("one", 1)], "word string, term bigint")
    plan = dc.postings(docs, terms)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert not any(f in above.lower() for f in ("xxhash64", "split", "rlike"))
    assert below.count("xxhash64") == 1 and below.count("split(") == 1
