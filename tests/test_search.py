import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmine.operators.blocks import TopRows, meet
from quillmine.operators.corpus import corpus_topk
from quillmine.operators import postings as po
from quillmine.operators.ranking import spread_row_number
from quillmine.operators.vectors import vector_topk
from quillmine.session import cut_lineage


def indexed_topk(questions, chunks, k=20, block_rows=512, salts=None):
    """``corpus_topk`` through an index of short ranges."""
    return po.search_index(questions, cut_lineage(po.index_chunks(chunks, 30)), k, block_rows, salts or 1)


@pytest.mark.parametrize("search", [corpus_topk, indexed_topk])
@pytest.mark.parametrize("salts", [None, 3])
def test_corpus_search_with_many_blocks_equals_brute_force(spark, search, salts):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    asked = [(q, sorted(set(rng.choices(words, k=rng.randint(0, 6))))) for q in range(40)]
    chunks = [
        (f"u{i // 4:03d}", i % 4, sorted({"w0", *rng.choices(words, k=8)}), rng.sample(words, 2), rng.sample(words, 1))
        for i in range(400)
    ]
    questions = spark.createDataFrame(asked, "query_id long, query_terms array<string>")
    rows = spark.createDataFrame(
        chunks, "page_url string, chunk_index long, chunk_terms array<string>, title_terms array<string>, heading_terms array<string>"
    ).repartition(5)
    got: dict[int, list] = {}
    for r in search(questions, rows, k=7, block_rows=9, salts=salts).sort("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.page_url, r.chunk_index, round(r.score, 9)))
    for q, terms in asked:
        scored = []
        for u, i, c, t, h in chunks:
            if terms:
                s = [len(set(terms) & set(x)) / len(terms) for x in (c, t, h)]
                score = s[0] * 0.7 + s[1] * 0.2 + s[2] * 0.1
                if score > 0:
                    scored.append((-round(score, 9), u, i))
        want = [(u, i, -s) for s, u, i in sorted(scored)[:7]]
        assert [x[2] for x in got.get(q, [])] == [x[2] for x in want]
        assert got.get(q, []) == want


@pytest.mark.parametrize("salts", [None, 2])
def test_vector_search_with_many_blocks_equals_brute_force(spark, salts):
    rng = np.random.default_rng(2)
    corpus, asked = rng.normal(size=(300, 8)), rng.normal(size=(30, 8))
    corpus[17] = 0
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    rows = vector_topk(q, c, k=5, dims=8, block_rows=7, salts=salts).sort("query_id", "rank").collect()
    norms = np.linalg.norm(corpus, axis=1, keepdims=True)
    unit = np.divide(corpus, norms, out=np.zeros_like(corpus), where=norms > 0)
    want = np.argsort(-(asked @ unit.T), axis=1)[:, :5]
    assert [r.vec_id for r in rows] == want.ravel().tolist()


def test_spread_row_number_equals_a_window(spark):
    rng = random.Random(4)
    order = list(range(2000))
    rng.shuffle(order)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 9)}", o // 50, o) for o in order]
    df = spark.createDataFrame(rows, "g string, run int, o int")
    got = {(r.g, r.o): r.n for r in spread_row_number(df, ["g"], ["run"], ["o"], "n").collect()}
    for g in {r[0] for r in rows}:
        for n, o in enumerate(sorted(r[2] for r in rows if r[0] == g), 1):
            assert got[g, o] == n


def test_no_question_terms_give_no_rows(spark):
    questions = spark.createDataFrame([(1, [])], "query_id long, query_terms array<string>")
    rows = spark.createDataFrame([("u", 0, ["a"], ["b"], ["c"])], "page_url string, chunk_index long, chunk_terms array<string>, title_terms array<string>, heading_terms array<string>")
    assert corpus_topk(questions, rows).filter(F.lit(True)).count() == 0


def test_tiles_of_one_chunk_pages_use_every_salt(spark):
    tiles = spark.createDataFrame([([f"u{i}"], [0]) for i in range(400)], "urls array<string>, indexes array<long>")
    blocks = spark.createDataFrame([(0, "asked")], "block long, asked string")
    used = meet(tiles, blocks, 1, ("urls", "indexes"), salts=16).groupBy("salt").count().collect()
    assert len(used) == 16 and max(r["count"] for r in used) < 60


def test_top_rows_of_a_task_are_those_of_all_its_parts():
    rng = random.Random(8)
    rows = pd.DataFrame({"query_id": [rng.randint(0, 5) for _ in range(4000)], "score": [rng.randint(0, 40) for _ in range(4000)], "key": range(4000)})
    top = TopRows(3, ["score", "key"], [False, True], hold=50)
    for at in range(0, 4000, 37):
        top.add(rows.iloc[at:at + 37])
    want = rows.sort_values(["score", "key"], ascending=[False, True]).groupby("query_id").head(3)
    assert sorted(top.best()["key"]) == sorted(want["key"])


CHUNKS = "page_url string, chunk_index long, chunk_terms array<string>, title_terms array<string>, heading_terms array<string>"


def test_ranges_below_the_threshold_are_not_opened(spark):
    """Pages of one topic lie together; a question opens its topic's ranges and few of the others that hold a common word."""
    rng = random.Random(6)
    rows = []
    for topic in range(40):
        words = [f"t{topic}w{i}" for i in range(30)]
        rows += [(f"u{topic:02d}{i:03d}", 0, ["the", *rng.sample(words, 12)], ["the", words[0]], []) for i in range(64)]
    chunks = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    asked = spark.createDataFrame(
        [(q, ["the", *(f"t{q % 40}w{i}" for i in range(q % 5 + 1))]) for q in range(200)], "query_id long, query_terms array<string>")
    index = cut_lineage(po.index_chunks(chunks, 64))
    upper = po.upper_bounds(asked, index).cache()
    first = po.first_ranges(upper).cache()
    opened = po.open_ranges(asked, index, first, 10)
    rest = po.ranges_above(upper, opened, first, 10)
    assert upper.count() == 200 * 40
    assert first.count() + rest.count() <= 200 * 3
    got = po.search_index(asked, index, 10).sort("query_id", "rank").collect()
    for q, terms in asked.collect():
        scored = sorted((-round((0.7 * len(set(terms) & set(c)) + 0.2 * len(set(terms) & set(t))) / len(terms), 9), u) for u, _, c, t, _ in rows)
        assert [(-round(r.score, 9), r.page_url) for r in got if r.query_id == q] == scored[:10]


def test_a_term_everywhere_has_a_short_list_in_every_range(spark):
    rows = [(f"u{i:04d}", i % 3, ["hot", f"w{i}"], ["hot"], None) for i in range(1000)]
    index = cut_lineage(po.index_chunks(spark.createDataFrame(rows, CHUNKS).coalesce(1), 100))
    lists = index.filter("term = 'hot'").select(F.size("members").alias("n"), "bound", F.col("fields")[0].alias("f")).collect()
    assert [(r.n, round(r.bound, 9), r.f) for r in lists] == [(100, 0.9, 3)] * 10
    assert index.filter("term IS NULL").select(F.explode("urls")).distinct().count() == 1000


def test_odd_chunks_and_questions(spark):
    rows = [(None, 0, ["a"], None, []), ("u", None, ["a", None], ["b"], []), ("v", 1, None, None, None), ("w", 2, [], [], []), ("x", 0, ["a", "a"], [], [])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, None), (3, []), (4, ["zz"]), (5, ["a"])], "query_id long, query_terms array<string>")
    got = [(r.query_id, r["rank"], r.page_url, round(r.score, 9)) for r in indexed_topk(asked, chunks).sort("query_id", "rank").collect()]
    assert got == [(1, 1, "u", 0.45), (1, 2, None, 0.35), (1, 3, "x", 0.35), (5, 1, None, 0.7), (5, 2, "u", 0.7), (5, 3, "x", 0.7)]
    assert indexed_topk(asked, chunks.limit(0)).count() == 0
    assert indexed_topk(asked.limit(0), chunks).count() == 0


def test_shares_do_not_depend_on_how_many_hits_are_listed_at_once(monkeypatch):
    import pyarrow as pa

    from quillmine.operators import corpus as cp

    asked = [{"query_id": i, "query_terms": ["the", "of"] + ["a"] * (i % 2) + [f"w{i}"]} for i in range(7)]
    sets = [["the", "w3"], None, [], ["of", "the", "a", "x"], ["x"], ["a", *(f"w{i}" for i in range(7))]] * 5
    want = [[sum(w in row["query_terms"] for w in words or ()) / len(row["query_terms"]) for row in asked] for words in sets]
    for cells in (1, 5, 1 << 20):
        monkeypatch.setattr(cp, "CELLS", cells)
        assert cp._Block(asked).shares(pa.array(sets, pa.list_(pa.string()))).tolist() == want
