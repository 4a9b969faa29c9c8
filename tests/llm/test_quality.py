import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmine.llm import quality as q
from quillmine.llm.queries import op5_quality_lines
from tests.llm.conftest import clashing

LARGE = "/root/testdata/sf0.1"


def brute_marginals(scores, moves):
    """P(good) of each line, expected transitions and log partition by summing over all labelings of one chain."""
    total, good, moved = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=len(scores)):
        weight = np.exp(sum(s * y for s, y in zip(scores, labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            moved[a, b] += weight
    return good / total, moved / total, np.log(total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-3, 3), min_size=1, max_size=7), min_size=1, max_size=5), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_forward_backward_equals_the_sum_over_labelings(chains, moves):
    moves = np.array(moves).reshape(2, 2)
    good, moved, whole = q.marginals(np.concatenate(chains).astype(float), np.array([len(c) for c in chains]), moves)
    want = [brute_marginals(c, moves) for c in chains]
    assert np.allclose(good, np.concatenate([w[0] for w in want]))
    assert np.allclose(moved, sum(w[1] for w in want))
    assert np.allclose(whole, [w[2] for w in want])


def test_line_shapes_of_single_lines_equal_those_in_a_text():
    texts = ["One line, two!! words\nTHE the end.\n\nOne line, two!! words", "", None, "a", "é é\n### ###"]
    shapes, lengths, counts = q.line_shapes(texts)
    assert counts.tolist() == [4, 1, 1, 1, 2]
    assert lengths.tolist() == [len(line.encode()) for t in texts for line in (t or "").split("\n")]
    alone = [q.line_shapes([line])[0][0] for t in texts for line in (t or "").split("\n")]
    repeat = q.SHAPES.index("repeat")
    assert shapes[3, repeat] == 1.0
    shapes[3, repeat] = alone[3][repeat] = 0
    assert np.allclose(shapes, np.stack(alone))


def test_neighbours_are_seen_within_a_text_only():
    shapes, _, counts = q.line_shapes(["good words here\n%%% $$$ ###", "%%% $$$ ###\ngood words here"])
    x = q.evidence(shapes, counts, np.zeros((shapes.shape[1], 1), dtype=np.float32))
    n = shapes.shape[1]
    assert not x[0, n:2 * n].any() and not x[1, 2 * n:3 * n].any()
    assert (x[0, 2 * n:3 * n] == x[1, :n]).all() and (x[1, n:2 * n] == x[0, :n]).all()


def small_field():
    good = [f"plain words of text number {i}\nand another line of it" for i in range(30)]
    bad = [f"%%% $$$ {i} ###\n@@@ ### ||| |||" for i in range(30)]
    shapes, _, counts = q.line_shapes(good + bad)
    return q.fit_field(shapes, counts, np.array([1] * 30 + [0] * 30))


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_weights_without_the_matrix(lines):
    field = small_field()
    texts = ["good words\n%%% ###\nagain words", "", "x", "a\n\nb", None, "THE %%%\n" * 7]
    shapes, _, counts = q.line_shapes(texts)
    want = q.evidence(shapes, counts, field.steps) @ field.weights
    assert np.allclose(q.line_weights(shapes, counts, field, lines), want, atol=1e-4)


def test_mixed_documents_score_between():
    field = small_field()
    good, bad = "plain words of text here\nand another line of it", "%%% $$$ ###\n@@@ ### |||"
    scores = q.text_scores([good, good + "\n" + bad, bad, "", None, "x" * 100_000, "\n" * 500], field)
    assert scores[0] > 0.9 > scores[1] > 0.1 > scores[2]
    assert ((scores >= 0) & (scores <= 1)).all()
    assert scores[3] == scores[4]


def test_operator_on_odd_rows(spark, docs):
    scored = q.score_quality(clashing(docs, "score", "held"), small_field()).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert q.score_quality(docs.limit(0), small_field()).count() == 0


def test_labels_that_say_nothing(spark, docs):
    for rows in ([], [(1, None), (2, 7)], [(1, 1), (2, 1), (3, 1)]):
        field = q.fit_quality(docs, spark.createDataFrame(rows, "doc_id bigint, quality int"))
        assert {round(r.score, 9) for r in q.score_quality(docs.limit(5), field).collect()} == {0.5}


def test_held_out_rows_teach_nothing(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = q.fit_quality(frame, labels), q.fit_quality(frame, flipped)
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()


def test_query_and_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op5_quality_lines(spark, LARGE).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.99


@pytest.mark.parametrize("n", [0, 1])
def test_no_texts(n):
    assert len(q.text_scores([""] * n, small_field())) == n


def test_copies_do_not_crowd_the_sample(spark, monkeypatch):
    monkeypatch.setattr(q, "SAMPLE_LINES", 200)
    docs = [(i, f"plain words of text number {i}\nand another line" if i % 2 else f"%%% $$$ {i}\n### ###") for i in range(1, 41)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, quality int")
    once = spark.createDataFrame(docs, "doc_id bigint, text string")
    # the copies come first in key order, and would fill all 200 lines
    repeated = spark.createDataFrame(docs + [docs[0]] * 300 + [(1, "x\n" * 11)], "doc_id bigint, text string").repartition(4)
    a, b = q.fit_quality(once, labels), q.fit_quality(repeated, labels)
    assert a.weights.any() and np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)


def test_the_line_bound_holds_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(q, "SAMPLE_LINES", 100)
    rows = [(i, i % 2, "line\n" * (i % 5)) for i in range(100)] + [(7, 1, "line\n" * 9)]
    sample = spark.createDataFrame(rows, "k bigint, y int, text string").selectExpr("k", "y", "text", "xxhash64(text) AS h")
    picked = q._one_text_of_each(sample).join(sample, ["k", "h"]).collect()
    assert len({r.k for r in picked}) == len(picked) and 0.7 * 100 < sum(r.text.count("\n") + 1 for r in picked) <= 100
