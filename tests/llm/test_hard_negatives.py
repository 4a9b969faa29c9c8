import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """Plain loops over all pairs, in the order that the contract states."""
    good = []
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    out, seen = [], set()
    for i, v, y in good:
        if i % 5 or (i, tuple(v), y) in seen:
            continue
        seen.add((i, tuple(v), y))
        others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in good if j != i and len(w) == len(v))
        for p, j, z in [o for o in others if o[2] == y][:positives]:
            fit = [(s, k) for s, k, z in others if z != y and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, hn.hard_negatives(docs, F.col("vec_id") % 5 == 0, **more).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    some = [(i, [c + rng.gauss(0, 0.6) for c in rng.choice(centre)], rng.randrange(4)) for i in range(220)]
    # whole numbers and few of them: many ties
    some += [(300 + i, [float(rng.randint(0, 1)) for _ in range(6)], rng.randrange(3)) for i in range(90)]
    some += [(400, None, 1), (405, [1.0] * 6, None), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (415, [float("nan")] * 6, 1), (420, [float("inf")] * 6, 2)]
    some += [(None, [1.0] * 6, 1), (425, [1.0, 2.0], 1), (426, [2.0, 1.0], 1), (427, [1.0, 1.0], 2), (430, [], 1), (431, [], 1), (435, [0.0] * 6, 77), (440, [-1.0] * 6, 1)]
    return some + some[5:9] + some[7:8]


@pytest.mark.parametrize("more", [{}, {"positives": 1, "negatives": 1}, {"positives": 9, "negatives": 4, "low": 20, "high": 100}])
def test_equals_brute_force(spark, rows, more):
    want = brute(rows, **more)
    assert len(want) > 50
    assert found(spark, rows, **more) == want


def test_small_blocks_and_steps_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 150)
    monkeypatch.setattr(hn, "SCORES", 64)
    assert found(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2**20)) for _ in range(8)], i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_nothing_to_mine(spark, rows):
    assert found(spark, []) == []
    assert found(spark, [r for r in rows if r[0] and r[0] % 5]) == []
    assert found(spark, [(5, [1.0], 1), (6, [1.0], 2)]) == []


def test_a_task_sends_no_more_than_its_anchors_need():
    best = hn.Best(4, 3)
    rng = np.random.default_rng(1)
    for _ in range(50):
        best.add(rng.integers(0, 4, 500), rng.integers(-5, 5, 500), rng.integers(0, 10**6, 500))
    assert len(best.group) == 12 and (best.least == best.score.reshape(4, 3)[:, 2]).all()


def test_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS v", "3 AS score", "4 AS g", "5 AS a")
    got = hn.hard_negatives(docs, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
