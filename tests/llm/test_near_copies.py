import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from quillmine.llm import near_copies
from tests.llm.conftest import SF


def similarity(a, b):
    """Jaccard similarity of the sets of five-word shingles."""
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def edits(rng, text):
    """A copy with single words changed, of 5-word similarity about 0.75 to 1."""
    words = text.split()
    for _ in range(rng.randint(1, max(1, len(words) // 45))):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if len(r.text.split()) > 60]
    return given[:60] + [edits(rng, t) for t in given[:60]] + [edits(rng, given[0]) for _ in range(40)]


def test_the_stage_finds_what_brute_force_finds(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if similarity(texts[a], texts[b]) >= 0.8]
    root = list(range(len(texts)))
    for a, b in near:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    kept = {r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect()}
    lost, want = set(range(len(texts))) - kept, {i for i, r in enumerate(root) if r != i}
    assert len(want) > 60 and lost <= want
    assert len(lost) >= 0.98 * len(want)


def test_what_is_less_alike_stays(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text), (2, text.replace("word50", "x")), (3, text.replace("word20", "x").replace("word70", "y").replace("word45", "z")), (4, None), (5, " "), (None, text)]
    rows += [(6, "short text"), (7, "SHORT  text"), (2, rows[1][1])]
    assert similarity(text, rows[2][1]) < 0.8 < similarity(text, rows[1][1])
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 3, 4, 6])


def test_lists_meet_at_the_similarity_asked_for():
    rng = np.random.default_rng(1)
    met, tallies = 0, []
    for _ in range(300):
        all_of = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        a, b = (np.frombuffer(near_copies.signature(s), dtype=np.uint8) for s in (all_of[:270], all_of[30:]))
        met += (a == b).reshape(-1, near_copies.RUN).all(axis=1).any()
        tallies.append((a == b).sum())
    assert met >= 298 and min(tallies) >= near_copies.TALLY * near_copies.LEAST * near_copies.BYTES
    assert near_copies.signature(np.zeros(0, dtype=np.uint64)) == b""


def groups(texts, least=0.8):
    """Root of every text: the first text that it is connected to, similarities by set arithmetic over an inverted list."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    where, root = {}, list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where.get(g, ()))
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            where.setdefault(g, []).append(i)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [50])
def test_lists_of_thousands_with_common_passages(spark, monkeypatch, block):
    """Every text holds the same passage of 70 to 90 in a hundred words; pairs of them are near copies at 0.8 or more."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(160)]
    texts = []
    for i in range(600):
        own = passage + [f"w{i}x{j}" for j in range(rng.choice([18, 24, 36]))]
        texts.append(" ".join(own))
        for _ in range(rng.choice([0, 1, 2])):
            twin = list(own)
            for _ in range(rng.randint(1, 3)):
                twin[rng.randrange(len(twin))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(twin))
    root = groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in near_copies.keep_one(docs).select("doc_id").collect()}
    lost, want = set(range(len(texts))) - kept, {i for i, r in enumerate(root) if r != i}
    assert len(texts) > 1000 and len(want) > 300 and lost <= want
    assert len(lost) >= 0.98 * len(want)
