import zlib
from itertools import combinations

import numpy as np
import pytest

from quillmine.llm import toxicity
from tests.llm.conftest import EDGES, SF, clashing

LABELLED = SF.replace("0.001", "0.01")


def shown(some):
    """Strings as lists of classes, by sentence."""
    ends = np.append(some.starts, len(some.codes))
    out = {}
    for i, s in enumerate(some.sentence):
        word = "".join("^" if c == 1 else chr(95 + c) if 2 <= c < 28 else "#" if c == 0 else "~" for c in some.codes[ends[i]:ends[i + 1]])
        out.setdefault((int(some.sentence_text[s]), int(s)), []).append(word)
    return [(t, words) for (t, _), words in out.items()]


def test_strings_and_sentences():
    texts = ["You I.d-i.o,t! a b c\nDe f", None, "", "1d10t *** é x", "... --", "e.g. this"]
    assert shown(toxicity.strings(texts)) == [
        (0, ["^you", "^idiot"]), (0, ["^abc"]), (0, ["^de", "^f"]), (3, ["^#d##t", "^~x"]), (5, ["^eg"]), (5, ["^this"])]
    assert [len(w) for _, w in shown(toxicity.strings(["aa bb " * 20]))] == [16, 16, 8]


def brute_kernel(a, b):
    """Sum over common subsequences of four letters, both sides' stretches weighed, scaled as the module says."""
    def parts(word):
        out = {}
        for at in combinations(range(len(word)), 4):
            if at[-1] - at[0] < toxicity.SPAN and all(word[i] > 0 for i in at):
                key = tuple(int(word[i]) for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = parts(a), parts(b)
    scale = [max(sum(toxicity.DECAY ** (2 * (s[-1] - s[0] + 1)) for s in combinations(range(len(w)), 4) if s[-1] - s[0] < toxicity.SPAN),
                 toxicity.DECAY**8) ** 0.5 for w in (a, b)]
    return sum(v * y.get(k, 0) for k, v in x.items()) / scale[0] / scale[1]


def test_kernel_equals_brute_force():
    some = toxicity.strings(["idiot id-iot idxiot i1diot banana bananas trash t r a s h é è abcdefghijkl"])
    rows, table = toxicity._table(some)
    got = toxicity.kernel(some, rows, table)
    ends = np.append(some.starts, len(some.codes))
    words = [some.codes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)
    assert got[0, 0] > 0.9 and abs(got[0, 1] - got[0, 0]) < 1e-6 and got[0, 2] > 0.3 and got[0, 4] < 0.05


@pytest.fixture(scope="module")
def machine(spark):
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "text")
    return toxicity.fit_toxicity(docs, spark.read.parquet(f"{LABELLED}/labels.parquet"))


def test_one_weight_for_each_subsequence_is_the_kernel_machine(machine):
    """Sums over subsequences equal sums over landmark strings: take two strings as landmarks by hand."""
    marks = toxicity.strings(["idiot moron"])
    rows, table = toxicity._table(marks)
    alpha = np.array([0.7, -0.4], dtype=np.float32)
    hand = toxicity.Machine(np.flatnonzero(rows >= 0), table @ alpha, 0.1, np.ones(toxicity.HIGHEST), 0.0)
    some = toxicity.strings(["idiot", "an idi-ot here", "morons", "nothing"])
    want = np.maximum.reduceat(toxicity.kernel(some, rows, table) @ alpha, np.flatnonzero(np.diff(some.sentence, prepend=-1))) + 0.1
    assert np.allclose(toxicity.sentence_values(some, hand.weights(), 0.1), want, atol=1e-6)


def test_insults_are_caught_also_with_gaps_and_inserted_characters(machine):
    clean = "The report was the thing that they were to read on."
    texts = [clean, *(f"{clean} You {w} and {w}. So {w}." for w in ("idiot", "i d i o t", "i-d-i-o-t", "MORON!!!", "idiott", "m.o.r.o.n"))]
    scores = toxicity.text_scores(texts, machine)
    assert scores[0] < 0.2 and (scores[1:] >= 0.5).all()


def test_held_out_accuracy(spark, machine):
    docs = spark.read.parquet(f"{LABELLED.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LABELLED.replace('0.01', '0.1')}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    told, known = toxicity.text_scores([r.text for r in rows], model) >= 0.5, np.array([r.toxic for r in rows])
    assert len(rows) > 700 and told[known == 1].mean() > 0.85 and 1 - told[known == 0].mean() > 0.94


def test_spark_equals_the_function_and_keeps_rows(spark, machine, docs, texts):
    scored = toxicity.score_toxicity(clashing(docs, "score", "labels"), machine)
    assert scored.columns == ["doc_id", "text", "labels", "score"]
    got = sorted((r.doc_id or -1, r.text or "", r.score) for r in scored.collect())
    want = sorted((i or -1, t or "", float(s)) for (i, t), s in zip(texts, toxicity.text_scores([t for _, t in texts], machine), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want]) and all(0 <= g[2] <= 1 for g in got)


def test_pieces_of_long_texts(machine, monkeypatch):
    texts = ["the idiot said. " * 40 + "x" * 300 + " no more. ", *EDGES]
    whole = toxicity.text_scores(texts, machine)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    owner, pieces = toxicity._pieces(texts)
    assert max(map(len, pieces)) <= 100 and ["".join(p for o, p in zip(owner, pieces, strict=True) if o == i) for i in range(len(texts))] == [t or "" for t in texts]
    assert abs(toxicity.text_scores(texts, machine)[0] - whole[0]) < 0.2


def test_no_labels_one_label_and_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a moron"), (2, None), (3, ""), (None, "x"), (1, "again")], "doc_id bigint, text string")

    def scores(rows):
        model = toxicity.fit_toxicity(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        return {round(r.score, 6) for r in toxicity.score_toxicity(docs, model).collect()}

    assert scores([]) == {0.0} and scores([(1, 0), (1, 1), (7, 1)]) == {0.0} and scores([(1, None), (2, 5), (None, 1)]) == {0.0}
    assert scores([(1, 1)]) == {1.0}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit([], np.zeros(0))).count() == 0
    model = toxicity.fit(["an idiot", "", "fine words"], np.array([1, 0, 0]))
    assert np.isfinite(toxicity.text_scores(["an idiot", None], model)).all()
