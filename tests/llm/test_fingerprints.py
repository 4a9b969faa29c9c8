import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.llm import fingerprints as fp
from quillmine.llm.queries import op8_chunk_fingerprints
from tests.llm.conftest import clashing


def slow_chunks(text, c=fp.Chunking()):
    """The same cut rule, one code point at a time."""
    h, out, start = 0, [], 0
    for i, ch in enumerate(text):
        h = ((h << 1) + (int(fp._mixed(np.array([ord(ch)]))[0]) >> 32)) & 0xFFFFFFFF
        size = i + 1 - start
        cut = (size >= c.least and h >> (32 - c.strict) == 0) if size <= c.usual else h >> (32 - c.lax) == 0
        if cut or size == c.most:
            out.append(text[start:i + 1])
            start = i + 1
    return out + [text[start:]] if start < len(text) else out


def chunks(text):
    starts = fp.cut_points(fp.gear(fp.code_points(text)), fp.Chunking())
    return [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]


def test_chunks_follow_the_rule_and_digests_the_chunks(texts):
    for _, text in texts:
        if text:
            want = slow_chunks(text)
            assert chunks(text) == want
            digests, weights = fp.fingerprint(text)
            assert len(digests) == len(set(want))
            assert weights.sum() == len(text)


def test_an_insertion_leaves_most_chunks():
    words = random.Random(5)
    text = " ".join("".join(words.choices("abcdefghij", k=words.randint(2, 9))) for _ in range(600))
    moved = text[:1000] + "something new " + text[1000:]
    a, b = fp.fingerprint(text), fp.fingerprint(moved)
    assert fp.containment(a, b) > 0.9
    assert fp.containment(a, fp.fingerprint(text[::-1])) < 0.1
    assert fp.containment(fp.fingerprint(text[:1500]), a) > 0.9


def test_containment_of_nothing():
    none, some = fp.fingerprint(""), fp.fingerprint("some text")
    assert (fp.containment(none, none), fp.containment(none, some), fp.containment(some, none)) == (1.0, 0.0, 0.0)
    assert len(fp.fingerprint(None)[0]) == 0


def test_operator(docs, texts):
    got = fp.fingerprints(clashing(docs, "fingerprint", "digest")).collect()
    assert sorted((r.doc_id or 0, sum(c.weight for c in r.fingerprint)) for r in got) == sorted((i or 0, len(t or "")) for i, t in texts)
    assert fp.fingerprints(docs.limit(0)).count() == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + following[:k]
        own = fp.fingerprint(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.shown(own), fp.shown(fp.fingerprint(edited)),
                    fp.containment(own, fp.fingerprint(edited)), fp.containment(own, fp.fingerprint(following))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_next_document_across_ranges(spark, docs, texts, parts, monkeypatch):
    split = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda *a, **b: split(*a, **b, parts=parts))
    # repeated rows and null ids: their order among each other is that of their texts
    assert sorted(repr(tuple(r)) for r in fp.next_likeness(docs).collect()) == brute(texts)


def test_single_row_and_empty_table(spark, docs):
    one = fp.next_likeness(spark.createDataFrame([(7, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(7, hashlib.sha256(b"abcdefab").hexdigest())]
    assert fp.next_likeness(docs.limit(0)).count() == 0


def test_query(spark, folder, texts):
    rows = op8_chunk_fingerprints(spark, folder)
    assert sorted(repr(tuple(r)) for r in rows.collect()) == brute([t for t in texts if t[0] is not None])
    spread = rows.where("n_chars > 400").agg(F.min("near_edited"), F.max("near_next")).first()
    assert spread[0] > spread[1]
