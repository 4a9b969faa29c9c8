import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmine.llm import langid
from quillmine.llm.queries import op7_language_families
from tests.llm.conftest import SF, clashing

LARGE = "/root/testdata/sf0.1"


def brute_vector(text):
    counts = np.zeros(1 << langid.WIDTH_BITS)
    text = text.lower()
    for n in langid.GRAMS:
        for i in range(len(text) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in text[i:i + n]:
                h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            counts[(h * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - langid.WIDTH_BITS)] += 1
    return np.sqrt(counts) / max(np.sqrt(counts.sum()), 1e-9)


def test_vectors_of_a_block_equal_those_of_single_texts():
    texts = ["Hello", "", "é", "ab", None, "İx 😀", "the end"]
    assert np.allclose(langid.vectors(texts), np.stack([brute_vector(t or "") for t in texts]), atol=1e-6)


def sample(langs, n, seed=1):
    draw, out = random.Random(seed), []
    for lang in langs:
        for _ in range(n):
            out.append((lang, " ".join("".join(draw.choices(langs[lang], k=4)) for _ in range(12))))
    return out


LANGS = {"en": "abcde", "de": "abcdz", "fr": "mnopq", "es": "mnopz", "xx": "rstuv"}


def test_every_pair_of_a_family_has_a_machine_and_others_none():
    rows = sample(LANGS, 30)
    model = langid.fit(langid.vectors([t for _, t in rows]), [lang for lang, _ in rows])
    assert model.families == ["germanic", "romance", "xx"]
    assert set(model.pair_weights) == {("de", "en"), ("es", "fr")}
    fresh = sample(LANGS, 20, seed=2)
    got, score = langid.predict(langid.vectors([t for _, t in fresh]), model)
    assert np.mean([g == lang for g, (lang, _) in zip(got, fresh)]) > 0.95
    assert ((score >= 0) & (score <= 1)).all()


def test_one_language_alone(spark):
    docs = spark.createDataFrame([(i, "some words", "en") for i in range(1, 9)], "doc_id bigint, text string, lang string")
    got = langid.identify(docs, langid.fit_languages(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("en", 1.0)}


def test_odd_rows_and_nothing_to_learn_from(spark, docs):
    frame = clashing(docs, "lang_pred", "h")
    none = langid.fit_languages(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert none is None
    assert {(r.lang_pred, r.score) for r in langid.identify(frame, none).collect()} == {("und", 0.0)}
    rows = sample(LANGS, 10)
    model = langid.fit(langid.vectors([t for _, t in rows]), [lang for lang, _ in rows])
    got = langid.identify(frame, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(docs.limit(0), model).count() == 0


def test_query_and_held_out_accuracy(spark):
    rows = op7_language_families(spark, LARGE).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.99


def test_copies_do_not_crowd_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where(~langid.held_out("doc_id")).orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).limit(1)
    repeated = docs.unionByName(one.crossJoin(spark.range(300)).drop("id"))
    a, b = langid.fit_languages(docs), langid.fit_languages(repeated)
    assert a.pair_weights.keys() == b.pair_weights.keys()
    assert all(np.allclose(w, b.pair_weights[pair]) for pair, w in a.pair_weights.items())


def test_many_language_values_share_one_bounded_sample(spark, monkeypatch):
    """A dirty column of 300 values: the commonest are learned, with as many texts of each as the bound allows."""
    monkeypatch.setattr(langid, "LANGUAGES", 6)
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 48)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, langs, families: seen.append((len(x), langs)))
    rows = [(i, f"some words {i}", f"l{i % 5}") for i in range(400)] + [(1000 + i, f"words {i}", f"rare{i}") for i in range(300)]
    langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    n, langs = seen[0]
    assert n <= 48 and len(set(langs)) <= 6 and {f"l{i}" for i in range(5)} <= set(langs)
    assert max(langs.count(c) for c in set(langs)) == 8
