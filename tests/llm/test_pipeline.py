import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quillmine.llm import near_copies, packing, quality, simhash
from quillmine.llm.queries import vocabulary
from tests.llm.conftest import EDGES, SF
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_copies import groups
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secret_scan import brute as brute_secrets

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark):
    """Documents of the smallest scale and the edge texts, with all columns and repeated rows."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    edges = [(20_000 + i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(EDGES)]
    edges += edges[4:8] + [(None, "a null id", None, None, None)]
    return given.unionByName(spark.createDataFrame(edges, given.schema)).cache()


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def stage(spark, table, name, **columns):
    docs = table.select("*", *(F.lit(v).alias(k) for k, v in columns.items()))
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns or name == "best_fit_packing"
    return out


def test_the_stages():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    assert pipeline.ORACLE_SQL is None


def test_quality_keeps_what_scores_enough(spark, table):
    field = quality.fit_quality(table, spark.read.parquet(f"{SF}/labels.parquet"))
    want = Counter(r for r in rows(table) if quality.text_scores([r[1]], field)[0] >= 0.3)
    assert Counter(rows(stage(spark, table, "quality_classifier", score=1, doc="x"))) == want


def test_one_document_of_each_group(spark, table):
    """Groups at a shingle similarity of 0.8 by brute force; clashing names change nothing."""
    given = sorted(set(rows(table)), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in given]
    # the first text that makes a group is the row that stays; texts without words are one group
    blank = [i for i, t in enumerate(texts) if not t.split()]
    want = {given[r] for i, r in enumerate(groups(texts)) if i not in blank} | {given[blank[0]]}
    got = rows(stage(spark, table, "simhash_near_dedup", hash=1, simhash=2, sid=3, check=4, signature=5))
    assert len(got) == len(set(got)) and set(got) <= set(given)
    assert len(set(got) ^ want) <= 0.02 * len(want)


def test_fingerprints_propose_and_the_similarity_decides(spark, monkeypatch):
    """SimHash groups are the first pairs of the stage; one whose five-word shingles are less alike than 0.8 stays apart."""
    draw = random.Random(17)
    base = [f"w{draw.randrange(10**6)}" for _ in range(40)] * 30
    tail = [f"z{draw.randrange(10**6)}" for _ in range(20)]
    near = [f"y{draw.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base + tail), "other words that stand alone here", "", None,
             " ".join(near), " ".join(["x", *near])]
    assert all((simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() <= simhash.BITS for a, b in ((0, 1), (5, 6)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    link, proposed = near_copies._similar, []

    def similar(pairs, *more):
        proposed.append(pairs.count())
        return link(pairs, *more)

    monkeypatch.setattr(near_copies, "_similar", similar)
    assert {i for i, _ in rows(STAGES["simhash_near_dedup"](spark, docs, SF))} == {0, 1, 2, 3, 5}
    # both groups of fingerprints were proposed first, and nothing was left to the lists
    assert proposed[0] == 2 and not any(proposed[1:])


def test_documents_with_benchmark_windows_go(spark, table):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    given = rows(table)
    clean = {(i, t) for i, t in given if next(iter(brute_hits([(i, t)], items)))[2] == 0}
    assert len(clean) < len(set(given))
    assert Counter(rows(stage(spark, table, "benchmark_decontamination", term=1, pos=2))) == Counter(r for r in given if r in clean)


def test_documents_with_secrets_go(spark, table):
    given = rows(table)
    got = Counter(rows(stage(spark, table, "secret_scans", spans=1, kind="k")))
    assert not [r for r in got if brute_secrets(r[1])]
    # beside strong secrets only the edge texts with linked weak parts go
    lost = Counter(r for r in given if not brute_secrets(r[1])) - got
    assert {t for _, t in lost} <= {t for t in EDGES if t and ("Zx81" in t or "user" in t or "://" in t)}


def test_packing_places_every_token(spark, table):
    docs = table.where("doc_id IS NOT NULL")
    library = Tokenizer.from_file(vocabulary())
    lengths = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows(docs)]
    check_packing(stage(spark, docs, "best_fit_packing").collect(), lengths, packing.SIZES)


def test_empty_documents(spark, table):
    for name, function in pipeline.STAGES:
        assert function(spark, table.limit(0), SF).count() == 0


def test_run_is_the_stages_one_after_the_other(spark, table, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, function in pipeline.STAGES:
        docs = function(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))

    def digest(df):
        return hashlib.sha256(repr(sorted(map(repr, map(tuple, df.collect())))).encode()).hexdigest()

    assert digest(pipeline.run(spark, SF)) == digest(docs)
