"""A corpus pipeline of the training-data operators: each stage keeps, drops or packs documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import decontaminate, near_copies, packing, quality, secret_scan, simhash, token_counts
from quillmine.llm.common import row_key, table, written
from quillmine.llm.queries import vocabulary

#: Documents below this quality score go.
LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on ``labels``, does not reject."""
    field = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select(F.struct(*docs.columns).alias("doc"), "text"), field)
    return scored.where(F.col("score") >= LEAST_QUALITY).select("doc.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    SimHash proposes as in ``op9_simhash_groups`` (fingerprints at most 3 bits apart), the exact similarity decides, and
    an index of minima finds the copies that fingerprints miss.
    """
    return near_copies.keep_one(docs, bits=simhash.BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ``benchmark`` occurs."""
    hits = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hits = hits.select(F.col("text_hash").alias("__hash"))
    return docs.join(hits, row_key("doc_id", "text") == F.col("__hash"), "left_anti")


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret, strong or linked."""
    found = secret_scan.find_secrets(docs)
    found = written(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "pipeline-secrets")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (row_key("doc_id", "text") == F.col("__hash"))
    return docs.join(found, same, "left_anti")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of every document's pieces in packed sequences; lengths are those of ``token_counts``."""
    return packing.pack(written(token_counts.token_lengths(docs, vocabulary()), "pipeline-lengths"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", drop_secrets),
    ("best_fit_packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifier, the fingerprints' groups and the packing; tests hold them against brute force.
ORACLE_SQL = None
