"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import decontaminate, fingerprints, hard_negatives, langid, oracles, packing, phrases, pii, quality, secret_scan, simhash, token_counts, toxicity, url_filter
from quillmine.llm.common import own_folder, table, written

VOCABULARY = "word_bpe_49k.json"
CACHE_CONF = "spark.quillmine.token.cache"


def vocabulary() -> str:
    """The vocabulary file, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document; a kept cache folder can be named in ``CACHE_CONF``."""
    cache = spark.conf.get(CACHE_CONF, None) or own_folder(spark, "token-cache")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, vocabulary(), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


BASE_PII = ("email", "ip", "card", "phone")


def span_text(spans) -> Column:
    """kind:start:end of every span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: str) -> Column:
    """How many of a row's ``spans`` are of one kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_PII))
    counts = [number_of(kind).alias(f"n_{kind}") for kind in BASE_PII]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window or near one, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), near=True)
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near", F.size("near_items").cast("bigint").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"))


URL_RULES = (
    url_filter.Rule("net", "/", allow=False),
    url_filter.Rule("example.net", "/en/", allow=True),
    url_filter.Rule("example.com", "/de/", allow=False),
    url_filter.Rule("org", "/fr/", allow=True),
)


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score_quality(docs.withColumn("held_out", quality.held_out()), field)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: strong patterns, and weak ones beside a complementary part."""
    found = secret_scan.with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [number_of(kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op7_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = langid.identify(docs.drop("lang").withColumn("held_out", quality.held_out()), langid.fit_languages(docs))
    return told.select("doc_id", "held_out", "lang_pred", "score")


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, held against an edit of it and against the next document."""
    return fingerprints.next_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and group of near duplicates of every document."""
    grouped = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, of tokens as ``op1_token_counts`` counts them, and their places in packed sequences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(written(token_counts.token_lengths(docs, vocabulary()), "packing-lengths"))


def op11_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs.withColumn("held_out", quality.held_out()), machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor, a fiftieth of all embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of the documents."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_pii_anchors, op3_decontamination, op4_url_verdicts, op5_quality_lines,
    op6_secret_links, op7_language_families, op8_chunk_fingerprints, op9_simhash_groups,
    op10_best_fit_packing, op11_toxicity_kernel, op12_hard_negatives, op13_phrase_collocations,
)}
ORACLES = {"op3_decontamination": oracles.DECONTAMINATION, "op4_url_verdicts": oracles.URL_VERDICTS,
           "op12_hard_negatives": oracles.HARD_NEGATIVES, "op13_phrase_collocations": oracles.COLLOCATIONS}
