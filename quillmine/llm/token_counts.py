"""Token counts through a digest cache: only content never seen before is encoded.

Content is normalised (runs of space, tab and line ends become one space, ends are trimmed) and
digested with SHA-256; the tokenizer's version is the digest of its vocabulary file and library.
Digests are joined to the stored counts, distinct misses are encoded once and appended.

The normalisation keeps every count: these tokenizers drop white space, no token and no special
string spans it, and canonical composition never crosses a space.  For the same reason a text's
count is the sum over its space-separated words, so a task encodes every distinct word of a block
once.  A vocabulary file that keeps white space is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmine.llm.common import without
from quillmine.session import cut_lineage, ship_package

CACHE_SCHEMA = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("tokenizer", T.StringType()),
])
#: A worker's memory of word counts: so many words of at most so many characters.
MEMO_WORDS = 400_000
MEMO_LENGTH = 40
#: Printable ASCII without "<" (special strings start with it) needs no normaliser but lower case, and
#: splits into these pieces, so the library's model is asked directly; other words take its whole path.
PLAIN = re.compile(r"[!-;=-~]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The settings for which ``PIECE`` and lower case are what the library does to such words.
LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: Words and white space that tell a tokenizer which keeps white space.
PROBES = (" ", "a b", " a", "a ", "a  b", "a\tb", "a\n\nb", "the cat\r\n sat.", "1 2", "<a> b")


def tokenizer_version(vocabulary: str) -> str:
    """Digest of the vocabulary file's bytes and the library's version."""
    import tokenizers

    with open(vocabulary, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def drops_white_space(tokenizer) -> bool:
    """Whether the probes count as many tokens as their words do one by one."""
    def count(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    return all(count(probe) == sum(map(count, probe.split())) for probe in PROBES)


def known_pieces(settings: dict) -> bool:
    """Whether a vocabulary file treats plain words as ``PIECE`` does: its normaliser, splitter, model and special strings."""
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = settings["model"]
    return (
        (settings.get("normalizer") or {}).get("normalizers") == LOWERS
        and [s.get("type") for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == SPLITS
        and split[0]["behavior"] == "Removed" and split[0]["invert"]
        and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        and model.get("type") == "BPE" and not model.get("dropout")
        and all("<" in added["content"] for added in settings.get("added_tokens", ())))


def normalised(text: str = "text"):
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \\t\\r\\n]+", " "))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``digest`` (binary) and ``n_tokens`` (long) added.

    ``vocabulary``: a white-space-dropping ``tokenizers`` file, at the same path on every executor; one that
    keeps white space is a ValueError.
    ``cache``: folder of the stored counts, shared and kept by the caller; created when missing,
    appended to otherwise.  Counts of other tokenizer versions in it are left alone.
    Null text counts as empty: 0 tokens.  Repeated rows come back as often as they came; columns
    named ``digest`` or ``n_tokens`` are replaced; any other column passes through.  No table rows:
    no rows.  Two runs may append one digest twice; readers take it once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    _checked(vocabulary)
    version = tokenizer_version(vocabulary)
    keyed = docs.select(F.unhex(F.sha2(normalised(text), 256)).alias("digest"), normalised(text).alias("__content"))
    # copies go map-side, before the exchange that also serves the join with the cache
    misses = keyed.dropDuplicates(["digest"]).join(stored(spark, cache, version), "digest", "left_anti")
    counted = misses.mapInPandas(_counter(vocabulary, "digest"), "digest binary, n_tokens bigint")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # checkpointed, so that the join below has two plain sides and a digest of very many rows can be split
    known = cut_lineage(stored(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    digests = without(docs, "digest", "n_tokens").withColumn("digest", F.unhex(F.sha2(normalised(text), 256)))
    digests = digests.drop(text)
    return digests.join(known, "digest", "left").select(*(F.col(f"`{c}`") for c in digests.columns), "n_tokens")


def token_lengths(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens``: the counts of ``count_tokens`` without a cache, row for row, made where the texts lie.

    For a caller that needs the lengths once: texts are not exchanged, and a task encodes the distinct words
    of its block once, so copies cost little.  Null text counts as empty.
    """
    ship_package(docs.sparkSession)
    _checked(vocabulary)
    rows = docs.select(F.col(key), normalised(text).alias("__content"))
    return rows.mapInPandas(_counter(vocabulary, key), T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType())]))


def _checked(vocabulary: str) -> None:
    from tokenizers import Tokenizer

    if not drops_white_space(Tokenizer.from_file(vocabulary)):
        raise ValueError(f"{vocabulary} keeps white space: its counts are not sums over words")


def stored(spark, cache: str, version: str) -> DataFrame:
    """The cached counts of one tokenizer version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).drop("tokenizer")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).drop("tokenizer")


@lru_cache(maxsize=2)
def _loaded(vocabulary: str):
    """The tokenizer of this Python worker, its counts of short words, and whether it splits plain words as ``PIECE`` does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as file:
        pieces = known_pieces(json.load(file))

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, {}, pieces


def _counter(vocabulary: str, key: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, memo, pieces = _loaded(vocabulary)
        for part in parts:
            counts = [count for rows in _blocks(part["__content"]) for count in count_words(tokenizer, memo, rows, pieces)]
            yield pd.DataFrame({key: part[key], "n_tokens": pd.Series(counts, dtype="int64")})

    return run


def _blocks(texts, size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters, so that a block's words stay few."""
    block, chars = [], 0
    for text in texts:
        block.append(text)
        chars += len(text)
        if chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block


def count_words(tokenizer, memo: dict[str, int], texts: list[str], pieces: bool = True) -> list[int]:
    """Counts of normalised texts; every word of the block that the memo lacks is encoded once.

    ``pieces``: whether plain words may go to the model directly, as ``known_pieces`` tells.
    """
    words = [text.split(" ") for text in texts]
    new = set().union(*words).difference(memo)
    plain = {word for word in new if PLAIN.fullmatch(word)} if pieces else set()
    model = tokenizer.model
    for word in plain:
        memo[word] = sum(len(model.tokenize(piece)) for piece in PIECE.findall(word.lower()))
    rest = list(new - plain)
    memo.update(zip(rest, map(len, tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
    out = [sum(map(memo.__getitem__, row)) for row in words]
    for word in new:
        if len(word) > MEMO_LENGTH:
            del memo[word]
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return out
