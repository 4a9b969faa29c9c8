"""Language identification in two steps: family first, then closely related languages apart.

One linear support vector machine per family picks the family; within it one per pair of languages
votes.  Texts are seen as square roots of hashed character n-gram counts, scaled to length 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import without
from quillmine.llm.quality import held_out
from quillmine.session import ship_package

#: Bound of the fitting sample: so many documents of each language at most.
SAMPLE_DOCS = 600
#: Learned languages, and documents of all of them together (8 KB each on the driver).
LANGUAGES = 200
SAMPLE_TOTAL = 24_000
WIDTH_BITS = 12
GRAMS = (1, 2, 3)
#: Languages that are told apart within a family; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
UNKNOWN = "und"


def vectors(texts: list[str | None]) -> np.ndarray:
    """One row per text: hashed n-gram counts, square roots, scaled to length 1; zeros for an empty text."""
    width = 1 << WIDTH_BITS
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * width, sizes)
    counts = np.zeros(len(texts) * width, dtype=np.int64)
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ points[i:i + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        inside = owner[:m] == owner[n - 1:]
        at = owner[:m] + (h >> np.uint32(32 - WIDTH_BITS))
        counts += np.bincount(at[inside], minlength=len(counts))
    out = np.sqrt(counts.reshape(len(texts), width), dtype=np.float32)
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Languages:
    """Linear machines: one per family, and one per pair of languages of a family (positive: the first)."""

    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]


def fit_machine(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; both classes weigh the same."""
    w, speed = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        slack = np.maximum(1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]), 0)
        pull = (share * slack * y).astype(np.float32)
        slope = np.concatenate([x.T @ pull, [pull.sum()]]) * 2 - decay * ahead
        speed = 0.9 * speed + 0.3 * slope
        w = w + speed
    return w


def fit(x: np.ndarray, langs: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Languages:
    """Machines for the languages that occur."""
    home = {lang: name for name, group in families.items() for lang in group}
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(home.get(lang, lang), []).append(lang)
    names, y = sorted(members), np.array(langs)
    kin = np.array([home.get(lang, lang) for lang in langs])
    tops = np.stack([fit_machine(x, np.where(kin == n, 1.0, -1.0)) for n in names]) if len(names) > 1 else np.zeros((len(names), x.shape[1] + 1))
    pairs = {}
    for group in members.values():
        for a, b in combinations(group, 2):
            of = (y == a) | (y == b)
            pairs[a, b] = fit_machine(x[of], np.where(y[of] == a, 1.0, -1.0))
    return Languages(names, members, tops, pairs)


def predict(x: np.ndarray, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every row: the product of the family's and the language's certainty."""
    tops = x @ model.family_weights[:, :-1].T.astype(np.float32) + model.family_weights[:, -1]
    kin = tops.argmax(axis=1)
    if len(model.families) > 1:
        rest = np.where(np.arange(tops.shape[1]) == kin[:, None], -np.inf, tops).max(axis=1)
        sure = _certainty(tops[np.arange(len(x)), kin] - rest)
    else:
        sure = np.ones(len(x))
    out = np.empty(len(x), dtype=object)
    for i, name in enumerate(model.families):
        at, group = np.flatnonzero(kin == i), model.members[name]
        votes, margin = np.zeros((len(at), len(group))), np.full((len(at), len(group)), np.inf)
        for (a, b), w in model.pair_weights.items():
            if a in group:
                m, ia, ib = x[at] @ w[:-1].astype(np.float32) + w[-1], group.index(a), group.index(b)
                votes[:, ia] += m > 0
                votes[:, ib] += m <= 0
                margin[:, ia], margin[:, ib] = np.minimum(margin[:, ia], m), np.minimum(margin[:, ib], -m)
        best = np.lexsort((np.arange(len(group))[None, :].repeat(len(at), 0), -margin, -votes), axis=1)[:, 0] if len(at) else np.zeros(0, int)
        out[at] = np.array(group, dtype=object)[best]
        if len(group) > 1:
            sure[at] *= _certainty(2 * margin[np.arange(len(at)), best])
    return out, sure


def _certainty(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Languages | None:
    """Fit on documents with a language, a letter in their text, and a key that is not held out.

    The sample is ``SAMPLE_DOCS`` keys of each language at most, those with the smallest hashes, and of each
    key the text with the smallest hash: a hash threshold from each language's approximate count of keys
    keeps about that many on the executors, the driver cuts to the bound.  Of more than ``LANGUAGES`` values
    of ``lang`` those with the most keys are learned, and the whole sample is ``SAMPLE_TOTAL`` keys at most,
    the same number of each language.  None if no document qualifies.
    """
    ship_package(docs.sparkSession)
    fit_rows = docs.where(F.col(lang).isNotNull() & ~held_out(key)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(key), 1).alias("h"),
        F.xxhash64(text).alias("t")).where(F.col("text").rlike("\\p{L}"))
    sizes = fit_rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    counts = {r.lang: r.n for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts))
    top = 2**63 - 1
    most = {c: min(top, top // max(n, 1) * each * 6 // 5) for c, n in counts.items()}
    below = F.create_map(*(F.lit(v) for pair in most.items() for v in pair))[F.col("lang")]

    def seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set[tuple[str, int]] = set()
        for part in parts:
            # a task reads equal rows once
            part = part.drop_duplicates(["lang", "h"])
            part = part[[(c, h) not in held for c, h in zip(part["lang"], part["h"], strict=True)]]
            held.update(zip(part["lang"], part["h"], strict=True))
            for at in range(0, len(part), 64):
                some = part.iloc[at:at + 64]
                rows = vectors(some["text"].tolist()).astype(np.float16)
                yield pd.DataFrame({"lang": some["lang"], "h": some["h"], "x": [r.tobytes() for r in rows]})

    likely = fit_rows.where(F.col("h") <= below)
    first = likely.groupBy("lang", "h").agg(F.min("t").alias("t"))
    rows = likely.join(first, ["lang", "h", "t"], "left_semi").mapInPandas(seen, "lang string, h bigint, x binary")
    rows = rows.dropDuplicates(["lang", "h"]).collect()
    taken: dict[str, int] = {}
    chosen = []
    for r in sorted(rows, key=lambda r: (r.lang, r.h, bytes(r.x))):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= each:
            chosen.append(r)
    x = np.stack([np.frombuffer(r.x, dtype=np.float16) for r in chosen]).astype(np.float32)
    return fit(x, [r.lang for r in chosen], families)


def identify(docs: DataFrame, model: Languages | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text.

    A null text, one without a letter, or no model: ``und`` with score 0.  Rows one for one; columns of the
    added names are replaced.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = [], []
            for block in _blocks(batch.tolist()):
                got, sure = predict(vectors(block), model)
                langs.append(got)
                scores.append(sure)
            yield pd.DataFrame({"lang": np.concatenate(langs), "score": np.concatenate(scores)}) if langs else pd.DataFrame({"lang": [], "score": []})

    clean = without(docs, "lang_pred", "score")
    if model is None:
        return clean.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    read = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    told = clean.withColumn("__told", column(F.when(read, F.col(text))))
    return told.select(
        *(F.col(f"`{c}`") for c in clean.columns),
        F.when(read, F.col("__told.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(read, F.col("__told.score")).otherwise(0.0).alias("score"))


def _blocks(texts: list[str | None], size: int = 1 << 19, most: int = 256) -> Iterator[list[str | None]]:
    block, chars = [], 0
    for text in texts:
        block.append(text)
        chars += len(text or "")
        if chars >= size or len(block) == most:
            yield block
            block, chars = [], 0
    if block:
        yield block
