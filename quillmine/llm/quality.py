"""Document quality from a linear-chain conditional random field over its lines.

Every line is good or bad.  A line's evidence is its own shape and that of the lines beside it, and
neighbouring labels are tied by transition weights.  Forward-backward gives every line's marginal
probability of being good; the document's score is their mean, weighted by line length.

The field is fitted on a bounded sample of labelled documents, whose lines take their document's
label; scoring covers every line of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import without
from quillmine.session import ship_package

#: Bound of the fitting sample: so many labelled documents at most, and lines of them at most.
SAMPLE_DOCS = 4000
SAMPLE_LINES = 200_000
#: Shapes become features by comparison with these quantiles of the sample's lines.
QUANTILES = (0.03, 0.1, 0.3, 0.5, 0.7, 0.85, 0.93, 0.98)
#: The share of the data that is held out: one in five, by the checksum of the id's text.
FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is held out of fitting: crc32 of the key's text is divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


CLASSES = 6
SHAPES = ("length", "upper", "digit", "mark", "rare", "gap", "word", "marked", "same", "repeat", "stutter")


def _classes() -> np.ndarray:
    """Class of every byte: 0 other letters, 1 capitals, 2 digits, 3 usual punctuation, 4 rare marks, 5 white space."""
    table = np.zeros(256, dtype=np.uint8)
    for byte in range(128):
        char = chr(byte)
        table[byte] = 1 if "A" <= char <= "Z" else 2 if char.isdigit() else 0 if char.isalpha() else 5 if byte <= 32 else (
            3 if char in ".,;:'\"!?()-" else 4)
    return table


CLASS_OF = _classes()


def line_shapes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes of all lines of some texts, lengths of the lines in bytes, and how many lines each text has.

    A text has one line more than line feeds, so an empty text has one empty line.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lines = [line for raw in raws for line in raw.split(b"\n")]
    counts = np.array([raw.count(b"\n") + 1 for raw in raws], dtype=np.int64)
    codes = CLASS_OF[np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)]
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    share = np.empty((CLASSES, len(lines)))
    for k in range(CLASSES):
        share[k] = np.add.reduceat(codes == k, starts, dtype=np.int64)
    share[5] -= 1  # the line feed
    gap = codes == 5
    word_starts = np.add.reduceat(~gap & np.concatenate([[True], gap[:-1]]), starts, dtype=np.int64)
    after_mark = np.concatenate([[False], (codes[:-1] >= 3) & (codes[:-1] <= 4)])
    marked = np.add.reduceat(gap & after_mark, starts, dtype=np.int64)
    twin = np.concatenate([[False], (codes[1:] == codes[:-1]) & (codes[1:] >= 3) & (codes[1:] <= 4)])
    same = np.add.reduceat(twin, starts, dtype=np.int64)
    size, words = np.maximum(lengths, 1), np.maximum(word_starts, 1)
    shapes = np.stack([
        np.log1p(lengths), share[1] / size, share[2] / size, share[3] / words, share[4] / words, share[5] / size,
        np.log1p((lengths - share[5]) / words), marked / words, same / words, *_repeats(lines, counts),
    ], axis=1)
    return shapes.astype(np.float32), lengths, counts


def _repeats(lines: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much of a line is repetition (1 if the line stood before in its text), and how many words repeat the word before."""
    out, stutter, at = np.zeros(len(lines)), np.zeros(len(lines)), 0
    for n in counts.tolist():
        seen: set[bytes] = set()
        for i in range(at, at + n):
            line = lines[i]
            if not line:
                continue
            words = line.lower().split()
            if words:
                out[i] = 1.0 if line in seen else 1 - len(set(words)) / len(words)
                stutter[i] = sum(map(eq, words, words[1:])) / len(words)
            seen.add(line)
        at += n
    return out, stutter


def evidence(shapes: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Binary features of every line: its shapes above each step, the same of the lines before and after, and 1.

    The first line has no line before it and the last none after: those features are 0 there.
    """
    own = (shapes[:, :, None] > steps[None, :, :]).reshape(len(shapes), -1)
    first = np.zeros(len(shapes), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(len(shapes), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    before = np.concatenate([own[:1], own[:-1]]) & ~first[:, None]
    after = np.concatenate([own[1:], own[-1:]]) & ~last[:, None]
    return np.concatenate([own, before, after, np.ones((len(own), 1), dtype=bool)], axis=1).astype(np.float32)


@dataclass
class Field:
    """Weights of the label "good" by feature, transition weights [before, label], and the steps of the features."""

    weights: np.ndarray
    moves: np.ndarray
    steps: np.ndarray


def marginals(good: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, expected transitions (2 x 2, summed), and each chain's log partition.

    Chains run side by side, longest first, so a step touches only those that still have lines.
    """
    order = np.argsort(-counts, kind="stable")
    firsts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    scores = np.zeros((len(good), 2))
    scores[:, 1] = good
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    for t in range(steps):
        at = firsts[: alive[t]] + t
        ahead[at] = scores[at]
        if t:
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(steps - 2, -1, -1):
        at = firsts[: alive[t + 1]] + t
        after = scores[at + 1] + back[at + 1]
        back[at] = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
    ends = np.cumsum(counts) - 1
    whole = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    by_line = np.repeat(whole, counts)
    inner = np.ones(len(good), dtype=bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] + moves[None] + (scores[at] + back[at])[:, None, :] - by_line[at][:, None, None]
    return np.exp(ahead[:, 1] + back[:, 1] - by_line), np.exp(joint).sum(axis=0), whole


def fit_field(shapes: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 0.003) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam over the whole sample."""
    steps = np.stack([np.quantile(shapes[:, k], QUANTILES) for k in range(shapes.shape[1])]).astype(np.float32)
    x = evidence(shapes, counts, steps)
    y = np.repeat(labels.astype(np.float64), counts)
    same = np.diag([(counts[labels == k] - 1).sum() for k in (0, 1)]).astype(np.float64)
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, moved, _ = marginals((x @ theta[:-4].astype(np.float32)).astype(np.float64), counts, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (y - good).astype(np.float32), (same - moved).ravel()]) / len(counts) - decay * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2), steps)


def line_scores(texts: list[str | None], field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the lines' lengths, and how many lines each text has."""
    shapes, lengths, counts = line_shapes(texts)
    return marginals(line_weights(shapes, counts, field), counts, field.moves)[0], lengths, counts


def line_weights(shapes: np.ndarray, counts: np.ndarray, field: Field, lines: int = 1 << 14) -> np.ndarray:
    """``evidence @ weights`` of every line without the matrix: a text of very many lines needs little memory.

    What a line says about itself, the next and the last one is summed ``lines`` lines at a time and then
    moved to the line it is about.
    """
    width = field.steps.size
    parts = field.weights[:-1].reshape(3, width).T.astype(np.float32)
    said = np.empty((len(shapes), 3))
    for at in range(0, len(shapes), lines):
        some = shapes[at:at + lines, :, None] > field.steps[None, :, :]
        said[at:at + lines] = some.reshape(len(some), width).astype(np.float32) @ parts
    good = said[:, 0] + field.weights[-1]
    ends = np.cumsum(counts)
    inner = np.ones(len(good), dtype=bool)
    inner[ends - counts] = False
    good[inner] += said[np.flatnonzero(inner) - 1, 1]
    inner = np.ones(len(good), dtype=bool)
    inner[ends - 1] = False
    good[inner] += said[np.flatnonzero(inner) + 1, 2]
    return good


def text_scores(texts: list[str | None], field: Field) -> np.ndarray:
    """Mean of every text's line marginals, weighted by length plus one."""
    if not texts:
        return np.zeros(0)
    good, lengths, counts = line_scores(texts, field)
    starts = np.cumsum(counts) - counts
    weight = lengths + 1.0
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """Fit on labelled documents that are not held out.

    The sample is the labelled keys with the smallest hashes, ``SAMPLE_DOCS`` of them at most, one text of each
    (that with the smallest hash), without texts above a twentieth of ``SAMPLE_LINES`` lines and without
    documents past ``SAMPLE_LINES`` lines in sum, in hash order.  Both bounds hold before anything is
    collected; the driver receives shapes of lines, not texts.  Null labels and
    labels other than 0 and 1 are left out; a key labelled twice counts with its smaller label.  With no
    sample, or only one label in it, the field has no weights and scores everything 0.5.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("k"))
    # a hash threshold leaves about the sample where the labels lie; only that is ordered and cut
    rank, top = F.shiftrightunsigned(F.xxhash64("k"), 1), 2**63 - 1
    below = min(top, top // max(known.count(), 1) * SAMPLE_DOCS * 6 // 5)
    likely = known.where(rank <= below).groupBy("k").agg(F.min("y").alias("y"))
    chosen = likely.orderBy(rank, "k").limit(SAMPLE_DOCS)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).join(chosen, "k")
    picked = _one_text_of_each(sample)

    def shaped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for part in parts:
            texts = part["text"].where(part["text"].notna(), None).tolist()
            for i, one in enumerate(texts):
                # a task shapes equal rows once
                if (k := str(part["k"].iloc[i])) not in seen:
                    seen.add(k)
                    shapes, _, counts = line_shapes([one])
                    yield pd.DataFrame({"k": [k], "y": [part["y"].iloc[i]], "lines": [int(counts[0])], "shapes": [shapes.tobytes()]})

    rows = sample.join(picked, ["k", "h"], "left_semi").mapInPandas(shaped, "k string, y int, lines int, shapes binary")
    rows = sorted(rows.dropDuplicates(["k"]).collect(), key=lambda r: (r.k, bytes(r.shapes)))
    counts = np.array([r.lines for r in rows], dtype=np.int64)
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        steps = np.zeros((len(SHAPES), len(QUANTILES)), dtype=np.float32)
        return Field(np.zeros(3 * steps.size + 1), np.zeros((2, 2)), steps)
    shapes = np.concatenate([np.frombuffer(r.shapes, dtype=np.float32).reshape(-1, len(SHAPES)) for r in rows])
    return fit_field(shapes, counts, y)


def _one_text_of_each(sample: DataFrame) -> DataFrame:
    """``k, h``: the smallest text hash of every key, as far as the line bound goes in the order of the keys' hashes."""
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    sized = sample.select("k", "h", lines.cast("bigint").alias("lines")).where(F.col("lines") <= SAMPLE_LINES // 20)
    first = sized.groupBy("k").agg(F.min(F.struct("h", "lines")).alias("one")).select("k", "one.*")
    # one row per sampled key: SAMPLE_DOCS at most
    before = Window.orderBy(F.shiftrightunsigned(F.xxhash64("k"), 1), "k").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("sum", F.sum("lines").over(before)).where(F.col("sum") <= SAMPLE_LINES).select("k", "h")


def score_quality(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) from all lines of the whole text.

    A null text counts as empty, and an empty text is one empty line.  Rows one for one; a column
    ``score`` is replaced.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = batch.where(batch.notna(), None).tolist()
            out = [text_scores(block, field) for block in blocks(rows)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return without(docs, "score").withColumn("score", column(F.col(text)))


def blocks(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters."""
    block, chars = [], 0
    for text in texts:
        block.append(text)
        chars += len(text or "")
        if chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block
