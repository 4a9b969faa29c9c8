"""Toxicity from a subsequence string kernel and a support vector machine over sentences.

Two strings are alike as far as they share subsequences of four letters; a subsequence weighs ``DECAY`` to the power
of the stretch it takes up, so ``id-iot``, ``i d i o t`` and ``idxiot`` stay close to ``idiot``.  Strings are compared
with a bounded set of landmarks (Nyström): their similarities to the landmarks, whitened by the landmarks' own
kernel matrix, are the features.

A sentence's value is that of its strongest string.  The machine is fitted on the sentences of a bounded sample of
labelled documents, which take their document's label; as a toxic document need not be toxic throughout, fitting is
repeated with the strongest strings of its strongest sentences only.  A document's score comes from its highest
sentences.  As the kernel is a sum over subsequences, the fitted machine is one weight for every subsequence, which
is all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import without
from quillmine.llm.quality import blocks, held_out
from quillmine.session import ship_package

#: Bound of the fitting sample: labelled documents of each label at most, characters of them, and of one document.
SAMPLE_DOCS = 700
SAMPLE_CHARS = 2_000_000
LONGEST = 40_000
#: Clean documents weigh so much more than toxic ones when scores become probabilities.
CLEAN_WEIGHT = 2.0
LANDMARKS = 160
DECAY = 0.6
#: Letters of a subsequence.
ORDER = 4
#: A subsequence takes up so many characters at most.
SPAN = 7
#: Strings in a sentence at most; longer ones are cut.
SENTENCE = 16
#: Sentences of a toxic document that are taken as toxic after the first fit, and sentences that make a document's score.
WITNESSES = 3
HIGHEST = 3
ROUNDS = 4
#: Characters that are looked at together.
PIECE = 1 << 20

#: Letter classes: 0 no letter, 1 the mark before a string, then a-z, then all other letters in 20 classes.
ALPHABET = 48
GAP, DROP, SPACE, STOP = 100, 101, 102, 103
#: Where the further letters of a subsequence lie, counted from its first.
STEPS = list(combinations(range(1, SPAN), ORDER - 1))


def _letter_classes(size: int = 0x3000) -> np.ndarray:
    """Class of every character below ``size``; the others count as letters."""
    table = np.full(size, DROP, dtype=np.uint8)
    for point in range(size):
        char = chr(point)
        if "a" <= char <= "z":
            table[point] = 2 + point - ord("a")
        elif char.isalpha():
            table[point] = 28 + point % 20
        elif char.isdigit():
            table[point] = GAP
        elif char in "\n.!?":
            table[point] = STOP
        elif char.isspace():
            table[point] = SPACE
    return table


CLASS_OF = _letter_classes()


@dataclass
class Strings:
    """Strings of some texts: classes of all their characters, where each string starts, and its sentence and text."""

    codes: np.ndarray
    starts: np.ndarray
    sentence: np.ndarray
    sentence_text: np.ndarray
    texts: int

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.codes)))


def strings(texts: list[str | None]) -> Strings:
    """Letters and digits of the lower-cased texts cut into strings and sentences.

    Strings end at white space, but neighbours of at most one letter are one string.  Sentences end at ``.!?`` before
    white space and at line feeds, and after ``SENTENCE`` strings.  Marks inside a string are dropped, digits are gaps.
    """
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1
    points = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = CLASS_OF[np.minimum(points, len(CLASS_OF) - 1)]
    beyond = points >= len(CLASS_OF)
    code[beyond] = 28 + points[beyond] % 20
    gap = (code == SPACE) | (points == 10)
    # a full stop ends a sentence only before white space
    stop = (code == STOP) & np.append(gap[1:], True) | (points == 10)
    inked = code <= GAP
    token = np.cumsum(np.concatenate([[True], gap[:-1]]) & ~gap) - 1  # of every character that is no white space
    n_tokens = int(token[-1]) + 1 if len(token) else 0
    letters = np.bincount(token[inked], minlength=n_tokens)
    # tokens without a letter belong to no string
    real = np.flatnonzero(letters)
    owner = np.repeat(np.arange(len(texts)), sizes)
    spot = np.flatnonzero(inked)
    first = np.searchsorted(token[spot], real)
    at = spot[first]
    line = np.cumsum(stop)[at] - stop[at]
    text = owner[at]
    lone = letters[real] <= 1
    new = np.ones(len(real), dtype=bool)
    new[1:] = ~(lone[1:] & lone[:-1] & (line[1:] == line[:-1]))
    of_token = np.cumsum(new) - 1
    # one mark before each string, then its characters
    string = np.repeat(of_token, letters[real])
    n = int(of_token[-1]) + 1 if len(of_token) else 0
    sizes = np.bincount(string, minlength=n) + 1
    starts = np.cumsum(sizes) - sizes
    codes = np.ones(int(sizes.sum()), dtype=np.int32)
    body = np.ones(len(codes), dtype=bool)
    body[starts] = False
    some = code[spot].astype(np.int32)
    codes[body] = np.where(some == GAP, 0, some)
    # sentences: a new line, or so many strings
    line, text = line[new], text[new]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = line[1:] != line[:-1]
    begin = np.flatnonzero(fresh)
    within = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    fresh |= within % SENTENCE == 0
    return Strings(codes, starts, np.cumsum(fresh) - 1, text[fresh], len(texts))


def subsequences(some: Strings) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Place, number and weight of all subsequences of ``ORDER`` letters, one shape of gaps at a time."""
    codes, n = some.codes, len(some.codes)
    string = np.repeat(np.arange(len(some.starts), dtype=np.int32), some.lengths())
    letter = codes > 0
    for steps in STEPS:
        size = n - steps[-1]
        if size <= 0:
            continue
        number, whole = codes[:size], letter[:size] & (string[:size] == string[steps[-1]:])
        for step in steps:
            number = number * ALPHABET + codes[step:step + size]
            whole = whole & letter[step:step + size]
        at = np.flatnonzero(whole)
        yield at, number[at], DECAY ** (steps[-1] + 1)


def norms(lengths: np.ndarray) -> np.ndarray:
    """What strings of these lengths are divided by: the kernel's root if all their subsequences were different."""
    total = sum(np.maximum(lengths - s[-1], 0) * DECAY ** (2 * (s[-1] + 1)) for s in STEPS)
    return np.sqrt(np.maximum(total, DECAY ** (2 * ORDER)))


def kernel(some: Strings, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Similarity of every string to every landmark: ``rows`` names the row of ``table`` that a subsequence has, or -1."""
    out = np.zeros((len(some.starts), table.shape[1]), dtype=np.float32)
    string = np.repeat(np.arange(len(some.starts)), some.lengths())
    for at, number, weight in subsequences(some):
        row = rows[number]
        for lo in range(0, len(at), 1 << 16):
            r, s = row[lo:lo + (1 << 16)], string[at[lo:lo + (1 << 16)]]
            s, r = s[r >= 0], r[r >= 0]
            if len(s):
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                out[s[first]] += weight * np.add.reduceat(table[r], first, axis=0)
    return out / norms(some.lengths())[:, None].astype(np.float32)


def _distinct(some: Strings) -> tuple[Strings, np.ndarray]:
    """Distinct strings, and which of them every string is."""
    lengths = some.lengths()
    place = np.arange(len(some.codes)) - np.repeat(some.starts, lengths)
    mix = np.random.default_rng(1).integers(1, 1 << 62, int(lengths.max(initial=1)), dtype=np.int64) | 1
    marks = np.add.reduceat((some.codes + 1) * mix[place], some.starts) if len(some.starts) else np.zeros(0, dtype=np.int64)
    _, first, which = np.unique(marks, return_index=True, return_inverse=True)
    return _pick(some, first), which


def _pick(some: Strings, chosen: np.ndarray) -> Strings:
    lengths = some.lengths()[chosen]
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(some.starts[chosen] - starts, lengths) + np.arange(int(lengths.sum()))
    zero = np.zeros(len(chosen), dtype=np.int64)
    return Strings(some.codes[at], starts, zero, zero[:1], 1)


@dataclass
class Machine:
    """Weights of the subsequences that landmarks have, and the bias; then the calibration of a document's highest sentences."""

    numbers: np.ndarray
    values: np.ndarray
    bias: float
    scale: np.ndarray
    offset: float

    def weights(self) -> np.ndarray:
        """One weight for every possible subsequence."""
        out = np.zeros(ALPHABET**ORDER, dtype=np.float32)
        out[self.numbers] = self.values
        return out


def sentence_values(some: Strings, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision on every sentence."""
    if not len(some.starts):
        return np.zeros(0)
    gain = np.zeros(len(some.codes))
    for at, number, weight in subsequences(some):
        gain[at] += weight * weights[number]
    of_string = np.add.reduceat(gain, some.starts) / norms(some.lengths())
    return _by_sentence(of_string, some.sentence) + bias


def _begins(sorted_ids: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]])) if len(sorted_ids) else np.zeros(0, dtype=np.int64)


def _by_sentence(values: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The strongest string's value of every sentence."""
    return np.maximum.reduceat(values, _begins(sentence)) if len(values) else np.zeros(0)


def _strongest(values: np.ndarray, some: Strings) -> np.ndarray:
    """The first strongest string of every sentence."""
    order = np.lexsort((np.arange(len(values)), -values, some.sentence))
    return order[_begins(some.sentence[order])]


def highest(values: np.ndarray, text: np.ndarray, texts: int, bias: float) -> np.ndarray:
    """Every text's ``HIGHEST`` highest sentence values, falling; what a text lacks counts as ``bias``, a sentence of nothing."""
    out = np.full((texts, HIGHEST), bias)
    order = np.lexsort((-values, text))
    text, values = text[order], values[order]
    begin = _begins(text)
    rank = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    top = rank < HIGHEST
    out[text[top], rank[top]] = values[top]
    return out


def fit_hinge(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, decay: float = 1e-2, rounds: int = 20) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last column of ``x`` is 1.

    Rows count ``toxic`` and ``clean`` times.
    """
    ridge = np.diag([decay] * (x.shape[1] - 1) + [1e-9])
    w, said = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(rounds):
        low, high = toxic * (said < 1), clean * (said > -1)
        at = np.flatnonzero(low + high)
        some, pull = x[at], low[at] - high[at]
        w = np.linalg.solve((some * (low + high)[at, None].astype(np.float32)).T @ some + ridge, some.T @ pull)
        before, said = said, x @ w.astype(np.float32)
        if np.array_equal(before < 1, said < 1) and np.array_equal(before > -1, said > -1):
            break
    return w


def fit(texts: list[str], labels: np.ndarray) -> Machine:
    """Landmarks, machine and calibration from labelled texts; with one label only, every text gets that label."""
    some = strings(texts)
    if len(set(labels.tolist())) < 2 or not len(some.starts):
        return Machine(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0, np.zeros(HIGHEST), 30.0 if (labels > 0).any() else -30.0)
    kinds, which = _distinct(some)
    marks = _landmarks(some, which, labels, len(kinds.starts))
    chosen = _pick(kinds, marks)
    rows, table = _table(chosen)
    own = kernel(chosen, rows, table)
    size, turn = np.linalg.eigh((own + own.T).astype(np.float64) / 2)
    good = size > 1e-3 * size.max()
    white = (turn[:, good] / np.sqrt(size[good])).astype(np.float32)
    x = np.empty((len(kinds.starts), white.shape[1] + 1), dtype=np.float32)
    x[:, :-1], x[:, -1] = kernel(kinds, rows, table) @ white, 1
    toxic = labels[some.sentence_text[some.sentence]] > 0
    text = some.sentence_text[some.sentence]
    clean_of = _texts_with(which[~toxic], text[~toxic], len(x)) / max((labels <= 0).sum(), 1)
    witness = toxic
    for step in range(ROUNDS):
        w = fit_hinge(x, _texts_with(which[witness], text[witness], len(x)) / max((labels > 0).sum(), 1), clean_of)
        values = (x @ w.astype(np.float32))[which]
        if step + 1 < ROUNDS:
            # the strongest string of each of the text's strongest sentences
            best = _strongest(values, some)
            of_text = text[best]
            order = np.lexsort((-values[best], of_text))
            begin = _begins(of_text[order])
            rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            witness = np.zeros(len(values), dtype=bool)
            witness[best[order[rank < WITNESSES]]] = True
            witness &= toxic
    values = _by_sentence(values, some.sentence)
    scale, offset = _calibrated(highest(values, some.sentence_text, len(texts), w[-1]), labels)
    return Machine(np.flatnonzero(rows >= 0), table @ (white @ w[:-1].astype(np.float32)), float(w[-1]), scale, offset)


def _table(chosen: Strings) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' subsequences: a row for each, the landmarks' scaled weights in it."""
    string = np.repeat(np.arange(len(chosen.starts)), chosen.lengths())
    parts = [(number, string[at], np.full(len(at), weight)) for at, number, weight in subsequences(chosen)]
    number, owner, weight = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
    seen, row = np.unique(number.astype(np.int64), return_inverse=True)
    table = np.zeros((max(len(seen), 1), len(chosen.starts)), dtype=np.float32)
    np.add.at(table, (row, owner.astype(np.int64)), weight)
    rows = np.full(ALPHABET**ORDER, -1, dtype=np.int32)
    rows[seen] = np.arange(len(seen))
    return rows, table / norms(chosen.lengths())[None, :].astype(np.float32)


def _texts_with(kind: np.ndarray, text: np.ndarray, kinds: int) -> np.ndarray:
    """In how many texts every distinct string occurs."""
    pairs = np.unique(kind.astype(np.int64) << 32 | text)
    return np.bincount(pairs >> 32, minlength=kinds).astype(float)


def _landmarks(some: Strings, which: np.ndarray, labels: np.ndarray, kinds: int) -> np.ndarray:
    """Distinct strings: half those whose texts are toxic most clearly, half spread over all others."""
    text = some.sentence_text[some.sentence]
    bad = labels[text] > 0
    toxic, clean = _texts_with(which[bad], text[bad], kinds), _texts_with(which[~bad], text[~bad], kinds)
    rate = (toxic + 0.5) / (labels > 0).sum() / ((clean + 0.5) / max((labels <= 0).sum(), 1))
    order = np.argsort(-np.log(rate) * np.sqrt(toxic), kind="stable")
    first = order[:LANDMARKS // 2]
    rest = order[LANDMARKS // 2:]
    step = max(1, len(rest) // (LANDMARKS // 2))
    return np.sort(np.concatenate([first, rest[::step][:LANDMARKS // 2]]))


def _calibrated(top: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression of the label on the highest values, by Newton steps."""
    mean, spread = top.mean(axis=0), top.std(axis=0) + 1e-6
    x = np.column_stack([(top - mean) / spread, np.ones(len(top))])
    weight = np.where(labels > 0, 1 / max((labels > 0).sum(), 1), CLEAN_WEIGHT / max((labels <= 0).sum(), 1))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * top.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (labels - p)) - ridge @ w
        w = w + np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge, slope)
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def text_scores(texts: list[str | None], machine: Machine, weights: np.ndarray | None = None) -> np.ndarray:
    """Toxicity of every text, 0 to 1, a bounded number of characters at a time."""
    weights = machine.weights() if weights is None else weights
    owner, pieces = _pieces(texts)
    values, of, at = [np.zeros(0)], [np.zeros(0, dtype=np.int64)], 0
    for block in blocks(pieces, PIECE):
        some = strings(block)
        values.append(sentence_values(some, weights, machine.bias))
        of.append(owner[at:at + len(block)][some.sentence_text])
        at += len(block)
    top = highest(np.concatenate(values), np.concatenate(of), len(texts), machine.bias)
    return 1 / (1 + np.exp(-np.clip(top @ machine.scale + machine.offset, -30, 30)))


def _pieces(texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """Texts cut after white space into pieces of at most ``PIECE`` characters where they can be, and the text of each piece."""
    owner, out = [], []
    for i, text in enumerate(texts):
        rest = text or ""
        at = 0
        while len(rest) - at > PIECE:
            cut = max(rest.rfind(" ", at, at + PIECE), rest.rfind("\n", at, at + PIECE)) + 1 or at + PIECE
            owner.append(i)
            out.append(rest[at:cut])
            at = cut
        owner.append(i)
        out.append(rest[at:])
    return np.array(owner, dtype=np.int64), out


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fit on labelled documents that are not held out.

    The sample is ``SAMPLE_DOCS`` keys of each label at most, those with the smallest hashes, of each key the text with
    the smallest hash, texts above ``LONGEST`` characters left out, and of each label documents up to
    ``SAMPLE_CHARS`` characters in the order of the hashes.  The bounds hold before anything is collected.  Null
    labels and labels other than 0 and 1 are left out; a key labelled twice counts with its smaller label.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("k"))
    rank, top = F.shiftrightunsigned(F.xxhash64("k"), 1), 2**63 - 1
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], np.zeros(0))
    # a hash threshold leaves about the sample where the labels lie; only that is ordered and cut
    below = F.element_at(F.create_map(*(F.lit(v) for y, n in sizes.items() for v in (y, min(top, top // n * SAMPLE_DOCS * 6 // 5)))), F.col("y"))
    likely = known.where(rank <= below).groupBy("k").agg(F.min("y").alias("y"))
    order = Window.partitionBy("y").orderBy(rank, "k")
    chosen = likely.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE_DOCS).drop("at")
    # SAMPLE_DOCS of each label at most, so the texts stay where they are
    chosen = F.broadcast(chosen.limit(2 * SAMPLE_DOCS))
    named = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    sample = named.join(chosen, "k").groupBy("k", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    so_far = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = sample.withColumn("chars", so_far).where(F.col("chars") <= SAMPLE_CHARS).select("k", "y", "text").collect()
    rows = sorted(rows, key=lambda r: (r.y, str(r.k)))
    return fit([r.text for r in rows], np.array([r.y for r in rows], dtype=np.int64))


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) from all sentences of the whole text.

    A null text counts as empty, and a text without a letter has no sentence: both get the score of nothing.  Rows
    one for one; a column ``score`` is replaced.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = machine.weights()
        for batch in texts:
            yield pd.Series(text_scores(batch.where(batch.notna(), None).tolist(), machine, weights), dtype=float)

    return without(docs, "score").withColumn("score", column(F.col(text)))
