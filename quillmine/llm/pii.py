"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits and identifier cues.
From every anchor a small deterministic parser walks to the boundaries of the address or account
around it and validates what it finds.  No parser backtracks: each is linear in what it walks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import without
from quillmine.session import ship_package

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
HOST = DIGITS | LETTERS | {"-"}
LOCAL = DIGITS | LETTERS | set("._%+-")
SCHEME = DIGITS | LETTERS | set("+.-")
PHONE = DIGITS | set(" ().-")
USERINFO = DIGITS | LETTERS | set("._~%!$&'()*+,;=:-")
#: Words that announce an account or identity number, in the spellings that texts use.
CUES = tuple(sorted({s for w in ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
                     for s in (w, w.upper(), w.capitalize())}))
KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: all personal data of the whole text, as (kind, start, end).

    Positions count code points, the end is exclusive; spans are ordered by kind as in ``KINDS``, then
    start.  ``email``, ``ip``, ``card`` and ``phone`` follow from their anchors alone.  Cues and schemes add
    ``login`` (user information in a URL), ``iban`` (valid check digits) and ``account`` (a cue, then a
    number of 6 to 18 digits).  A null or empty text has no spans.  Rows come back one for one, repeated
    rows too; a column named ``spans`` is replaced, others pass through.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] if t else [])

    return without(docs, "spans").withColumn("spans", spans(F.col(text)))


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *sorted(DIGITS), *CUES):
        automaton.add_word(anchor, anchor)
    automaton.make_automaton()
    return automaton


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text.  ``done`` keeps, by parser, where its last match or walk ended."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, anchor in _anchors().iter(text):
        if anchor in DIGITS:
            if last >= done["ip"]:
                done["ip"] = _ip(text, last, found["ip"])
            if last >= done["card"]:
                done["card"] = _card(text, last, found["card"])
        elif anchor == "@":
            _email(text, last, done, found["email"])
        elif anchor == "+":
            if last >= done["phone"]:
                done["phone"] = _phone(text, last, found["phone"])
        elif anchor == "://":
            _login(text, last - 2, done, found["login"])
        else:
            _account(text, last + 1, done, found)
    return [(kind, a, b) for kind in KINDS for a, b in sorted(found[kind])]


def _run(text: str, at: int, allowed: frozenset | set) -> int:
    """The end of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, floor: int, allowed: frozenset | set) -> int:
    """The start of the run of allowed characters that ends before ``at``, not below ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, done: dict, out: list) -> None:
    """Local part to the left of the at-sign, then a host of two labels or more."""
    start = _back(text, at, done["email"], LOCAL)
    end = _run(text, at + 1, HOST)
    if start == at or end == at + 1:
        return
    labels = 1
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, HOST)) > end + 1:
        end, labels = more, labels + 1
    if labels > 1:
        out.append((start, end))
        done["email"] = end


def _ip(text: str, at: int, out: list) -> int:
    """Four runs of digits joined by single dots; returns where the walk ended.

    A chain of fewer runs holds no address further right either.
    """
    starts, ends = [], []
    while len(ends) < 4:
        stop = _run(text, at, DIGITS)
        if stop == at:
            break
        starts.append(at)
        ends.append(stop)
        if text[stop:stop + 1] != ".":
            break
        at = stop + 1
    if len(ends) == 4 and all(_small(text[a:b]) for a, b in zip(starts, ends, strict=True)):
        out.append((starts[0], ends[3]))
    return ends[-1]


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _card(text: str, at: int, out: list) -> int:
    """Digits with at most one space or hyphen between two of them; returns where the walk ended."""
    n, end, digits = len(text), at + 1, [text[at]]
    while end < n:
        step = end + 1 if text[end] in " -" else end
        if step >= n or text[step] not in DIGITS:
            break
        digits.append(text[step])
        end = step + 1
    if 16 <= len(digits) <= 19 and luhn(digits):
        out.append((at, end))
    return end


def luhn(digits) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _phone(text: str, at: int, out: list) -> int:
    """A plus sign and a digit, then digits and separators up to the last digit of their run."""
    if _run(text[at + 1:at + 2], 0, DIGITS) == 0:
        return at + 1
    stop = _run(text, at + 2, PHONE)
    end = stop
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return at + 1
    if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
        out.append((at, end))
    return end


def _login(text: str, at: int, done: dict, out: list) -> None:
    """User information before the at-sign of a URL, from the scheme's first letter on."""
    start = _back(text, at, done["login"], SCHEME)
    end = _run(text, at + 3, USERINFO)
    if start < at and end > at + 3 and end < len(text) and text[end] == "@" and _run(text, end + 1, HOST) > end + 1:
        out.append((start, end))
        done["login"] = end


def _account(text: str, at: int, done: dict, found: dict) -> None:
    """After a cue: a few separators and words, then an IBAN or a number of 6 to 18 digits."""
    if at < len(text) and text[at] in LETTERS:
        return
    at = _run(text, at, frozenset(" .:#=-"))
    for word in ("number", "no", "nr", "num"):
        if text[at:at + len(word)].lower() == word and text[at + len(word):at + len(word) + 1] not in LETTERS:
            at = _run(text, at + len(word), frozenset(" .:#=-"))
            break
    if at < max(done["iban"], done["account"]):
        return
    if at + 1 < len(text) and text[at] in LETTERS and text[at + 1] in LETTERS:
        end, chars = at, []
        while end < len(text) and len(chars) < 34 and (text[end] in DIGITS or text[end] in LETTERS or (
                text[end] == " " and end + 1 < len(text) and (text[end + 1] in DIGITS or text[end + 1] in LETTERS))):
            if text[end] != " ":
                chars.append(text[end].upper())
            end += 1
            if len(chars) >= 15 and (end == len(text) or text[end] == " " or text[end] not in HOST) and iban(chars):
                found["iban"].append((at, end))
                done["iban"] = end
                return
        return
    if at < len(text) and text[at] in DIGITS:
        end, digits = at, 0
        while end < len(text) and (text[end] in DIGITS or (text[end] in " -" and text[end + 1:end + 2] in DIGITS)):
            digits += text[end] in DIGITS
            end += 1
        if 6 <= digits <= 18:
            found["account"].append((at, end))
            done["account"] = end


def iban(chars: list[str]) -> bool:
    """Whether the check digits of an international account number fit (ISO 7064, mod 97)."""
    if not (chars[2] in DIGITS and chars[3] in DIGITS):
        return False
    return int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1
