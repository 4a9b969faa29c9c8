"""Text helpers as Column expressions.

All of them stay inside the JVM.  Whitespace, case and token rules are pinned here
once, because Java, Python, the browser and RE2 disagree about them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmine import rules

SPACE_RUN = rules.SPACE_CLASS + "+"
WEB_SPACE_RUN = rules.WEB_SPACE_CLASS + "+"


def text_of(col: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column, chars: str = rules.SPACE_CHARS) -> Column:
    return F.trim(col, F.lit(chars))


def web_strip(col: Column) -> Column:
    return F.trim(col, F.lit(rules.WEB_SPACE_CHARS))


def or_else(col: Column, *others: Column) -> Column:
    """First non-null, non-empty value."""
    return F.coalesce(F.nullif(col, F.lit("")), *[F.nullif(o, F.lit("")) for o in others[:-1]], *others[-1:])


def collapse(col: Column) -> Column:
    """Every whitespace run becomes one blank."""
    return F.regexp_replace(col, SPACE_RUN, " ")


def contains_any(col: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(col, F.lit(word))
    return found


def all_matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def tokens(col: Column, stop_words: Sequence[str] = rules.QUERY_STOP_WORDS) -> Column:
    """Lower-cased word tokens in text order, duplicates kept."""
    found = all_matches(F.lower(col), rules.TOKEN_PATTERN)
    return F.filter(
        found,
        lambda t: (F.length(t) >= rules.TOKEN_MIN_LENGTH) & ~t.isin(*stop_words),
    )


def token_set(col: Column, stop_words: Sequence[str] = rules.QUERY_STOP_WORDS) -> Column:
    """Distinct tokens; array_except drops the stop words and the duplicates in one pass."""
    found = all_matches(F.lower(col), rules.TOKEN_PATTERN)
    return F.array_except(
        F.filter(found, lambda t: F.length(t) >= rules.TOKEN_MIN_LENGTH),
        F.array(*[F.lit(w) for w in stop_words]),
    )


def word_tokens(
    col: Column, min_length: int = 4, stop_words: Sequence[str] = rules.MATCHER_STOP_WORDS
) -> Column:
    """Tokens between non-alphanumerics, duplicates kept."""
    parts = F.split(F.lower(col), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) >= min_length) & ~t.isin(*stop_words))


def overlap_share(query_terms: Column, other_terms: Column) -> Column:
    """Share of the question terms found in another term set; 0 without question terms."""
    n = F.size(query_terms)
    return F.when(n > 0, F.size(F.array_intersect(query_terms, other_terms)) / n).otherwise(F.lit(0.0))


def shorten(col: Column, limit: int) -> Column:
    flat = collapse(strip(text_of(col)))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def slug(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))


def token_estimate(col: Column) -> Column:
    """One token per four characters, rounded up."""
    return F.ceil(F.length(text_of(col)) / 4).cast("int")


def word_count(col: Column) -> Column:
    parts = F.split(col, WEB_SPACE_RUN)
    return F.size(F.filter(parts, lambda w: w != ""))


def sigmoid_unit(score: Column) -> Column:
    """Scores outside [0, 1] go through the logistic function."""
    return F.when(score.between(0.0, 1.0), score).otherwise(1.0 / (1.0 + F.exp(-score)))


def page_label(title: Column, role: Column, source_type: Column) -> Column:
    return F.concat(shorten(title, 48), F.lit(" ["), role, F.lit("/"), source_type, F.lit("]"))


def alias_of(col: Column, aliases: dict[str, str], default: str) -> Column:
    """Look a name up in an alias map; unknown names pass, blank ones get the default."""
    key = F.lower(strip(text_of(col)))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.nullif(key, F.lit("")), F.lit(default))


def provider_alias(col: Column) -> Column:
    return alias_of(col, rules.PROVIDER_ALIASES, "openai")


def embedding_provider_alias(col: Column) -> Column:
    return alias_of(col, rules.EMBEDDING_PROVIDER_ALIASES, "openai")


def reasoning_effort_alias(col: Column) -> Column:
    key = F.lower(strip(text_of(col)))
    known = F.when(key.isin(*rules.REASONING_EFFORTS), key).otherwise("")
    for alias, target in rules.REASONING_EFFORT_ALIASES.items():
        known = F.when(key == alias, F.lit(target)).otherwise(known)
    return known
