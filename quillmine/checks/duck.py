"""Pieces of DuckDB SQL for the oracles."""

from __future__ import annotations

from quillmine import rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(q(i) for i in items)


def strip(x: str) -> str:
    return f"trim({x}, {q(rules.SPACE_CHARS)})"


def web_strip(x: str) -> str:
    return f"trim({x}, {q(rules.WEB_SPACE_CHARS)})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {q(rules.SPACE_CLASS + '+')}, ' ', 'g')"


def tokens(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9._/-]*'), "
        f"lambda t: length(t) >= 3 AND t NOT IN ({words(rules.QUERY_STOP_WORDS)}))"
    )


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def word_tokens(x: str, n: int = 4, stop=rules.MATCHER_STOP_WORDS) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), "
        f"lambda t: length(t) >= {n} AND t NOT IN ({words(stop)}))"
    )


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def shorten(x: str, n: int) -> str:
    flat = collapse(strip(f"coalesce({x}, '')"))
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE rtrim(substr({flat}, 1, {n - 1})) || '…' END"


def contains_any(x: str, items) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(i)})" for i in items) + ")"


def any_pattern(x: str, patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({x}, {q('(?i)' + joined)})"


def source_type(x: str) -> str:
    blank = "''"
    low = f"lower({strip(f'coalesce({x}, {blank})')})"
    return (
        f"CASE WHEN {low} LIKE '%/browse/%' OR {low} LIKE '%jira.%' THEN 'jira' "
        f"WHEN {low} LIKE '%confluence%' OR {low} LIKE '%atlassian.net/wiki%' "
        f"OR {low} LIKE '%/pages/viewpage.action%' OR {low} LIKE '%wiki.%' THEN 'confluence' "
        f"ELSE 'generic' END"
    )


def canonical(x: str) -> str:
    """Plain form for the hierarchical URLs and bare strings of the fixtures."""
    raw = strip(f"coalesce({x}, '')")
    no_tail = f"regexp_replace(regexp_replace({raw}, '[?#].*$', '', 's'), ';[^/]*$', '')"
    head = f"lower(regexp_extract({no_tail}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1))"
    path = f"regexp_replace({no_tail}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"
    path = f"lower(rtrim(regexp_replace({path}, '/+', '/', 'g'), '/'))"
    return (
        f"CASE WHEN {raw} = '' THEN '' "
        f"ELSE {head} || CASE WHEN {path} = '' THEN '/' ELSE {path} END END"
    )


def page_role(title: str, url: str, md: str, kind: str) -> str:
    hay = f"lower({title} || chr(10) || {url} || chr(10) || substr({md}, 1, 1200))"
    out = "CASE"
    for role, hints in rules.DOCUMENT_ROLE_HINTS.items():
        out += f" WHEN {contains_any('hay', hints)} THEN '{role}'"
    out += f" WHEN {kind} = 'jira' THEN 'ticket' ELSE 'generic' END"
    return f"(SELECT {out} FROM (SELECT {hay} AS hay))"


def heading_terms(md: str) -> str:
    ws = rules.SPACE_CLASS
    pattern = "(?m)^" + ws + "{0,3}#{1,6}" + ws + "+(.+)$"
    return token_set(f"array_to_string(regexp_extract_all({md}, {q(pattern)}, 1)[1:12], ' ')")


def weight(table: dict, mode: str, kind: str) -> str:
    out = "CASE"
    for m, row in table.items():
        for k, w in row.items():
            out += f" WHEN {mode} = '{m}' AND {kind} = '{k}' THEN {w}::DOUBLE"
    return out + " ELSE 1.0::DOUBLE END"
