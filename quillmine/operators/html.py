"""HTML to Markdown and anchors, one partition-parallel pass over the raw pages.

Only what needs a document tree runs in Python; counting, cleaning up and filtering are
Column expressions on the result.  No shuffle.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.functions import urls
from quillmine.operators.blocks import pieces

# HTML element groups
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript "
    "ol output p pre section table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLING_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tbody"}, {"table"}),
}
CONTENT_DROPPED = frozenset(
    "audio colgroup head iframe math noembed noframes noscript plaintext script style svg template "
    "title video xmp".split()
)
MEANINGFUL_BLANK = frozenset("a table thead tbody tfoot th td iframe script audio video".split())
SAFE_URL = re.compile(
    r"^(?:(?:(?:f|ht)tps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$))", re.I
)
MARKDOWN_ESCAPES = [
    (re.compile(p), r)
    for p, r in (
        (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"),
        (r"^(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"),
        (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "),
    )
]
WEB_SPACES = rules.WEB_SPACE_CHARS
#: Elements nested deeper become siblings, as in browsers, so that no page is too deep to walk.
MAX_DEPTH = 512
#: Character references that titles use.
TITLE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "depth")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids, self.up, self.depth = tag, attrs or {}, [], None, 0

    def add(self, kid: Node | str) -> None:
        if isinstance(kid, Node):
            kid.up, kid.depth = self, self.depth + 1
        self.kids.append(kid)

    def walk(self) -> Iterator[Node]:
        for kid in self.kids:
            if isinstance(kid, Node):
                yield kid
                yield from kid.walk()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def drop(self) -> None:
        self.up.kids = [k for k in self.up.kids if k is not self]

    def chain(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.up


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root")

    def _end(self, names: set[str], stops: set[str]) -> None:
        for node in self.here.chain():
            if node.tag in names:
                self.here = node.up
                return
            if node.tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end({"p"}, {"td", "th", "table", "button", "#root"})
        if tag in SIBLING_ENDS:
            self._end(*SIBLING_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.here.add(node)
        if tag not in VOID and node.depth < MAX_DEPTH:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._end({tag}, {"#root"})

    def handle_data(self, data):
        self.here.add(data)


def parse(html: str | None) -> Node:
    """The tree of a page; a null page is empty."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


# --- selectors: tag, #id, .class, [attr], [attr=v], [attr*=v] and descendants ------

_SIMPLE = re.compile(r"""([\w-]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(\*?=)['"]?([^'"\]]*)['"]?)?\]""")


@lru_cache(maxsize=512)
def _compiled(selector: str) -> tuple[tuple[tuple, ...], ...]:
    steps = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector)
    return tuple(tuple(m.groups() for m in _SIMPLE.finditer(step)) for step in steps)


def _fits(node: Node, step: tuple[tuple, ...]) -> bool:
    for tag, ident, cls, attr, how, value in step:
        if tag and node.tag != tag:
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None or (how == "=" and have != value) or (how == "*=" and value not in have):
                return False
    return True


def matches(node: Node, selector: str) -> bool:
    *outer, last = _compiled(selector)
    if not _fits(node, last):
        return False
    for up in node.chain():
        if not outer:
            return True
        if up is not node and _fits(up, outer[-1]):
            outer.pop()
    return not outer


def first(root: Node, selector: str) -> Node | None:
    return next((n for n in root.walk() if matches(n, selector)), None)


def closest(node: Node, selectors: Sequence[str]) -> Node | None:
    return next((up for up in node.chain() if any(matches(up, s) for s in selectors)), None)


# --- cleaning ---------------------------------------------------------------------


def main_content(root: Node, page_type: str) -> Node:
    special = rules.MAIN_CONTENT_SELECTORS.get(page_type, ()) if page_type != "generic" else ()
    for selector in special:
        found = first(root, selector)
        if found:
            return found
    for selector in rules.MAIN_CONTENT_SELECTORS["generic"]:
        found = first(root, selector)
        if found and len(found.text().strip(WEB_SPACES)) > rules.MAIN_CONTENT_MIN_CHARS:
            return found
    body = first(root, "body") or root
    for node in list(body.walk()):
        if node.tag in rules.BODY_DROP_TAGS or node.tag == "head":
            node.drop()
    return body


def strip_noise(content: Node, page_type: str) -> Node:
    selectors = rules.NOISE_SELECTORS["common"] + rules.NOISE_SELECTORS.get(page_type, ())
    part = Node("#part")
    for kid in content.kids:
        part.add(kid)
    for node in [n for n in part.walk() if any(matches(n, s) for s in selectors)]:
        node.drop()
    for node in [n for n in part.walk() if n.tag in rules.EMPTY_DROP_TAGS and not n.kids]:
        node.drop()
    return part


def allowlist(node: Node) -> Node:
    """Keep the allowed tags and attributes; other elements give way to their content."""
    out = Node(node.tag, {
        k: v for k, v in node.attrs.items()
        if k in rules.ALLOWED_ATTRIBUTES and (k not in ("href", "src") or SAFE_URL.match(v))
    })
    for kid in node.kids:
        if isinstance(kid, str):
            out.add(kid)
        elif kid.tag in rules.ALLOWED_TAGS:
            out.add(allowlist(kid))
        elif kid.tag not in CONTENT_DROPPED:
            for inner in allowlist(kid).kids:
                out.add(inner)
    return out


def to_html(node: Node) -> str:
    parts = []
    for kid in node.kids:
        if isinstance(kid, str):
            parts.append(escape(kid, quote=False))
            continue
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in kid.attrs.items())
        parts.append(f"<{kid.tag}{attrs}>" + ("" if kid.tag in VOID else f"{to_html(kid)}</{kid.tag}>"))
    return "".join(parts)


def absolute(href: str, base: str) -> str:
    """The absolute address; what cannot be joined stays as it is."""
    try:
        return quote(urljoin(base or "", href.strip()), safe="%/:=&?~#+!$,;'@()*[]|")
    except ValueError:
        return href.strip()


# --- Markdown ----------------------------------------------------------------------


def _collapse(root: Node) -> None:
    """Whitespace as a browser shows it: one blank between words, none at block edges."""
    last: list = [None]  # (node, index) of the previous text

    def trim_last() -> None:
        if last[0]:
            node, i = last[0]
            if node.kids[i].endswith(" "):
                node.kids[i] = node.kids[i][:-1]

    def visit(node: Node) -> None:
        for i, kid in enumerate(node.kids):
            if isinstance(kid, str):
                flat = re.sub(r"[ \r\n\t]+", " ", kid)
                before = last[0] and last[0][0].kids[last[0][1]]
                if (last[0] is None or before.endswith(" ")) and flat.startswith(" "):
                    flat = flat[1:]
                node.kids[i] = flat
                if flat:
                    last[0] = (node, i)
            elif kid.tag == "pre":
                trim_last()
                last[0] = None
            else:
                edge = kid.tag in BLOCK or kid.tag == "br"
                if edge:
                    trim_last()
                    last[0] = None
                visit(kid)
                if edge:
                    trim_last()
                    last[0] = None

    visit(root)
    trim_last()


def _blank(node: Node) -> bool:
    inner = [node, *node.walk()]
    return (
        not node.text().strip(WEB_SPACES)
        and node.tag not in VOID
        and not any(n.tag in MEANINGFUL_BLANK for n in inner)
        and not any(n.tag in VOID for n in inner)
    )


def _join(left: str, right: str) -> str:
    head, tail = left.rstrip("\n"), right.lstrip("\n")
    gap = max(len(left) - len(head), len(right) - len(tail))
    return head + "\n" * min(2, gap) + tail


def _escape(text: str) -> str:
    for pattern, replacement in MARKDOWN_ESCAPES:
        text = pattern.sub(replacement, text)
    return text


def _cells(row: Node, tags: tuple[str, ...]) -> list[str]:
    return [n.text().strip(WEB_SPACES) for n in row.walk() if n.tag in tags]


def _table(table: Node) -> str:
    rows = [n for n in table.walk() if n.tag == "tr"]
    if not rows:
        return ""
    head = _cells(rows[0], ("th", "td"))
    lines = [f"| {' | '.join(head)} |", f"| {' | '.join('---' for _ in head)} |"] if head else []
    lines += [f"| {' | '.join(c)} |" for c in (_cells(r, ("td",)) for r in rows[1:]) if c]
    return "\n" + "\n".join(lines) + "\n"


def _item(node: Node, content: str) -> str:
    content = re.sub(r"\n+$", "\n", content.lstrip("\n")).replace("\n", "\n    ")
    mark = "-   "
    if node.up is not None and node.up.tag == "ol":
        items = [k for k in node.up.kids if isinstance(k, Node)]
        start = node.up.attrs.get("start", "1")
        mark = f"{(int(start) if start.isdigit() else 1) + items.index(node)}.  "
    follows = node.up is not None and node is not node.up.kids[-1]
    return mark + content + ("\n" if follows and not content.endswith("\n") else "")


def _render(node: Node, base: str, code: bool) -> str:
    out = ""
    for kid in node.kids:
        if isinstance(kid, str):
            out = _join(out, kid if code else _escape(kid))
        else:
            out = _join(out, _element(kid, base, code))
    return out


def _element(node: Node, base: str, code: bool) -> str:
    tag = node.tag
    content = _render(node, base, code or tag == "code")
    if _blank(node):
        return "\n\n" if tag in BLOCK and tag != "p" else ""
    lead = trail = ""
    if tag not in BLOCK and not code:
        core = content.strip(" \t\r\n")
        if core != content and core:
            at = content.index(core)
            lead, trail, content = content[:at], content[at + len(core):], core
    return lead + _mark(node, content, base) + trail


def _mark(node: Node, content: str, base: str) -> str:
    tag = node.tag
    if tag == "pre":
        inner = first(node, "code")
        language = inner.attrs.get("data-language", "") if inner else ""
        return f"\n```{language}\n{content.strip(WEB_SPACES)}\n```\n"
    if tag == "code":
        return content if node.up is not None and node.up.tag == "pre" else f"`{content}`"
    if tag == "table":
        return _table(node)
    if tag == "a":
        href = node.attrs.get("href", "")
        return content if not href or href.startswith("#") else f"[{content}]({absolute(href, base)})"
    if tag == "br":
        return "  \n"
    if tag == "img":
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']}{title})" if node.attrs.get("src") else ""
    if tag in ("em", "strong"):
        mark = "*" if tag == "em" else "**"
        return f"{mark}{content}{mark}" if content.strip() else ""
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {content}\n\n"
    if tag == "blockquote":
        return "\n\n" + re.sub("^", "> ", content.strip("\n"), flags=re.M) + "\n\n"
    if tag in ("ul", "ol"):
        nested = node.up is not None and node.up.tag == "li" and node.up.kids[-1] is node
        return f"\n{content}" if nested else f"\n\n{content}\n\n"
    if tag == "li":
        return _item(node, content)
    return f"\n\n{content}\n\n" if tag in BLOCK else content


def to_markdown(allowed: Node, base: str) -> str:
    _collapse(allowed)
    text = _render(allowed, base, False)
    return text.lstrip("\t\r\n").rstrip()


# --- jobs --------------------------------------------------------------------------

PASS_SCHEMA = (
    "page_url string, html_title string, page_type string, main_html string, stripped_html string, "
    "allowed_html string, markdown string"
)
ANCHOR_SCHEMA = (
    "src_url string, anchor_index long, href string, url string, link_text string, parent_text string, "
    "in_list boolean, in_nav boolean, classes string"
)


def clean_html(pages_raw: DataFrame, stages: bool = False) -> DataFrame:
    """url, html -> title, Markdown and, on request, the HTML after each stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "html"):
            rows = []
            for url, kind, html in batch.itertuples(index=False):
                root = parse(html)
                title = first(root, "title")
                name = " ".join(title.text().split()) if title else ""
                content = main_content(root, kind)
                main = to_html(content) if stages else None
                part = strip_noise(content, kind)
                stripped = to_html(part) if stages else None
                allowed = allowlist(part)
                shown = to_html(allowed) if stages else None
                rows.append((url, name, kind, main, stripped, shown, to_markdown(allowed, url)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PASS_SCHEMA.split(", ")])

    source = pages_raw.select("url", urls.page_type(F.col("url")).alias("kind"), "html")
    return source.mapInPandas(run, PASS_SCHEMA)


def markdown_cleanup(markdown: Column) -> Column:
    """At most one blank line in a row, none at the ends."""
    few = F.regexp_replace(markdown, "\n{3,}", "\n\n")
    gaps = F.regexp_replace(few, "\n" + rules.WEB_SPACE_CLASS + "+\n", "\n\n")
    return tx.web_strip(gaps)


def page_title(html: Column) -> Column:
    """Text of the first title element, references decoded and white space collapsed; empty without one."""
    out = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    for name, char in TITLE_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.coalesce(tx.web_strip(F.regexp_replace(out, tx.WEB_SPACE_RUN, " ")), F.lit(""))


def title_or(html_title: Column, given: Column, url: Column) -> Column:
    return tx.or_else(html_title, given, urls.hostname(url))


def pages_clean(pages_raw: DataFrame) -> DataFrame:
    """Raw pages to (page_url, title, markdown, type, token_estimate, word_count)."""
    return clean_html(pages_raw).select(
        "page_url",
        title_or(F.col("html_title"), F.lit(""), F.col("page_url")).alias("title"),
        markdown_cleanup(F.col("markdown")).alias("markdown"),
        F.col("page_type").alias("type"),
    ).withColumns(
        {"token_estimate": tx.token_estimate(F.col("markdown")), "word_count": tx.word_count(F.col("markdown"))}
    )


def good_quality(title: Column, markdown: Column, words: Column) -> Column:
    """False for thin pages and login walls."""
    text = F.lower(F.concat_ws("\n", title, markdown))
    return (
        (F.length(tx.web_strip(markdown)) >= rules.QUALITY_MIN_CHARS)
        & (words >= rules.QUALITY_MIN_WORDS)
        & ~tx.contains_any(text, rules.LOGIN_WALL_PHRASES)
    )


def extract_anchors(
    pages_raw: DataFrame,
    selectors: Sequence[str] = rules.LINK_CONTENT_SELECTORS,
    nav_ancestors: Sequence[str] = rules.LINK_NAV_ANCESTORS,
) -> DataFrame:
    """One row per anchor inside a content area, in selector then document order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "html"):
            rows = []
            for url, html in batch.itertuples(index=False):
                links = [n for n in parse(html).walk() if n.tag == "a" and n.attrs.get("href", "").strip()]
                picked = {id(n): n for s in selectors for n in links if matches(n, s)}
                for i, node in enumerate(picked.values()):
                    href = node.attrs["href"].strip()
                    if href.lower().startswith("javascript:"):
                        continue
                    box = closest(node, ("p", "li", "td", "div"))
                    rows.append((
                        url, i, href, absolute(href, url), node.text().strip(WEB_SPACES),
                        box.text().strip(WEB_SPACES) if box else "", closest(node, ("ul", "ol")) is not None,
                        closest(node, nav_ancestors) is not None, node.attrs.get("class", ""),
                    ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANCHOR_SCHEMA.split(", ")])

    return pages_raw.select("url", "html").mapInPandas(run, ANCHOR_SCHEMA)
