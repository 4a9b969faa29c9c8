"""URL block rules that follow redirects and canonical links.

Rules decide the URLs they fit.  Pages that redirect to each other or name one canonical address are
one page under several names: their connected component passes a block on to every alias no rule
fits, unless a rule allows one of its members.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import ascii_lower, without
from quillmine.llm.components import connected_components
from quillmine.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A rule for a host with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL's place in the alias graph: without fragment, scheme and host in lower case."""
    scheme = ascii_lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), url_host(url), rest))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(name, allow) of the longest rule that fits, an allowing one first among equals; else null."""
    out = F.lit(None).cast("struct<name:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.allow)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


LINK = r"(?is)<link\b[^>]*>"
META = r"(?is)<meta\b[^>]*>"
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)\bcontent\s*=\s*(?:"[^"]*?url\s*=\s*'?([^"']*)|'[^']*?url\s*=\s*"?([^"']*))"""


def declared_aliases(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(left, right)`` from a page to the canonical address and refresh targets its HTML names."""
    canonical = F.filter(F.regexp_extract_all(F.col(html), F.lit(LINK), 0), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.filter(F.regexp_extract_all(F.col(html), F.lit(META), 0), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    targets = F.concat(
        F.transform(canonical, lambda t: F.concat(*(F.regexp_extract(t, HREF, i) for i in (1, 2, 3)))),
        F.transform(refresh, lambda t: F.concat(*(F.regexp_extract(t, REFRESH, i) for i in (1, 2)))))
    linked = F.col(html).rlike(r"(?i)canonical|refresh")
    found = pages.where(linked).select(F.col(url).alias("url"), F.explode(targets).alias("target"))
    found = found.select("url", F.trim(F.replace(F.col("target"), F.lit("&amp;"), F.lit("&"))).alias("target"))
    return found.where("target <> ''").select(
        node_of(F.col("url")).alias("left"), node_of(resolved(F.col("url"), F.col("target"))).alias("right"))


def resolved(base: Column, link: Column) -> Column:
    """A link's absolute address; dot segments stay as they are."""
    scheme = F.regexp_extract(base, "(?s)^(.*?):", 1)
    root = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "(?s)^.*?://[^/?#]*((?:/[^/?#]*)*/)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, "(?s)^([^?#]*)", 1), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], aliases: DataFrame | None = None, url: str = "url",
               html: str | None = "html") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) added.

    ``aliases``: further edges ``(left, right)`` between URLs, such as logged redirects; ``html``: the column
    whose canonical links and refreshes count as edges, or None.  The longest fitting rule decides a URL.
    URLs without one take their component's verdict: allow if a rule allows a member, else block if a rule
    blocks one, else allow; targets that are no page count as members.  A null URL, or one without
    ``://``, has empty host and path, no aliases, and is allowed.  Repeated rows are judged alike; columns
    of the added names are replaced.  ``rules`` is a list for expressions, at most some hundreds.
    """
    address = F.col(url)
    clean = without(pages, "host", "path", "rule", "verdict")
    edges = declared_aliases(pages, url, html) if html else None
    if aliases is not None:
        given = aliases.select(node_of(F.col("left")).alias("left"), node_of(F.col("right")).alias("right"))
        edges = given if edges is None else edges.unionByName(given)
    judged = clean.withColumns({"host": url_host(address), "path": url_path(address)})
    judged = judged.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    if edges is not None:
        members = connected_components(edges.dropna(), "left", "right")
        own = fitting_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["allow"]
        # True where a rule allows a member, False where rules only block, null where none fits
        verdicts = members.groupBy("component").agg(F.max(own).alias("allowed"))
        passed = cut_lineage(members.join(verdicts.where("NOT allowed"), "component", "left_semi").select(F.col("node").alias("__node")))
        judged = judged.join(passed.withColumn("__blocked", F.lit(True)), node_of(address) == F.col("__node"), "left")
    else:
        judged = judged.withColumn("__blocked", F.lit(None).cast("boolean"))
    allow = F.coalesce(F.col("__rule.allow"), ~F.col("__blocked"), F.lit(True))
    return judged.select(
        *(F.col(f"`{c}`") for c in clean.columns), "host", "path", F.col("__rule.name").alias("rule"),
        F.when(allow, "allow").otherwise("block").alias("verdict"))
