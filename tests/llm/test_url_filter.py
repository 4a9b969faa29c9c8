import re
from collections import Counter

from quillmine.llm import url_filter
from quillmine.llm.queries import URL_RULES, op4_url_verdicts
from tests.llm.conftest import SF, clashing

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def rule(url):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "http://example.net/en/1", "http://a.b.example.net/en/",
    "http://example.net/en", "https://EXAMPLE.com/de/x?y=/fr/#z", "https://example.com?/de/", "https://example.com/DE/", "http://x.org/fr/://y.net/", "a b://İ.org/fr/",
    "http://u:p@example.net:80/en/", "http://example.com/de/\n", "x#://a.net/",
]


def judged(spark, rows, **options):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r.verdict for r in url_filter.judge_urls(frame, URL_RULES, **options).collect()}


def test_rules_by_brute_force(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(7, URLS[7], "<html>")] * 2
    frame = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "host", "rule", "node", "component")
    want = Counter()
    for i, u, _ in rows:
        r = rule(u)
        want[(i, *parts(u), r[0] + r[1] if r else None, r[2] if r else "allow")] += 1
    got = url_filter.judge_urls(frame, URL_RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert got[0].node == "mine"
    assert url_filter.judge_urls(frame.limit(0), URL_RULES).count() == 0


def canonical(target):
    return f'<html><head><LINK href="{target}" rel="canonical"></head>'


def test_blocks_pass_through_redirects_and_canonical_links(spark):
    rows = [
        (1, "https://shop.com/a#top", canonical("http://bad.net/x")),  # names a blocked page
        (2, "https://shop.com/b", '<meta content="0; url=/a" http-equiv="Refresh">'),  # goes to the page above
        (3, "https://free.com/c", canonical("http://www.example.net/en/ok")),  # names an allowed page
        (4, "https://free.com/d", canonical("c") + '<meta http-equiv=refresh content="1;URL=http://bad.net/y">'),  # blocked and allowed members
        (5, "https://alone.com/", canonical("https://alone.com/")), (6, "https://plain.com/", "<p>canonical</p>"), (7, None, canonical("http://bad.net/")),
        (8, "https://logged.com/1", None), (9, "https://logged.com/2", ""), (10, "http://bad.net/x", None), (11, "https://mail.com/", canonical("mailto:a@bad.net")),
    ]
    aliases = spark.createDataFrame([("https://logged.com/1", "https://logged.com/2"), ("https://logged.com/2", "HTTP://BAD.net/z#f"), (None, "x")], "left string, right string")
    got = judged(spark, rows, aliases=aliases)
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block", 11: "allow"}
    assert judged(spark, rows, html=None)[1] == "allow"


def test_a_hub_of_many_aliases(spark):
    rows = [(i, f"https://m{i}.com/", canonical("https://hub.com/")) for i in range(500)] + [(900, "https://hub.com/", canonical("https://bad.net/"))]
    assert Counter(judged(spark, rows).values()) == {"block": 501}


def test_query(spark, folder):
    want = Counter()
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        r = rule(p.url)
        want[(p.page_id, *parts(p.url), r[0] + r[1] if r else None, r[2] if r else "allow")] += 1
    assert Counter(tuple(r) for r in op4_url_verdicts(spark, folder).collect()) == want
