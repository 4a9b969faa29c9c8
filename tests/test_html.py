from pyspark.sql import functions as F

from quillmine.operators import html as hm

PAGE = """<!DOCTYPE html><html><head><title> Plan &amp; notes
 </title><script>var t="</p>";</script></head><body><nav><a href="/home">Home</a></nav>
<main><h1>Rollout  plan</h1><p>See <a href="/spec?x=1">the <em>design</em> spec</a> and <a href="#top">top</a>.</p>
<p>  </p><div class="sidebar">skip me</div><ul><li>first<li>second <strong>bold</strong></ul>
<ol start="3"><li>third</li></ol><pre><code data-language="sql">SELECT 1
 FROM t_x</code></pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td> 2 </td></tr></table>
<blockquote>Quoted *text*</blockquote><img src="i.png" alt="pic"><p>Some text long enough to pass the hundred character limit of the main content rule.</p></main></body></html>"""

MARKDOWN = """# Rollout plan

See [the *design* spec](https://w.example.org/spec?x=1) and top.

-   first
-   second **bold**

1.  third

```sql
SELECT 1
 FROM t_x
```
| A | B |
| --- | --- |
| 1 | 2 |

> Quoted \\*text\\*

![pic](i.png)

Some text long enough to pass the hundred character limit of the main content rule."""


def raw(spark, html, url="https://w.example.org/a/b"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def test_page_to_markdown(spark):
    row = hm.pages_clean(raw(spark, PAGE)).collect()[0]
    assert row.title == "Plan & notes"
    assert row.markdown == MARKDOWN
    assert row.token_estimate == -(-len(MARKDOWN) // 4)
    assert row.word_count == len(MARKDOWN.split())


def test_noise_depends_on_the_page_type(spark):
    html = '<main><p>' + "word " * 40 + '</p><div class="status-macro">macro</div><span></span></main>'
    plain = hm.clean_html(raw(spark, html), stages=True).collect()[0]
    wiki = hm.clean_html(raw(spark, html, "https://wiki.example.org/x"), stages=True).collect()[0]
    assert "macro" in plain.markdown and "macro" not in wiki.markdown
    assert "<span>" in plain.main_html and "<span>" not in plain.stripped_html
    assert "<div" not in plain.allowed_html


def test_body_without_content_area_loses_its_frame(spark):
    html = "<body><header>top</header><p>kept</p><footer>end</footer></body>"
    assert hm.pages_clean(raw(spark, html)).collect()[0].markdown == "kept"


def test_login_walls_and_thin_pages_fail(spark):
    good = "word " * 60
    df = spark.createDataFrame([("t", good), ("Sign in", good), ("t", "short")], "title string, md string")
    got = df.select(hm.good_quality(F.col("title"), F.col("md"), F.size(F.split("md", " ")))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_anchors(spark):
    html = """<main><ul><li>Read <a class="btn x" href="../doc/1">the doc</a> now</li></ul>
    <nav><a href="/n">nav</a></nav><a href="javascript:void(0)">js</a><p><a href="https://o.example.org/ü">o</a></p></main><a href="/out">out</a>"""
    rows = hm.extract_anchors(raw(spark, html)).sort("anchor_index").collect()
    assert [(r.url, r.in_list, r.in_nav, r.parent_text, r.classes) for r in rows] == [
        ("https://w.example.org/doc/1", True, False, "Read the doc now", "btn x"),
        ("https://w.example.org/n", False, True, "", ""),
        ("https://o.example.org/%C3%BC", False, False, "o", ""),
    ]


def test_odd_pages_end_no_job(spark):
    deep = "<main>" + "<div>" * 3000 + '<a href="http://[bad">x</a> text' + "</div>" * 3000 + "</main>"
    rows = [("https://a.example/x", deep), ("https://a.example/y", None), ("https://a.example/z", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r.page_url: r.markdown for r in hm.clean_html(pages).collect()}
    assert "text" in got["https://a.example/x"] and got["https://a.example/y"] == got["https://a.example/z"] == ""
    assert [r.url for r in hm.extract_anchors(pages).collect()] == ["http://[bad"]


def test_title_column(spark):
    rows = [("<TITLE lang=en> a &amp;\n &lt;b&gt; </TITLE ><title>c</title>", "a & <b>"), ("<p>none", ""), (None, ""), ("<title></title>", "")]
    frame = spark.createDataFrame(rows, "html string, want string")
    for r in frame.select(hm.page_title(frame["html"]).alias("got"), "want").collect():
        assert r.got == r.want
