"""Main text of made pages whose article is known, and of the sample tables."""

import html as entities
import random
import re

import pytest

from tritmarts.llm import sitetree


def text_of(source, url="http://a.example/x", noise=()):
    return sitetree.Page(url, source).text(set(noise))


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("a<b", "a"), ("2 < 3 &lt; 4", "2 < 3 < 4"),
    ("<p>one<p>two<br>three", "one\ntwo three"),
    ("<p><b>x<br><p>y</p>z", "x\ny\nz"),
    ("<b><p>text</b> more</p>", "text more"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p>a&nbsp;&amp;amp; &#8364; &eacute;</p>", "a &amp; € é"),
    ("<p>foo<b>bar</b><i> baz</i></p>", "foobar baz"),
    ('<script>var t="</p>";</script><style>p{}</style><p title="a>b">k</p><!-- no <p> -->', "k"),
    ("<p>a<script>if (a < b) {}", "a"), ("<p>a<!-- open <p>b", "a"), ("<p>a<a href='x", "a"),
    ("<nav><a>m</a></nav><header>h</header><article><header><h1>T</h1></header><p>x<footer>by</footer></article>"
     "<aside>s</aside><footer>f</footer>", "T\nx"),
    ("<div class=cookie-notice>c</div><div id=main-menu>m</div><div class='content with-sidebar'><article>a</article></div>", "a"),
    ("<article>a<div class=comments><article class=comment>c</article></div></article>", "a"),
    ("<section class=comments><article>c</article></section><article>a</article>", "a"),
    ("<main><p>m</p><form><input><button>b</button></form></main>", "m"),
    ("<form id=aspnet><article>a</article></form>", "a"),
    ("<div class=header><h1>Title</h1></div><div class=adBox>ad</div><p>x", "Title\nx"),
    ("<div hidden>no</div><div style='display: none'>no</div><p>yes", "yes"),
    ("<html><head><title>t</title><meta charset=utf-8><p>body without tag", "body without tag"),
    ("<p>a</p></div></p></table>b", "a\nb"), ("<b>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
])
def test_text(source, want):
    assert text_of(source) == want


def test_long_unclosed_quotes_are_linear():
    assert text_of('<p a="' + "x" * 200000 + "<p b='" * 20000) == ""


def pages_of(rows, spark):
    return spark.createDataFrame([(i, u, h, 7, "n") for i, u, h in rows],
                                 "page_id long, url string, html string, noise int, key string")


def test_constant_branches_go_and_shared_titles_stay(spark):
    draw = random.Random(1)
    words = lambda n: " ".join(draw.choice("alpha beta gamma delta epsilon".split()) + str(draw.randrange(999)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        body, lead = words(30), words(5)
        rows.append((i, "https://site.example/%d" % i, "<article><h1>Same title</h1><div class=x1>Read the same everywhere</div>"
                     f"<p>{body}</p></article><div class=zz>{words(3)}</div>"))
        want[i] = f"Same title\n{body}"
        rows.append((100 + i, "https://plain.example/%d" % i,
                     f"<body><div class=top><div>Plain site</div></div><div class=text><p>{lead}</p><p>{body}</p></div><div>Bye</div>"))
        want[100 + i] = f"{lead}\n{body}"
    for i in range(8):  # copies: nothing varies, so nothing is judged
        rows.append((200 + i, "https://copies.example/", "<article><h1>T</h1><div>part</div><p>x</p></article>"))
        want[200 + i] = "T\npart\nx"
    rows += [(300, None, None), (301, "::bad[", ""), (300, None, None)]
    want |= {300: "", 301: ""}
    got = sitetree.main_text(pages_of(rows, spark)).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_sample_pages(spark):
    """The sample pages keep their article between article tags, which makes a plain extraction possible."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in sitetree.main_text(rows).collect()}
    for r in rows.collect():
        body = r.html.partition("<article>")[2].partition("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", body)
        plain = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " ")))).strip() for p in parts]
        assert got[r.page_id] == "\n".join(p for p in plain if p)


def test_empty_table(spark):
    assert sitetree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
