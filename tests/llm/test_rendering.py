from __future__ import annotations

import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import rendering as R

CASES = {
    "implied ends": ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    "open inline": ("<p><b>a<br><p>b</p>", "a\n\nb"),
    "misnested": ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    "blanks": ("<p>  a \n b&nbsp; c<span> d</span></p>", "a b\xa0 c d"),
    "entities": ("<p>&lt;x&gt; &amp;amp; &copy;</p>", "<x> &amp; ©"),
    "unseen": ("<head><title>t</title></head><body>a<script>if (a</b) x</script><style>p{}</style><template>t</template><noscript>n</noscript>b", "ab"),
    "hidden": ("a<div hidden>x</div><p style='color:red; display : none'>y</p><span style=\"visibility:hidden\">z</span><input type=hidden value=v>b", "ab"),
    "sheet": ("<style>.no, p#x { display:none } i{display:none} i{display:inline} @media print{ u{display:none} }</style><div class='a no'>1</div><p id=x>2</p><i>3</i><u>4</u>", "34"),
    "list": ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  9. d\n- e"),
    "item lines": ("<ul><li>a<br>b<p>c</ul>x", "- a\n  b\n\n  c\n\nx"),
    "reversed": ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    "table": ("<table><caption>T</caption><tr><th>name<th>n</tr><tr><td>long name<td>1<tr><td>x<td>22</table>", "T\nname       n\nlong name  1\nx          22"),
    "spans": ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td colspan=2>wide text here</table>", "a  b  c\n   wide text here"),
    "cell lines": ("<table><tr><td>a<br>bb<td>c<p>d</table>", "a   c\nbb\n    d"),
    "wide signs": ("<table><tr><td>知识<td>x<tr><td>ab<td>y</table>", "知识  x\nab    y"),
    "implied row": ("<table><td>a<td>b</table>", "a  b"),
    "stray in table": ("<table>lost<tr><td>a</table>", "lost\na"),
    "stray in row": ("<table><tr>note<td>x<tr><td>y</table>", "note\nx\ny"),
    "stray element in row": ("<table><tr><b>note</b> <td>x</table>", "note\nx"),
    "cells in a form": ("<table><tr><form><td>a<td>b</form></tr><tr><td>long<td>c</table>", "a     b\nlong  c"),
    "cells in a link": ("<table><tr><a>z<td>a</a><td>b</table>", "z\na  b"),
    "hidden in a row": ("<table><tr><form><td hidden>a<td>b</form></tr></table>", "b"),
    "footer last": ("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
    "pre": ("<pre>\n  a\n\n b  c</pre>x", "  a\n\n b  c\n\nx"),
    "quotes in tags": ("<a title='x > y'>z</a><a title=\"a>b\" href=x>w</a>", "zw"),
    "unclosed quote": ('<a title="x>y</a>z', "yz"),
    "no tag": ("1 < 2 and <3 </ >x", "1 < 2 and <3 x"),
    "comment": ("a<!-- <p>x --><!doctype html><?php x ?>b<!-- never closed", "ab"),
    "details": ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"),
    "controls": ("<select><option>a<option selected>b</select> <input value=v> <textarea>t\nu</textarea><dialog>x</dialog>", "b v t\nu"),
    "definition": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n    b\nc\n    d"),
    "quote": ("<blockquote><p>a<p>b</blockquote><q>c</q>", "    a\n\n    b\n\n“c”"),
    "nested table": ("<table><tr><td><table><tr><td>a<td>b</table><td>c</table>", "a  b  c"),
    "empty": ("<p></p><div> </div>", ""),
    "tag at the end": ("a<b", "a<b"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    html, text = CASES[name]
    assert R.render(html) == text


def test_deep_and_long():
    assert R.render("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert "deep" in R.render("<ul><li>" * 3000 + "deep")
    assert "deep" in R.render("<table><tr><td>" * 2000 + "deep")
    assert len(R.render("<p>word</p>" * 50_000).split()) == 50_000
    R.render('<a b="' * 20_000)
    assert R.render("<td colspan=1000>x" * 300)


class Plain(HTMLParser):
    """All text that isn't in an unseen element, another reader's view."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.mute = [], 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.mute -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.mute:
            self.out.append(data)


def test_no_visible_sign_is_lost(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    from quillmesh.llm.queries import op4_html_rendering

    got = {r.page_id: r.text for r in op4_html_rendering(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for page, html in pages.items():
        other = Plain()
        other.feed(html)
        other.close()
        bare = lambda s: re.sub(r"\s", "", s)
        assert bare(re.sub(r"(?m)^- ", "", got[page])) == bare("".join(other.out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<div>", "</div>", "<br>", "<pre>", "</pre>", "<", ">", "'", '"', "=", "<a x='", "word", " ", "\n"]), max_size=40))
def test_words_survive(parts):
    html = "".join(parts)
    if "'" not in html and '"' not in html and "<<" not in html and "<w" not in html and "<>" not in html:
        assert R.render(html).count("word") == html.count("word")
    else:
        R.render(html)


def test_frames(spark):
    rows = [(1, "<p>a"), (2, None), (3, ""), (1, "<p>a"), (None, "x")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, html string, text string")
    assert sorted(map(str, [(r.page_id, r.text) for r in R.render_pages(pages).collect()])) == sorted(map(str, [(1, "a"), (2, ""), (3, ""), (1, "a"), (None, "x")]))
    assert R.render_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0
