"""Trees that the HTML standard asks for, depth, and pages that break."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.operators import dispatch, html, html_tree

TREES = {
    "<p>1<b>2<i>3</b>4</i>5</p>": "body(p(1b(2i(3))i(4)5))",
    "<a>x<p>y<a>z": "body(a(x)p(a(y)a(z)))",
    "<a href=1><div>x</a>y</div>": "body(a()div(a(x)y))",
    "<b>1<p>2</b>3</p>": "body(b(1)p(b(2)3))",
    "<p><b><b><b><b>X<p>Y": "body(p(b(b(b(b(X)))))p(b(b(b(Y)))))",
    "<table><b><tr><td>aaa</td></tr>bbb</table>ccc": "body(b()b(bbb)table(tbody(tr(td(aaa))))b(ccc))",
    "<table>x<tr><td>1<td>2<tr><th>3</table>y": "body(xtable(tbody(tr(td(1)td(2))tr(th(3))))y)",
    "<table><caption>c<tr><td>1</table>": "body(table(caption(c)tbody(tr(td(1)))))",
    "<table><colgroup><col><td>1</table>": "body(table(colgroup(col())tbody(tr(td(1)))))",
    "<table><tr><td><table><tr><td>in</table>out</table>": "body(table(tbody(tr(td(table(tbody(tr(td(in))))out)))))",
    "<ul><li>a<li>b<ul><li>c</ul>d</ul>": "body(ul(li(a)li(bul(li(c))d)))",
    "<select><option>a<optgroup><option>b</select>z": "body(select(option(a)optgroup(option(b)))z)",
    "<svg><g>t</g><p>out</svg>": "body(svg(g(t))p(out))",
    "<math><mi><b>q</b></mi></math>r": "body(math(mi(b(q)))r)",
    "<p>x<svg><![CDATA[<q>]]></svg>": "body(p(xsvg(<q>)))",
    "<p>a<table><td>b</table>c": "body(p(atable(tbody(tr(td(b))))c))",
    "<!doctype html><p>a<table><td>b</table>c": "body(p(a)table(tbody(tr(td(b))))c)",
    "<script><!--<script></script>--></script>z": "body(z)",
    "<textarea>\n<b>x</textarea>y": "body(textarea(<b>x)y)",
    "</p>x</p>y</br>z": "body(xp()ybr()z)",
    "<p>a</p></body>b<p>c": "body(p(a)bp(c))",
    "<frameset><frame></frameset>x": "frameset(frame())",
    "a&amp;b &notit; &copy &#x80; < c <": "body(a&b ¬it; © € < c <)",
    "<div><!--><p>x<!-- c --!>y<?q?><!w>": "body(div(p(xy)))",
    "<nobr>a<nobr>b<button>c<button>d": "body(nobr(a)nobr(bbutton(c)button(d)))",
}


@pytest.mark.parametrize("page", TREES)
def test_trees(page):
    root = html_tree.parse(page)
    assert html_tree.outline(html.find(root, TREES[page].split("(")[0])) == TREES[page]


def test_attributes():
    node = html.find(html_tree.parse("<a href='?a=1&copy=2&amp;x&copy' HREF=second b=\"q\"c =d/e/>l</a>"), "a")
    assert node.attrs == {"href": "?a=1&copy=2&x©", "b": "q", "c": "d/e/"}


def test_empty_end_tag_of_a_paragraph():
    assert html.html_to_markdown("</p>x")[0] == "x"


@pytest.mark.parametrize("opened", ["<b>", "<div>", "<p><b><i>", "<span>", "<blockquote>", "<a href=x>"])
def test_twenty_thousand_levels(opened):
    began = time.time()
    assert "x" in html.html_to_markdown(opened * 20_000 + "x<p>y")[0]
    assert time.time() - began < 30


def test_marks_around_blocks_and_rows():
    cases = {
        "<b><p>x</p><p>y</p></b>": "**x**\n\n**y**",
        "<a href=/q><div>x</div>y</a>": "[x](/q)\n\n[y](/q)",
        "<b>a <b>b</b></b>": "**a b**",
        "<table><tr><th>a<th>b<tr><td>c<td><p>d</table>": "a b\n\nc\n\nd",
        "<p>1. x<br> <br>y<br></p># z": "1\\. x  \n  \ny\n\n\\# z",
        "": "",
    }
    for source, want in cases.items():
        assert html.html_to_markdown(source)[0] == want


def test_a_page_that_breaks_is_its_own_rows_error(spark):
    fonts = "".join(f"<font size={i}>" for i in range(2000))
    growing = f"<p>{fonts}" + "<p>x" * 2000
    pages = [(1, "<b>" * 1500 + "deep"), (2, growing), (3, "<p>fine"), (4, ""), (5, None)]
    rows = spark.createDataFrame(pages, "source_id long, page string").selectExpr("source_id", "encode(page, 'utf-8') AS content")
    got = {r.source_id: r for r in dispatch.converted(rows, html.html).collect()}
    assert got[1].markdown == "**deep**" and got[3].markdown == "fine" and got[4].markdown == ""
    assert "grows too much" in got[2].error and got[2].markdown is None
    assert all(got[i].error is None for i in (1, 3, 4, 5))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<b> </b> <i> </i> <p> </p> <a href=x> </a> <table> </table> <tr> <td> </td> <caption> <col> <ul> <li> </ul> <select> <option> </select> <svg> </svg> <template> </template> <form> </form> <button> <h1> </h1> <br> <frameset> <body> </body> </html> <head> <title>t</title> <script> <!-- --> text &amp; <math> <mi> <div> </div> <dd> <nobr> <marquee> </marquee> <math> <annotation-xml>".split()), max_size=40).map("".join))
def test_any_order_of_tags(page):
    root = html_tree.parse(page)
    for node in html_tree.preorder(root):
        for child in node.children:
            assert isinstance(child, str) or child.parent is node
    html.html_to_markdown(page)
