"""Whole documents of markup, read back."""

import pytest

from quire.operators import document, tree
from quire.sources import adapters, markup

SILENT = ("Run", "Artifact", "Document", "Title", "Option")
ODD = [
    "<html lang=cy><title>A & B</title><body><h1 id=x>T</h1>loose<table><caption>Cap</caption><tr><th>A<th scope=row>B<tr><td colspan=2>c<ul><li>in a cell</ul></table><table><tr><td>only</table><p>see <a href='http://x.org/?a=1&b=2'>x &lt;y&gt;</a> or <a href=/z></a><img src=q>",
    "<ol type=a><li>one<ol><li>deep<p>par</ol>tail<li>two</ol><li>orphan<blockquote>q<p>r</blockquote><pre>c o\n d e</pre><dl><dt>t<dd>d</dl>",
    "<form><label for=n>Name</label><input id=n required value='\"1\"'><label>Kind <select name=k multiple><option value=1>a<option selected>b</select></label><input type=radio name=r value=v checked><textarea name=notes readonly>x<b>y</textarea><button disabled>Go</button><input type=submit value=Send><input name=Text1 placeholder='as DD/MM'></form>",
    "<nav><a href=#>a</a></nav><footer>gone</footer>",
    "<div>" * 400 + "<p>bottom" + "</div>" * 400,
]


def printed(rows):
    """Elements that carry an id, with the nearest one above that does, and the text of those that hold some."""
    by_id = {r["element_id"]: r for r in rows}

    def above(r):
        while r["parent_id"] is not None:
            r = by_id[r["parent_id"]]
            if r["kind"] not in SILENT:
                return r["element_id"]
        return None

    return [(r["element_id"], above(r), r["kind"]) for r in rows if r["kind"] not in SILENT]


def read_back(html):
    rows = markup.tree(html)
    by_id = {r[0]: r for r in rows}
    own = lambda r: int(r[7]["id"][1:]) if r[7].get("id", "").startswith("e") else None

    def above(r):
        while r[1] is not None:
            r = by_id[r[1]]
            if own(r) is not None:
                return own(r)
        return None

    return {own(r): (above(r), r[5], r[8], r[7]) for r in rows if own(r) is not None}


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_markup_gives_the_tree_back(spark, sf_dir, chunk):
    made = adapters.customer_pages(spark, sf_dir).filter("page_id < 60").selectExpr("page_id + 1000 AS page_id", "html")
    pages = made.unionByName(spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string"))
    t = markup.page_tree(pages)
    rows, html = {}, {}
    for r in t.orderBy("doc_id", "element_id").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for r in document.html_of(t, chunk).orderBy("doc_id", "chunk_no").collect():
        html[r["doc_id"]] = html.get(r["doc_id"], "") + r["html"]
    assert set(rows) == set(html)
    for doc, own in rows.items():
        back = read_back(html[doc])
        assert [(i, back[i][0]) for i, _, _ in printed(own) if i in back] == [(i, a) for i, a, _ in printed(own)], doc
        for r in own:
            if r["kind"] in ("Heading", "Paragraph", "ListItem", "TableCell", "BlockQuote", "Code", "Caption", "Label") and "(http" not in html[doc]:
                got = back[r["element_id"]][2]
                assert (r["text"] in got) if r["kind"] == "Label" or any(x["kind"] in ("FormField", "Link", "Figure") and r["element_id"] < x["element_id"] <= r["last_id"] for x in own) else got == r["text"]


def test_controls_tables_and_heads(spark):
    t = markup.page_tree(spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string"))
    html = {}
    for r in document.html_of(t).orderBy("doc_id", "chunk_no").collect():
        html[r["doc_id"]] = html.get(r["doc_id"], "") + r["html"]
    assert html[0].startswith('<!DOCTYPE html><html lang="cy">') and "<title>A &amp; B</title>" in html[0] and html[0].endswith("</section></main></body></html>")
    assert html[0].count("<thead>") == 1 and html[0].count("<tbody>") == 2 and 'scope="col"' in html[0] and 'scope="row"' in html[0] and 'colspan="2"' in html[0]
    assert "(http://x.org/?a=1&amp;b=2)" in html[0] and ">/z</a>" in html[0] and "Image with no description" in html[0]
    assert '<ol tabindex' not in html[1] and ' type="a">' in html[1] and "<ul><li" in html[1]
    assert 'required aria-required="true"' in html[2] and " multiple size" in html[2] and "<option value=\"b\" selected>b</option>" in html[2] and " checked>" in html[2] and "no label in the document" in html[2] and ' title="as DD/MM"' in html[2] and '<label id="e4" for="e8">Name</label>' in html[2]
    assert "gone" not in html[3] and "bottom" in html[4] and html[4].count("</section>") == 401


def test_threads_nest_to_any_depth(spark):
    rows = [(1, i, i - 1 if i else None, i, "me" if i % 2 else None, f"<{i}>", None) for i in range(300)] + [(2, 0, None, 0, "a", "x", "y"), (2, 1, 0, 0, "b", "r1", None), (2, 2, 0, 1, "c", "r2", None), (3, 5, 5, 0, "loop", "cut", None)]
    walked = tree.paths(spark, spark.createDataFrame(rows, "doc_id long, element_id int, parent_id int, sibling_ord int, author string, text string, anchored string"))
    html = {}
    for r in document.threads_html(walked, 10).orderBy("doc_id", "chunk_no").collect():
        html[r["doc_id"]] = html.get(r["doc_id"], "") + r["html"]
    assert set(html) == {1, 2} and html[1].endswith("</aside>" * 300)
    back = read_back(html[2].replace("aside", "section"))  # furniture holds no elements when it is read
    assert [back[i][0] for i in (0, 1, 2)] == [None, 0, 0] and "On the text: y" in html[2]


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_pages_at_hand_give_the_same_markup(spark, sf_dir, chunk):
    """F6 of round 4: openings and closings in the order of the rows are those that a sort puts in order."""
    made = adapters.customer_pages(spark, sf_dir).filter("page_id < 60").selectExpr("page_id + 1000 AS page_id", "html")
    pages = made.unionByName(spark.createDataFrame([*enumerate(ODD), (900, None), (901, "")], "page_id long, html string"))
    got = document.html_of_placed(markup.over_trees(pages, document.placed, document.PLACED), chunk)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, document.html_of(markup.page_tree(pages), chunk).collect()))
