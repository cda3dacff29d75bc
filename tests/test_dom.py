import random

import pytest

from pagesieve.functions.dom import WITH_TEXT, numbered, original, parse_pages
from pagesieve.operators import nodes

GOLDEN = [
    ("<html><body><p>a</p><p>b</p></body></html>", 6, [(5, "a"), (3, "b")], "ab"),
    ("<div>x<span>y</span>z</div>", 4, [(3, "x"), (1, "z")], "xz"),
    ("<div>a<!--c--><script>s</script>b</div>", 6, [(5, "a"), (1, "b")], "ab"),
    ("<div>p<table><tr><td>1</td><td>2</td></tr></table></div>", 8, [(7, "p"), (1, "12"), (6, "1"), (4, "2")], "p1212"),
    ("<div><noscript>n</noscript>t</div>", 4, [(1, "t")], "t"),
    ("<p>a<p>b", 4, [(3, "a"), (2, "b")], "ab"),
    ("<ul>\n<li>a</li>\n</ul>", 5, [(3, "a")], "a"),
]


@pytest.mark.parametrize("html,n,want,text", GOLDEN)
def test_golden(html, n, want, text):
    rows = numbered(html)
    got = [(r["node_id"], r["own_text"].strip()) for r in rows if (r["is_text"] or r["tag"] in WITH_TEXT) and (r["own_text"] or "").strip()]
    assert len(rows) == n
    assert sorted(got) == sorted(want)
    assert "".join(t for _, t in sorted(got, reverse=True)) == text


def _random_html(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        k = rng.random()
        if k < 0.4:
            out.append(rng.choice(["a", "b ", " ", "&amp;", "c&copy;"]))
        elif depth < 4:
            tag = rng.choice(["div", "p", "b", "ul"])
            out.append(f"<{tag}>{_random_html(rng, depth + 1)}</{tag}>")
        else:
            out.append("<br>")
    return "".join(out)


def test_ids_are_intervals():
    rng = random.Random(3)
    for _ in range(200):
        rows = numbered("<div>" + _random_html(rng) + "</div>")
        n = len(rows)
        assert sorted(r["node_id"] for r in rows) == list(range(n))
        by = {r["doc_order"]: r for r in rows}
        for r in rows:
            assert r["node_id"] == n - 1 - r["post"]
            if r["parent"] >= 0:
                p = by[r["parent"]]
                assert p["node_id"] < r["node_id"] <= r["last_desc_id"] <= p["last_desc_id"]
        leaves = [r["node_id"] for r in rows if r["is_text"]]
        assert leaves == sorted(leaves, reverse=True)


def test_odd_pages():
    assert numbered("") == [] and numbered("just text") == [] and numbered("<!doctype html>") == []
    assert numbered("<p>&#150;&#x41;&nosuch;</p>")[1]["own_text"] == "–A&nosuch"
    deep = numbered("<div>" * 3000 + "x")
    assert len(deep) == 3001 and deep[-1]["own_text"] == "x"
    assert numbered("<div>x<span>y</span></div>", wrap_all=True)[-1]["own_text"] == "y"


def test_original():
    html = '<html semanticlayout="1"><body data-dcnode-id="1"><span data-dcnode-id="2" instrument_node="">a &amp; b</span><!--c--><br></body></html>'
    assert original(html) == "<html><body>a &amp; b<!--c--><br/></body></html>"


def test_tables(spark):
    pages = spark.createDataFrame([("u1", GOLDEN[3][0], 1), ("u2", None, 2), ("u3", "", 3)], "url STRING, html STRING, node_id INT")
    n = parse_pages(pages)
    assert n.count() == 8 and n.select("url").distinct().count() == 1
    assert {(r.node_id, r.text) for r in nodes.candidates(n).collect()} == {(7, "p"), (1, "12"), (6, "1"), (4, "2")}
    ends = {r.node_id: (r.first_text_id, r.last_text_id) for r in nodes.text_ends(n).collect()}
    assert ends[0] == (7, 4) and ends[1] == (6, 4) and ends[7] == (7, 7)
    tags = {r.tag: r.ids for r in nodes.descendants_by_tag(n, n.where("tag = 'table'"), ["td", "tr"]).collect()}
    assert tags == {"tr": [2], "td": [5, 3]}
    kids = {r.node_id: r.child_ids for r in nodes.children(n).collect()}
    assert kids[0] == [7, 1] and kids[2] == [5, 3]
    links = {r.node_id: (r.prev_id, r.next_id) for r in nodes.linked(n).collect()}
    assert links[7] == (None, 6) and links[0] == (1, None)


def test_nested_bound_is_exclusive(spark):
    df = spark.createDataFrame([("u", 10, 14), ("u", 12, 12), ("u", 14, 14)], "url STRING, node_id INT, last_desc_id INT")
    assert {r.node_id for r in nodes.nested(df, ["url"]).where("is_nested").collect()} == {12}


def test_original_of_deep_pages():
    from pagesieve.functions.dom import original

    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert original(deep) == deep
    assert original('<p data-dcnode-id="3">a <span data-dcnode-id="2" instrument_node="">b &amp; c</span><br></p>') == "<p>a b &amp; c<br/></p>"
