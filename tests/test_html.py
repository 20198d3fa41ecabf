"""The page tokeniser alone: selectors, implied tags, blocks and rendered text."""

import pyarrow as pa

from driftshelf.sources import html


def nodes(page, rules, blocks=()):
    marker = html._Marker(html.index_rules(rules), blocks)
    marker.feed(page)
    marker.close()
    return marker.nodes


def texts(page, selector):
    return [html.rendered(n["text"], False) for n in nodes(page, {"x": selector})]


def test_selectors():
    page = ('<div id="a" class="b c"><p class="c" data-k="v1"><i data-k="">1</i></p></div>'
            '<p data-k="xv2">2</p><a href="/z/dp/1">3</a><a href="/q">4</a>')
    assert texts(page, ".b i") == ["1"]
    assert texts(page, "#a .c") == ["1"]
    assert texts(page, "div.c.b p") == ["1"]
    assert texts(page, "[data-k]") == ["1", "1", "2"]
    assert texts(page, "[data-k]:not([data-k=''])") == ["1", "2"]
    assert texts(page, "[data-k='v1']") == ["1"]
    assert texts(page, "a[href*='/dp/'], p.none") == ["3"]
    assert texts(page, "p i, a") == ["1", "3", "4"]
    assert texts(page, "i p") == []


def test_one_element_may_fill_several_fields():
    found = nodes('<b class="x y">t</b>', {"p": ".x", "q": ".y", "r": "b"})
    assert [n["field"] for n in found] == ["p", "q", "r"]


def test_implied_end_tags():
    assert texts("<ul><li>a<li>b <ul><li>c</ul><li>d</ul>", "li") == ["a", "b\nc", "c", "d"]
    assert texts("<table><tr><td>a<b>x<td>b<tr><td>c</table>", "td") == ["ax", "b", "c"]
    assert texts("<p>a <b>b<p>c<div>d</div>", "p") == ["a b", "c"]
    assert texts("<table><tr><td><p>a<table><tr><td>b</table>c</table>", "p") == ["a"]


def test_rendered_text():
    assert texts("<p> a\n  b&nbsp;&amp; <br> c <script>no()</script><style>no</style></p>", "p") == ["a b &\nc"]
    assert texts("<title> T \n t </title>", "title") == ["T t"]
    raw = nodes("<script type='x'> {\"a\":\n1} </script>", {"s": "script[type='x']"})[0]
    assert html.rendered(raw["text"], True) == ' {"a":\n1} '


def test_body_is_implied():
    assert texts("<title>t</title><p>a</p>b", "body") == ["a\nb"]
    assert texts("just text", "body") == ["just text"]
    assert texts("<html><head><title>t</title></head><body class=k>x</body></html>", "body") == ["x"]


def test_blocks_hold_their_nodes():
    page = "<table><tr><td>1<td>2<tr><td>3</table>"
    found = nodes(page, {"row": "tr", "cell": "td"}, ("row",))
    rows = [n["pos"] for n in found if n["field"] == "row"]
    cells = [(html.rendered(n["text"], False), n["blocks"]) for n in found if n["field"] == "cell"]
    assert cells == [("1", rows[:1]), ("2", rows[:1]), ("3", rows[1:])]


def test_pages_of_a_batch_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(html, "PAGE_SLICE", 3)
    most, plain = [], pa.array

    def array(values, type):
        most.append(len(values))
        return plain(values, type=type)

    monkeypatch.setattr(html.pa, "array", array)
    out = html._in_slices(lambda a, b: {"x": f"{a}{b}"}, [plain(list("abcdefgh")), plain([*range(7), None])],
                          pa.struct([("x", pa.string())]))
    assert [r["x"] for r in out.to_pylist()] == ["a0", "b1", "c2", "d3", "e4", "f5", "g6", "hNone"]
    assert most == [3, 3, 2]
