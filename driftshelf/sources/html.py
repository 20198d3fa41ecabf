"""Saved HTML to marked nodes.

The one place with per-row Python: an Arrow UDF tokenises each page with the standard
library parser and returns the nodes its selectors name. Everything after that (clean-up,
fallbacks, sorting) is Catalyst's. One page in, one row out: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typed here, not as DDL text: UDFs are made at import, before a session exists.
NODE = (
    T.StructType()
    .add("pos", T.IntegerType())
    .add("blocks", T.ArrayType(T.IntegerType()))
    .add("text", T.StringType())
    .add("link", T.StringType())
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
)
_ARROW_NODES = pa.list_(
    pa.struct(
        [
            ("pos", pa.int32()), ("blocks", pa.list_(pa.int32())), ("text", pa.string()),
            ("link", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ]
    )
)
#: Pages held as Python objects at a time.
PAGE_SLICE = 64
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = {"script", "style", "noscript", "template"}
_HEAD = _SILENT | {"html", "head", "title", "meta", "link", "base"}
_LINES = set(
    "address article aside blockquote br div dd dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tr ul".split()
)
# Start tags that end an open element: which, and where to stop looking for it.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "table"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS |= {tag: ({"p"}, {"td", "th", "table", "button"}) for tag in _LINES - {"li", "tr", "dd", "dt", "br"}}
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_PART = re.compile(
    r"(?P<tag>^[\w*-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|(?P<no>:not\()?\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)'(?P<val>[^']*)')?\]"
)


def compile_selector(text: str) -> list[list[list[tuple]]]:
    """A selector list as chains of simple tests, outermost element first."""
    chains = []
    for chain in text.split(","):
        steps = []
        for step in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", chain.strip()):
            tests = []
            for m in _PART.finditer(step):
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower()))
                elif m["id"]:
                    tests.append(("id", m["id"]))
                elif m["cls"]:
                    tests.append(("class", m["cls"]))
                else:
                    kind = {None: "has", "=": "is", "*=": "contains"}[m["op"]]
                    tests.append(("not_" + kind if m["no"] else kind, m["attr"], m["val"]))
            steps.append(tests)
        chains.append(steps)
    return chains


def index_rules(rules: dict[str, str]) -> dict[tuple, list[tuple]]:
    """Chains by one thing their element must have, so a tag only meets likely chains."""
    index: dict[tuple, list[tuple]] = {}
    for rank, (field, selector) in enumerate(rules.items()):
        for chain in compile_selector(selector):
            named = {kind: args[0] for kind, *args in reversed(chain[-1])}
            key = next(
                (kind, named[kind]) for kind in ("id", "class", "is", "has", "contains", "tag")
                if kind in named
            )
            if key[0] in ("is", "has", "contains"):
                key = ("attr", key[1])
            index.setdefault(key, []).append((rank, field, chain))
    return index


def _passes(tests, tag, attrs) -> bool:
    for kind, *args in tests:
        if kind == "tag":
            ok = tag == args[0]
        elif kind == "id":
            ok = attrs.get("id") == args[0]
        elif kind == "class":
            ok = args[0] in (attrs.get("class") or "").split()
        else:
            value = attrs.get(args[0])
            name = kind.removeprefix("not_")
            ok = value is not None and (
                name == "has" or (value == args[1] if name == "is" else args[1] in value)
            )
            ok = ok != kind.startswith("not_")
        if not ok:
            return False
    return True


class _Marker(HTMLParser):
    def __init__(self, index, blocks):
        super().__init__(convert_charrefs=True)
        self.index, self.blocks = index, blocks
        self.stack, self.nodes, self.count = [], [], 0
        self.in_body = False

    def _fields(self, tag, attrs):
        """Fields whose selector the element satisfies, in rule order."""
        keys = [("tag", tag), ("id", attrs.get("id")), *(("attr", a) for a in attrs)]
        keys += [("class", c) for c in (attrs.get("class") or "").split()]
        likely = [entry for key in keys for entry in self.index.get(key, ())]
        hits = {(rank, field) for rank, field, chain in likely if self._match(chain, tag, attrs)}
        return [field for _, field in sorted(hits)]

    def _match(self, chain, tag, attrs):
        if not _passes(chain[-1], tag, attrs):
            return False
        need = len(chain) - 2
        for up_tag, up_attrs, *_ in reversed(self.stack):
            if need < 0:
                break
            if _passes(chain[need], up_tag, up_attrs):
                need -= 1
        return need < 0

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if not self.in_body and tag not in _HEAD:
            self._begin_body(tag)
        self._end_before(tag)
        if tag in _LINES:
            self._text("\n")
        blocks = [at for *_, at in self.stack if at is not None]
        made = [
            {"field": field, "pos": self.count, "blocks": blocks, "text": [], "attrs": attrs}
            for field in self._fields(tag, attrs)
        ]
        self.nodes += made
        if tag not in _VOID:
            block = self.count if any(n["field"] in self.blocks for n in made) else None
            self.stack.append((tag, attrs, made, block))
        self.count += 1

    def _begin_body(self, tag=None):
        """Content begins the body, tag or not."""
        self.in_body = True
        if tag != "body":
            self.handle_starttag("body", [])

    def _end_before(self, tag):
        ended, stops = _ENDS.get(tag, ((), ()))
        if ended:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] in ended:
                    del self.stack[at:]
                    return
                if self.stack[at][0] in stops:
                    return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                del self.stack[at:]
                break
        if tag in _LINES:
            self._text("\n")

    def handle_data(self, data):
        if not self.in_body and data.strip() and not any(t in _HEAD - {"html"} for t, *_ in self.stack):
            self._begin_body()
        inside = next((t for t, *_ in reversed(self.stack) if t in _SILENT), None)
        self._text(data if inside else _BLANKS.sub(" ", data), inside)

    def _text(self, data, inside=None):
        for tag, _, made, _ in self.stack:
            if made and (inside is None or tag == inside):
                for node in made:
                    node["text"].append(data)


def rendered(pieces: list[str], raw: bool) -> str:
    """Text as shown: blanks collapsed, one line per block (scripts stay as they are)."""
    whole = "".join(pieces)
    if raw:
        return whole
    lines = (_BLANKS.sub(" ", line).strip(" ") for line in whole.split("\n"))
    return "\n".join(line for line in lines if line).strip()


def _link(base: str, attrs: dict[str, str]) -> str | None:
    target = attrs.get("href") or attrs.get("src") or attrs.get("data-src")
    try:
        return urljoin(base, target) if target else None
    except ValueError:
        return None


@dataclass(frozen=True)
class PageNodes:
    """What a page style takes from a page. ``opening`` limits the search for block markers to so
    many characters of the body."""

    selectors: dict[str, str]
    required: str
    blocks: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    opening: int | None = None

    @property
    def all(self) -> dict[str, str]:
        return {**self.selectors, "required": self.required, "page_title": "title", "page_body": "body"}


def _layout(fields: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(field, T.ArrayType(NODE)) for field in fields])


def _arrow(fields: Iterable[str]) -> pa.StructType:
    return pa.struct([(field, _ARROW_NODES) for field in fields])


def _page_nodes(index: dict, fields: Iterable[str], blocks: tuple, raw: tuple, base: str | None,
                page: str | None) -> dict[str, list]:
    """Nodes of a page by field."""
    marker = _Marker(index, blocks)
    marker.feed(page or "")
    marker.close()
    out = {field: [] for field in fields}
    for n in marker.nodes:
        out[n["field"]].append(
            {"pos": n["pos"], "blocks": n["blocks"], "text": rendered(n["text"], n["field"] in raw),
             "link": _link(base or "", n["attrs"]), "attrs": list(n["attrs"].items())}
        )
    return out


def _in_slices(read, columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """``read`` of each row. Rows and results are Python objects for `PAGE_SLICE` pages at a time;
    a batch of 10,000 pages is never held as such."""
    done = []
    for at in range(0, len(columns[0]), PAGE_SLICE):
        pages = zip(*(c.slice(at, PAGE_SLICE).to_pylist() for c in columns))
        done.append(pa.array([read(*page) for page in pages], type=kind))
    return pa.concat_arrays(done) if done else pa.array([], type=kind)


def marked_nodes(rules: dict[str, str], blocks: tuple[str, ...] = (), raw: tuple[str, ...] = ()):
    """A UDF ``(url, html) -> struct`` with the nodes of each named selector, in document order.

    A node inside elements of ``blocks`` fields carries their positions, so nested values
    (cells of a row, fields of a review) can be told apart. ``link`` is the address of a
    link or image, resolved against the page.
    """
    index = index_rules(rules)
    layout, arrow = _layout(rules), _arrow(rules)

    @F.arrow_udf(layout)
    def parse(url: pa.Array, html: pa.Array) -> pa.Array:
        return _in_slices(lambda base, page: _page_nodes(index, rules, blocks, raw, base, page), [url, html], arrow)

    return parse


def styled_nodes(styles: dict[str, PageNodes], markers: tuple[str, ...]):
    """A UDF ``(style, url, html) -> struct`` that reads pages of all styles in one go.

    ``nodes`` has a struct for each style, in order, and only that of the page's own is filled;
    ``lost`` says that its required node is absent, ``marker`` is the first marker in its title or
    body. The body is searched here and stays here.
    """
    named = {style: (at, index_rules(s.all), s) for at, (style, s) in enumerate(styles.items())}
    layout = T.StructType([
        T.StructField("lost", T.BooleanType()), T.StructField("marker", T.StringType()),
        T.StructField("nodes", T.StructType([
            T.StructField(f"style_{at}", _layout(s.selectors)) for at, _, s in named.values()])),
    ])
    arrow = pa.struct([
        ("lost", pa.bool_()), ("marker", pa.string()),
        ("nodes", pa.struct([(f"style_{at}", _arrow(s.selectors)) for at, _, s in named.values()])),
    ])

    def read(style: str, base: str | None, page: str | None) -> dict:
        at, index, s = named[style]
        fields = _page_nodes(index, s.all, s.blocks, s.raw, base, page)
        required, title, body = (fields.pop(name) for name in ("required", "page_title", "page_body"))
        seen = " ".join([title[0]["text"] if title else "", (body[0]["text"] if body else "")[:s.opening]]).lower()
        return {"lost": not required, "marker": next((m for m in markers if m in seen), None),
                "nodes": {f"style_{at}": fields}}

    @F.arrow_udf(layout)
    def parse(style: pa.Array, url: pa.Array, html: pa.Array) -> pa.Array:
        return _in_slices(read, [style, url, html], arrow)

    return parse


def inside(nodes: Column, block: Column, field: str) -> Column:
    """Nodes of a field within one block element."""
    return F.filter(nodes[field], lambda n: F.array_contains(n["blocks"], block["pos"]))


def nodes_of(nodes: Column, field: str) -> Column:
    return nodes[field]


def texts(nodes: Column, field: str) -> Column:
    return F.transform(nodes_of(nodes, field), lambda n: n["text"])


def first_text(nodes: Column, field: str) -> Column:
    """Text of the first node of a field; null when absent or blank."""
    return first_of(nodes_of(nodes, field))


def first_of(nodes: Column) -> Column:
    return F.nullif(F.try_element_at(nodes, F.lit(1))["text"], F.lit(""))


def row_cells(nodes: Column, rows: str) -> Column:
    """Non-empty cell texts of each table row of a field."""
    return F.transform(
        nodes_of(nodes, rows),
        lambda r: F.filter(
            F.transform(inside(nodes, r, "cell"), lambda n: n["text"]), lambda t: t != ""
        ),
    )


def first_attr(nodes: Column, field: str, name: str) -> Column:
    return F.try_element_at(nodes_of(nodes, field), F.lit(1))["attrs"][name]
