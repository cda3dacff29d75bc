"""Web pages as numbered node rows.

The tree comes from the standard library's HTML events: no implied end tags, void tags close at once, an end tag
without an open match is ignored. Node ids are ranks in pre-order with siblings from right to left, so a subtree is
an interval of ids and document order is descending ids; they follow from the rank in post-order.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Void tags, tags whose strings are no text, tags that keep blanks, tags that start a block.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT = frozenset("script style template".split())
KEEP_BLANKS = frozenset("pre textarea".split())
BLOCK = frozenset(
    "address article aside blockquote canvas dd div dl dt fieldset figcaption caption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav noscript ol output p pre "
    "section table tr td th tbody thead tfoot ul video h7 h8 h9 applet audio button datalist frameset legend menu summary textarea title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdo big br cite code dfn em i img input kbd label map object q samp script small span strong sub sup textarea time tt var".split()
)
WITH_TEXT = frozenset(("ol", "dl", "table"))
STRIP = "\r\n\t\xa0 "
MARKER, ID = "instrument_node", "data-dcnode-id"


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class Text:
    __slots__ = ("text", "silent", "raw")

    def __init__(self, text: str, silent: bool, raw: str) -> None:
        self.text, self.silent, self.raw = text, silent, raw


class Tree(HTMLParser):
    """Builds elements and strings; comments, declarations and script strings are strings without text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.top = Element("[document]", {}, None)
        self.at, self.data = self.top, []
        self.open: dict[str, int] = {}

    def flush(self, wrap: str | None = None) -> None:
        if not self.data:
            return
        text = "".join(self.data)
        self.data = []
        if wrap is None and not text.strip(" \t\n\r\f\v") and not self._inside(KEEP_BLANKS):
            text = "\n" if "\n" in text else " "
        silent = wrap is not None or self.at.tag in SILENT
        self.at.children.append(Text("" if silent else text, silent, text if wrap is None else wrap % text))

    def _inside(self, tags: frozenset[str]) -> bool:
        e = self.at
        while e is not None:
            if e.tag in tags:
                return True
            e = e.parent
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if not self.open.get(tag):
            return
        while True:
            name = self.at.tag
            self.open[name] -= 1
            self.at = self.at.parent
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_charref(self, name: str) -> None:
        try:
            n = int(name[1:], 16) if name[0] in "xX" else int(name)
            # numbers of control characters mean the bytes of the usual western charset
            self.data.append(bytes([n]).decode("cp1252") if 0x80 <= n < 0xA0 else chr(n))
        except (ValueError, OverflowError, UnicodeDecodeError):
            self.data.append("�")

    def handle_entityref(self, name: str) -> None:
        self.data.append(html5.get(name + ";", "&" + name))

    def _silent(self, text: str, wrap: str) -> None:
        self.flush()
        self.data.append(text)
        self.flush(wrap)

    def handle_comment(self, data: str) -> None:
        self._silent(data, "<!--%s-->")

    def handle_decl(self, decl: str) -> None:
        self._silent(decl, "<!%s>")

    def unknown_decl(self, data: str) -> None:
        self.flush()
        if data.upper().startswith("CDATA["):
            self.data.append(data[6:])
            self.flush()
        else:
            self._silent(data, "<![%s]>")

    def handle_pi(self, data: str) -> None:
        self._silent(data, "<?%s>")


def build(html: str) -> Element:
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.flush()
    return tree.top


def numbered(html: str, wrap_all: bool = False) -> list[dict]:
    """Node rows of the first top-level tag in document order. With wrap_all, strings right under a span are nodes too."""
    first = next((c for c in build(html).children if isinstance(c, Element)), None)
    if first is None:
        return []
    rows: list[dict] = []
    texts: list[tuple[int, str]] = []  # document order of row, plain string
    post = 0
    # a frame is [element, row, next child, block row]
    stack: list[list] = []

    def enter(e: Element, parent: int, depth: int, block: int) -> None:
        row = len(rows)
        mine = row if e.tag in BLOCK else block
        rows.append(
            {"doc_order": row, "depth": depth, "parent": parent, "tag": e.tag, "attrs": e.attrs, "is_text": False, "own_text": None, "block": mine, "from": len(texts)}
        )
        stack.append([e, row, 0, mine])

    enter(first, -1, 0, -1)
    while stack:
        frame = stack[-1]
        e, row, k, block = frame
        if k < len(e.children):
            frame[2] += 1
            child = e.children[k]
            if isinstance(child, Element):
                enter(child, row, rows[row]["depth"] + 1, block)
            else:
                if wrap_all or e.tag != "span":
                    marked = MARKER in e.attrs
                    rows.append(
                        {"doc_order": len(rows), "depth": rows[row]["depth"] + 1, "parent": row, "tag": "span", "attrs": {MARKER: ""}, "is_text": e.tag != "noscript" and not marked,
                         "own_text": child.text, "block": block, "from": len(texts), "post": post, "size": 1}
                    )
                    post += 1
                if not child.silent:
                    texts.append((row, child.text))
        else:
            stack.pop()
            r = rows[row]
            r["post"], r["size"] = post, len(rows) - row
            if e.tag in WITH_TEXT:
                r["own_text"] = "".join(t for _, t in texts[r["from"] :])
            post += 1
    n = len(rows)
    for r in rows:
        r["node_id"] = n - 1 - r["post"]
    for r in rows:
        p = r["parent"]
        r["parent_id"] = rows[p]["node_id"] if p >= 0 else None
        r["parent_tag"] = rows[p]["tag"] if p >= 0 else None
        r["parent_style"] = rows[p]["attrs"].get("style") if p >= 0 else None
        r["block_id"] = rows[r["block"]]["node_id"] if r["block"] >= 0 else None
        r["last_desc_id"] = r["node_id"] + r["size"] - 1
    return rows


def annotated(html: str) -> list[dict]:
    """Node rows of a page that carries its ids and text markers already, in document order; nothing is renumbered.

    An element without an id is no node; the parent is the nearest ancestor with one, and a leaf is its own last descendant.
    """
    rows: list[dict] = []
    texts: list[str] = []
    # a frame is [element, row or None, next child, nearest row with an id, first own string]
    stack: list[list] = []

    def enter(e: Element, above: int) -> None:
        row = None
        if e.attrs.get(ID, "").isdigit():
            row, parent = len(rows), rows[above] if above >= 0 else None
            inner = parent["block_id"] if parent else None
            rows.append(
                {"node_id": int(e.attrs[ID]), "doc_order": row, "depth": parent["depth"] + 1 if parent else 0, "parent_id": parent["node_id"] if parent else None, "tag": e.tag,
                 "attrs": e.attrs, "is_text": MARKER in e.attrs and (e.parent is None or e.parent.tag != "noscript"), "own_text": None,
                 "block_id": int(e.attrs[ID]) if e.tag in BLOCK else inner, "parent_tag": e.parent.tag if e.parent and e.parent.parent else None,
                 "parent_style": e.parent.attrs.get("style") if e.parent else None, "last_desc_id": int(e.attrs[ID])}
            )
        stack.append([e, row, 0, above if row is None else row, len(texts)])

    for top in build(html).children:
        if isinstance(top, Element):
            enter(top, -1)
        while stack:
            frame = stack[-1]
            e, row, k, near, first = frame
            if k < len(e.children):
                frame[2] += 1
                child = e.children[k]
                if isinstance(child, Element):
                    enter(child, near)
                elif not child.silent:
                    texts.append(child.text)
            else:
                stack.pop()
                if row is not None:
                    rows[row]["own_text"] = "".join(texts[first:])
                    if stack and stack[-1][3] >= 0:
                        above = rows[stack[-1][3]]
                        above["last_desc_id"] = max(above["last_desc_id"], rows[row]["last_desc_id"])
    return rows


def original(html: str) -> str:
    """The page without the markers of an annotated copy: ids and defaults are dropped, wrapped strings unwrapped. Pages of any
    depth, as the walk keeps its own stack."""
    out: list[str] = []
    stack: list[Element | Text | str] = list(reversed(build(html).children))
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        if isinstance(e, Text):
            out.append(e.raw if e.silent else e.raw.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            continue
        attrs = dict(e.attrs)
        if e.tag == "html":
            attrs.pop("semanticlayout", None)
            attrs.pop("mattrdefaults", None)
        if ID in attrs:
            del attrs[ID]
            if MARKER in attrs:
                if all(isinstance(c, Text) for c in e.children):
                    stack += reversed(e.children)
                    continue
                del attrs[MARKER]
        shown = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in attrs.items())
        if e.tag in VOID:
            out.append(f"<{e.tag}{shown}/>")
            continue
        out.append(f"<{e.tag}{shown}>")
        stack.append(f"</{e.tag}>")
        stack += reversed(e.children)
    return "".join(out)


NODE_FIELDS = (
    ("node_id", pa.int32(), "INT"), ("doc_order", pa.int32(), "INT"), ("depth", pa.int32(), "INT"), ("parent_id", pa.int32(), "INT"), ("tag", pa.string(), "STRING"),
    ("attrs", pa.map_(pa.string(), pa.string()), "MAP<STRING,STRING>"), ("is_text", pa.bool_(), "BOOLEAN"), ("own_text", pa.string(), "STRING"),
    ("last_desc_id", pa.int32(), "INT"), ("block_id", pa.int32(), "INT"), ("parent_tag", pa.string(), "STRING"), ("parent_style", pa.string(), "STRING"),
)


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html", wrap_all: bool = False, ids: str = "assign") -> DataFrame:
    """One row for each node of each page. Pages without a tag, and null pages, have no rows.

    ids is "assign" to number the nodes, or "read" for annotated pages that bring their ids. Filters on the page belong
    before this call: nothing is pushed down through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [] if h is None else annotated(h) if ids == "read" else numbered(h, wrap_all)
                if rows:
                    cols = [pa.array([u] * len(rows), pa.string())]
                    for name, kind, _ in NODE_FIELDS:
                        values = [r[name] for r in rows]
                        cols.append(pa.array([list(v.items()) for v in values] if name == "attrs" else values, kind))
                    yield pa.record_batch(cols, ["url", *(f[0] for f in NODE_FIELDS)])

    ddl = "url STRING, " + ", ".join(f"{n} {s}" for n, _, s in NODE_FIELDS)
    return pages.select(pages[url].alias("url"), pages[html].alias("html")).mapInArrow(run, ddl)
