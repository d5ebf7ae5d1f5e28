"""HTML to Markdown: a tree builder for real-world markup, and a renderer.

The builder follows the public HTML parsing rules that matter for text: implied end tags, the list of
active formatting elements with reconstruction and a form of the adoption agency, foster parenting of
what stands wrongly inside tables, raw-text elements and character references.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import HIDDEN_DECLARATIONS, HIDDEN_PARTS
from ..functions.options import ConversionOptions
from ..session import ship

# Element classes of the renderer.
IGNORED = frozenset("script style head noscript template svg iframe object embed canvas button input select textarea".split())
BLOCKS = frozenset(
    "p div section article header footer main aside nav center address figure figcaption table tbody thead tfoot tr td th caption dl dt dd form fieldset body html "
    "h1 h2 h3 h4 h5 h6 ul ol li pre blockquote hr".split()
)
BLOCK_INSIDE = frozenset("p div table h1 h2 h3 h4 h5 h6 ul ol blockquote pre hr".split())
IN_CELL = frozenset("div p h1 h2 h3 h4 h5 h6 ul ol blockquote pre".split())
# Classes of the parsing rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("title textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp li dd dt".split()
)
SPECIAL = CLOSES_P | frozenset(
    "body html td th tr tbody thead tfoot caption button object marquee applet template select".split()
)
SCOPE = frozenset("html table td th caption marquee object applet template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("dd dt li option optgroup p rb rp rt rtc".split())

_WS = "\t\n\x0b\x0c\r \x85\xa0             　"
_INVISIBLE = re.compile("[͏­​‌‍⁠﻿᠎]")
_SPACES = re.compile(f"[{_WS}]+")
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<bogus>[!?][^>]*)(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S
)
_ATTR = re.compile(r"([^\s=>/\"'][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(eq=False)
class Node:
    """An element; ``children`` holds nodes and strings."""

    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: "Node | None" = None

    def append(self, child) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.detach()
            child.parent = self
        self.children.append(child)

    def detach(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator["Node"]:
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += node.children[::-1]
        return "".join(out)


class TreeBuilder:
    """Builds body and title from markup."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.body = Node("body")
        self.root.append(self.body)
        self.stack: list[Node] = [self.root, self.body]
        #: Active formatting elements; None is a marker set by table cells.
        self.active: list[Node | None] = []
        self.title: str | None = None
        self.in_head = False

    # -- helpers -----------------------------------------------------------------------------
    @property
    def top(self) -> Node:
        return self.stack[-1]

    def in_scope(self, names, extra=()) -> bool:
        for node in reversed(self.stack):
            if node.name in names:
                return True
            if node.name in SCOPE or node.name in extra:
                return False
        return False

    def pop_to(self, names) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().name in names:
                return

    def implied(self, but: str = "") -> None:
        while self.top.name in IMPLIED and self.top.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope({"p"}, ("button",)):
            self.implied("p")
            self.pop_to({"p"})

    def insert(self, node: Node) -> Node:
        self.place(node)
        self.stack.append(node)
        return node

    def place(self, child) -> None:
        """Put a child at the insertion point; inside table structure it goes before the table."""
        if self.top.name in {"table", "tbody", "thead", "tfoot", "tr"} and (
            isinstance(child, str) or child.name not in {
                "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "col", "script", "style", "template"
            }
        ):
            table = next((n for n in reversed(self.stack) if n.name == "table"), None)
            if table is not None and table.parent is not None:
                at = next(i for i, c in enumerate(table.parent.children) if c is table)
                siblings = table.parent.children
                if isinstance(child, str):
                    if at and isinstance(siblings[at - 1], str):
                        siblings[at - 1] += child
                    else:
                        siblings.insert(at, child)
                else:
                    child.detach()
                    at = next(i for i, c in enumerate(table.parent.children) if c is table)
                    child.parent = table.parent
                    table.parent.children.insert(at, child)
                return
        self.top.append(child)

    def reconstruct(self) -> None:
        """Open again the formatting elements that were closed by the end of a block."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and not any(n is self.active[k - 1] for n in self.stack):
            k -= 1
        for j in range(k, len(self.active)):
            old = self.active[j]
            self.active[j] = self.insert(Node(old.name, dict(old.attrs)))

    def push_formatting(self, node: Node) -> None:
        alike = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.name == node.name and n.attrs == node.attrs:
                alike.append(n)
        if len(alike) >= 3:
            self.active.remove(alike[-1])
        self.active.append(node)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- tokens ------------------------------------------------------------------------------
    def text(self, data: str) -> None:
        if not data:
            return
        if self.top.name in {"table", "tbody", "thead", "tfoot", "tr"} and not data.strip():
            self.top.append(data)
            return
        if self.top.name not in RAW | {"textarea"} and not self.in_head:
            if data.strip() or len(self.stack) > 2:
                self.reconstruct()
        self.place(data)

    def start(self, name: str, attrs: dict[str, str], raw) -> None:
        if name in {"html", "body"}:
            for k, v in attrs.items():
                (self.body if name == "body" else self.root).attrs.setdefault(k, v)
            return
        if name == "head":
            return
        if name in {"meta", "link", "base"}:
            return
        if name == "title" and self.title is None and len(self.stack) == 2:
            self.title = raw
            return
        if name in CLOSES_P:
            if name == "li":
                self.close_item({"li"})
            elif name in {"dd", "dt"}:
                self.close_item({"dd", "dt"})
            self.close_p()
            if name in HEADINGS and self.top.name in HEADINGS:
                self.stack.pop()
            node = self.insert(Node(name, attrs))
            if name == "hr":
                self.stack.pop()
            if raw is not None:
                node.append(raw)
                self.stack.pop()
            return
        if name in {"caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"}:
            self.table_part(name, attrs)
            return
        if name in FORMATTING:
            if name == "a" and any(n is not None and n.name == "a" for n in self.since_marker()):
                self.end("a")
                self.active = [n for n in self.active if n is None or n.name != "a" or any(n is s for s in self.stack)]
            self.reconstruct()
            if name == "nobr" and self.in_scope({"nobr"}):
                self.end("nobr")
                self.reconstruct()
            self.push_formatting(self.insert(Node(name, attrs)))
            return
        if name == "option" and self.top.name == "option":
            self.stack.pop()
        if name not in RAW:
            self.reconstruct()
        node = self.insert(Node(name, attrs))
        if raw is not None:
            node.append(raw)
            self.stack.pop()
        elif name in VOID:
            self.stack.pop()

    def since_marker(self) -> list[Node]:
        out = []
        for n in reversed(self.active):
            if n is None:
                break
            out.append(n)
        return out

    def close_item(self, names) -> None:
        for node in reversed(self.stack):
            if node.name in names:
                self.implied(node.name)
                self.pop_to({node.name})
                return
            if node.name in SPECIAL and node.name not in {"address", "div", "p"}:
                return

    def table_part(self, name: str, attrs: dict[str, str]) -> None:
        if not any(n.name == "table" for n in self.stack):
            return
        if name in {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}:
            if self.in_table({"td", "th", "caption"}):
                self.implied()
                self.pop_to({"td", "th", "caption"})
                self.clear_to_marker()
        if name in {"tr", "tbody", "thead", "tfoot", "caption", "colgroup"} and self.in_table({"tr"}):
            self.pop_to({"tr"})
        if name in {"tbody", "thead", "tfoot", "caption", "colgroup"} and self.in_table({"tbody", "thead", "tfoot"}):
            self.pop_to({"tbody", "thead", "tfoot"})
        if name in {"td", "th"} and not self.in_table({"tr"}):
            self.table_part("tr", {})
        if name == "tr" and not self.in_table({"tbody", "thead", "tfoot"}):
            self.back_to({"table"})
            self.insert(Node("tbody"))
        self.back_to(
            {"table"} if name in {
                "tbody", "thead", "tfoot", "caption", "colgroup", "col"
            } else {"tbody", "thead", "tfoot"} if name == "tr" else {"tr"}
        )
        self.insert(Node(name, attrs))
        if name in {"td", "th", "caption"}:
            self.active.append(None)
        elif name == "col":
            self.stack.pop()

    def in_table(self, names) -> bool:
        for node in reversed(self.stack):
            if node.name in names:
                return True
            if node.name in {"table", "html"}:
                return False
        return False

    def back_to(self, names) -> None:
        while self.top.name not in names and self.top.name not in {"table", "body", "html"}:
            self.stack.pop()

    def end(self, name: str) -> None:
        if name in {"html", "body", "head"} or name in VOID and name != "br":
            return
        if name == "br":
            self.start("br", {}, None)
            return
        if name == "p":
            if not self.in_scope({"p"}, ("button",)):
                self.insert(Node("p"))
            self.close_p()
            return
        if name in FORMATTING:
            self.adopt(name)
            return
        if name == "li":
            if self.in_scope({"li"}, ("ol", "ul")):
                self.implied("li")
                self.pop_to({"li"})
            return
        if name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied()
                self.pop_to(HEADINGS)
            return
        if name in {"td", "th", "caption", "tr", "tbody", "thead", "tfoot"}:
            if self.in_table({name}):
                if name not in {"td", "th", "caption"} and self.in_table({"td", "th", "caption"}):
                    self.pop_to({"td", "th", "caption"})
                    self.clear_to_marker()
                self.implied()
                self.pop_to({name})
                if name in {"td", "th", "caption"}:
                    self.clear_to_marker()
            return
        if name == "table":
            if any(n.name == "table" for n in self.stack):
                if self.in_table({"td", "th", "caption"}):
                    self.clear_to_marker()
                self.pop_to({"table"})
            return
        if name in SPECIAL:
            if self.in_scope({name}):
                self.implied(name if name in {"dd", "dt"} else "")
                self.pop_to({name})
            return
        self.other_end(name)

    def other_end(self, name: str) -> None:
        for node in reversed(self.stack):
            if node.name == name:
                self.implied(name)
                while len(self.stack) > 2 and self.stack.pop() is not node:
                    pass
                return
            if node.name in SPECIAL:
                return

    def adopt(self, name: str) -> None:
        """Close a formatting element that may hold or cross blocks."""
        if self.top.name == name and not any(n is self.top for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            mark = next((n for n in self.since_marker() if n.name == name), None)
            if mark is None:
                self.other_end(name)
                return
            if not any(n is mark for n in self.stack):
                self.active.remove(mark)
                return
            at = next(i for i, n in enumerate(self.stack) if n is mark)
            furthest = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].name in SPECIAL), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(mark)
                return
            block, ancestor = self.stack[furthest], self.stack[at - 1]
            bookmark = self.active.index(mark)
            last, k, inner = block, furthest, 0
            while True:
                k -= 1
                node = self.stack[k]
                if node is mark:
                    break
                inner += 1
                if inner > 3 and node in self.active:
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[k]
                    continue
                copy = Node(node.name, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.stack[k] = copy
                if last is block:
                    bookmark = self.active.index(copy) + 1
                copy.append(last)
                last = copy
            if ancestor.name in {"table", "tbody", "thead", "tfoot", "tr"}:
                top, self.stack = self.stack, self.stack[:at]
                last.detach()
                self.place(last)
                self.stack = top
            else:
                ancestor.append(last)
            copy = Node(mark.name, dict(mark.attrs))
            for child in list(block.children):
                if isinstance(child, Node):
                    child.parent = copy
                copy.children.append(child)
            block.children = []
            block.append(copy)
            where = self.active.index(mark)
            self.active.remove(mark)
            self.active.insert(min(bookmark - (where < bookmark), len(self.active)), copy)
            self.stack = [n for n in self.stack if n is not mark]
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is block) + 1, copy)


def parse(markup: str) -> TreeBuilder:
    """The tree of a document or fragment."""
    builder, at = TreeBuilder(), 0
    markup = markup.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    skip_lf = False
    for m in iter(lambda: _TOKEN.search(markup, at), None):
        data = markup[at : m.start()]
        at = m.end()
        if data:
            if skip_lf and data.startswith("\n"):
                data = data[1:]
            builder.text(entities.unescape(data))
        skip_lf = False
        if m["end"]:
            builder.end(m["end"].lower())
        elif m["start"]:
            name, attrs, raw = m["start"].lower(), {}, None
            for a in _ATTR.finditer(m["attrs"] or ""):
                attrs.setdefault(a[1].lower(), entities.unescape(next((v for v in a.groups()[1:] if v is not None), "")))
            if name in RAW | RCDATA:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(markup, at)
                raw = markup[at : close.start()]
                raw = entities.unescape(raw) if name in RCDATA else raw
                at = close.end()
            if name == "plaintext":
                builder.start(name, attrs, markup[at:])
                at = len(markup)
                continue
            builder.start(name, attrs, raw)
            skip_lf = name in {"pre", "textarea", "listing"}
    if at < len(markup):
        builder.text(entities.unescape(markup[at:]))
    return builder


# -- rendering ---------------------------------------------------------------------------------


def _trim(s: str) -> str:
    return s.strip(_WS)


def _collapse(s: str) -> str:
    return _trim(_SPACES.sub(" ", s))


def normal_text(s: str) -> str:
    return _SPACES.sub(" ", _INVISIBLE.sub("", s))


_ORDERED = re.compile(f"([{_WS}]*\\d{{1,9}})([.)])(?=[{_WS}]|\\Z)")
_OPENS = re.compile(r"[ \t]*(?=>|[#+*\-](?:[ \t]|\Z)|-[- \t]*\Z|=[= \t]*\Z)")


def escape_line(line: str) -> str:
    """What opens a block at the start of a line gets a backslash."""
    if m := _ORDERED.match(line):
        return f"{m[1]}\\{line[m.end(1):]}"
    m = _OPENS.match(line)
    return f"{m[0]}\\{line[m.end():]}" if m else line


def hidden(node: Node) -> bool:
    """What a mail reader doesn't show."""
    if node.name in IGNORED or "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true" and not _trim(node.text()):
        return True
    style = node.attrs.get("style", "").replace(" ", "").lower()
    if any(s in style for s in HIDDEN_PARTS):
        return True
    gone = {d + u for d in HIDDEN_DECLARATIONS for u in ("", "px", "%")}
    return any(p.replace("!important", "") in gone for p in style.split(";"))


class Renderer:
    """Blocks of one context: (text, list key or None)."""

    def __init__(self, options: ConversionOptions):
        self.options, self.blocks, self.inline, self.lists = options, [], [], 0

    def add(self, text: str, key: str | None = None) -> None:
        if _trim(text):
            self.blocks.append((text.rstrip(_WS), key))

    def flush(self) -> None:
        lines = (_trim(x) for x in "".join(self.inline).split("\n"))
        self.inline = []
        self.add("\n".join(escape_line(x) for x in lines if x))

    def build(self) -> str:
        out, before = [], None
        for k, (text, key) in enumerate(self.blocks):
            if k:
                out.append("\n\n" if key is None or before is None else "\n" if key == before else "\n\n<!-- -->\n\n")
            out.append(text)
            before = key
        return "".join(out) + "\n" if out else ""

    def block(self, node: Node, depth: int = 0) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.inline.append(normal_text(child))
            elif not hidden(child):
                self.element(child, depth)

    def element(self, e: Node, depth: int) -> None:
        name = e.name
        if name == "br":
            self.inline.append("\n")
            return
        special = {"hr", "ul", "ol", "pre", "blockquote"} | HEADINGS
        table = name == "table" and data_table(e)
        if name in special or table:
            self.flush()
        if name in HEADINGS:
            if text := _collapse(self.inner(e)):
                self.add("#" * int(name[1]) + " " + text)
        elif name == "hr":
            self.add("---")
        elif name in {"ul", "ol"}:
            self.lists += 1
            self.list(e, depth, f"list-{self.lists}")
        elif name == "pre":
            if code := e.text().rstrip(_WS):
                self.add(f"```\n{code}\n```")
        elif name == "blockquote":
            inside = Renderer(self.options)
            inside.block(e)
            inside.flush()
            if quoted := inside.build():
                self.add("\n".join(f"> {x}" if x else ">" for x in quoted.split("\n")))
        elif table:
            self.table(e)
        elif name in BLOCKS or any(n.name in BLOCK_INSIDE for n in e.walk()):
            self.flush()
            self.block(e, depth)
            self.flush()
        else:
            self.inline.append(self.inline_element(e))

    def list(self, e: Node, depth: int, key: str) -> None:
        number = 0
        for item in e.elements():
            if item.name != "li" or hidden(item):
                continue
            parts = [
                normal_text(c) if isinstance(c, str) else "" if c.name in {"ul", "ol"} or hidden(c) else self.inline_element(c) for c in item.children
            ]
            number += 1
            mark = f"{number}." if e.name == "ol" else "-"
            self.add("  " * depth + mark + " " + _collapse("".join(parts)), key)
            for nested in item.elements():
                if nested.name in {"ul", "ol"}:
                    self.list(nested, depth + 1, key)

    def inner(self, node: Node) -> str:
        return "".join(
            normal_text(c) if isinstance(c, str) else "" if hidden(c) else self.inline_element(c) for c in node.children
        )

    def inline_element(self, e: Node) -> str:
        name = e.name
        if name in IGNORED:
            return ""
        if name == "br":
            return "\n"
        if name == "img":
            return _collapse(e.attrs.get("alt", ""))
        inner = self.inner(e)
        core = _trim(inner)
        if not core:
            return " " if inner else ""
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "strike": "~~", "del": "~~"}.get(name)
        if mark:
            return (" " if inner[0] in _WS else "") + mark + _collapse(inner) + mark + (" " if inner[-1] in _WS else "")
        if name == "code":
            return f"`{core}`"
        if name == "a":
            href = _trim(e.attrs.get("href", ""))
            if not self.options.include_link_urls or not re.match("https?://|mailto:", href, re.I):
                return inner
            text = _collapse(core)
            return f"<{href}>" if text == href else f"[{text}]({href.replace(' ', '%20').replace(')', '%29')})"
        return inner

    def table(self, e: Node) -> None:
        rows = [
            [
                _collapse(self.inner(c)).replace("|", "\\|") for c in r.elements() if c.name in {"td", "th"} and not hidden(c)
            ] for r in table_rows(e) if not hidden(r)
        ]
        rows = [r for r in rows if any(r)]
        if not rows:
            return
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        self.add("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))


def table_rows(e: Node) -> list[Node]:
    parts = [r for c in e.elements() for r in (c.elements() if c.name in {"thead", "tbody", "tfoot"} else [c])]
    return [r for r in parts if r.name == "tr"]


def data_table(e: Node) -> bool:
    """Two visible rows and two columns at least, no tables or blocks inside; not marked as presentation."""
    if e.attrs.get("role", "").lower() == "presentation" or any(n.name == "table" for n in e.walk()):
        return False
    rows = [[c for c in r.elements() if c.name in {"td", "th"}] for r in table_rows(e) if not hidden(r)]
    if len(rows) < 2 or max(map(len, rows)) < 2:
        return False
    return not any(n.name in IN_CELL for r in rows for c in r for n in c.walk())


def compact(markdown: str) -> str:
    lines = "\n".join(x.rstrip(_WS) for x in markdown.replace("\r\n", "\n").split("\n"))
    return re.sub("\n{3,}", "\n\n", lines).strip("\n")


def convert_html(markup: str | None, options: ConversionOptions = ConversionOptions()) -> tuple[str, str | None, list[str]]:
    """Markdown, title (null if blank) and warnings (none for HTML)."""
    tree = parse(markup or "")
    r = Renderer(options)
    r.block(tree.body)
    r.flush()
    return compact(r.build()), _collapse(tree.title or "") or None, []


_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def decode_html(data: bytes) -> str:
    """Bytes to text: byte order mark, then a declared charset, then UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    m = _CHARSET.search(data[:1024])
    name = m[1].decode("ascii", "replace").lower() if m else "utf-8"
    name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(name, name)
    try:
        return data.decode(name, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


RESULT = "markdown string, title string, warnings array<string>"


def html_to_markdown(html: Column, options: ConversionOptions = ConversionOptions()) -> Column:
    """struct(markdown, title, warnings) of a string column; null gives an empty text."""
    ship()

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([convert_html(x, options) for x in s], columns=["markdown", "title", "warnings"])

    return run(html)


def convert_pages(df: DataFrame, html_col: str = "html", options: ConversionOptions = ConversionOptions()) -> DataFrame:
    """``df`` with markdown, title and warnings instead of the markup."""
    out = df.withColumn("__r", html_to_markdown(F.col(html_col), options))
    return out.select(*[c for c in df.columns if c != html_col], "__r.markdown", "__r.title", "__r.warnings")
