"""Word documents to Markdown, from the OOXML package with the standard library.

A package becomes a list of blocks (text, list key or None); blocks are assembled by the rules that
``functions.markdown.join_blocks`` applies to tables of blocks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from itertools import groupby
from xml.etree import ElementTree as ET

from ..functions.markdown import IMAGE_EXTENSIONS
from ..functions.options import ConversionOptions
from .html import _collapse, _trim, _WS, escape_line

#: Fixed value: names of heading styles.
HEADING = re.compile(r"(?:heading|t[ií]?tulo|ttulo|titre|berschrift|überschrift)\s*([1-9])", re.I)
IMAGES_OFF = "The document has images that were left out; turn on extract_images and name an image_directory."
IMAGES_NOWHERE = "extract_images is on, but no image_directory is named; images were left out."
OLD_IMAGE = "An image in an old format (VML) was left out."


class ConversionError(ValueError):
    """The content can't be read as what it claims to be."""


def escape_inline(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>~])", r"\\\1", text)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for step in path:
        e = next((c for c in e if _name(c) == step), None) if e is not None else None
    return e


def _attr(e: ET.Element | None, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None) if e is not None else None


def _int(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


@dataclass(frozen=True)
class Piece:
    """Inline text with its format; ``kind`` is text, raw or break."""

    kind: str
    text: str = ""
    style: tuple[bool, bool, bool] = (False, False, False)
    link: str | None = None


@dataclass
class Docx:
    """What one conversion knows of its package."""

    package: zipfile.ZipFile
    options: ConversionOptions
    warnings: list[str] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)
    blocks: list[tuple[str, str | None]] = field(default_factory=list)
    images: list[tuple[str, bytes]] = field(default_factory=list)
    heading: str | None = None
    list_level: int = -1

    def __post_init__(self) -> None:
        main = next((t for t, kind in self.relations("").values() if kind.endswith("/officeDocument")), "word/document.xml")
        self.main = main.lstrip("/")
        self.links = self.relations(self.main)
        styles = self.part("styles")
        self.styles = {
            (_attr(s, "styleId") or "").lower(): s for s in reversed(styles if styles is not None else []) if _name(s) == "style"
        }
        self.formats = self._formats()

    # -- parts -----------------------------------------------------------------------------------
    def xml(self, path: str) -> ET.Element | None:
        try:
            return ET.fromstring(self.package.read(path))
        except KeyError:
            return None

    def relations(self, of: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (target, type); inner targets are package paths."""
        head, tail = posixpath.split(of)
        root = self.xml(posixpath.join(head, "_rels", f"{tail}.rels"))
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join("/" + head, target)).lstrip("/")
            out[r.get("Id")] = (target, r.get("Type", ""))
        return out

    def part(self, kind: str) -> ET.Element | None:
        path = next((t for t, k in self.links.values() if k.endswith("/" + kind)), None)
        return self.xml(path) if path else None

    def warn(self, message: str) -> None:
        if message not in self.warnings:
            self.warnings.append(message)

    # -- styles and numbering ----------------------------------------------------------------------
    def chain(self, style: str | None):
        """A style and what it is based on; a circle ends the walk.  Yields (id, element or None)."""
        seen = set()
        while style is not None and style.lower() not in seen:
            seen.add(style.lower())
            e = self.styles.get(style.lower())
            yield style, e
            if e is None:
                return
            style = _attr(_child(e, "basedOn"), "val")

    def heading_level(self, p: ET.Element) -> int:
        direct = _int(_attr(_child(p, "pPr", "outlineLvl"), "val"))
        if direct is not None and 0 <= direct <= 8:
            return direct + 1
        for name, e in self.chain(_attr(_child(p, "pPr", "pStyle"), "val") or None):
            outline = _int(_attr(_child(e, "pPr", "outlineLvl"), "val"))
            own = _attr(_child(e, "name"), "val")
            for level in (
                named_level(name), outline + 1 if outline is not None and 0 <= outline <= 8 else 0,
                named_level(own or "")
            ):
                if level:
                    return level
        return 0

    def list_of(self, p: ET.Element) -> tuple[int, int] | None:
        """(numbering id, level) of a list item; id 0 cancels."""
        own = _child(p, "pPr", "numPr")
        number, level = _int(_attr(_child(own, "numId"), "val")), _int(_attr(_child(own, "ilvl"), "val"))
        if number is None:
            for _, e in self.chain(_attr(_child(p, "pPr", "pStyle"), "val")):
                numbering = _child(e, "pPr", "numPr")
                number = _int(_attr(_child(numbering, "numId"), "val"))
                if number is not None:
                    level = level if level is not None else _int(_attr(_child(numbering, "ilvl"), "val"))
                    break
        return (number, max(level or 0, 0)) if number else None

    def _formats(self) -> dict[tuple[int, int], str]:
        """(numbering id, level) to number format: overrides before the abstract definition."""
        root, abstract, out = self.part("numbering"), {}, {}
        elements = list(root) if root is not None else []
        for a in elements:
            if _name(a) == "abstractNum":
                levels = abstract.setdefault(_attr(a, "abstractNumId"), {})
                for lv in a:
                    if _name(lv) == "lvl":
                        levels.setdefault(_int(_attr(lv, "ilvl")), _attr(_child(lv, "numFmt"), "val"))
        for n in elements:
            if _name(n) == "num":
                levels = dict(abstract.get(_attr(_child(n, "abstractNumId"), "val"), {}))
                for o in n:
                    lv = _child(o, "lvl") if _name(o) == "lvlOverride" else None
                    if lv is not None:
                        levels[_int(_attr(o, "ilvl"))] = _attr(_child(lv, "numFmt"), "val")
                for level, form in levels.items():
                    out.setdefault((_int(_attr(n, "numId")), level), form)
        return out

    # -- inline ------------------------------------------------------------------------------------
    def pieces(self, parent: ET.Element, link: str | None = None):
        for e in parent:
            name = _name(e)
            if name == "r":
                yield from self.run(e, link)
            elif name == "hyperlink":
                yield from self.pieces(e, self.links.get(_attr(e, "id"), (None, ""))[0] or link)
            elif name == "sdt":
                content = _child(e, "sdtContent")
                yield from self.pieces(content, link) if content is not None else ()
            elif name in {"ins", "fldSimple", "customXml"}:
                yield from self.pieces(e, link)

    def run(self, r: ET.Element, link: str | None):
        on = lambda e: e is not None and (_attr(e, "val") or "1").lower() not in {"0", "false", "off"}
        style = tuple(on(_child(r, "rPr", k)) for k in ("b", "i", "strike"))
        for e in r:
            name = _name(e)
            if name in {"t", "tab", "noBreakHyphen"}:
                text = e.text or "" if name == "t" else " " if name == "tab" else "-"
                if text:
                    yield Piece("text", text, style, link)
            elif name in {"br", "cr"}:
                yield Piece("break")
            elif name in {"footnoteReference", "endnoteReference"}:
                mark = self.note(name[:-9], _attr(e, "id"))
                if mark:
                    yield Piece("raw", mark, link=link)
            elif name == "drawing":
                image = self.image(e)
                if image:
                    yield Piece("raw", image, link=link)
            elif name == "pict":
                self.warn(OLD_IMAGE)

    def note(self, kind: str, number: str | None) -> str | None:
        root = self.part(kind + "s")
        found = next((n for n in root if _name(n) == kind and _attr(n, "id") == number), None) if root is not None else None
        text = _collapse(plain_text(found)) if found is not None else ""
        if not text:
            return None
        mark = f"[^{'E' if kind == 'endnote' else 'F'}{number}]"
        self.notes.setdefault(mark, escape_inline(text))
        return mark

    def image(self, drawing: ET.Element) -> str | None:
        about = next((e for e in drawing.iter() if _name(e) == "docPr"), None)
        alt = next((t for t in (_attr(about, "descr"), _attr(about, "name")) if t and _trim(t)), "imagen")
        if not self.options.extract_images:
            self.warn(IMAGES_OFF)
            return None
        if not self.options.image_directory:
            self.warn(IMAGES_NOWHERE)
            return None
        blip = next((e for e in drawing.iter() if _name(e) == "blip"), None)
        path, kind = self.links.get(_attr(blip, "embed"), (None, ""))
        if not path or not kind.endswith("/image") or path not in self.package.namelist():
            return None
        name = f"imagen-{len(self.images) + 1:03d}{IMAGE_EXTENSIONS.get(self.content_type(path).lower(), '.bin')}"
        self.images.append((name, self.package.read(path)))
        prefix = self.options.image_prefix
        return f"![{escape_inline(alt)}]({prefix.rstrip('/') + '/' if prefix else ''}{name})"

    def content_type(self, path: str) -> str:
        root = self.xml("[Content_Types].xml")
        rows = list(root) if root is not None else []
        own = next((e.get("ContentType") for e in rows if e.get("PartName", "").lower() == "/" + path.lower()), None)
        return own or next(
            (e.get("ContentType") for e in rows if e.get("Extension", "?").lower() == path.rpartition(".")[2].lower()),
            ""
        ) or ""

    def inline(self, p: ET.Element) -> str:
        """The paragraph's text: like neighbours merged, links opened and closed, marks outside of edge spaces."""
        out, open_link = [], None
        same = lambda x: (x[1].kind, x[1].style, x[1].link) if x[1].kind == "text" else x[0]
        for _, group in groupby(enumerate(self.pieces(p)), same):
            run = [x for _, x in group]
            first, text = run[0], "".join(x.text for x in run)
            link = open_link if first.kind == "break" else first.link
            if open_link is not None and link != open_link:
                out.append(closed(open_link))
                open_link = None
            if link is not None and open_link is None and first.kind != "break":
                out.append("[")
                open_link = link
            out.append(
                "  \n" if first.kind == "break" else text if first.kind == "raw" else emphasised(escape_inline(text), first.style)
            )
        return "".join(out) + (closed(open_link) if open_link is not None else "")

    # -- blocks ------------------------------------------------------------------------------------
    def walk(self, parent: ET.Element) -> None:
        for e in parent:
            name = _name(e)
            if name == "p":
                self.paragraph(e)
            elif name == "tbl":
                self.add(self.table(e))
            elif name == "sdt" and _child(e, "sdtContent") is not None:
                self.walk(_child(e, "sdtContent"))
            elif name == "customXml":
                self.walk(e)

    def add(self, text: str, key: str | None = None) -> None:
        if _trim(text):
            self.blocks.append((text.rstrip(_WS), key))

    def paragraph(self, p: ET.Element) -> None:
        text = self.inline(p)
        if not _trim(text):
            return
        level = self.heading_level(p)
        if level:
            self.heading = self.heading or _collapse(plain_text(p)) or None
            self.add("#" * min(level, 6) + " " + _collapse(text))
            return
        item = self.list_of(p)
        if item is None:
            self.add("\n".join(map(escape_line, _trim(text).split("\n"))))
            return
        number, depth = item
        if not self.blocks or self.blocks[-1][1] is None:
            self.list_level = -1
        self.list_level = min(depth, self.list_level + 1)
        ordered = self.formats.get((number, depth)) not in {None, "bullet", "none"}
        self.add(" " * 4 * self.list_level + ("1. " if ordered else "- ") + _collapse(text), f"num:{number}")

    def table(self, t: ET.Element) -> str:
        rows = []
        for row in content_of(t, "tr"):
            cells = []
            for cell in content_of(row, "tc"):
                parts = [x for x in (self.inline(p) for p in cell.iter() if _name(p) == "p") if _trim(x)]
                text = re.sub("\r\n|\r|\n", "<br>", "<br>".join(parts)).replace("|", "\\|")
                span = _int(_attr(_child(cell, "tcPr", "gridSpan"), "val")) or 1
                cells += [_trim(text), *[""] * (span - 1)]
            if cells:
                rows.append(cells)
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = ["|" + "".join(f" {c or ' '} |" for c in r + [""] * (width - len(r))) for r in rows]
        return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def named_level(name: str) -> int:
    if name.lower() in {"title", "subtitle"}:
        return 1 if name.lower() == "title" else 2
    m = HEADING.fullmatch(name.strip())
    return int(m[1]) if m else 0


def plain_text(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _name(t) == "t")


def content_of(e: ET.Element, name: str):
    """Children of a name, also inside content controls."""
    for c in e:
        if _name(c) == name:
            yield c
        elif _name(c) == "sdt" and _child(c, "sdtContent") is not None:
            yield from (x for x in _child(c, "sdtContent") if _name(x) == name)


def closed(url: str) -> str:
    return f"](<{url}>)" if re.search("[ ()]", url) else f"]({url})"


def emphasised(text: str, style: tuple[bool, bool, bool]) -> str:
    core = _trim(text)
    if not any(style) or not core:
        return text
    start = text.index(core)
    marks = [m for m, on in zip(("**", "*", "~~"), style) if on]
    return text[:start] + "".join(marks) + core + "".join(reversed(marks)) + text[start + len(core) :]


def join(blocks: list[tuple[str, str | None]]) -> str:
    out, before = [], None
    for k, (text, key) in enumerate(blocks):
        if k:
            out.append("\n\n" if key is None or before is None else "\n" if key == before else "\n\n<!-- -->\n\n")
        out.append(text)
        before = key
    return "".join(out) + "\n" if out else ""


def read_docx(content: bytes, options: ConversionOptions = ConversionOptions()) -> Docx:
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        doc = Docx(package, options)
        root = doc.xml(doc.main)
    except (zipfile.BadZipFile, ET.ParseError, OSError, EOFError, RuntimeError, NotImplementedError) as e:
        raise ConversionError(f"not a readable .docx package: {e}") from e
    body = _child(root, "body")
    if body is None:
        raise ConversionError("the .docx package has no document body")
    doc.walk(body)
    for mark, text in doc.notes.items():
        doc.add(f"{mark}: {text}")
    return doc


def convert_docx(content: bytes, options: ConversionOptions = ConversionOptions()) -> tuple[str, str | None, list[str]]:
    """Markdown, title (of the package, else the first heading) and warnings."""
    doc = read_docx(content, options)
    core = doc.xml("docProps/core.xml")
    title = next((e.text for e in core if _name(e) == "title" and e.text and _trim(e.text)), None) if core is not None else None
    return join(doc.blocks), title or doc.heading, doc.warnings
