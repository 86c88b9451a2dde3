"""Edits of packages: statements (op and arguments) applied document by document.

Tree rewrites are not relational, so a document's entries and its statements meet in one task
(``apply``: one co-group by doc_id, documents in parallel); all that is found, planned or compared
before and after is relational. A document's statements all take effect or none does: the first
that fails leaves its entries as they were, with the reason in ``error``.

Paragraph indexes count direct children of a section that hold no section property; tables are
counted at any depth; cells are addressed by logical row and column, through merges.
"""

from __future__ import annotations

import base64
import copy
import json
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache
from io import BytesIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: namespaces, units, defaults.
PARAGRAPH = "http://www.hancom.co.kr/hwpml/2011/paragraph"
HEAD = "http://www.hancom.co.kr/hwpml/2011/head"
CORE = "http://www.hancom.co.kr/hwpml/2011/core"
TABLE_WIDTH, ROW_HEIGHT, PAGE_WIDTH, IMAGE_WIDTH = 42520, 2400, 42520, 22677
GUIDE_MARK = "※"
OUTLINE = re.compile(r"^(?:heading|개요)\s*(\d+)")
PAGE_MARKS = re.compile(r"(\{\{PAGE\}\}|\{\{TOTAL_PAGE\}\})")
HISTORY = "Contents/history.xml"

OPS: dict[str, Callable] = {}


def op(name: str):
    def add(f):
        OPS[name] = f
        return f

    return add


class EditError(ValueError):
    """A statement that can't be applied."""


def need(ok: object, message: str) -> None:
    if not ok:
        raise EditError(message)


@lru_cache(4096)
def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def local(e: ET.Element) -> str:
    return _local(e.tag)


def kids(e: ET.Element, tag: str) -> list[ET.Element]:
    return [x for x in e if _local(x.tag) == tag]


def kid(e: ET.Element, tag: str) -> ET.Element | None:
    for x in e:
        if _local(x.tag) == tag:
            return x
    return None


def within(e: ET.Element, *tags: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x.tag) in tags)


def units(mm: float) -> int:
    return int(mm * 7200.0 / 25.4 + 0.5) if mm > 0 else 0


def shares(total: int, n: int) -> list[int]:
    return [total // n] * (n - 1) + [total // n + total % n]


def number(value: str | None, default: int = 0) -> int:
    if value is None:  # as of most attributes asked for
        return default
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


XML_SPACE = "http://www.w3.org/XML/1998/namespace"


def written(root: ET.Element) -> bytes:
    """A part as ElementTree writes it in UTF-8, in half the time: names are made once each.

    ElementTree itself chooses the prefixes, from an element that has all the names in their order.
    """
    tags, keys, sample = set(), set(), ET.Element(root.tag)
    for e in root.iter():
        if not isinstance(e.tag, str):  # a comment or an instruction
            return ET.tostring(root, "utf-8", xml_declaration=True)
        if e.tag not in tags:
            tags.add(e.tag)
            ET.SubElement(sample, e.tag)
        for k in e.keys():
            if k not in keys:
                keys.add(k)
                ET.SubElement(sample, root.tag, {k: ""})
    prefixes = {uri: prefix for _, (prefix, uri) in ET.iterparse(BytesIO(ET.tostring(sample)), ["start-ns"])} | {XML_SPACE: "xml"}

    def short(name: str) -> str:
        uri, _, rest = name[1:].rpartition("}")
        return f"{prefixes[uri]}:{rest}" if uri else name

    starts, names = {t: f"<{short(t)}" for t in tags}, {k: f' {short(k)}="' for k in keys}
    spaces = "".join(f' xmlns:{p}="{_quoted(u)}"' for u, p in sorted(prefixes.items(), key=lambda x: x[1]) if u != XML_SPACE)
    out = ["<?xml version='1.0' encoding='utf-8'?>\n"]

    def put_down(e: ET.Element, more: str = "") -> None:
        start = starts[e.tag]
        said = "".join([f'{names[k]}{_quoted(v)}"' for k, v in e.items()])
        if e.text or len(e):
            out.append(f"{start}{more}{said}>{_escaped(e.text) if e.text else ''}")
            for x in e:
                put_down(x)
            out.append(f"</{start[1:]}>")
        else:
            out.append(f"{start}{more}{said} />")
        if e.tail:
            out.append(_escaped(e.tail))

    put_down(root, spaces)
    return "".join(out).encode("utf-8", "xmlcharrefreplace")


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(text: str) -> str:
    if text.isalnum():
        return text
    return _escaped(text).replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;")


class Book:
    """One document's entries; parts are parsed when needed and written back if changed."""

    def __init__(self, entries: dict[str, bytes]):
        self.entries, self.roots = dict(entries), {}
        self.grids: dict[tuple, dict] = {}  # of tables, while statements only fill cells

    def root(self, path: str) -> ET.Element:
        if path not in self.roots:
            need(path in self.entries, f"no such part: {path}")
            parsed = ET.iterparse(BytesIO(self.entries[path]), ["start-ns"])
            for _, (prefix, uri) in parsed:
                if prefix and not re.fullmatch(r"ns\d+", prefix):
                    ET.register_namespace(prefix, uri)
            self.roots[path] = parsed.root
        return self.roots[path]

    def saved(self) -> dict[str, bytes]:
        return self.entries | {p: written(r) for p, r in self.roots.items() if p in self.entries}

    @property
    def content(self) -> ET.Element:
        return self.root("Contents/content.hpf")

    @property
    def head(self) -> ET.Element:
        return self.root("Contents/header.xml")

    def part(self, tag: str) -> ET.Element:
        found = next(within(self.content, tag), None)
        return found if found is not None else add(self.content, tag)

    def path_of(self, href: str) -> str:
        href = href.lstrip("/")
        under = f"Contents/{href}"
        if href in self.entries or href.startswith(("Contents/", "BinData/")):
            return href
        return under if under in self.entries else href

    def sections(self) -> list[str]:
        items = {i.get("id"): self.path_of(i.get("href", "")) for i in within(self.content, "item")}
        named = [items.get(r.get("idref"), "") for r in within(self.content, "itemref")]
        return [p for p in named if re.search(r"(^|/)section[^/]*\.xml$", p)]

    def section(self, at: int | str | None) -> ET.Element:
        if isinstance(at, str):
            return self.root(at)
        paths = self.sections()
        need(0 <= (at or 0) < len(paths), f"no section {at or 0}")
        return self.root(paths[at or 0])

    def targets(self, section: int | None, every: bool) -> list[ET.Element]:
        need(section is None or not every, "one section or all sections, not both")
        return [self.section(p) for p in self.sections()] if every else [self.section(section)]

    def list_of(self, tag: str) -> ET.Element:
        """A list of the header (charProperties and the like), made if missing."""
        lists = kid(self.head, "refList")
        lists = lists if lists is not None else add(self.head, "refList")
        found = next(within(self.head, tag), None)
        return found if found is not None else add(lists, tag, itemCnt="0")

    def cloned(self, tag: str, item: str, base: str, change: Callable[[ET.Element], None]) -> str:
        """A copy of a style under a new id, always a new one, with change applied to it."""
        styles = self.list_of(tag)
        known = kids(styles, item)
        found = next((s for s in known if s.get("id") == base), None)
        new = copy.deepcopy(found) if found is not None else ET.Element(f"{{{space(styles)}}}{item}")
        new.set("id", str(max([number(s.get("id")) for s in known], default=-1) + 1))
        change(new)
        styles.append(new)
        styles.set("itemCnt", str(len(known) + 1))
        return new.get("id")


def space(e: ET.Element) -> str:
    return e.tag[1:].split("}")[0] if e.tag.startswith("{") else ""


def make(ns: str, tag: str, text: str | None = None, **attrs: object) -> ET.Element:
    e = ET.Element(f"{{{ns}}}{tag}" if ns else tag, {k: str(v) for k, v in attrs.items()})
    e.text = text
    return e


def add(parent: ET.Element, tag: str, text: str | None = None, ns: str | None = None, **attrs: object) -> ET.Element:
    e = make(space(parent) if ns is None else ns, tag, text, **attrs)
    parent.append(e)
    return e


def words_space(root: ET.Element) -> str:
    """The namespace of a section's paragraphs."""
    return next((space(p) for p in within(root, "p")), PARAGRAPH)


def next_id(root: ET.Element) -> int:
    return max([number(e.get("id")) for e in root.iter()], default=0) + 1


def paragraph(root: ET.Element, text: str = "", style: dict[str, str] | None = None) -> ET.Element:
    style = style or {}
    ns = words_space(root)
    p = make(ns, "p", id=next_id(root), paraPrIDRef=style.get("para", "0"), styleIDRef=style.get("id", "0"), pageBreak="0", columnBreak="0", merged="0")
    write(add(p, "run", charPrIDRef=style.get("char", "0")), text)
    return p


def write(run: ET.Element, text: str) -> None:
    """A run's text in t elements, with breaks and tabs between them."""
    for i, line in enumerate(text.split("\n")):
        if i:
            add(run, "lineBreak")
        for j, bit in enumerate(line.split("\t")):
            if j:
                add(run, "tab")
            if bit or not (i or j):
                add(run, "t", bit or None)


def has_section_property(p: ET.Element) -> bool:
    return any(kid(r, "secPr") is not None for r in kids(p, "run"))


def body(root: ET.Element) -> list[ET.Element]:
    return [p for p in kids(root, "p") if not has_section_property(p)]


def pick(items: list, at: int, what: str):
    need(0 <= at < len(items), f"no {what} {at}")
    return items[at]


def replace_text(p: ET.Element, text: str) -> None:
    """In place if there is one run of text and no line break, else one run that keeps the first one's style."""
    runs = kids(p, "run")
    text = re.sub("\r\n?", "\n", text)
    if len(runs) == 1 and "\n" not in text and len(kids(runs[0], "t")) == len(runs[0]) <= 1:
        t = kid(runs[0], "t")
        (t if t is not None else add(runs[0], "t")).text = text or None
        return
    ref = runs[0].get("charPrIDRef", "0") if runs else "0"
    for r in runs:
        p.remove(r)
    for e in kids(p, "linesegarray"):
        p.remove(e)
    run = make(space(p), "run", charPrIDRef=ref)
    p.insert(0, run)
    write(run, text)


def plain(e: ET.Element) -> str:
    return "".join(x.text or "" if local(x) == "t" else "\n" if local(x) == "lineBreak" else "\t" for x in within(e, "t", "lineBreak", "tab"))


# --- paragraphs and runs


@op("append-text")
def append_text(book: Book, texts: list[str], section: int | None = None) -> None:
    root = book.section(section)
    for text in texts:
        root.append(paragraph(root, text))


@op("set-paragraph-text")
def set_paragraph_text(book: Book, index: int, text: str, section: int | None = None) -> None:
    replace_text(pick(body(book.section(section)), index, "paragraph"), text)


@op("delete-paragraph")
def delete_paragraph(book: Book, index: int, section: int | None = None) -> None:
    root = book.section(section)
    root.remove(pick(body(root), index, "paragraph"))


@op("add-run-text")
def add_run_text(book: Book, index: int, text: str, run: int | None = None, section: int | None = None) -> None:
    p = pick(body(book.section(section)), index, "paragraph")
    runs = kids(p, "run")
    at = len(runs) if run is None else run
    need(0 <= at <= len(runs), f"no run {at}")
    new = make(space(p), "run", charPrIDRef=runs[max(0, at - 1)].get("charPrIDRef", "0") if runs else "0")
    write(new, text)
    p.insert(list(p).index(runs[at]) if at < len(runs) else (list(p).index(runs[-1]) + 1 if runs else 0), new)


@op("set-run-text")
def set_run_text(book: Book, index: int, run: int, text: str, section: int | None = None) -> None:
    r = pick(kids(pick(body(book.section(section)), index, "paragraph"), "run"), run, "run")
    for e in [x for x in r if local(x) in ("t", "lineBreak", "tab")]:
        r.remove(e)
    write(r, text)


def style_of(book: Book, run: ET.Element) -> dict:
    """The character properties of a run; an unknown reference has the defaults."""
    pr = next((c for c in within(book.list_of("charProperties"), "charPr") if c.get("id") == (run.get("charPrIDRef") or "0")), None)
    if pr is None:
        return {"bold": False, "italic": False, "underline": False, "color": "#000000", "font": "", "size_pt": 10.0}
    line, ref = kid(pr, "underline"), kid(pr, "fontRef")
    fonts = {f.get("id"): f.get("face", "") for face in within(book.head, "fontface") if face.get("lang", "").upper() == "HANGUL" for f in kids(face, "font")}
    wanted = (ref.get("hangul") or ref.get("latin")) if ref is not None else None
    return {
        "bold": kid(pr, "bold") is not None, "italic": kid(pr, "italic") is not None, "underline": line is not None and line.get("type", "").upper() != "NONE",
        "color": pr.get("textColor", "#000000").upper(), "font": fonts.get(wanted, ""), "size_pt": number(pr.get("height"), 1000) / 100,
    }


@op("replace-runs-by-style")
def replace_runs_by_style(book: Book, where: dict, text: str, section: int | None = None, every: bool = False) -> None:
    need(where, "at least one condition is needed")
    same = lambda k, a, b: abs(a - b) < 0.01 if k == "size_pt" else a.lower() == b.lower() if isinstance(a, str) else a == b
    for root in book.targets(section, every):
        for p in body(root):
            for r in kids(p, "run"):
                now = style_of(book, r)
                if all(same(k, now[k], v) for k, v in where.items()):
                    for e in [x for x in r if local(x) in ("t", "lineBreak", "tab")]:
                        r.remove(e)
                    write(r, text)


def char_change(book: Book, style: dict) -> Callable[[ET.Element], None]:
    need(style, "at least one style option is needed")

    def change(pr: ET.Element) -> None:
        for flag in ("bold", "italic"):
            if flag in style:
                for e in kids(pr, flag):
                    pr.remove(e)
                if style[flag]:
                    add(pr, flag)
        if "underline" in style:
            line = kid(pr, "underline")
            line = line if line is not None else add(pr, "underline", shape="SOLID", color="#000000")
            line.set("type", "BOTTOM" if style["underline"] else "NONE")
        if "color" in style:
            pr.set("textColor", style["color"].upper())
        if "size_pt" in style:
            pr.set("height", str(round(style["size_pt"] * 100)))
        if "font" in style:
            faces = book.list_of("fontfaces")
            face = next((f for f in kids(faces, "fontface") if f.get("lang") == "HANGUL"), None)
            face = face if face is not None else add(faces, "fontface", lang="HANGUL")
            known = kids(face, "font")
            font = next((f for f in known if f.get("face") == style["font"]), None)
            font = font if font is not None else add(face, "font", id=max([number(f.get("id")) for f in known], default=-1) + 1, face=style["font"], type="TTF")
            face.set("fontCnt", str(len(kids(face, "font"))))
            ref = kid(pr, "fontRef")
            (ref if ref is not None else add(pr, "fontRef")).set("hangul", font.get("id"))

    return change


def restyle(book: Book, runs: list[ET.Element], style: dict) -> None:
    """One new character style for each distinct one that the runs have."""
    new: dict[str, str] = {}
    for r in runs:
        base = r.get("charPrIDRef", "0")
        if base not in new:
            new[base] = book.cloned("charProperties", "charPr", base, char_change(book, style))
        r.set("charPrIDRef", new[base])


@op("set-text-style")
def set_text_style(book: Book, index: int, style: dict, run: int | None = None, section: int | None = None) -> None:
    runs = kids(pick(body(book.section(section)), index, "paragraph"), "run")
    restyle(book, runs if run is None else [pick(runs, run, "run")], style)


def para_change(layout: dict) -> Callable[[ET.Element], None]:
    need(layout, "at least one layout option is needed")

    def change(pr: ET.Element) -> None:
        if "align" in layout:
            align = kid(pr, "align")
            (align if align is not None else add(pr, "align", vertical="BASELINE")).set("horizontal", layout["align"].upper())
        sides = {"indent_mm": "intent", "left_mm": "left", "right_mm": "right", "before_mm": "prev", "after_mm": "next"}
        if any(k in layout for k in sides):
            margin = next(within(pr, "margin"), None)
            margin = margin if margin is not None else add(pr, "margin")
            for k in (k for k in sides if k in layout):
                side = kid(margin, sides[k])
                side = side if side is not None else add(margin, sides[k], ns=CORE, unit="HWPUNIT")
                side.set("value", str(units(layout[k]) if layout[k] >= 0 else -units(-layout[k])))
        if "line_percent" in layout:
            spacing = next(within(pr, "lineSpacing"), None)
            spacing = spacing if spacing is not None else add(pr, "lineSpacing", unit="HWPUNIT")
            spacing.set("type", "PERCENT")
            spacing.set("value", str(layout["line_percent"]))

    return change


def relayout(book: Book, ps: list[ET.Element], change: Callable[[ET.Element], None]) -> None:
    new: dict[str, str] = {}
    for p in ps:
        base = p.get("paraPrIDRef", "0")
        if base not in new:
            new[base] = book.cloned("paraProperties", "paraPr", base, change)
        p.set("paraPrIDRef", new[base])


@op("set-paragraph-layout")
def set_paragraph_layout(book: Book, index: int, layout: dict, section: int | None = None) -> None:
    relayout(book, [pick(body(book.section(section)), index, "paragraph")], para_change(layout))


@op("set-paragraph-list")
def set_paragraph_list(book: Book, index: int, kind: str, level: int = 0, start: int | None = None, section: int | None = None) -> None:
    kind = kind.upper()
    need(kind in ("BULLET", "NUMBER", "NONE"), f"unknown list kind {kind}")
    need(start is None or kind != "BULLET", "a bullet list has no start number")
    ref = "0"
    if kind != "NONE":
        tag, item = ("bullets", "bullet") if kind == "BULLET" else ("numberings", "numbering")
        lists = book.list_of(tag)
        found = None if start is not None else next(iter(kids(lists, item)), None)
        if found is None:
            found = add(lists, item, id=max([number(x.get("id")) for x in kids(lists, item)], default=0) + 1, **({"char": "•"} if kind == "BULLET" else {"start": start or 1}))
            for n in range(1, 8 if kind == "NUMBER" else 2):
                add(found, "paraHead", f"^{n}." if kind == "NUMBER" else None, level=n, start=start or 1, align="LEFT", numFormat="DIGIT")
        ref = found.get("id")

    def change(pr: ET.Element) -> None:
        heading = kid(pr, "heading")
        heading = heading if heading is not None else add(pr, "heading")
        for k, v in (("type", kind), ("idRef", ref), ("level", level)):
            heading.set(k, str(v))

    relayout(book, [pick(body(book.section(section)), index, "paragraph")], change)


# --- sections


@op("add-section")
def add_section(book: Book, texts: list[str] | None = None) -> None:
    n = len(book.sections())
    first = book.section(0)
    root = ET.Element(first.tag, dict(first.attrib))
    for text in texts or [""]:
        root.append(paragraph(first, text))
    for i, p in enumerate(root):
        p.set("id", str(i + 1))
    path, used = n, {i.get("id") for i in within(book.content, "item")}
    while f"Contents/section{path}.xml" in book.entries or f"section{path}" in used:
        path += 1
    book.entries[f"Contents/section{path}.xml"], book.roots[f"Contents/section{path}.xml"] = b"", root
    add(book.part("manifest"), "item", **{"id": f"section{path}", "href": f"Contents/section{path}.xml", "media-type": "application/xml"})
    add(book.part("spine"), "itemref", idref=f"section{path}", linear="yes")
    renumber_sections(book)


@op("delete-section")
def delete_section(book: Book, section: int) -> None:
    paths = book.sections()
    need(len(paths) > 1, "the last section stays")
    path = pick(paths, section, "section")
    for item in [i for i in within(book.content, "item") if book.path_of(i.get("href", "")) == path]:
        for ref in [r for r in within(book.content, "itemref") if r.get("idref") == item.get("id")]:
            book.part("spine").remove(ref)
        book.part("manifest").remove(item)
    book.entries.pop(path)
    book.roots.pop(path, None)
    renumber_sections(book)


@op("renumber-sections")
def renumber_sections(book: Book) -> None:
    """Paths, manifest and spine ids in spine order; the declared count."""
    paths = book.sections()
    held = [(book.entries.pop(p), book.roots.pop(p, None)) for p in paths]
    items = {book.path_of(i.get("href", "")): i for i in within(book.content, "item")}
    refs = [r for r in within(book.content, "itemref")]
    for n, (path, (raw, root)) in enumerate(zip(paths, held, strict=True)):
        new, item = f"Contents/section{n}.xml", next(i for i in within(book.content, "item") if i is items.get(path) or i.get("href", "").lstrip("/") in (path, path.removeprefix("Contents/")))
        for r in refs:
            if r.get("idref") == item.get("id"):
                r.set("idref", f"\0section{n}")
        item.set("id", f"\0section{n}")
        item.set("href", f"\0{new}")
        book.entries[new] = raw
        if root is not None:
            book.roots[new] = root
    for e in book.content.iter():
        for k, v in e.attrib.items():
            if v.startswith("\0"):
                e.set(k, v[1:])
    book.head.set("secCnt", str(len(paths)))


# --- tables


def tables(root: ET.Element) -> list[ET.Element]:
    return list(within(root, "tbl"))


def rows_of(table: ET.Element) -> list[ET.Element]:
    return kids(table, "tr")


def cells_of(table: ET.Element) -> list[ET.Element]:
    return [c for r in rows_of(table) for c in kids(r, "tc")]


def address(cell: ET.Element) -> tuple[int, int, int, int]:
    """row, column, row span, column span."""
    at = by = None
    for x in cell:  # asked of every cell of a table, so both are found in one pass
        name = _local(x.tag)
        if name == "cellAddr":
            at = x if at is None else at
        elif name == "cellSpan":
            by = x if by is None else by
    row, col = (number(at.get("rowAddr")), number(at.get("colAddr"))) if at is not None else (0, 0)
    rows, cols = (number(by.get("rowSpan"), 1), number(by.get("colSpan"), 1)) if by is not None else (1, 1)
    return row, col, max(1, rows), max(1, cols)


def extent(cell: ET.Element) -> tuple[int, int]:
    e = kid(cell, "cellSz")
    return (number(e.get("width")), number(e.get("height"))) if e is not None else (0, 0)


def put(cell: ET.Element, tag: str, **attrs: object) -> None:
    e = kid(cell, tag)
    e = e if e is not None else add(cell, tag)
    for k, v in attrs.items():
        e.set(k, str(v))


def dead(cell: ET.Element) -> bool:
    return extent(cell) == (0, 0) and address(cell)[2:] == (1, 1) and not plain(cell).strip()


def grid_of(table: ET.Element) -> dict[tuple[int, int], ET.Element]:
    out: dict[tuple[int, int], ET.Element] = {}
    for c in cells_of(table):
        claim(out, c)
    return out


def claim(grid: dict[tuple[int, int], ET.Element], cell: ET.Element) -> None:
    """The places of a cell that comes after those of the grid."""
    r, k, rs, cs = address(cell)
    if rs == cs == 1 and (r, k) not in grid:
        grid[r, k] = cell
        return
    for at in ((i, j) for i in range(r, r + rs) for j in range(k, k + cs)):
        if at not in grid or dead(grid[at]):
            grid[at] = cell
        else:
            need(dead(cell), f"cells overlap at {at}")


def cell_at(book: Book, table: int, row: int, col: int, section: int | str | None) -> ET.Element:
    grid = grid_of(pick(tables(book.section(section)), table, "table"))
    need((row, col) in grid, f"no cell ({row}, {col})")
    return grid[row, col]


def paragraphs_of(cell: ET.Element) -> list[ET.Element]:
    sub = kid(cell, "subList")
    return kids(sub, "p") if sub is not None else []


def fill_cell(root: ET.Element, cell: ET.Element, texts: list[str]) -> None:
    """The cell's paragraphs, the first one's style kept."""
    sub = kid(cell, "subList")
    sub = sub if sub is not None else add(cell, "subList", textDirection="HORIZONTAL", lineWrap="BREAK", vertAlign="CENTER")
    old = kids(sub, "p")
    if len(old) == 1 and len(texts) == 1:
        replace_text(old[0], texts[0])
        return
    style = {"para": old[0].get("paraPrIDRef", "0"), "id": old[0].get("styleIDRef", "0"), "char": next((r.get("charPrIDRef", "0") for r in kids(old[0], "run")), "0")} if old else {}
    for p in old:
        sub.remove(p)
    for text in texts:
        sub.append(paragraph(root, text, style))


def new_cell(root: ET.Element, row: int, col: int, width: int, height: int, text: str) -> ET.Element:
    cell = make(words_space(root), "tc", name="", header="0", hasMargin="0", protect="0", editable="0", dirty="1", borderFillIDRef="3")
    add(cell, "subList", id="", textDirection="HORIZONTAL", lineWrap="BREAK", vertAlign="CENTER").append(paragraph(root, text))
    add(cell, "cellAddr", colAddr=col, rowAddr=row)
    add(cell, "cellSpan", colSpan=1, rowSpan=1)
    add(cell, "cellSz", width=width, height=height)
    return cell


def sizes(n: int, each: list[float] | None, total_mm: float | None, default: int, what: str) -> list[int]:
    """Column widths or row heights in units; a given total must match the given parts within rounding."""
    if each:
        need(len(each) == n, f"{what} count must match")
        out = [units(x) for x in each]
        need(min(out) > 0, f"{what}s must be positive")
        need(total_mm is None or abs(units(total_mm) - sum(out)) <= n, f"the total must match the summed {what}s")
        return out
    need(total_mm is None or units(total_mm) > 0, f"total of {what}s must be positive")
    return shares(units(total_mm) if total_mm is not None else default, n)


def new_table(root: ET.Element, rows: int, cols: int, cells: list[list[str]] | None, widths: list[int], heights: list[int]) -> ET.Element:
    need(rows > 0 and cols > 0, "a table has rows and columns")
    table = make(words_space(root), "tbl", id=next_id(root), zOrder="0", numberingType="TABLE", textWrap="TOP_AND_BOTTOM", pageBreak="CELL", repeatHeader="0", rowCnt=rows, colCnt=cols, cellSpacing="0", borderFillIDRef="3", noAdjust="0")
    add(table, "sz", width=sum(widths), widthRelTo="ABSOLUTE", height=sum(heights), heightRelTo="ABSOLUTE", protect="0")
    add(table, "pos", treatAsChar="1", vertRelTo="PARA", horzRelTo="COLUMN", vertAlign="TOP", horzAlign="LEFT", vertOffset="0", horzOffset="0")
    for r in range(rows):
        line = add(table, "tr")
        for c in range(cols):
            line.append(new_cell(root, r, c, widths[c], heights[r], (cells or [])[r][c] if r < len(cells or []) and c < len(cells[r]) else ""))
    return table


def matrix(text: str) -> list[list[str]]:
    """``a,b;c,d``"""
    return [[c.strip() for c in r.split(",")] for r in text.split(";")]


@op("add-table")
def add_table(book: Book, rows: int, cols: int, cells: list[list[str]] | str | None = None, width_mm: float | None = None, height_mm: float | None = None, widths_mm: list[float] | None = None, heights_mm: list[float] | None = None, section: int | None = None) -> None:
    root = book.section(section)
    need(rows > 0 and cols > 0, "a table has rows and columns")
    p = paragraph(root)
    run = kid(p, "run")
    run.clear()
    run.set("charPrIDRef", "0")
    cells = matrix(cells) if isinstance(cells, str) else cells
    run.append(new_table(root, rows, cols, cells, sizes(cols, widths_mm, width_mm, TABLE_WIDTH, "column width"), sizes(rows, heights_mm, height_mm, ROW_HEIGHT * rows, "row height")))
    root.append(p)


@op("add-nested-table")
def add_nested_table(book: Book, table: int, row: int, col: int, rows: int, cols: int, cells: list[list[str]] | str | None = None, section: int | None = None) -> None:
    root, cell = book.section(section), cell_at(book, table, row, col, section)
    sub = kid(cell, "subList")
    sub = sub if sub is not None else add(cell, "subList")
    p = paragraph(root)
    run = kid(p, "run")
    run.clear()
    run.set("charPrIDRef", "0")
    cells = matrix(cells) if isinstance(cells, str) else cells
    run.append(new_table(root, rows, cols, cells, shares(extent(cell)[0] or TABLE_WIDTH, cols), [ROW_HEIGHT] * rows))
    sub.append(p)


@op("set-table-cell")
def set_table_cell(book: Book, table: int, row: int, col: int, text: str | None = None, texts: list[str] | None = None, style: dict | None = None, align: str | None = None, border: dict | None = None, section: int | str | None = None) -> None:
    need(any(x is not None for x in (text, texts, style, align, border)), "nothing to set")
    root, cell = book.section(section), cell_at(book, table, row, col, section)
    if texts is not None or text is not None:
        fill_cell(root, cell, texts if texts is not None else re.sub("\r\n?", "\n", text).split("\n"))
    if style:
        restyle(book, [r for p in paragraphs_of(cell) for r in kids(p, "run")], style)
    if align:
        put(cell, "subList", vertAlign=align.upper())
    if border:
        cell.set("borderFillIDRef", bordered(book, base_of(book, cell), border))


@op("set-table-cell-layout")
def set_table_cell_layout(book: Book, table: int, row: int, col: int, layout: dict, paragraph: int | None = None, section: int | None = None) -> None:
    ps = paragraphs_of(cell_at(book, table, row, col, section))
    relayout(book, ps if paragraph is None else [pick(ps, paragraph, "paragraph")], para_change(layout))


@op("set-table-cell-text-style")
def set_table_cell_text_style(book: Book, table: int, row: int, col: int, style: dict, paragraph: int | None = None, run: int | None = None, section: int | None = None) -> None:
    ps = paragraphs_of(cell_at(book, table, row, col, section))
    runs = [r for p in (ps if paragraph is None else [pick(ps, paragraph, "paragraph")]) for r in kids(p, "run")]
    restyle(book, runs if run is None else [pick(runs, run, "run")], style)


SIDES = ("left", "right", "top", "bottom")
#: How strong a line of a kind is beside its width.
STRENGTH = {"DOUBLE_SLIM": 30, "SOLID": 20, "DASH": 10}


def border_fill(book: Book, cell: ET.Element) -> ET.Element | None:
    """The cell's border fill, or the one of id 3 if it names none that is there."""
    known = {b.get("id"): b for b in reversed(kids(book.list_of("borderFills"), "borderFill"))}
    return known.get(cell.get("borderFillIDRef", "").strip() or "3", known.get("3"))


def base_of(book: Book, cell: ET.Element) -> str:
    fill = border_fill(book, cell)
    return fill.get("id") if fill is not None else "3"


def line_of(book: Book, cell: ET.Element, side: str) -> dict[str, str]:
    fill = border_fill(book, cell)
    e = kid(fill, f"{side}Border") if fill is not None else None
    return dict(e.attrib) if e is not None else {"type": "NONE", "width": "0.1 mm", "color": "#000000"}


def strength(line: dict[str, str]) -> tuple[bool, int]:
    """Visible lines before others, then a hundred times the width and the kind's rank."""
    kind = line.get("type", "NONE").upper()
    width = re.match(r"\s*([\d.]+)", line.get("width", "0"))
    return kind not in ("", "NONE"), round(float(width.group(1)) * 100 if width else 0) + STRENGTH.get(kind, 5)


def bordered(book: Book, base: str, lines: dict[str, dict], fill: str | None = None) -> str:
    def change(e: ET.Element) -> None:
        for side, attrs in lines.items():
            put(e, f"{side}Border", **attrs)
        if fill:
            brush = kid(e, "fillBrush")
            brush = brush if brush is not None else add(e, "fillBrush", ns=CORE)
            put(brush, "winBrush", faceColor=fill)

    return book.cloned("borderFills", "borderFill", base, change)


def fill_of(book: Book, cell: ET.Element) -> str | None:
    fill = border_fill(book, cell)
    color = next((w.get("faceColor", "").strip().upper() for w in within(fill, "winBrush")), None) if fill is not None else None
    return None if color in (None, "", "NONE") else color


@op("merge-table-cells")
def merge_table_cells(book: Book, table: int, row: int, col: int, row_to: int, col_to: int, section: int | None = None) -> None:
    """All cells must lie inside; covered ones become single, empty and of no size; the perimeter keeps its strongest lines."""
    root = book.section(section)
    t = pick(tables(root), table, "table")
    grid = grid_of(t)
    need(row_to >= row and col_to >= col, "a rectangle is needed")
    places = [(r, c) for r in range(row, row_to + 1) for c in range(col, col_to + 1)]
    need(all(at in grid for at in places), "the rectangle leaves the table")
    inside = list(dict.fromkeys(id(grid[at]) for at in places))
    by_id = {id(grid[at]): grid[at] for at in places}
    for c in by_id.values():
        r, k, rs, cs = address(c)
        need(row <= r and r + rs - 1 <= row_to and col <= k and k + cs - 1 <= col_to, "a merged cell crosses the rectangle")
    anchor = grid[row, col]
    distinct = lambda edge: {id(grid[at]): grid[at] for at in edge}.values()
    top, left = [(row, c) for c in range(col, col_to + 1)], [(r, col) for r in range(row, row_to + 1)]
    bottom, right = [(row_to, c) for c in range(col, col_to + 1)], [(r, col_to) for r in range(row, row_to + 1)]
    width, height = sum(extent(c)[0] for c in distinct(top)) or extent(anchor)[0], sum(extent(c)[1] for c in distinct(left)) or extent(anchor)[1]
    lines = {side: max((line_of(book, c, side) for c in distinct(edge)), key=strength) for side, edge in (("top", top), ("left", left), ("bottom", bottom), ("right", right))}
    lines = {side: line for side, line in lines.items() if strength(line)[0]}
    fill = fill_of(book, anchor) or next((f for f in (fill_of(book, by_id[i]) for i in inside) if f), None)
    anchor.set("borderFillIDRef", bordered(book, base_of(book, anchor), lines, fill))
    put(anchor, "cellSpan", rowSpan=row_to - row + 1, colSpan=col_to - col + 1)
    put(anchor, "cellSz", width=width, height=height)
    covered = [c for c in by_id.values() if c is not anchor]
    for c in covered:
        fill_cell(root, c, [""])
        put(c, "cellSpan", rowSpan=1, colSpan=1)
        put(c, "cellSz", width=0, height=0)


@op("split-table-cell")
def split_table_cell(book: Book, table: int, row: int, col: int, section: int | None = None) -> None:
    root = book.section(section)
    t = pick(tables(root), table, "table")
    anchor = cell_at(book, table, row, col, section)
    r0, c0, rs, cs = address(anchor)
    if (rs, cs) == (1, 1):
        return
    widths, heights = shares(extent(anchor)[0], cs), shares(extent(anchor)[1], rs)
    put(anchor, "cellSpan", rowSpan=1, colSpan=1)
    own = {address(c)[:2]: c for c in cells_of(t) if c is not anchor}
    lines = rows_of(t)
    for r in range(rs):
        for c in range(cs):
            cell = anchor if not (r or c) else own.get((r0 + r, c0 + c))
            if cell is None:
                cell = new_cell(root, r0 + r, c0 + c, 0, 0, "")
                cell.set("borderFillIDRef", anchor.get("borderFillIDRef", "3"))
                line = pick(lines, r0 + r, "row")
                line.insert(sum(address(x)[1] < c0 + c for x in kids(line, "tc")), cell)
            put(cell, "cellSz", width=widths[c], height=heights[r])


@op("normalize-table-borders")
def normalize_table_borders(book: Book, table: int, section: int | None = None) -> None:
    """Lines that two cells share become the stronger one in both; a side of the table's rim gets its strongest line."""
    t = pick(tables(book.section(section)), table, "table")
    grid, change = grid_of(t), {}

    def give(cell: ET.Element, side: str, line: dict[str, str]) -> None:
        was = change.setdefault(id(cell), (cell, {}))[1]
        was[side] = max(was.get(side, line), line, key=strength)

    for (r, c), cell in sorted(grid.items(), key=lambda x: x[0]):
        for other, mine, theirs in ((grid.get((r, c + 1)), "right", "left"), (grid.get((r + 1, c)), "bottom", "top")):
            if other is not None and other is not cell:
                line = max(line_of(book, cell, mine), line_of(book, other, theirs), key=strength)
                give(cell, mine, line)
                give(other, theirs, line)
    for side, along, last in (("top", 0, False), ("bottom", 0, True), ("left", 1, False), ("right", 1, True)):
        edge = max((at[along] for at in grid), default=0) if last else 0
        rim = list({id(cell): cell for at, cell in sorted(grid.items(), key=lambda x: x[0]) if at[along] == edge}.values())
        line = max((line_of(book, cell, side) for cell in rim), key=strength, default=None)
        for cell in rim if line else ():
            give(cell, side, line)
    for cell, lines in change.values():
        lines = {s: v for s, v in lines.items() if strength(v)[0] and line_of(book, cell, s) != v}
        if lines:
            cell.set("borderFillIDRef", bordered(book, base_of(book, cell), lines))


@op("expand-table")
def expand_table(book: Book, table: int, rows: int, section: int | str | None = None) -> None:
    """Rows up to the given count, each a copy of the last one without its texts; it must hold no merge and no table."""
    root = book.section(section)
    t = pick(tables(root), table, "table")
    lines = rows_of(t)
    grid, taken, top = None, {}, next_id(root)  # the grid is made once and the rows are added to it; ids are counted on
    had = len(lines)
    while len(lines) < rows:
        last = lines[-1]
        at = len(lines)
        whole = kids(last, "tc")
        same = at > had + 1  # a copy of a row that was copied and emptied: what holds of that one holds of it
        need(same or whole and all(address(c)[2:] == (1, 1) and not dead(c) for c in whole), "the last row has merged cells")
        if grid is None:
            grid = grid_of(t)
            for r, k in grid:
                taken.setdefault(r, set()).add(k)
        else:
            for c in whole:
                claim(grid, c)
                taken.setdefault(at - 1, set()).add(address(c)[1])
        need(len(whole) == len(taken.get(at - 1, ())), "the last row has merged cells")
        need(same or next(within(last, "tbl"), None) is None, "the last row holds a table")
        new = copy.deepcopy(last)
        for c in kids(new, "tc"):
            put(c, "cellAddr", rowAddr=at)
            if not same:
                fill_cell(root, c, [""])
        t.insert(list(t).index(last) + 1, new)
        lines.append(new)
        if not same:
            top = max(top, next_id(new))
        for e in within(new, "p"):
            e.set("id", str(top))
            top += 1
    t.set("rowCnt", str(max(number(t.get("rowCnt")), len(lines))))


# --- filling and guides


@op("fill")
def fill(book: Book, section_path: str, new_text: str, all_p_idx: int | None = None, table_idx: int | None = None, row: int | None = None, col: int | None = None, **_: object) -> None:
    """One planned change: a paragraph by its place among all of the section, or a cell."""
    root = book.section(section_path)
    if all_p_idx is not None:
        book.grids.clear()
        replace_text(pick(list(within(root, "p")), all_p_idx, "paragraph"), new_text)
        return
    if (section_path, table_idx) not in book.grids:
        book.grids[section_path, table_idx] = grid_of(pick(tables(root), table_idx, "table"))
    grid = book.grids[section_path, table_idx]
    need((row, col) in grid, f"no cell ({row}, {col})")
    cell = grid[row, col]
    bare, nested = extent(cell) == (0, 0), next(within(cell, "tbl"), None) is not None
    was = bare and dead(cell)
    fill_cell(root, cell, re.sub("\r\n?", "\n", new_text).split("\n"))
    if nested or bare and dead(cell) != was:  # tables count differently, or another cell may have the place
        book.grids.clear()


@op("remove-guides")
def remove_guides(book: Book, reason: str | None = None, section: int | None = None) -> None:
    """The text of guide paragraphs goes, the paragraphs stay; those with a section property are left alone."""
    from folioframe.functions.text import GUIDE_PHRASES, MARKED_GUIDE_WORDS

    for path in book.sections() if section is None else [book.sections()[section]]:
        for p in within(book.section(path), "p"):
            text = "".join(t.text or "" for t in within(p, "t")).strip().lower()
            why = "guide-marker" if text.startswith(GUIDE_MARK) and any(w in text for w in MARKED_GUIDE_WORDS) else "guide-text" if any(w in text for w in GUIDE_PHRASES) else None
            if why and (reason is None or reason.strip().lower() == why) and not has_section_property(p) and next(within(p, "tbl"), None) is None:
                replace_text(p, "")


# --- the section's controls


def control_run(root: ET.Element) -> ET.Element:
    """The run of the section property, made at the section's start if missing."""
    for p in kids(root, "p"):
        for r in kids(p, "run"):
            if kid(r, "secPr") is not None:
                return r
    p = paragraph(root)
    run = kid(p, "run")
    run.insert(0, make(space(p), "secPr", id="", textDirection="HORIZONTAL", spaceColumns="1134", tabStop="8000"))
    root.insert(0, p)
    return run


def replace_control(run: ET.Element, tag: str, new: ET.Element | None) -> None:
    for ctrl in [c for c in kids(run, "ctrl") if kid(c, tag) is not None]:
        run.remove(ctrl)
    if new is not None:
        add(run, "ctrl").append(new)


def page_parts(text: str) -> list[str]:
    """Text between and at the page marks."""
    return [x for x in PAGE_MARKS.split(text) if x]


def header_footer(tag: str):
    def put_it(book: Book, texts: list[str] | str, pages: str = "BOTH", section: int | None = None) -> None:
        need(texts, f"{tag} text must not be empty")
        root = book.section(section)
        run = control_run(root)
        new = make(space(run), tag, id=next_id(root), applyPageType=pages.upper())
        sub = add(new, "subList", textDirection="HORIZONTAL", vertAlign="TOP" if tag == "header" else "BOTTOM")
        for text in [texts] if isinstance(texts, str) else texts:
            p = paragraph(root)
            r = kid(p, "run")
            r.clear()
            r.set("charPrIDRef", "0")
            for bit in page_parts(text):
                if PAGE_MARKS.fullmatch(bit):
                    kind = "PAGE" if bit == "{{PAGE}}" else "TOTAL_PAGE"
                    add(add(add(r, "ctrl"), "autoNum", num="1", numType=kind), "autoNumFormat", type="DIGIT")
                else:
                    add(r, "t", bit)
            sub.append(p)
        replace_control(run, tag, new)

    def take_it(book: Book, section: int | None = None) -> None:
        replace_control(control_run(book.section(section)), tag, None)

    OPS[f"set-{tag}"], OPS[f"remove-{tag}"] = put_it, take_it


header_footer("header")
header_footer("footer")


@op("set-page-number")
def set_page_number(book: Book, position: str = "BOTTOM_CENTER", format: str = "DIGIT", side: str = "", start: int = 0, section: int | None = None) -> None:
    need(start >= 0, "start page must be zero or greater")
    run = control_run(book.section(section))
    replace_control(run, "pageNum", make(space(run), "pageNum", pos=position, formatType=format, sideChar=side))
    if start:
        put(kid(run, "secPr"), "startNum", page=start)


@op("set-columns")
def set_columns(book: Book, count: int, gap_mm: float = 0, section: int | None = None) -> None:
    need(count > 0, "column count must be positive")
    need(gap_mm >= 0, "column gap must be zero or greater")
    run = control_run(book.section(section))
    kid(run, "secPr").set("spaceColumns", str(units(gap_mm)))
    replace_control(run, "colPr", make(space(run), "colPr", id="", type="NEWSPAPER", layout="LEFT", colCount=count, sameSz="1", sameGap=units(gap_mm)))


@op("set-page-layout")
def set_page_layout(book: Book, width_mm: float | None = None, height_mm: float | None = None, landscape: bool | None = None, margins_mm: dict | None = None, section: int | None = None) -> None:
    need(any(x is not None for x in (width_mm, height_mm, landscape, margins_mm)), "at least one option is needed")
    need(all(x is None or x > 0 for x in (width_mm, height_mm)) and all(v >= 0 for v in (margins_mm or {}).values()), "sizes must be positive")
    prop = kid(control_run(book.section(section)), "secPr")
    page = kid(prop, "pagePr")
    page = page if page is not None else add(prop, "pagePr", landscape="WIDELY", width="59528", height="84186", gutterType="LEFT_ONLY")
    for k, v in (("width", width_mm), ("height", height_mm)):
        if v is not None:
            page.set(k, str(units(v)))
    if landscape is not None:
        page.set("landscape", "NARROWLY" if landscape else "WIDELY")
    if margins_mm:
        put(page, "margin", **{k: units(v) for k, v in margins_mm.items()})


# --- notes, references, objects


def note(tag: str, name: str):
    def put_it(book: Book, anchor: str, text: list[str] | str, section: int | None = None) -> None:
        need(anchor.strip() and text, f"{name} anchor and text must not be empty")
        root = book.section(section)
        n = max([number(a.get("number")) for a in within(root, tag)], default=0) + 1
        p = paragraph(root, anchor)
        new = add(add(kid(p, "run"), "ctrl"), tag, number=n, suffixChar="41", instId=next_id(root))
        sub = add(new, "subList", textDirection="HORIZONTAL", vertAlign="TOP")
        for i, line in enumerate([text] if isinstance(text, str) else text):
            q = paragraph(root, line)
            if not i:
                ctrl = make(space(q), "ctrl")
                add(add(ctrl, "autoNum", num=n, numType="FOOTNOTE" if tag == "footNote" else "ENDNOTE"), "autoNumFormat", type="DIGIT", suffixChar=")")
                kid(q, "run").insert(0, ctrl)
            sub.append(q)
        root.append(p)

    OPS[f"add-{name}"] = put_it


note("footNote", "footnote")
note("endNote", "endnote")


def field(root: ET.Element, p: ET.Element, kind: str, text: str, char: str = "0", **strings: str) -> None:
    """A run of text between the begin and end marks of a field."""
    n = next_id(root)
    for r in kids(p, "run"):
        p.remove(r)
    begin = add(add(add(p, "run", charPrIDRef=char), "ctrl"), "fieldBegin", id=n, type=kind, name="", editable="0", dirty="0", fieldid=n)
    values = add(begin, "parameters", cnt=len(strings), name="")
    for k, v in strings.items():
        add(values, "stringParam", v, name=k)
    write(add(p, "run", charPrIDRef=char), text)
    add(add(add(p, "run", charPrIDRef=char), "ctrl"), "fieldEnd", beginIDRef=n, fieldid=n)


@op("add-memo")
def add_memo(book: Book, anchor: str, text: list[str] | str, author: str = "", section: int | None = None) -> None:
    need(anchor.strip() and text, "memo anchor and text must not be empty")
    root = book.section(section)
    shapes = book.list_of("memoProperties")
    if not kids(shapes, "memoPr"):
        add(shapes, "memoPr", id="1", width="15591", lineType="SOLID", lineWidth="0.6 mm", lineColor="#B6D7AE", fillColor="#F0FFE9")
    group = kid(root, "memogroup")
    group = group if group is not None else add(root, "memogroup", ns=words_space(root))
    ident = max([number(m.get("id")) for m in kids(group, "memo")], default=0) + 1
    memo = add(group, "memo", id=ident, memoShapeIDRef="1", author=author)
    for line in [text] if isinstance(text, str) else text:
        memo.append(paragraph(root, line))
    p = paragraph(root)
    field(root, p, "MEMO", anchor, Author=author, MemoShapeID="1", ID=str(ident))
    root.remove(group)
    root.append(p)
    root.append(group)


def bookmarks(root: ET.Element) -> dict[str, ET.Element]:
    """Names, and the paragraph that each is in."""
    return {b.get("name", ""): p for p in within(root, "p") for b in within(p, "bookmark")}


@op("add-bookmark")
def add_bookmark(book: Book, name: str, text: str, section: int | None = None, style: dict | None = None) -> None:
    need(name.strip() and text.strip(), "bookmark name and text must not be empty")
    root = book.section(section)
    need(name not in bookmarks(root), f"bookmark already exists: {name}")
    p = paragraph(root, text, style)
    mark = make(space(p), "run", charPrIDRef=(style or {}).get("char", "0"))
    add(add(mark, "ctrl"), "bookmark", name=name)
    p.insert(0, mark)
    root.append(p)


@op("add-hyperlink")
def add_hyperlink(book: Book, target: str, text: str, section: int | None = None) -> None:
    need(target.strip() and text.strip(), "hyperlink target and text must not be empty")
    root = book.section(section)
    need(not target.startswith("#") or target[1:] in bookmarks(root), f"bookmark does not exist: {target[1:]}")
    p = paragraph(root)
    field(root, p, "HYPERLINK", text, Path=target)
    root.append(p)


def styles_of(book: Book) -> dict[str, dict[str, str]]:
    return {s.get("name", "").strip().lower(): {"id": s.get("id", "0"), "para": s.get("paraPrIDRef", "0"), "char": s.get("charPrIDRef", "0")} for s in within(book.head, "style")}


@op("add-heading")
def add_heading(book: Book, text: str, level: int = 1, bookmark: str | None = None, section: int | None = None) -> None:
    known = styles_of(book)
    style = known.get(f"heading {level}") or known.get(f"개요 {level}")
    need(style, f"no style of heading level {level}")
    root = book.section(section)
    add_bookmark(book, bookmark or f"heading-{len(bookmarks(root)) + 1}", text, section, style)


def headings(book: Book, root: ET.Element, most: int) -> list[tuple[int, str, str | None]]:
    """(level, text, bookmark) of the paragraphs in a heading style, in order."""
    by_id = {s["id"]: name for name, s in styles_of(book).items()}
    named = {id(p): name for name, p in bookmarks(root).items()}
    out = []
    for p in body(root):
        m = OUTLINE.match(by_id.get(p.get("styleIDRef", ""), ""))
        if m and int(m.group(1)) <= most and plain(p).strip():
            out.append((int(m.group(1)), plain(p).strip(), named.get(id(p))))
    return out


@op("insert-toc")
def insert_toc(book: Book, title: str = "", max_level: int = 3, section: int | None = None) -> None:
    root = book.section(section)
    found = headings(book, root, max_level)
    need(found, "no headings")
    new = [paragraph(root, title)] if title else []
    for level, text, name in found:
        p = paragraph(root, "  " * (level - 1) + text)
        if name:
            field(root, p, "HYPERLINK", "  " * (level - 1) + text, Path=f"#{name}")
        new.append(p)
    at = 1 if len(root) and local(root[0]) == "p" and has_section_property(root[0]) else 0
    for i, p in enumerate(new):
        p.set("id", str(next_id(root)))
        root.insert(at + i, p)


@op("add-cross-reference")
def add_cross_reference(book: Book, bookmark: str, text: str | None = None, section: int | None = None) -> None:
    root = book.section(section)
    known = bookmarks(root)
    need(bookmark in known, f"bookmark does not exist: {bookmark}")
    p = paragraph(root)
    field(root, p, "CROSSREF", text or plain(known[bookmark]).strip(), RefPath=f"#{bookmark}", RefType="BOOKMARK")
    root.append(p)


def drawn(tag: str, name: str):
    def put_it(book: Book, width_mm: float, height_mm: float, line: str = "#000000", fill: str | None = None, text: list[str] | str | None = None, section: int | None = None) -> None:
        width, height = units(width_mm), units(height_mm)
        need(width > 0 and (height > 0 or tag == "line"), "sizes must be positive")
        need(text if name == "textbox" else True, "text box text must not be empty")
        root = book.section(section)
        p = paragraph(root)
        run = kid(p, "run")
        run.clear()
        run.set("charPrIDRef", "0")
        shape = add(run, tag, id=next_id(root), zOrder="0", numberingType="PICTURE", textWrap="TOP_AND_BOTTOM", lock="0", instid=next_id(root))
        add(shape, "orgSz", width=width, height=height)
        add(shape, "curSz", width=width, height=height)
        add(shape, "lineShape", color=line, width="33", style="SOLID")
        if fill and tag != "line":
            add(add(shape, "fillBrush", ns=CORE), "winBrush", faceColor=fill, hatchColor="#999999", alpha="0")
        if name == "textbox":
            sub = add(add(shape, "drawText", lastWidth=width, name="", editable="0"), "subList", textDirection="HORIZONTAL", vertAlign="TOP")
            for bit in [text] if isinstance(text, str) else text:
                sub.append(paragraph(root, bit))
        if tag == "line":
            add(shape, "startPt", ns=CORE, x=0, y=0)
            add(shape, "endPt", ns=CORE, x=width, y=height)
        place(shape, width, height)
        root.append(p)

    OPS[f"add-{name}"] = put_it


def place(shape: ET.Element, width: int, height: int) -> None:
    add(shape, "sz", width=width, widthRelTo="ABSOLUTE", height=height, heightRelTo="ABSOLUTE", protect="0")
    add(shape, "pos", treatAsChar="1", vertRelTo="PARA", horzRelTo="COLUMN", vertAlign="TOP", horzAlign="LEFT", vertOffset="0", horzOffset="0")


for _tag, _name in (("rect", "rectangle"), ("line", "line"), ("ellipse", "ellipse"), ("rect", "textbox")):
    drawn(_tag, _name)


@op("add-equation")
def add_equation(book: Book, script: str, section: int | None = None) -> None:
    need(script.strip(), "equation script must not be empty")
    root = book.section(section)
    p = paragraph(root)
    run = kid(p, "run")
    run.clear()
    run.set("charPrIDRef", "0")
    shape = add(run, "equation", id=next_id(root), zOrder="0", numberingType="EQUATION", version="Equation Version 60", baseUnit="1000", textColor="#000000")
    place(shape, 6000, 1200)
    add(shape, "script", script)
    root.append(p)


def image_size(raw: bytes) -> tuple[str, int, int]:
    """Format, width and height of a PNG, GIF, JPEG or BMP."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", *struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM":
        w, h = struct.unpack("<ii", raw[18:26])
        return "bmp", w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            mark, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "jpg", w, h
            at += 2 + size
    raise EditError("unknown image format")


def shown_size(pixels: tuple[int, int], width_mm: float | None = None) -> tuple[int, int]:
    """Units of a picture: the asked width, else the usual one, at most the page's text; its shape is kept."""
    need(min(pixels) > 0, "an image of no size")
    width = min((units(width_mm) if width_mm else 0) or IMAGE_WIDTH, PAGE_WIDTH)
    return width, int(width * pixels[1] / pixels[0] + 0.5) or width


@op("embed-image")
def embed_image(book: Book, data: str) -> str:
    """data: base64. Returns the item's id."""
    raw = base64.b64decode(data)
    kind, _, _ = image_size(raw)
    ids = {i.get("id") for i in within(book.content, "item")}
    n = 1
    while f"image{n}" in ids:
        n += 1
    path = f"BinData/image{n}.{kind}"
    book.entries[path] = raw
    add(book.part("manifest"), "item", **{"id": f"image{n}", "href": path, "media-type": f"image/{'jpeg' if kind == 'jpg' else kind}", "isEmbeded": "1"})
    items = book.list_of("binDataList")
    add(items, "binItem", id=n, Type="Embedding", BinData=f"image{n}.{kind}", Format=kind)
    items.set("itemCnt", str(len(items)))
    return f"image{n}"


@op("insert-image")
def insert_image(book: Book, data: str, width_mm: float | None = None, name: str = "", section: int | None = None) -> None:
    raw = base64.b64decode(data)
    _, w, h = image_size(raw)
    item = embed_image(book, data)
    width, height = shown_size((w, h), width_mm)
    root = book.section(section)
    p = paragraph(root)
    run = kid(p, "run")
    run.clear()
    run.set("charPrIDRef", "0")
    pic = add(run, "pic", id=next_id(root), zOrder="0", numberingType="PICTURE", textWrap="TOP_AND_BOTTOM", instid=next_id(root))
    add(pic, "orgSz", width=width, height=height)
    add(pic, "curSz", width=width, height=height)
    add(pic, "img", ns=CORE, binaryItemIDRef=item, bright="0", contrast="0", effect="REAL_PIC", alpha="0")
    add(pic, "imgDim", dimwidth=w * 75, dimheight=h * 75)
    place(pic, width, height)
    add(pic, "shapeComment", name or None)
    root.append(p)


@op("set-object-position")
def set_object_position(book: Book, kind: str, index: int, section: int | None = None, **attrs: object) -> None:
    tags = {"table": "tbl", "image": "pic", "equation": "equation", "line": "line", "ellipse": "ellipse", "rectangle": "rect", "textbox": "rect"}
    need(kind in tags, f"unknown object kind {kind}")
    need(attrs, "at least one option is needed")
    found = [e for e in within(book.section(section), tags[kind]) if tags[kind] != "rect" or (kid(e, "drawText") is not None) == (kind == "textbox")]
    values = {"treat_as_char": "treatAsChar", "x_mm": "horzOffset", "y_mm": "vertOffset", "horz_align": "horzAlign", "vert_align": "vertAlign", "horz_rel_to": "horzRelTo", "vert_rel_to": "vertRelTo"}
    put(pick(found, index, kind), "pos", **{values[k]: units(v) if k.endswith("_mm") else int(v) if isinstance(v, bool) else v for k, v in attrs.items()})


@op("record-history")
def record_history(book: Book, author: str, summary: str, at: str) -> None:
    """An entry under the next id; the part and its manifest item are made if missing."""
    if HISTORY not in book.entries:
        book.entries[HISTORY], book.roots[HISTORY] = b"", make(HEAD, "history")
        add(book.part("manifest"), "item", **{"id": "history", "href": HISTORY, "media-type": "application/xml"})
    root = book.root(HISTORY)
    entry = add(root, "historyEntry", id=max([number(e.get("id")) for e in within(root, "historyEntry")], default=0) + 1, author=author, date=at)
    add(entry, "summary", summary)


# --- statements over a corpus

STATEMENTS = "doc_id string, seq int, op string, args string"
RESULT = "doc_id string, path string, content binary, error string"


def statements(spark: SparkSession, rows: list[tuple[str, str, dict]]) -> DataFrame:
    """(doc_id, op, arguments) in order -> statements."""
    return spark.createDataFrame([(d, i, o, json.dumps(a)) for i, (d, o, a) in enumerate(rows)], STATEMENTS)


def edited(entries: dict[str, bytes], asked: list[tuple[str, str]]) -> tuple[dict[str, bytes], str | None]:
    book = Book(entries)
    for n, (name, args) in enumerate(asked):
        try:
            need(name in OPS, f"unknown statement {name}")
            if name != "fill":
                book.grids.clear()
            OPS[name](book, **json.loads(args or "{}"))
        except Exception as e:  # whatever a statement trips over is its document's error, not the job's
            why = f"{e}" if isinstance(e, EditError) else f"{type(e).__name__}: {e}"
            return entries, f"statement {n} ({name}): {why}"
    try:
        done = book.saved()
        for path in book.roots.keys() & done.keys():
            expat.ParserCreate(namespace_separator="}").Parse(done[path], True)
    except Exception as e:
        return entries, f"not well formed afterwards: {e}"
    return done, None


def apply(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """entries and statements -> (doc_id, path, content, error); documents without statements stay as they are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        if not left.num_rows:
            return kinds.empty_table()
        parts = dict(zip(left["path"].to_pylist(), left["content"].to_pylist(), strict=True))
        order = sorted(zip(*(right[c].to_pylist() for c in ("seq", "op", "args")), strict=True), key=lambda x: x[0])
        parts, error = edited(parts, [(name, args) for _, name, args in order])
        n = len(parts)
        return pa.table([[left["doc_id"][0].as_py()] * n, list(parts), list(parts.values()), [error] * n], schema=kinds)

    asked = asked.select("doc_id", "seq", "op", "args").toDF("doc_id", "seq", "op", "args")  # statements may come from the entries themselves
    touched = entries.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = entries.join(asked.select("doc_id").distinct(), "doc_id", "left_anti")
    done = touched.select("doc_id", "path", "content").groupBy("doc_id").cogroup(asked.groupBy("doc_id")).applyInArrow(run, RESULT)
    return done.unionByName(rest.select("doc_id", "path", "content", F.lit(None).cast("string").alias("error")))


@op("fail")
def fail(book: Book, message: str) -> None:
    raise EditError(message)


def fill_statements(final: DataFrame, grown: DataFrame | None = None, refused: DataFrame | None = None, unfit: DataFrame | None = None) -> DataFrame:
    """Planned changes (one a place, as ``fill.last_wins`` gives them) as statements; before them rows to add
    (section_path, table_idx, rows), and documents to leave alone: (doc_id, rid, matched), (doc_id, issues).

    Paragraphs come first: rows and cells that follow change how many paragraphs there are."""
    args = F.to_json(F.struct("section_path", "new_text", "all_p_idx", "table_idx", "row", "col"))
    out = final.select("doc_id", (F.when(F.col("all_p_idx").isNotNull(), 1).otherwise(20_001) + F.col("seq.rid")).cast("int").alias("seq"), F.lit("fill").alias("op"), args.alias("args"))
    if grown is not None:
        more = F.to_json(F.struct(F.col("section_path").alias("section"), F.col("table_idx").alias("table"), "rows"))
        out = grown.select("doc_id", F.lit(20_000).alias("seq"), F.lit("expand-table").alias("op"), more.alias("args")).unionByName(out)
    if refused is not None:
        why = F.to_json(F.struct(F.format_string("entry %d has %d targets", "rid", "matched").alias("message")))
        out = refused.select("doc_id", F.lit(0).alias("seq"), F.lit("fail").alias("op"), why.alias("args")).unionByName(out)
    if unfit is not None:
        why = F.to_json(F.struct(F.concat(F.lit("fingerprint: "), F.array_join("issues", "; ")).alias("message")))
        out = unfit.select("doc_id", F.lit(0).alias("seq"), F.lit("fail").alias("op"), why.alias("args")).unionByName(out)
    return out
