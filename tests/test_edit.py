"""Edits, read back through the flattened form."""

import base64
import json
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest

from folioframe.operators import borders
from folioframe.operators import document as D
from folioframe.operators import edit as E
from folioframe.sources import package as P

HEADER = (
    '<h:head xmlns:h="http://www.hancom.co.kr/hwpml/2011/head" secCnt="1"><h:refList><h:charProperties itemCnt="1"><h:charPr id="0" height="1000" textColor="#000000"/></h:charProperties>'
    '<h:paraProperties itemCnt="1"><h:paraPr id="0"/></h:paraProperties><h:styles><h:style id="0" name="Normal" paraPrIDRef="0" charPrIDRef="0"/><h:style id="1" name="Heading 1" paraPrIDRef="0" charPrIDRef="0"/></h:styles></h:refList></h:head>'
)


def parts() -> dict[str, bytes]:
    return {p: c for _, p, c in P.blank()} | {"Contents/header.xml": HEADER.encode()}


def run(*asked):
    book = E.Book(parts())
    for name, args in asked:
        E.OPS[name](book, **args)
    return E.Book(book.saved())


def texts(book, section=0):
    return [E.plain(p) for p in E.body(book.section(section))]


def test_paragraphs_and_runs():
    b = run(
        ("append-text", {"texts": ["one", "two", "three"]}), ("set-paragraph-text", {"index": 1, "text": "uno\ndos"}), ("delete-paragraph", {"index": 3}),
        ("add-run-text", {"index": 2, "text": "!"}), ("set-run-text", {"index": 2, "run": 0, "text": "zwei"}),
    )
    assert texts(b) == ["", "uno\ndos", "zwei!"]
    with pytest.raises(E.EditError):
        run(("delete-paragraph", {"index": 9}))


def test_styles_are_cloned_under_new_ids():
    b = run(
        ("append-text", {"texts": ["a", "b"]}), ("set-text-style", {"index": 1, "style": {"bold": True, "color": "#ff0000", "size_pt": 12, "font": "Batang", "underline": True}}),
        ("set-text-style", {"index": 2, "style": {"bold": True}}), ("set-paragraph-layout", {"index": 1, "layout": {"align": "center", "left_mm": 10, "line_percent": 160}}),
        ("set-paragraph-list", {"index": 2, "kind": "number", "start": 3}), ("replace-runs-by-style", {"where": {"color": "#FF0000", "size_pt": 12}, "text": "A"}),
    )
    assert texts(b) == ["", "A", "b"]
    first, second = (E.kid(p, "run") for p in E.body(b.section(0))[1:])
    assert [r.get("charPrIDRef") for r in (first, second)] == ["1", "2"] and E.style_of(b, first) == {"bold": True, "italic": False, "underline": True, "color": "#FF0000", "font": "Batang", "size_pt": 12.0}
    assert [p.get("paraPrIDRef") for p in E.body(b.section(0))] == [None, "1", "2"]
    with pytest.raises(E.EditError):
        run(("set-paragraph-list", {"index": 0, "kind": "bullet", "start": 2}))


def test_sections():
    b = run(("add-section", {"texts": ["second"]}), ("add-section", {"texts": ["third"]}), ("delete-section", {"section": 1}))
    assert b.sections() == ["Contents/section0.xml", "Contents/section1.xml"] and texts(b, 1) == ["third"] and b.head.get("secCnt") == "2"
    with pytest.raises(E.EditError):
        run(("delete-section", {"section": 0}))


def test_tables_merge_split_borders():
    b = run(
        ("add-table", {"rows": 2, "cols": 3, "cells": "a,b,c;d,e,f", "width_mm": 90}), ("merge-table-cells", {"table": 0, "row": 0, "col": 0, "row_to": 1, "col_to": 1}),
        ("set-table-cell", {"table": 0, "row": 1, "col": 1, "texts": ["x", "y"], "style": {"italic": True}, "align": "top"}), ("normalize-table-borders", {"table": 0}),
        ("add-nested-table", {"table": 0, "row": 0, "col": 2, "rows": 1, "cols": 2, "cells": [["n", "m"]]}),
    )
    table = E.tables(b.section(0))[0]
    anchor = E.grid_of(table)[1, 1]
    assert E.address(anchor) == (0, 0, 2, 2) and [E.plain(p) for p in E.paragraphs_of(anchor)] == ["x", "y"] and sum(map(E.dead, E.cells_of(table))) == 3
    assert E.extent(anchor)[0] == 2 * (E.units(90) // 3) and len(E.tables(b.section(0))) == 2
    E.OPS["split-table-cell"](b, table=0, row=0, col=0)
    assert all(E.address(c)[2:] == (1, 1) and E.extent(c)[0] > 0 for c in E.cells_of(table))
    with pytest.raises(E.EditError):
        E.OPS["expand-table"](run(("add-table", {"rows": 2, "cols": 2}), ("merge-table-cells", {"table": 0, "row": 1, "col": 0, "row_to": 1, "col_to": 1})), table=0, rows=3)
    with pytest.raises(E.EditError):
        run(("add-table", {"rows": 1, "cols": 2, "widths_mm": [10, 20], "width_mm": 50}))


def test_lines_of_tables(spark):
    """The edits and the relations agree on shared lines, rims, outlines, fills and sizes, and invisible lines change nothing."""
    line = lambda kind, mm: {s: f'<h:{s}Border type="{kind}" width="{mm} mm" color="#000000"/>' for s in borders.SIDES}
    fill = lambda i, left, rest, face="": f'<h:borderFill id="{i}">{line(*left)["left"]}{"".join(line(*rest)[s] for s in borders.SIDES[1:])}{face}</h:borderFill>'
    fills = fill(3, ("SOLID", 0.12), ("NONE", 0.1)) + fill(4, ("NONE", 0.5), ("DASH", 0.4)) + fill(5, ("DOUBLE_SLIM", 0.5), ("SOLID", 0.7), '<h:fillBrush><h:winBrush faceColor="#abcdef"/></h:fillBrush>')
    files = parts() | {"Contents/header.xml": HEADER.replace("<h:refList>", f"<h:refList><h:borderFills>{fills}</h:borderFills>").encode()}
    book = E.Book(files)
    E.OPS["add-table"](book, rows=3, cols=3, cells="a,b,c;d,e,f;g,h,i", width_mm=90)
    E.OPS["merge-table-cells"](book, table=0, row=0, col=0, row_to=1, col_to=1)
    for at, ref in (((0, 0), "4"), ((0, 2), "3"), ((1, 2), "5"), ((2, 0), "3"), ((2, 1), "99"), ((2, 2), "4")):
        E.grid_of(E.tables(book.section(0))[0])[at].set("borderFillIDRef", ref)
    entries = spark.createDataFrame([("d", p, c) for p, c in book.saved().items()], "doc_id string, path string, content binary")
    elements = P.flatten(entries)
    places = borders.lined(elements, entries, D.grid(D.cells(elements))).cache()
    asked = {(r.row, r.col, r.side): (r.line.kind, r.line.width) for r in borders.normalized(places).collect()}
    areas = spark.createDataFrame([("d", 0, "Contents/section0.xml", 0, *a) for a in ((0, 0, 2, 2), (1, 1, 2, 2), (2, 0, 2, 1), (2, 2, 3, 3))], "doc_id string, section_idx int, section_path string, table_idx int, row_from int, col_from int, row_to int, col_to int")
    merged = {(r.row_from, r.col_from): r for r in borders.merged(places, areas).collect()}
    assert merged[0, 0].whole and not merged[1, 1].whole and merged[2, 0].whole and not merged[2, 2].whole
    for at, to in (((0, 0), (2, 2)), ((2, 0), (2, 1))):
        b, m = E.Book(book.saved()), merged[at]
        E.OPS["merge-table-cells"](b, table=0, row=at[0], col=at[1], row_to=to[0], col_to=to[1])
        cell = E.grid_of(E.tables(b.section(0))[0])[at]
        assert E.extent(cell) == (m.width, m.height) and E.fill_of(b, cell) == m.face
        assert all((m[s].kind, m[s].width) == (E.line_of(b, cell, s)["type"], E.line_of(b, cell, s)["width"]) for s in borders.SIDES if m[s])
    before = {(E.address(c)[:2], s): E.line_of(book, c, s) for c in E.cells_of(E.tables(book.section(0))[0]) for s in borders.SIDES}
    E.OPS["normalize-table-borders"](book, table=0)
    for c in {id(c): c for c in E.grid_of(E.tables(book.section(0))[0]).values()}.values():
        for s in borders.SIDES:
            now, was = E.line_of(book, c, s), before[E.address(c)[:2], s]
            assert (now["type"], now["width"]) == asked.get((*E.address(c)[:2], s), (was["type"], was["width"]))
    assert len(asked) > 15 and asked[0, 2, "right"] == ("SOLID", "0.7 mm") == asked[2, 2, "top"]


def test_controls_notes_references_objects():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 960, 480) + bytes(5) + struct.pack(">I", zlib.crc32(b"x"))
    b = run(
        ("set-header", {"texts": "p {{PAGE}} of {{TOTAL_PAGE}}"}), ("set-footer", {"texts": ["f"]}), ("remove-footer", {}), ("set-page-number", {"start": 5}), ("set-columns", {"count": 2, "gap_mm": 8}),
        ("set-page-layout", {"width_mm": 210, "landscape": True, "margins_mm": {"left": 20}}), ("add-footnote", {"anchor": "see", "text": "note"}), ("add-footnote", {"anchor": "see", "text": "again"}),
        ("add-endnote", {"anchor": "see", "text": ["end", "more"]}), ("add-memo", {"anchor": "m", "text": "memo", "author": "me"}), ("add-heading", {"text": "Title", "bookmark": "top"}),
        ("add-bookmark", {"name": "mark", "text": "here"}), ("add-hyperlink", {"target": "#mark", "text": "go"}), ("add-cross-reference", {"bookmark": "top"}), ("insert-toc", {"title": "Contents"}),
        ("add-equation", {"script": "a over b"}), ("add-rectangle", {"width_mm": 10, "height_mm": 5}), ("add-line", {"width_mm": 10, "height_mm": 0}), ("add-ellipse", {"width_mm": 10, "height_mm": 5, "fill": "#00ff00"}),
        ("add-textbox", {"width_mm": 30, "height_mm": 10, "text": "boxed"}), ("insert-image", {"data": base64.b64encode(png).decode(), "width_mm": 50}), ("set-object-position", {"kind": "image", "index": 0, "x_mm": 10, "treat_as_char": False}),
        ("record-history", {"author": "a", "summary": "s", "at": "2026-01-01T00:00:00Z"}), ("record-history", {"author": "a", "summary": "t", "at": "2026-01-02T00:00:00Z"}),
    )
    root = b.section(0)
    count = lambda tag: sum(1 for _ in E.within(root, tag))
    assert {t: count(t) for t in ("header", "footer", "pageNum", "colPr", "footNote", "endNote", "memo", "bookmark", "equation", "rect", "line", "ellipse", "drawText", "pic")} == {
        "header": 1, "footer": 0, "pageNum": 1, "colPr": 1, "footNote": 2, "endNote": 1, "memo": 1, "bookmark": 2, "equation": 1, "rect": 2, "line": 1, "ellipse": 1, "drawText": 1, "pic": 1,
    }
    assert texts(b)[:2] == ["Contents", "Title"] and [n.get("number") for n in E.within(root, "footNote")] == ["1", "2"]
    assert next(E.within(root, "pos"), None) is not None and next(E.within(root, "pic")).find("./{*}pos").get("horzOffset") == str(E.units(10))
    assert E.shown_size((960, 480), 50) == (E.units(50), E.units(50) // 2 + E.units(50) % 2) and b.entries["BinData/image1.png"] == png
    assert [e.get("id") for e in E.within(b.root(E.HISTORY), "historyEntry")] == ["1", "2"]
    assert E.page_parts("a{{PAGE}}b") == ["a", "{{PAGE}}", "b"]
    for bad in (("add-bookmark", {"name": "x", "text": " "}), ("add-hyperlink", {"target": "#none", "text": "t"}), ("add-cross-reference", {"bookmark": "none"}), ("add-equation", {"script": ""})):
        with pytest.raises(E.EditError):
            run(bad)


def test_guides_are_blanked():
    b = run(("append-text", {"texts": ["※ 이 칸을 작성", "유의사항 하나", "stays"]}), ("remove-guides", {"reason": "guide-text"}))
    assert texts(b) == ["", "※ 이 칸을 작성", "", "stays"]


def test_statements_over_a_corpus(spark):
    """All or nothing a document; other documents are left alone."""
    rows = [(d, p, c) for d in ("a", "b", "c") for p, c in parts().items()]
    entries = spark.createDataFrame(rows, P.ENTRIES)
    asked = E.statements(spark, [("a", "append-text", {"texts": ["x"]}), ("b", "append-text", {"texts": ["y"]}), ("b", "delete-paragraph", {"index": 7}), ("a", "append-text", {"texts": ["z"]})])
    done = E.apply(entries, asked).cache()
    said = {r.doc_id: r.text for r in D.plain_text(D.paragraph_texts(P.flatten(done.drop("error")))).collect()}
    assert said.get("a") == "x\nz" and "y" not in (said.get("b") or "")
    errors = {r.doc_id: r.error for r in done.select("doc_id", "error").distinct().collect()}
    assert errors["a"] is None and errors["c"] is None and "no paragraph 7" in errors["b"]
    assert done.count() == len(rows)


def test_filling_looks_at_a_table_once(monkeypatch):
    """Rows added and cells filled take time in the table's size, not in its square."""
    seen, plain_address = [], E.address
    monkeypatch.setattr(E, "address", lambda c: seen.append(1) or plain_address(c))
    section, n = "Contents/section0.xml", 200
    cell = lambda r, c: f'<tc><subList><p id="{10 * r + c}"><run><t>a</t></run></p></subList><cellAddr rowAddr="{r}" colAddr="{c}"/><cellSpan rowSpan="1" colSpan="1"/><cellSz width="5" height="5"/></tc>'
    book = f'<sec><p id="90"><run><tbl rowCnt="2" colCnt="2">{"".join(f"<tr>{cell(r, 0)}{cell(r, 1)}</tr>" for r in range(2))}</tbl></run></p></sec>'
    asked = [("expand-table", {"section": section, "table": 0, "rows": n})] + [("fill", {"section_path": section, "new_text": f"v{r}", "table_idx": 0, "row": r, "col": 1}) for r in range(n)]
    parts, error = E.edited({section: book.encode()}, [(o, json.dumps(a)) for o, a in asked])
    assert error is None and len(seen) < 20 * n
    table = E.tables(E.ET.fromstring(parts[section]))[0]
    assert [[E.plain(c) for c in E.kids(r, "tc")] for r in E.rows_of(table)] == [["a" if r < 2 else "", f"v{r}"] for r in range(n)]
    assert [p.get("id") for p in E.within(table, "p")] == ["0", "1", "10", "11"] + [str(91 + i) for i in range(2 * n - 4)]


def test_new_rows_cost_no_second_look(monkeypatch):
    """Rows after the second new one are copies of it: they are not emptied again, and hold what it holds."""
    calls = []
    fill_cell = E.fill_cell
    monkeypatch.setattr(E, "fill_cell", lambda *a: (calls.append(1), fill_cell(*a)))
    cell = '<hp:tc><hp:subList><hp:p id="7"><hp:run><hp:t>said</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr rowAddr="0" colAddr="0"/><hp:cellSpan rowSpan="1" colSpan="1"/><hp:cellSz width="5" height="5"/></hp:tc>'
    section = f'<hs:sec xmlns:hp="p" xmlns:hs="s"><hp:p><hp:run><hp:tbl rowCnt="1"><hp:tr>{cell}</hp:tr></hp:tbl></hp:run></hp:p></hs:sec>'
    done, error = E.edited({"Contents/section0.xml": section.encode()}, [("expand-table", json.dumps({"section": "Contents/section0.xml", "table": 0, "rows": 30}))])
    root = ET.fromstring(done["Contents/section0.xml"])
    cells = E.cells_of(E.tables(root)[0])
    assert error is None and [E.address(c) for c in cells] == [(r, 0, 1, 1) for r in range(30)]
    assert [E.plain(c) for c in cells] == ["said"] + [""] * 29
    assert [p.get("id") for c in cells for p in E.within(c, "p")] == [str(i) for i in range(7, 37)]
    assert len(calls) <= 2


def test_parts_are_written_as_elementtree_does():
    odd = '<a:r xmlns:a="u&amp;1" xmlns:b="q"><x k="1&#10;&quot;&lt;" b:k="&#9;" xml:space="preserve">t&amp;&gt;<a:y/>tail &lt;</x><b:z b:k="é">\U0001f600</b:z><w></w></a:r>'
    for text in (odd, "<r/>", "<r>a<!-- c --><s/></r>"):
        root = ET.fromstring(text, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True)))
        assert E.written(root) == ET.tostring(root, "utf-8", xml_declaration=True)
