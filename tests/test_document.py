"""Package operators on small packages built here."""

import pytest

from folioframe.operators import document as D
from folioframe.sources import package as P

NS = 'xmlns:hp="p" xmlns:hs="s"'


def para(text, style="0"):
    return f'<hp:p styleIDRef="{style}"><hp:run charPrIDRef="1"><hp:t>{text}</hp:t></hp:run></hp:p>'


def cell(r, c, text, rs=1, cs=1, w=10):
    return f'<hp:tc><hp:subList>{para(text)}</hp:subList><hp:cellAddr rowAddr="{r}" colAddr="{c}"/><hp:cellSpan rowSpan="{rs}" colSpan="{cs}"/><hp:cellSz width="{w}" height="{w}"/></hp:tc>'


TABLE = (
    '<hp:p><hp:run><hp:tbl id="7" rowCnt="2" colCnt="2"><hp:tr>' + cell(0, 0, "품목 이름", cs=2) + cell(0, 1, "", w=0) + "</hp:tr><hp:tr>" + cell(1, 0, "담당 부서") + cell(1, 1, "시험 부서") + "</hp:tr></hp:tbl></hp:run></hp:p>"
)
HEADER = (
    '<h:head xmlns:h="h" secCnt="1"><h:style id="0" name="Normal"/><h:style id="1" name="Heading 2"/><h:charPr id="1" height="1200" textColor="#ff0000"><h:bold/></h:charPr></h:head>'
)
BODY = para("차례 설명", "1") + para("{{ORDER_TITLE}}") + para("※ 작성요령: 이 항목을 작성하세요") + para("비용 모음") + TABLE


@pytest.fixture(scope="module")
def entries(spark):
    rows = {p: c for _, p, c in P.blank()}
    rows["Contents/header.xml"] = HEADER.encode()
    rows["Contents/section0.xml"] = f"<hs:sec {NS}>{BODY}</hs:sec>".encode()
    return spark.createDataFrame([("d", p, c) for p, c in rows.items()], P.ENTRIES)


@pytest.fixture(scope="module")
def parts(entries):
    elements = P.flatten(entries).cache()
    paragraphs = D.paragraph_texts(elements).cache()
    cells = D.cells(elements, paragraphs).cache()
    return elements, paragraphs, cells, D.tables(elements, paragraphs, cells).cache()


def test_paragraphs_placeholders_guides(parts):
    _, paragraphs, _, _ = parts
    assert [r.text_t for r in paragraphs.where("depth = 1 and body_p_idx < 4").orderBy("body_p_idx").collect()] == ["차례 설명", "{{ORDER_TITLE}}", "※ 작성요령: 이 항목을 작성하세요", "비용 모음"]
    assert [r.reason for r in D.placeholders(paragraphs).collect()] == ["mustache-pattern"]
    assert [r.reason for r in D.guides(paragraphs).collect()] == ["guide-marker"]


def test_table_grid_and_label(parts):
    elements, paragraphs, cells, tables = parts
    row = tables.first()
    assert (row.rows, row.cols, row.label, row.role, row.merged_cells) == (2, 2, "비용 모음", "key-value", 1)
    assert {(r.row, r.col): (r.anchor_row, r.anchor_col) for r in D.grid(cells).collect()} == {(0, 0): (0, 0), (0, 1): (0, 0), (1, 0): (1, 0), (1, 1): (1, 1)}
    section = D.sections(elements, paragraphs, tables).first()
    assert (section.role, section.table_count, section.placeholder_count, section.guide_count) == ("template-form", 1, 1, 1)


def test_overlaps_are_rows(parts):
    _, _, cells, _ = parts
    twice = cells.where("row = 1 and col = 1").union(cells.where("row = 1 and col = 1"))
    assert [(r.doc_id, r.row, r.col, r.cells) for r in D.overlaps(twice).collect()] == [("d", 1, 1, 2)] and D.overlaps(cells).count() == 0
    assert D.grid(twice).count() == 1


def test_anchors_and_search(parts, entries):
    elements, paragraphs, cells, tables = parts
    found = {(r.text, r.score) for r in D.anchors(paragraphs, tables, cells, P.styles(entries)).collect()}
    assert {("비용 모음", 100), ("품목 이름", 95), ("담당 부서", 88), ("차례 설명", 80)} <= found
    assert D.find_by_tag(elements, "hp:tc").count() == 4
    assert D.find_by_attr(elements, "rowCnt", "2").first().tag == "tbl"
    assert [(r.kind, r.object_id) for r in D.objects(elements).collect()] == [("table", "7")]
    runs = D.runs(elements, P.char_props(entries))
    assert D.find_runs_by_style(runs, bold=True, size_pt=12, color="#FF0000").count() == 4
    with pytest.raises(ValueError):
        D.find_runs_by_style(runs)


def test_report_risks_exports(parts, entries):
    elements, paragraphs, cells, tables = parts
    assert D.report(entries).first().valid
    assert D.report(entries.where("path <> 'version.xml'")).first().errors == ["missing required entry: version.xml"]
    assert D.risk_signals(entries).first().hints == ["table-risk"]
    b = D.blocks(paragraphs, tables, cells, P.styles(entries), elements)
    assert D.export(b, "markdown").first().out.startswith("## 차례 설명\n\n{{ORDER_TITLE}}")
    assert "<th>품목 이름</th>" in D.export(b, "html").first().out
    assert D.plain_text(paragraphs).first().text.split("\n")[1] == "{{ORDER_TITLE}}"


def test_pack_round_trip(entries, spark, tmp_path):
    for r in P.pack(entries).collect():
        (tmp_path / "a.zip").write_bytes(r.archive)
    back = P.read_archives(spark, f"{tmp_path}/a.zip")
    assert {(r.path, bytes(r.content)) for r in back.collect()} == {(r.path, bytes(r.content)) for r in entries.collect()}
    bad = P.pack(spark.createDataFrame([("d", "../x", b""), ("e", "x", b"1")], P.ENTRIES))
    assert {r.doc_id: (r.archive is None, r.reason) for r in bad.collect()} == {"d": (True, "unsafe entry names: ['../x']"), "e": (False, None)}
    again = P.unzipped(bad.union(spark.createDataFrame([("f", b"no zip", None)], bad.schema)))
    assert {(r.doc_id, r.path) for r in again.collect()} == {("d", P.BROKEN), ("e", "x"), ("f", P.BROKEN)}
