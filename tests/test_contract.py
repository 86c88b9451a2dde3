"""Contracts, discovery, filling with added rows, round trips and the packing gate."""

import json

import pytest
from pyspark.sql import functions as F

from folioframe.operators import diff as X
from folioframe.operators import discovery
from folioframe.operators import document as D
from folioframe.operators import edit as E
from folioframe.plans import contract as C
from folioframe.plans import fill
from folioframe.sources import package as P
from tests.test_edit import parts


def book(*asked):
    b = E.Book(parts())
    for name, args in asked:
        E.OPS[name](b, **args)
    return b.saved()


@pytest.fixture(scope="module")
def entries(spark):
    docs = {
        "/x/One Form.zip": book(("append-text", {"texts": ["{{ORDER_NAME}}", "{{ORDER_DATE}}", "{{order name}}", "People of it"]}), ("add-table", {"rows": 2, "cols": 2, "cells": "Name,Role;,"}), ("append-text", {"texts": ["Body text with Name in it"]})),
        "two": book(("append-text", {"texts": ["{{ORDER_NAME}}"]}), ("add-table", {"rows": 2, "cols": 2, "cells": "Name,Role;a,b"}), ("merge-table-cells", {"table": 0, "row": 1, "col": 0, "row_to": 1, "col_to": 1})),
    }
    return spark.createDataFrame([(d, p, c) for d, x in docs.items() for p, c in x.items()], P.ENTRIES).cache()


def test_contract_issues_and_compiling():
    good = {
        "templateId": "t", "templateVersion": "1", "fingerprint": {"sectionCount": 1},
        "fields": [{"key": "order.name", "selector": {"type": "placeholder", "value": "{{ORDER_NAME}}"}, "required": True}, {"key": "order.by", "selector": {"type": "anchor", "value": "By"}, "fallbackValue": "nobody"}, {"key": "order.no", "selector": {"type": "near-text", "value": "No"}}],
        "tables": [{"key": "people", "selector": {"type": "anchor", "value": "Name"}, "columns": [{"key": "n", "source": "who.name"}, {"key": "r", "source": "role"}]}, {"key": "plain", "selector": {"type": "anchor", "value": "X"}}],
    }
    assert C.contract_issues(good) == []
    payload = {"order": {"name": "N"}, "people": [{"who": {"name": "A"}, "role": 1}, {"who": {"name": "B"}, "role": True}], "plain": [["1", 2], ["3", "4"]]}
    entries, told = C.compiled(good, payload)
    assert [e.get("value") for e in entries[:2]] == ["N", "nobody"] and entries[2]["records"] == [{"n": "A", "r": "1"}, {"n": "B", "r": "true"}] and entries[2]["expand"] and entries[3]["grid"] == [["1", "2"], ["3", "4"]]
    assert [t["skipped"] for t in told] == [False, False, True, False, False] and told[1]["usedFallback"] and told[3]["valuePreview"] == "n=A, r=1" and told[4]["valuePreview"] == "1 | 2"
    for broken in ({}, {"order": {"name": None}}, payload | {"people": [{"role": "x"}]}, payload | {"people": "x"}):
        with pytest.raises(ValueError):
            C.compiled(good, broken)
    bad = C.contract_issues({"fields": [{"key": "a", "selector": {"type": "x"}}, {"key": "a", "mode": "table_down_grid", "selector": {"type": "anchor", "value": "v"}}], "tables": [{"selector": {"type": "placeholder", "value": "v"}, "columns": [{}]}]})
    assert dict(bad) == {
        "templateId": "missing", "templateVersion": "missing", "fingerprint.sectionCount": "missing", "fields[0].selector.type": "unknown", "fields[0].selector.value": "missing", "fields[1].key": "repeated", "fields[1].mode": "unknown",
        "tables[0].key": "missing", "tables[0].selector.type": "unknown", "tables[0].columns[0].key": "missing", "tables[0].columns[0].source": "missing",
    } and len(bad) == 11 and C.contract_issues({})[0] == ("fields", "missing")
    assert C.payload_skeleton(good) == {"order": {"name": "", "by": "nobody", "no": ""}, "people": [{"who": {"name": ""}, "role": ""}], "plain": [""]}
    with pytest.raises(ValueError):
        C.assign({"a": "x"}, "a.b", "y")


def test_files(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schemaVersion": "any/fill-template-mapping/v1", "entries": [{"anchor": "a", "value": "b"}]}))
    assert C.load_mapping(str(tmp_path / "m.json")) == [{"anchor": "a", "value": "b"}]
    for bad in ({"entries": [1], "replacements": [1]}, {"schemaVersion": "v9", "entries": [1]}, {}, 3):
        with pytest.raises(ValueError):
            C.mapping_entries(bad)
    (tmp_path / "p.json").write_text("{}")
    with pytest.raises(ValueError):
        C.load_payload(str(tmp_path / "p.json"))
    (tmp_path / "c.json").write_text(json.dumps({"template_id": "t", "template_version": "1", "fingerprint": {"section_count": 1}, "fields": [{"key": "k", "fallback_value": "f", "selector": {"type": "anchor", "value": "v", "table_label": "l"}}]}))
    assert C.load_contract(str(tmp_path / "c.json"))["fields"][0] == {"key": "k", "fallbackValue": "f", "selector": {"type": "anchor", "value": "v", "tableLabel": "l"}}
    assert (C.artifact_format("", "a.json"), C.artifact_format("", "a.txt"), C.artifact_format("JSON", "a")) == ("json", "yaml", "json")


def test_scaffold_and_fingerprint(entries):
    elements = P.flatten(entries).cache()
    made = C.scaffold(elements, "/x/One Form.zip")
    assert made["templateId"] == "one_form" and [f["key"] for f in made["fields"]] == ["order.name", "order.date", "order.name_2"] and made["fingerprint"]["tableLabels"] == ["People of it"]
    prints = C.fingerprints(elements)
    issues = {r.doc_id: r.issues for r in C.fingerprint_issues(prints, made["fingerprint"]).collect()}
    assert list(issues) == ["two"] and any(x.startswith("placeholder_digest: {") for x in issues["two"]) and "table_labels: lacks People of it" in issues["two"]


def test_find_targets(entries):
    one = entries.where("doc_id like '/x/%'")
    elements = P.flatten(one)
    found = discovery.find_targets(elements, P.styles(one), anchor=" name", table_label="people", placeholder="{{order").collect()
    got = sorted((r.query_type, r.kind, r.text) for r in found)
    assert got == [
        ("anchor", "cell", "Name"), ("anchor", "paragraph", "Body text with Name in it"), ("anchor", "paragraph", "NameRole"), ("anchor", "paragraph", "{{ORDER_NAME}}"), ("anchor", "paragraph", "{{order name}}"),
        ("placeholder", "placeholder", "{{ORDER_DATE}}"), ("placeholder", "placeholder", "{{ORDER_NAME}}"), ("placeholder", "placeholder", "{{order name}}"), ("table-label", "table", "NameRole"),
    ]
    cell = next(r for r in found if r.kind == "cell")
    assert (cell.row, cell.col, cell.label, cell.table.rows, cell.section.table_count, cell.paragraph.text_preview) == (0, 0, "People of it", 2, 1, "Name")
    with pytest.raises(ValueError):
        discovery.find_targets(elements, P.styles(one))


def test_fill_with_new_rows(entries):
    """Records need three rows; what is planned is what is read back. The other document's last row is merged, so it stays as it was."""
    mapping = [
        {"placeholder": "{{ORDER_NAME}}", "value": "filled"}, {"anchor": "Name", "fields": ["n", "r"], "records": [{"n": str(i), "r": f"r{i}"} for i in range(3)], "expand": True},
        {"nearText": "Body text", "value": "new body", "mode": "paragraph-replace"},
    ]
    done, _ = fill.fill(entries, mapping)
    done = done.cache()
    errors = {r.doc_id: r.error for r in done.select("doc_id", "error").distinct().collect()}
    assert errors["/x/One Form.zip"] is None and "merged" in errors["two"]
    elements = P.flatten(done.where("error is null").drop("error"))
    cells = {(r.row, r.col): r.text for r in D.cells(elements).collect()}
    assert cells == {(0, 0): "Name", (0, 1): "Role"} | {(i + 1, 0): str(i) for i in range(3)} | {(i + 1, 1): f"r{i}" for i in range(3)}
    assert D.plain_text(D.paragraph_texts(elements)).first().text.split("\n")[0] == "filled" and D.plain_text(D.paragraph_texts(elements)).first().text.endswith("new body")


def test_unique_and_summary(spark, entries):
    one = entries.where("doc_id like '/x/%'")
    done, changes = fill.fill(one, [{"placeholder": "{{ORDER", "value": "x", "unique": True}, {"anchor": "Role", "value": "y", "mode": "table-down"}])
    assert {r.error for r in done.select("error").distinct().collect()} == {"statement 0 (fail): entry 0 has 2 targets"}
    elements = P.flatten(one)
    paragraphs = D.paragraph_texts(elements)
    tables = D.tables(elements, paragraphs, D.cells(elements))
    asked = fill.statements(spark, [{"anchor": "nowhere", "value": "z"}])
    rows = {(r.what, r.name, r.table_idx): r.changes for r in fill.summary(changes, tables, fill.misses(one, tables, changes.where("false"), asked)).collect()}
    assert rows == {("section", "Contents/section0.xml", None): 3, ("kind", "paragraph", None): 2, ("kind", "table-cell", None): 1, ("table", "Contents/section0.xml", 0): 1, ("miss", "anchor-not-found", None): 1}
    for bad in ({"anchor": "a", "values": ["x"], "unique": True, "mode": "table-right-repeat"}, {"anchor": "a", "value": "x", "expand": True, "mode": "table-right"}, {"anchor": "a", "value": "x", "occurrence": 0}):
        with pytest.raises(ValueError):
            fill.statements(spark, [bad])
    told = C.correlated([{"index": 0}], changes, changes.where("false"), [{"sourceIndex": 0}])
    assert told[0]["changeCount"] == 2 and told[0]["missCount"] == 0


def test_round_trip_and_gate(spark, entries):
    archives, gate = X.safe_pack(entries)
    assert {r.doc_id: r.blocked for r in gate.collect()} == {"/x/One Form.zip": [], "two": ["render-safe=false"]} and [r.doc_id for r in archives.select("doc_id").collect()] == ["/x/One Form.zip"]
    one = entries.where("doc_id like '/x/%'")
    changed = E.apply(one, E.statements(spark, [("/x/One Form.zip", "set-paragraph-text", {"index": 1, "text": "other"}), ("/x/One Form.zip", "add-line", {"width_mm": 5, "height_mm": 1}), ("/x/One Form.zip", "set-header", {"texts": "h"}), ("/x/One Form.zip", "add-section", {"texts": ["s"]})]))
    codes = {r.code for r in X.round_trip(one, changed.drop("error")).collect()}
    assert {"section-count-changed", "object-count-changed", "header-count-changed", "control-count-changed", "text-digest-changed", "placeholder-count-changed", "paragraph-changed", "object-changed", "header-footer-changed", "control-changed", "risk-added", "render-safe-changed"} <= codes
    assert X.round_trip(one, one).count() == 0


def test_unpack_images_paths(spark, entries, tmp_path):
    told = P.unpack(entries.where("doc_id = 'two'").union(spark.createDataFrame([("two", "../out", b"x")], P.ENTRIES)), str(tmp_path)).collect()
    folder = tmp_path / told[0].folder
    assert {r.path for r in told if not r.written} == {"../out"} and told[0].folder.startswith("two-") and (folder / "Contents" / "header.xml").exists() and not (tmp_path / "out").exists()
    apart = P.unpack(spark.createDataFrame([("/a/x.zip", "p", b"1"), ("/b/x.zip", "p", b"2")], P.ENTRIES), str(tmp_path)).collect()
    assert len({r.folder for r in apart}) == 2 and {(tmp_path / r.folder / "p").read_bytes() for r in apart} == {b"1", b"2"}
    back = P.read(spark, str(folder))
    assert {r.path for r in back.collect()} == {r.path for r in entries.where("doc_id = 'two'").collect()}
    assert P.next_ids(P.flatten(entries)).count() == 2 and P.entry_names(entries).where("doc_id = 'two'").first().paths == sorted(parts())


def test_reader_survives_broken_parts(spark):
    deep = b"<sec>" + b"<a>" * 3000 + b"</a>" * 3000 + b"</sec>"
    odd = b'<sec><p><run><tbl rowCnt="x"><tr><tc><cellAddr rowAddr="a" colAddr=""/></tc></tr></tbl></run></p></sec>'
    rows = [("broken", "section0.xml", b"<sec><p>"), ("deep", "section0.xml", deep), ("odd", "section0.xml", odd), ("none", "section0.xml", b"")]
    elements = P.walked(spark.createDataFrame(rows, P.ENTRIES)).cache()
    counts = {r.doc_id: r.n for r in elements.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"broken": 1, "deep": 3001, "odd": 7, "none": 1} and {r.doc_id for r in elements.where("tag = '#error'").collect()} == {"broken", "none"}
    cell = D.cells(elements).first()
    assert (cell.row, cell.col, cell.row_span) == (0, 0, 1)


def test_nested_paragraphs_scripts_and_objects(spark):
    ns = 'xmlns:hp="p"'
    section = (
        f'<sec {ns}><hp:p styleIDRef="0"><hp:run><hp:t>outer</hp:t><hp:tbl rowCnt="1" colCnt="1"><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>in<hp:lineBreak/>side</hp:t></hp:run></hp:p><hp:p><hp:run><hp:t>two</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr></hp:tbl>'
        "<hp:equation><hp:script>a over b</hp:script></hp:equation><hp:pic binaryItemIDRef='img1'/><hp:line/><hp:ellipse/><hp:rect/><hp:rect><hp:drawText><hp:subList><hp:p><hp:run><hp:t>boxed</hp:t></hp:run></hp:p></hp:subList></hp:drawText></hp:rect></hp:run></hp:p></sec>"
    )
    entries = spark.createDataFrame([("d", "section0.xml", section.encode()), ("d", "Contents/header.xml", b"<head/>")], P.ENTRIES)
    elements = P.walked(entries)
    paragraphs, cells = D.paragraph_texts(elements), D.cells(elements)
    assert D.plain_text(paragraphs).first().text == "outera over b\nin\nside\ntwo\nboxed"
    b = D.blocks(paragraphs, D.tables(elements, paragraphs, cells), cells, P.styles(entries), elements)
    assert D.export(b, "markdown").first().out.split("\n\n") == ["outer", "| in<br>sidetwo |\n| --- |", "[Equation: a over b]", "[Image: img1]", "[Line]", "[Ellipse]", "[Rectangle]", "boxed"]
    assert D.find_by_path(elements, "//tc//p[2]/run").count() == 1 and D.find_by_path(elements, "/sec/p[@styleIDRef='0']").count() == 1 and D.find_by_path(elements, "//rect[drawText]").count() == 1
    with pytest.raises(ValueError):
        D.find_by_path(elements, "p[position()=1]")


def test_fill_stores_what_its_statements_read(entries, monkeypatch):
    """Anchors without labels read tables and cells; with a label, or beside other selectors, paragraphs too. The changes are the planner's own."""
    asked = []
    stored = fill.stored
    monkeypatch.setattr(fill, "stored", lambda e, **more: (asked.append(more.get("tags")), stored(e, **more))[1])
    one = entries.where("doc_id like '/x/%'")
    elements = P.flatten(one)
    paragraphs, cells = D.paragraph_texts(elements), D.cells(elements)
    plain = {"anchor": "Role", "value": "y", "mode": "table-down"}
    for mapping in ([plain], [plain | {"tableLabel": "People"}], [plain | {"tableLabel": "nowhere"}], [plain, {"nearText": "Body text", "value": "b", "mode": "paragraph-replace"}]):
        _, changes = fill.fill(one, mapping)
        want = fill.planned(paragraphs, D.tables(elements, paragraphs, cells), cells, D.spans(cells), fill.statements(one.sparkSession, mapping))
        assert sorted(map(tuple, changes.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert asked == [{"tc", "tbl"}, *[{"tc", "tbl", "p"}] * 3]
