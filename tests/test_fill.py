"""The fill planner and the snapshot diff on the package of test_document."""

import pytest

from folioframe.operators import diff as X
from folioframe.operators import document as D
from folioframe.plans import fill
from tests.test_document import entries, parts  # noqa: F401


def test_modes_and_misses(spark, parts, entries):  # noqa: F811
    _, paragraphs, cells, tables = parts
    asked = fill.statements(spark, [
        {"placeholder": "{{ORDER_TITLE}}", "value": "제목"},
        {"anchor": "담당 부서", "value": "새 기관", "tableLabel": "모음"},
        {"nearText": "차례 설명", "values": ["가", "나"]},
        {"anchor": "품목 이름", "grid": [["1", "2"], ["3", "4"]], "mode": "table_down_grid"},
        {"anchor": "없음", "value": "x"},
        {"anchor": "품목 이름", "value": "x", "tableIndex": 7},
        {"anchor": "담당 부서", "values": ["p", "q"], "mode": "table-right-repeat"},
        {"placeholder": "{{NO}}", "value": "x", "required": True},
    ])
    changes = fill.planned(paragraphs, tables, cells, D.grid(cells), asked).cache()
    got = {(r.rid, r.k): (r.all_p_idx if r.table_idx is None else (r.row, r.col), r.new_text) for r in changes.collect()}
    assert got == {
        (0, 0): (1, "제목"), (1, 0): ((1, 1), "새 기관"), (2, 0): (1, "가"), (2, 1): (2, "나"),
        (3, 0): ((1, 0), "1"), (3, 1): ((1, 1), "2"), (6, 0): ((1, 1), "p"),
    }
    final = {(r.all_p_idx, r.row, r.col): r.new_text for r in fill.last_wins(changes).collect()}
    assert final[(None, 1, 1)] == "p" and final[(1, None, None)] == "가"
    missed = {r.rid: (r.reason, r.requested, r.matched) for r in fill.misses(entries, tables, changes, asked).collect()}
    assert missed == {
        3: ("insufficient-target-capacity", 4, 2), 4: ("anchor-not-found", 1, 0), 5: ("table-index-not-found", 1, 0),
        6: ("insufficient-target-capacity", 2, 1), 7: ("required-target-not-found", 1, 0),
    }


def test_bad_statements(spark):
    for bad in ({"value": "x"}, {"anchor": "a", "nearText": "b", "value": "x"}, {"anchor": "a", "values": ["x"], "mode": "table-right"}):
        with pytest.raises(ValueError):
            fill.statements(spark, [bad])


def test_diff(spark):
    rows = lambda *said: spark.createDataFrame([("d", i, s) for i, s in enumerate(said)] + [("same", 0, "x")], "doc_id string, position int, said string")
    found = {(r.code, r.position) for r in X.compare(rows("a", "b"), rows("a", "c", "d"), "paragraph").collect()}
    assert found == {("paragraph-count-changed", None), ("paragraph-changed", 1), ("paragraph-added", 2)}
