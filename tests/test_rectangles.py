"""Cells as rectangles: lookups and overlaps against all places written out, spans of any size, dead cells, repeated addresses."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from folioframe.operators import document as D
from folioframe.operators import rectangles as R
from folioframe.plans import fill
from folioframe.sources import package as P
from tests.test_document import cell, para

CELL = "doc_id string, section_idx int, section_path string, table_idx int, row int, col int, row_span int, col_span int, width int, height int, text string"


def cells(spark, tables: dict[str, list[tuple]]):
    return spark.createDataFrame([(d, 0, "s", 0, *r) for d, rows in tables.items() for r in rows], CELL)


def disjoint(rng: random.Random, size: int) -> list[tuple]:
    """Cells that fill a square, some merged, each with dead cells below it."""
    free = {(r, c) for r in range(size) for c in range(size)}
    out = []
    for r, c in sorted(free):
        if (r, c) in free:
            h, w = rng.choice([(1, 1), (1, 1), (2, 1), (1, 3), (3, 2), (5, 5)])
            box = {(r + i, c + j) for i in range(h) for j in range(w)}
            h, w, box = (h, w, box) if box <= free else (1, 1, {(r, c)})
            free -= box
            out += [(r, c, h, w, 9, 9, "x")] + [(i, j, 1, 1, 0, 0, " ") for i, j in sorted(box)[1:] if rng.random() < 0.5]
    return out


def test_lookup_equals_all_places(spark):
    rng = random.Random(7)
    tables = {f"d{i}": disjoint(rng, 12) for i in range(6)} | {"gap": [(0, 0, 1, 1, 9, 9, "a"), (3, 3, 1, 1, 0, 0, ""), (5, 0, 2, 9, 9, 9, "")], "none": []}
    want = {}
    for d, rows in tables.items():
        for r, c, h, w, *size, _ in sorted(rows, key=lambda x: x[4] > 0):  # live cells last, over the dead
            for i in range(h):
                for j in range(w):
                    want[d, r + i, c + j] = (r, c)
    made = cells(spark, tables)
    places = spark.createDataFrame([(d, 0, "s", 0, r, c) for d in tables for r in range(-1, 14) for c in range(-1, 14)], "doc_id string, section_idx int, section_path string, table_idx int, r int, c int")
    got = {(x.doc_id, x.r, x.c): (x.row, x.col) for x in R.covering(places, D.spans(made)).collect()}
    assert len(got) == places.count() and {k: v for k, v in got.items() if v[0] is not None} == want
    assert {(x.doc_id, x.row, x.col): (x.anchor_row, x.anchor_col) for x in D.grid(made).collect()} == want
    assert D.overlaps(made).count() == 0


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(11)
    tables = {}
    for i in range(60):
        tables[f"t{i}"] = [(rng.randrange(9), rng.randrange(9), rng.choice([1, 1, 2, 4]), rng.choice([1, 1, 2, 4]), 9, 9, "x") for _ in range(rng.choice([2, 4, 8]))]
    meet = lambda a, b: a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    want = {d for d, rows in tables.items() if any(meet(a, b) for i, a in enumerate(rows) for b in rows[:i])}
    got = defaultdict(list)
    for x in D.overlaps(cells(spark, tables)).collect():
        got[x.doc_id].append((x.row, x.col, x.cells))
    assert set(got) == want and 0 < len(want) < 60
    for d, places in got.items():  # every place told is one of several cells
        assert all(sum(r <= i < r + h and c <= j < c + w for r, c, h, w, *_ in tables[d]) >= 2 and n >= 2 for i, j, n in places)


def test_spans_of_any_size(spark):
    """A span of 2^31 - 1 rows and columns costs what any cell does; an overlap is a row of its document."""
    far = (1 << 31) - 1
    tables = {"far": [(0, 0, 1, 1, 9, 9, "a"), (1, 0, far, far, 9, 9, "b")], "twice": [(0, 0, 60_000, 60_000, 9, 9, "a"), (7, 8, 1, 1, 9, 9, "b"), (9, 9, 1, 1, 0, 0, "")], "ok": [(0, 0, 1, 1, 9, 9, "a")]}
    made = cells(spark, tables)
    assert [(x.doc_id, x.row, x.col, x.cells) for x in D.overlaps(made).collect()] == [("twice", 7, 8, 2)]
    places = made.select(*R.TABLE).distinct().select(*R.TABLE, F.lit(2_000_000_000).alias("r"), F.lit(1_999_999_999).alias("c"))
    assert {x.doc_id: x.row for x in R.covering(places, D.spans(made)).collect()} == {"far": 1, "twice": None, "ok": None}
    assert D.spans(made).count() == 5 and "sequence(row" not in R.overlaps(made)._jdf.queryExecution().toString()


def test_fill_beside_a_far_span(spark):
    """Planning walks along rectangles: a cell of 60,000 rows is one step, and what lies below it is met."""
    far = cell(0, 1, "wide").replace('rowSpan="1"', 'rowSpan="60000"')
    body = f"<hp:p><hp:run><hp:tbl rowCnt='2' colCnt='3'><hp:tr>{cell(0, 0, 'label')}{far}{cell(0, 2, 'end')}</hp:tr><hp:tr>{cell(1, 0, 'low')}{cell(1, 2, 'x')}</hp:tr></hp:tbl></hp:run></hp:p>"
    parts = [("d", p, c) for _, p, c in P.blank() if "section0" not in p] + [("d", "Contents/section0.xml", f"<hs:sec xmlns:hp='p' xmlns:hs='s'>{para('t')}{body}</hs:sec>".encode())]
    elements = P.flatten(spark.createDataFrame(parts, P.ENTRIES))
    paragraphs, found = D.paragraph_texts(elements), D.cells(elements)
    assert found.agg(F.max("row_span")).first()[0] == 60_000
    asked = fill.statements(spark, [{"anchor": "label", "values": ["1", "2", "3"], "mode": "table-right-repeat"}, {"anchor": "low", "grid": [["p", "q"]], "mode": "table-right-grid"}, {"anchor": "x", "values": ["u"], "mode": "table-left-repeat"}])
    got = fill.planned(paragraphs, D.tables(elements, paragraphs, found), found, D.spans(found), asked)
    assert sorted((r.rid, r.row, r.col, r.new_text) for r in got.collect()) == [(0, 0, 1, "1"), (0, 0, 2, "2"), (1, 0, 1, "p"), (1, 1, 2, "q"), (2, 0, 1, "u")]


def test_sweep_takes_plain_rows():
    """Rows and columns of a table, no frame: two cells reach over a third, which has two shared places counted once each."""
    from folioframe.operators import rectangles

    assert rectangles._swept([(1, 0, 3, 3), (0, 0, 0, 0), (2, 2, 2, 2), (2, 2, 2, 2), (4, 0, 4, 0)]) == [(2, 2), (2, 2)]
