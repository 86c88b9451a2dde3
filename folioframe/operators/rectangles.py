"""Cells as rectangles of logical places: which cell covers a place, and which cells claim one place.

A merged cell stays one row however far it reaches. ``covering`` finds cells by equi-joins: a
rectangle belongs to the blocks of its own size, at most two by two of them, and a place looks into
one block of each size that its table has. ``overlaps`` sweeps over the rectangles of a table.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = ["doc_id", "section_idx", "section_path", "table_idx"]


def _level(length: Column) -> Column:
    """The least k with 2^k >= length."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def covering(places: DataFrame, spans: DataFrame) -> DataFrame:
    """places(table, r, c, ...) with the address (row, col) of the cell that covers each, null without one.

    Where several do, a cell with a size or text stands before one with neither, then the first in
    row order. Equal rows of places become one.
    """
    own = spans.withColumn("lr", _level(F.expr("row_to - row + 1"))).withColumn("lc", _level(F.expr("col_to - col + 1")))
    sizes = own.groupBy(*TABLE).agg(F.collect_set(F.struct("lr", "lc")).alias("sizes"))  # at most 32 x 32
    cells = own.select(*TABLE, "lr", "lc", "row", "col", "row_to", "col_to", "anchor_row", "anchor_col", "dead", F.explode(F.expr("sequence(shiftright(row, lr), shiftright(row_to, lr))")).alias("br"))
    cells = cells.withColumn("bc", F.explode(F.expr("sequence(shiftright(col, lc), shiftright(col_to, lc))")))
    asked = places.join(sizes, TABLE, "left").withColumn("_s", F.explode_outer("sizes")).select(
        *places.columns, F.col("_s.lr").alias("lr"), F.col("_s.lc").alias("lc"), F.expr("shiftright(cast(r as bigint), _s.lr)").alias("br"), F.expr("shiftright(cast(c as bigint), _s.lc)").alias("bc")
    )
    p, x = asked.alias("p"), cells.alias("x")
    same = [F.col(f"p.{k}") == F.col(f"x.{k}") for k in (*TABLE, "lr", "lc", "br", "bc")]
    inside = F.expr("p.r between x.row and x.row_to and p.c between x.col and x.col_to")
    met = p.join(x, [*same, inside], "left").groupBy(*[F.col(f"p.{k}") for k in places.columns])
    at = F.struct("x.anchor_row", "x.anchor_col")
    best = met.agg(F.min_by(at, F.when(F.col("x.anchor_row").isNotNull(), F.struct("x.dead", "x.anchor_row", "x.anchor_col"))).alias("a"))
    return best.select(*places.columns, F.col("a.anchor_row").alias("row"), F.col("a.anchor_col").alias("col"))


def standing(cell_rows: DataFrame) -> DataFrame:
    """A rectangle (row, col, row_to, col_to) for each cell, without the dead ones that a cell of several places covers.

    A cell of one place, no size and no text is dead. Equal rows stay.
    """
    dead = F.expr("row_span = 1 and col_span = 1 and width = 0 and height = 0 and trim(text) = ''")
    end = lambda c: (F.col(c).cast("bigint") + F.col(f"{c}_span") - 1).alias(f"{c}_to")
    every = cell_rows.select(
        *TABLE, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), end("row"), end("col"), F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col"),
        "row_span", "col_span", F.coalesce(dead, F.lit(False)).alias("dead"),
    )
    wide = every.where("row_span > 1 or col_span > 1")
    hidden = covering(every.where("dead").select(*TABLE, F.col("anchor_row").alias("r"), F.col("anchor_col").alias("c")), wide)
    hidden = hidden.where("row is not null").select(*TABLE, F.col("r").alias("anchor_row"), F.col("c").alias("anchor_col"), F.lit(True).alias("dead"))
    return every.join(hidden, [*TABLE, "anchor_row", "anchor_col", "dead"], "left_anti").select(*every.columns)


def spans(cell_rows: DataFrame) -> DataFrame:
    """``standing``, one rectangle an address: of several the live one, then the largest."""
    found = standing(cell_rows)
    size = F.struct(~F.col("dead"), F.col("row_to"), F.col("col_to"))
    rest = [c for c in found.columns if c not in (*TABLE, "anchor_row", "anchor_col")]
    best = found.groupBy(*TABLE, "anchor_row", "anchor_col").agg(F.max_by(F.struct(*rest), size).alias("x"))
    return best.select(*TABLE, "anchor_row", "anchor_col", "x.*").select(*found.columns)


def _swept(rows: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The first shared place of every rectangle that meets one taken before it, by rows and columns of their beginnings."""
    starts: list[int] = []  # of the rectangles that reach the current row: first columns, and (last column, last row) beside them
    ends: list[tuple[int, int]] = []
    leaving: list[tuple[int, int]] = []
    found = []
    for row, col, row_to, col_to in sorted(rows):
        while leaving and leaving[0][0] < row:
            i = bisect_left(starts, heapq.heappop(leaving)[1])
            del starts[i], ends[i]
        i = bisect_right(starts, col)
        if i and ends[i - 1][0] >= col:
            found.append((row, col))
        elif i < len(starts) and starts[i] <= col_to:
            found.append((row, starts[i]))
        else:
            starts.insert(i, col)
            ends.insert(i, (col_to, row_to))
            heapq.heappush(leaving, (row_to, col))
    return found


def overlaps(cell_rows: DataFrame) -> DataFrame:
    """(section, table_idx, row, col, cells): places that several cells claim; a document with one is not to be edited by its grid.

    One row for the first place that a cell shares with one before it. Tables whose cells are of one
    place each at an address of their own can't have any and are not swept.
    """
    found = standing(cell_rows)
    busy = found.groupBy(*TABLE).agg(F.max(F.expr("row_span > 1 or col_span > 1")).alias("wide"), F.count("*").alias("n"), F.countDistinct("row", "col").alias("m")).where("wide or n > m").select(*TABLE)

    def sweep(key: tuple, rows: pa.Table) -> pa.Table:
        places = Counter(_swept(zip(*(rows[c].to_pylist() for c in ("row", "col", "row_to", "col_to")), strict=True)))
        at = {c: pa.array([k.as_py()] * len(places), k.type) for c, k in zip(TABLE, key, strict=True)}
        told = {"row": [r for r, _ in places], "col": [c for _, c in places], "cells": [n + 1 for n in places.values()]}
        return pa.table(at | {c: pa.array(v, pa.int64()) for c, v in told.items()})

    kinds = dict(found.select(*TABLE).dtypes)
    return found.select(*TABLE, "row", "col", "row_to", "col_to").join(busy, TABLE, "left_semi").groupBy(*TABLE).applyInArrow(sweep, ", ".join(f"{c} {kinds[c]}" for c in TABLE) + ", row bigint, col bigint, cells bigint")
