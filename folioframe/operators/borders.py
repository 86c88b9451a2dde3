"""Lines between cells as relations: what two cells share, the rim of a table, the outline and size of a merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators.document import SECTION
from folioframe.sources import package as P

TABLE = [*SECTION, "table_idx"]
SIDES = ("left", "right", "top", "bottom")
#: Fixed value: the border fill of cells that name none, or one that is not there.
DEFAULT = "3"


def fills(entries: DataFrame) -> DataFrame:
    """(doc_id, border_id, a struct(kind, width, color) for each side, face): the border fills of the header; of several with an id the first stands."""
    e = P.flatten(entries, r"^Contents/header\.xml$").withColumn("own", F.regexp_extract("path", r"^(.*/borderFill\[\d+\])", 1)).where("own <> ''")
    said = lambda name: F.trim(F.coalesce(F.col("attrs")[name], F.lit("")))
    line = F.struct(F.upper(said("type")).alias("kind"), said("width").alias("width"), F.upper(said("color")).alias("color"))
    face = F.nullif(F.nullif(F.upper(said("faceColor")), F.lit("")), F.lit("NONE"))
    one = e.groupBy("doc_id", "own").agg(
        F.min("pre").alias("pre"), F.max(F.when(F.col("tag") == "borderFill", said("id"))).alias("border_id"),
        *[F.min_by(line, F.when(F.col("tag") == f"{side}Border", F.col("pre"))).alias(side) for side in SIDES], F.min_by(face, F.when(F.col("tag") == "winBrush", F.col("pre"))).alias("face"),
    )
    return one.groupBy("doc_id", "border_id").agg(*[F.min_by(c, "pre").alias(c) for c in (*SIDES, "face")])


def strength(line: Column) -> Column:
    """Null for lines that can't be seen; else a hundred times the width in millimetres and the kind's rank."""
    width = F.coalesce(F.regexp_extract(line["width"], r"^([0-9.]+) *(mm|MM)?$", 1).try_cast("double"), F.lit(0.0))
    return F.when(~F.coalesce(line["kind"], F.lit("")).isin("", "NONE"), T.border_strength(line["kind"], width))


def lined(elements: DataFrame, entries: DataFrame, grid_rows: DataFrame) -> DataFrame:
    """Grid places with the size, the fill and, for each side, struct(kind, width, color, strength) of the cell that covers them."""
    named = F.coalesce(F.nullif(F.trim(F.col("attrs")["borderFillIDRef"]), F.lit("")), F.lit(DEFAULT))
    own = elements.where("tag = 'tc'").select(*TABLE, F.col("cell_row").alias("anchor_row"), F.col("cell_col").alias("anchor_col"), "width", "height", named.alias("border_id"))
    known = fills(entries)
    spare = known.where(F.col("border_id") == DEFAULT).select("doc_id", F.struct(*SIDES, "face").alias("spare"))
    found = own.join(known.select("doc_id", "border_id", F.struct(*SIDES, "face").alias("found")), ["doc_id", "border_id"], "left").join(spare, "doc_id", "left")
    found = found.withColumn("f", F.coalesce("found", "spare"))
    sides = [F.struct(*[F.col(f"f.{s}.{c}").alias(c) for c in ("kind", "width", "color")], strength(F.col(f"f.{s}")).alias("strength")).alias(s) for s in SIDES]
    styled = found.select(*TABLE, "anchor_row", "anchor_col", "width", "height", "border_id", F.col("f.face").alias("face"), *sides)
    # of cells that claim one address the grid keeps one; a covered cell of no size has an address of its own
    return grid_rows.join(styled, [*TABLE, "anchor_row", "anchor_col"])


def _strongest(line: Column, *order: Column) -> Column:
    """The strongest line that can be seen; of equal ones the first."""
    return F.max_by(line, F.when(line["strength"].isNotNull(), F.struct(line["strength"], *[-o for o in order])))


def normalized(places: DataFrame) -> DataFrame:
    """(table, row, col of a cell, side, line): each line that a cell gets.

    A line that two cells share becomes the stronger one in both; the rim of a table gets its
    strongest line on each side; of several for one side of a cell the strongest. Lines that can't
    be seen change nothing. Every place goes to the four edges around it, so an edge is a group of
    one or two rows and no self-join is needed.
    """
    at = {"left": ("v", "row", "col - 1"), "right": ("v", "row", "col"), "top": ("h", "row - 1", "col"), "bottom": ("h", "row", "col")}
    edges = [F.struct(F.lit(kind).alias("kind"), F.expr(r).alias("r"), F.expr(c).alias("c"), F.lit(side).alias("side"), F.col(side).alias("line")) for side, (kind, r, c) in at.items()]
    met = places.select(*TABLE, "anchor_row", "anchor_col", F.explode(F.array(*edges)).alias("e")).select(*TABLE, "anchor_row", "anchor_col", "e.*")
    who = F.struct("anchor_row", "anchor_col", "side")
    first = F.col("side").isin("left", "top").cast("int")  # the cell before the edge knows it as its right or bottom
    shared = met.groupBy(*TABLE, "kind", "r", "c").agg(F.collect_list(who).alias("cells"), _strongest(F.col("line"), first).alias("line"))
    differ = F.expr("size(cells) = 2 and (cells[0].anchor_row, cells[0].anchor_col) <> (cells[1].anchor_row, cells[1].anchor_col)")
    inner = shared.where(differ & F.col("line").isNotNull()).select(*TABLE, F.explode("cells").alias("x"), "line").select(*TABLE, "x.*", "line")

    size = places.groupBy(*TABLE).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    rim = {"top": ("row = 0", "col"), "bottom": ("row = rows", "col"), "left": ("col = 0", "row"), "right": ("col = cols", "row")}
    on = [F.when(F.expr(c), F.struct(F.lit(side).alias("side"), F.col(k).alias("k"), F.col(side).alias("line"))) for side, (c, k) in rim.items()]
    around = places.join(size, TABLE).select(*TABLE, "anchor_row", "anchor_col", F.explode(F.array_compact(F.array(*on))).alias("e")).select(*TABLE, "anchor_row", "anchor_col", "e.*")
    best = around.groupBy(*TABLE, "side").agg(_strongest(F.col("line"), F.col("k")).alias("line")).where("line is not null")
    outer = around.drop("line", "k").distinct().join(best, [*TABLE, "side"])

    got = inner.unionByName(outer).groupBy(*TABLE, F.col("anchor_row").alias("row"), F.col("anchor_col").alias("col"), "side")
    return got.agg(_strongest(F.col("line")).alias("line"))


def merged(places: DataFrame, areas: DataFrame) -> DataFrame:
    """What cell a merge of each area (table, row_from, col_from, row_to, col_to) makes.

    The outline keeps the strongest line that can be seen on each side (null: none), the fill is the
    first cell's, else the first in reading order; the size is the sum of the distinct cells' widths
    in the top row and heights in the left column. ``whole`` is false if the area leaves the table
    or a cell crosses its border.
    """
    inside = places.join(areas, TABLE).where("row between row_from and row_to and col between col_from and col_to")
    side = {"top": ("row = row_from", "col"), "bottom": ("row = row_to", "col"), "left": ("col = col_from", "row"), "right": ("col = col_to", "row")}
    lines = [_strongest(F.when(F.expr(c), F.col(s)), F.col(k)).alias(s) for s, (c, k) in side.items()]
    total = lambda c, size: F.aggregate(F.collect_set(F.when(F.expr(c), F.struct("anchor_row", "anchor_col", size))), F.lit(0), lambda a, x: a + x[size]).alias(size)
    fits = F.expr("anchor_row >= row_from and anchor_col >= col_from and anchor_row + row_span - 1 <= row_to and anchor_col + col_span - 1 <= col_to")
    area = F.expr("(row_to - row_from + 1) * (col_to - col_from + 1)")
    out = inside.groupBy(*TABLE, "row_from", "col_from", "row_to", "col_to").agg(
        *lines, F.min_by("face", F.when(F.col("face").isNotNull(), F.struct("row", "col"))).alias("face"), total("row = row_from", "width"), total("col = col_from", "height"),
        F.every(fits).alias("fits"), F.count("*").alias("n"),
    )
    return out.withColumn("whole", F.col("fits") & (F.col("n") == area)).drop("fits", "n")
