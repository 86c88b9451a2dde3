"""Targets of an edit: paragraphs, cells, tables and placeholders that say a text, with what is around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import document as D
from folioframe.operators.document import SECTION
from folioframe.sources.store import kept

PLACE = ["kind", "all_p_idx", "table_idx", "row", "col"]


def contains_normalized(value: Column, query: str) -> Column:
    """Case and outer blanks aside; an empty query is in nothing."""
    query = query.strip().lower()
    return F.lower(T.trim_unicode(value)).contains(query) if query else F.lit(False)


def _rows(df: DataFrame, query_type: str, query: str, kind: str, order: int, **columns: Column) -> DataFrame:
    none = {c: F.lit(None).cast("int") for c in ("all_p_idx", "table_idx", "row", "col", "row_span", "col_span")} | {c: F.lit(None).cast("string") for c in ("label", "text", "reason", "style_summary")}
    told = none | columns
    return df.select(*SECTION, F.lit(query_type).alias("query_type"), F.lit(query).alias("query"), F.lit(kind).alias("kind"), F.lit(order).alias("o"), columns.get("at", F.lit(0)).cast("int").alias("at"), *[c.alias(n) for n, c in told.items() if n != "at"])


def find_targets(elements: DataFrame, style_rows: DataFrame, *, anchor: str = "", near_text: str = "", table_label: str = "", placeholder: str = "") -> DataFrame:
    """Matches of up to four queries, the first of each place, with section, table and paragraph context.

    An anchor and a near text are looked for in body paragraphs, table labels and cells; a table label
    in labels and previews; a placeholder among placeholder candidates.
    """
    paragraphs = D.style_names(D.paragraph_texts(elements), style_rows).withColumn("said", T.trim_unicode(F.col("text_t"))).where("said <> ''")
    cell_rows = D.cells(elements).withColumn("said", T.truncate_bytes(T.trim_unicode(F.col("text")), 120))
    every = D.paragraph_texts(elements)
    table_rows = kept(D.tables(elements, every, D.cells(elements)), "tables")
    section_rows = D.sections(elements, every, table_rows)
    c, out = F.col, []
    of_table = {"table_idx": c("table_idx"), "label": c("label"), "text": c("text_preview"), "at": c("table_idx")}
    labels = table_rows.select(*SECTION, "table_idx", "label")
    for n, (kind, query) in enumerate((("anchor", anchor), ("near-text", near_text))):
        q = query.strip().lower()
        if not q:
            continue
        body = paragraphs.where(c("table_idx").isNull() & contains_normalized(c("said"), q))
        out.append(_rows(body, kind, q, "paragraph", 10 * n, all_p_idx=c("all_p_idx"), text=c("said"), style_summary=c("style_summary"), at=c("all_p_idx")))
        out.append(_rows(table_rows.where(contains_normalized(c("label"), q)), kind, q, "table", 10 * n + 1, **of_table))
        held = cell_rows.where(contains_normalized(c("said"), q)).join(labels, [*SECTION, "table_idx"])
        out.append(_rows(held, kind, q, "cell", 10 * n + 1, table_idx=c("table_idx"), row=c("row"), col=c("col"), row_span=c("row_span"), col_span=c("col_span"), label=c("label"), text=c("said"), at=c("table_idx")))
    if q := table_label.strip().lower():
        hit = contains_normalized(c("label"), q) | contains_normalized(c("text_preview"), q)
        out.append(_rows(table_rows.where(hit), "table-label", q, "table", 20, **of_table))
    if q := placeholder.strip().lower():
        marked = paragraphs.withColumn("reason", T.is_placeholder(c("said"))).where(c("reason").isNotNull() & contains_normalized(c("said"), q))
        out.append(_rows(marked, "placeholder", q, "placeholder", 30, all_p_idx=c("all_p_idx"), table_idx=c("table_idx"), row=c("cell_row"), col=c("cell_col"), text=c("said"), reason=c("reason"), style_summary=c("style_summary"), at=c("all_p_idx")))
    if not out:
        raise ValueError("at least one query is needed")
    found = reduce(DataFrame.unionByName, out)
    first = W.partitionBy(*SECTION, "query_type", *PLACE).orderBy("o", "at", "text")
    found = kept(found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "o", "at"), "targets")
    return with_context(found, section_rows, table_rows, paragraphs)


def with_context(found: DataFrame, section_rows: DataFrame, table_rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """found with structs ``section``, ``table`` and ``paragraph``; null where there is none.

    The paragraph is the one named by index, else of the cell's paragraphs the first that says the query, else the first.
    """
    near = ["paragraph_count", "table_count", "merged_cell_count", "placeholder_count", "guide_count", "has_header", "has_footer", "has_page_number", "text_preview", "role", "role_hints"]
    around = section_rows.select(*SECTION, F.struct(*near).alias("section"))
    inside = ["rows", "cols", "merged_cells", "paragraph_count", "placeholder_count", "guide_count", "anchor_count", "nested_depth", "label", "text_preview", "anchor_hints", "role", "role_hints"]
    holding = table_rows.select(*SECTION, "table_idx", F.struct(*inside).alias("table"))
    said = F.struct("style_summary", T.truncate_bytes(F.col("said"), 120).alias("text_preview")).alias("paragraph")
    of_index = paragraphs.select(*SECTION, "all_p_idx", said)
    key = [*SECTION, "table_idx", "row", "col"]
    in_cell = paragraphs.where("table_idx is not null and cell_row is not null").select(*SECTION, "table_idx", F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), F.col("all_p_idx").alias("i"), "said", F.struct("style_summary", T.truncate_bytes(F.col("said"), 120).alias("text_preview")).alias("p"))
    asked = found.where("kind = 'cell'").select(*key, "query").distinct()
    best = asked.join(in_cell, key).groupBy(*key, "query").agg(F.min_by("p", F.struct(~F.lower("said").contains(F.col("query")), "i")).alias("in_cell"))
    out = found.join(around, SECTION, "left").join(holding, [*SECTION, "table_idx"], "left").join(of_index, [*SECTION, "all_p_idx"], "left").join(best, [*key, "query"], "left")
    return out.withColumn("paragraph", F.coalesce("paragraph", "in_cell")).drop("in_cell", "query")
