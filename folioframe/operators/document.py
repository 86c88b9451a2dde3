"""Relational operators over flattened packages: paragraphs, tables, cells, search, checks, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators.rectangles import overlaps, spans  # noqa: F401
from folioframe.sources import package as P

#: A section: its document, its place in the spine (the order of reading) and its part.
SECTION = ["doc_id", "section_idx", "section_path"]


def section_paths() -> Column:
    """An aggregate: the parts of a document's sections in the order of the spine."""
    return F.transform(F.array_sort(F.collect_set(F.struct("section_idx", "section_path"))), lambda x: x["section_path"]).alias("section_paths")


def paragraph_texts(elements: DataFrame) -> DataFrame:
    """Every paragraph with its coordinates and texts, as the walk gathered them."""
    style = F.trim(F.coalesce(F.col("attrs")["styleIDRef"], F.lit(""))).alias("style_id")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("text_t", "text_tbt", "text_lines", "text_direct", "text_fill")]
    return elements.where("tag = 'p'").select(*SECTION, "pre", "last", "depth", "all_p_idx", "body_p_idx", "table_idx", "in_tables", "cell_row", "cell_col", style, "has_secpr", *texts, F.col("text_direct").alias("text_own"))


def table_labels(paragraphs: DataFrame) -> DataFrame:
    """(section, all_p_idx, label, fill_label): a paragraph's own text, else the last one before it in the section; section properties say nothing.

    label is for reports, fill_label for the planner (text boxes left out). Both as they stand: ``tables`` trims those of tables only.
    """
    w = W.partitionBy(*SECTION).orderBy("all_p_idx").rowsBetween(W.unboundedPreceding, 0)
    shown = ~F.coalesce("has_secpr", F.lit(False))
    carried = lambda said: F.last(F.when(T.says(said) & shown, said), ignorenulls=True).over(w)
    return paragraphs.select(*SECTION, "all_p_idx", carried(F.col("text_own")).alias("label"), F.when(shown, carried(F.col("text_fill"))).alias("fill_label"))


def cells(elements: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """One row a cell with address, spans, size, paragraph count and text (``text_all``: line breaks included)."""
    return elements.where("tag = 'tc'").select(
        *SECTION, "table_idx", "in_tables", "pre", F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), "row_span", "col_span", "width", "height", "paragraph_count",
        F.col("text_t").alias("text"), "text_all",
    )


def grid(cell_rows: DataFrame) -> DataFrame:
    """Every logical (row, col) with the cell that covers it. Where cells overlap the first in row order stands; ``overlaps`` has these places.

    A row a place: for what needs all of them. ``spans`` has a row a cell and serves the planner as well.
    """
    at = lambda c: F.explode(F.expr(f"sequence({c}, {c}_to)"))
    spread = spans(cell_rows).select(*SECTION, "table_idx", "anchor_row", "anchor_col", "row_span", "col_span", "dead", "col", "col_to", at("row").alias("r"))
    spread = spread.select("*", at("col").alias("c")).groupBy(*SECTION, "table_idx", "r", "c").agg(F.min_by(F.struct("anchor_row", "anchor_col", "row_span", "col_span"), F.struct("dead", "anchor_row", "anchor_col")).alias("a"))
    return spread.select(*SECTION, "table_idx", F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), "a.*")


def tables(elements: DataFrame, paragraphs: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """One row a table with size, nesting, label, preview, role and the counts of what is in it (nested tables included in merged_cells and paragraph_count)."""
    own = elements.where("tag = 'tbl'").select(
        *SECTION, "pre", "table_idx", "parent_table_idx", "all_p_idx", F.when(F.col("parent_table_idx").isNull(), 0).otherwise(1).alias("nested_depth"),
        F.expr("try_cast(attrs['rowCnt'] as int)").alias("declared_rows"), F.coalesce(F.expr("try_cast(attrs['colCnt'] as int)"), F.lit(0)).alias("cols"),
        T.truncate_bytes(T.trim_unicode(F.col("text_t")), 120).alias("text_preview"),
    )
    rows = elements.where("tag = 'tr'").groupBy(*SECTION, F.col("parent_pre").alias("pre")).agg(F.count("*").cast("int").alias("tr"))
    # what each table holds, from its cells and paragraphs at once; marks count where they stand, the rest in every table around
    text, none = T.trim_unicode(F.col("text_t")), F.lit(0)
    here = lambda mark: F.when((F.col("_t") == F.col("table_idx")) & (text != "") & mark.isNotNull(), 1).otherwise(0)
    of_cells = cell_rows.select(*SECTION, F.explode("in_tables").alias("table_idx"), F.expr("cast(row_span > 1 or col_span > 1 as int)").alias("m"), none.alias("p"), none.alias("h"), none.alias("g"))
    of_paragraphs = paragraphs.select(*SECTION, "table_idx", "text_t", F.explode("in_tables").alias("_t")).select(*SECTION, F.col("_t").alias("table_idx"), none.alias("m"), F.lit(1).alias("p"), here(T.is_placeholder(text)).alias("h"), here(T.is_guide(F.lower(text))).alias("g"))
    held = of_cells.unionByName(of_paragraphs).groupBy(*SECTION, "table_idx").agg(F.sum("m").alias("merged_cells"), F.sum("p").alias("paragraph_count"), F.sum("h").alias("placeholder_count"), F.sum("g").alias("guide_count"))
    out = own.join(rows, [*SECTION, "pre"], "left").join(table_labels(paragraphs), [*SECTION, "all_p_idx"], "left")
    out = out.withColumns({"label": T.trim_unicode(T.normalize_inline(F.col("label"))), "fill_label": T.trim_unicode(F.col("fill_label"))})
    for found in (held, anchor_hints(cell_rows)):
        out = out.join(found, [*SECTION, "table_idx"], "left")
    out = out.withColumn("rows", F.coalesce("declared_rows", "tr", F.lit(0))).fillna(0, ["merged_cells", "paragraph_count", "placeholder_count", "guide_count"])
    c = F.col
    out = out.withColumns({"label": T.truncate_bytes(F.coalesce("label", F.lit("")), 120), "fill_label": F.coalesce("fill_label", F.lit("")), "anchor_hints": F.coalesce("anchor_hints", F.array().cast("array<string>"))})
    out = out.withColumn("role", T.table_role(c("nested_depth"), c("rows"), c("cols")))
    hints = T.role_hints(c("role"), labeled_table=c("label") != "", contains_placeholders=c("placeholder_count") > 0, contains_guides=c("guide_count") > 0, nested_table=c("nested_depth") > 0, anchor_rich=F.size("anchor_hints") > 0)
    return out.select(*SECTION, "table_idx", "parent_table_idx", "nested_depth", "rows", "cols", "merged_cells", "paragraph_count", "placeholder_count", "guide_count", "label", "fill_label", "text_preview", "anchor_hints", F.size("anchor_hints").alias("anchor_count"), "role", hints.alias("role_hints"))


def table_kin(elements: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(section, table_idx, parent_table_idx, fill_label) of every table, as ``tables`` has them: what finding an anchor asks for; empty labels without paragraphs."""
    own = elements.where("tag = 'tbl'").select(*SECTION, "table_idx", "parent_table_idx", "all_p_idx")
    if paragraphs is None:
        return own.drop("all_p_idx").withColumn("fill_label", F.lit(""))
    labels = table_labels(paragraphs).select(*SECTION, "all_p_idx", "fill_label")
    out = own.join(labels, [*SECTION, "all_p_idx"], "left")
    return out.select(*SECTION, "table_idx", "parent_table_idx", F.coalesce(T.trim_unicode(F.col("fill_label")), F.lit("")).alias("fill_label"))


def anchor_hints(cell_rows: DataFrame) -> DataFrame:
    """Of each table up to eight distinct cell texts that can be anchors: those of the first row or column first."""
    text = T.collapse_blanks(F.col("text"))
    kept = cell_rows.select(*SECTION, "table_idx", (~F.expr("row = 0 or col = 0")).alias("late"), "pre", text.alias("text")).where(T.keeps_anchor(F.col("text")))
    once = kept.groupBy(*SECTION, "table_idx", "text").agg(F.min(F.struct("pre", "late")).alias("at"))
    w = W.partitionBy(*SECTION, "table_idx").orderBy("at.late", "at.pre")
    top = once.withColumn("k", F.row_number().over(w)).where("k <= 8")
    return top.groupBy(*SECTION, "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("anchor_hints"))


def candidates(paragraphs: DataFrame, reason: Column) -> DataFrame:
    """Paragraphs that a detector names: placeholders with ``T.is_placeholder``, guides with ``T.is_guide``."""
    return paragraphs.withColumn("text", T.trim_unicode(F.col("text_t"))).withColumn("reason", reason).where("text <> '' and reason is not null").select(*SECTION, "all_p_idx", "table_idx", "cell_row", "cell_col", "text", "reason")


def placeholders(paragraphs: DataFrame) -> DataFrame:
    return candidates(paragraphs, T.is_placeholder(T.trim_unicode(F.col("text_t"))))


def guides(paragraphs: DataFrame) -> DataFrame:
    return candidates(paragraphs, T.is_guide(F.lower(T.trim_unicode(F.col("text_t")))))


def sections(elements: DataFrame, paragraphs: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Counts, flags, preview and role of every section."""
    hidden = elements.where("tag = 'secPr'").select(*SECTION, "all_p_idx").distinct().withColumn("hidden", F.lit(True))
    seen = paragraphs.where("depth = 1").join(hidden, [*SECTION, "all_p_idx"], "left").where("hidden is null")
    said = T.truncate_bytes(T.trim_unicode(F.col("text_t")), 120)
    body = seen.groupBy(*SECTION).agg(F.count("*").alias("paragraph_count"), F.min_by(said, F.when(T.trim_unicode(F.col("text_t")) != "", F.col("pre"))).alias("text_preview"))
    count = lambda df, name: df.groupBy(*SECTION).agg(F.count("*").alias(name))
    spans = F.expr("tag = 'cellSpan' and (coalesce(try_cast(attrs['rowSpan'] as int), 1) > 1 or coalesce(try_cast(attrs['colSpan'] as int), 1) > 1)")
    flags = elements.groupBy(*SECTION).agg(*[F.max(F.col("tag") == tag).alias(name) for tag, name in (("header", "has_header"), ("footer", "has_footer"), ("pageNum", "has_page_number"))], F.count_if(spans).alias("merged_cell_count"))
    tabs = table_rows.groupBy(*SECTION).agg(F.count("*").alias("table_count"), F.count_if(F.expr("parent_table_idx is null")).alias("top_level_tables"))
    out = flags.join(body, SECTION, "left").join(tabs, SECTION, "left").join(count(placeholders(paragraphs), "placeholder_count"), SECTION, "left").join(count(guides(paragraphs), "guide_count"), SECTION, "left")
    out = out.fillna(0).fillna("", ["text_preview"]).withColumn("nested_table_count", F.col("table_count") - F.col("top_level_tables"))
    c = F.col
    out = out.withColumn("role", T.section_role(c("table_count"), c("top_level_tables"), c("paragraph_count"), c("placeholder_count"), c("guide_count")))
    return out.withColumn("role_hints", T.role_hints(c("role"), contains_placeholders=c("placeholder_count") > 0, contains_guides=c("guide_count") > 0, contains_tables=c("top_level_tables") > 0, contains_nested_tables=c("nested_table_count") > 0, page_decorated=c("has_header") | c("has_footer") | c("has_page_number")))


def with_anchor_counts(rows: DataFrame, anchor_rows: DataFrame, key: list[str]) -> DataFrame:
    """Sections (key SECTION) or tables (key SECTION and table_idx) with the number of their anchors; hints are left alone."""
    found = anchor_rows.where("table_idx is not null") if "table_idx" in key else anchor_rows
    counted = found.groupBy(*key).agg(F.count("*").alias("anchor_count"))
    return rows.drop("anchor_count").join(counted, key, "left").fillna(0, ["anchor_count"])


def anchors(paragraphs: DataFrame, table_rows: DataFrame, cell_rows: DataFrame, style_rows: DataFrame) -> DataFrame:
    """Anchor candidates of the three kinds, the first one of each (section, place, kind, text), ranked within their section."""
    where = [*SECTION, "table_idx", "row", "col"]
    none = lambda name: F.lit(None).cast("int").alias(name)
    labels = table_rows.select(*SECTION, "table_idx", none("row"), none("col"), F.col("table_idx").alias("seq"), F.lit("table-label").alias("kind"), F.lit("table-label").alias("role"), F.lit(100).alias("score"), T.collapse_blanks(F.col("label")).alias("text"))
    mark = T.cell_anchor(F.col("row"), F.col("col"))
    in_cells = cell_rows.withColumn("a", mark).where("a is not null").select(*where, F.col("pre").alias("seq"), F.lit("table-cell").alias("kind"), "a.role", "a.score", T.collapse_blanks(F.col("text")).alias("text"))
    style = paragraphs.where("table_idx is null").join(style_rows.select("doc_id", F.col("id").alias("style_id"), "name"), ["doc_id", "style_id"], "left")
    heading = F.lower(F.coalesce("name", F.lit(""))).rlike("heading|title")
    body = style.select(*SECTION, "table_idx", none("row"), none("col"), F.col("pre").alias("seq"), F.lit("paragraph").alias("kind"), F.when(heading, "section-heading").otherwise("paragraph-label").alias("role"), F.when(heading, 80).otherwise(60).alias("score"), T.collapse_blanks(F.col("text_t")).alias("text"))
    body = body.where(T.paragraph_anchor_shape(F.col("text")))
    every = labels.unionByName(in_cells).unionByName(body).where(T.keeps_anchor(F.col("text")))
    first = every.groupBy(*where, "kind", "text").agg(F.min(F.struct("seq", "role", "score")).alias("first")).select(*where, "kind", "text", "first.*")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*SECTION).orderBy(F.desc("score"), "kind", "text", "seq")) - 1)


def style_names(paragraphs: DataFrame, style_rows: DataFrame) -> DataFrame:
    """paragraphs with style_name and style_summary: ``name (id)``, ``style#id`` of an unknown id, empty of none."""
    known = style_rows.select("doc_id", F.col("id").alias("style_id"), F.col("name").alias("style_name"))
    out = paragraphs.join(known, ["doc_id", "style_id"], "left")
    named = F.concat("style_name", F.lit(" ("), "style_id", F.lit(")"))
    return out.withColumn("style_summary", F.when(F.col("style_id") == "", "").otherwise(F.coalesce(named, F.concat(F.lit("style#"), "style_id")))).fillna("", ["style_name"])


def headings(paragraphs: DataFrame, style_rows: DataFrame, most: int = 3) -> DataFrame:
    """(section, all_p_idx, level, text, nth) of body paragraphs in a heading style up to a level, in order."""
    level = T.heading_level(F.col("style_name"), cap=None, title=False)
    rows = style_names(paragraphs.where("depth = 1 and body_p_idx is not null"), style_rows).withColumn("level", level).where((F.col("level") <= most) & (T.trim_unicode(F.col("text_tbt")) != ""))
    return rows.select(*SECTION, "all_p_idx", "level", T.trim_unicode(F.col("text_tbt")).alias("text"), (F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "all_p_idx")) - 1).alias("nth"))


def find_guides(paragraphs: DataFrame, reason: str | None = None, section: int | None = None) -> DataFrame:
    """Guide candidates, of one reason in any case if given, of one section by its place if given."""
    found = guides(paragraphs if section is None else paragraphs.where(F.col("section_idx") == section))
    return found.where(F.col("reason") == reason.strip().lower()) if reason else found


def find_by_path(elements: DataFrame, path: str) -> DataFrame:
    """Elements by a path: steps of names or ``*`` after ``/`` or ``//``, each with ``[n]`` (from 1), ``[@a]``, ``[@a='v']`` or ``[tag]``.

    A subset of XPath, over the flattened form: every step is an equi-join with the parent's number,
    or, for ``//``, with the numbers of all ancestors, which every element carries. A path that
    starts with one ``/`` starts at the root. Matches are numbered in the order of the spine.
    """
    steps = re.findall(r"(//?|^)\s*([\w.:*-]+)((?:\[[^\]]*\])*)", path.strip())
    if not steps or "".join("".join(x) for x in steps).replace(" ", "") != path.strip().replace(" ", ""):
        raise ValueError(f"unknown path: {path}")
    now: DataFrame | None = None
    for axis, name, tests in steps:
        named = elements if name == "*" else elements.where(F.col("tag") == name.rsplit(":", 1)[-1])
        if now is None:
            found = named.where("depth = 0") if axis == "/" else named
        elif axis == "//":
            below = named.select(*SECTION, "pre", F.explode("above").alias("up"))
            hits = below.join(now.select(*SECTION, F.col("pre").alias("up")), [*SECTION, "up"], "left_semi").select(*SECTION, "pre").distinct()
            found = named.join(hits, [*SECTION, "pre"], "left_semi")
        else:
            found = named.join(now.select(*SECTION, F.col("pre").alias("parent_pre")), [*SECTION, "parent_pre"], "left_semi")
        for test in re.findall(r"\[([^\]]*)\]", tests):
            attr = re.fullmatch(r"@([\w.:-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"))?", test.strip())
            if test.strip().isdigit():
                w = W.partitionBy(*SECTION, "parent_pre", *([] if name == "*" else ["tag"])).orderBy("pre")
                found = found.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == int(test)).drop("_nth")
            elif attr:
                value = F.col("attrs")[attr[1].rsplit(":", 1)[-1]]
                wanted = attr[2] if attr[2] is not None else attr[3]
                found = found.where(value.isNotNull() if wanted is None else value == wanted)
            elif re.fullmatch(r"[\w.:-]+", test.strip()):
                kids = elements.where(F.col("tag") == test.strip().rsplit(":", 1)[-1]).select(*SECTION, F.col("parent_pre").alias("pre"))
                found = found.join(kids, [*SECTION, "pre"], "left_semi")
            else:
                raise ValueError(f"unknown test: [{test}]")
        now = found
    return now.withColumn("match_index", F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "pre")) - 1)


def find_by_tag(elements: DataFrame, tag: str) -> DataFrame:
    return elements.where(F.col("tag") == tag.rsplit(":", 1)[-1])


def find_by_attr(elements: DataFrame, name: str, value: str | None = None, tag: str | None = None) -> DataFrame:
    rows = elements.select("*", F.explode("attrs").alias("attr", "value")).where(F.col("attr") == name.rsplit(":", 1)[-1])
    if value is not None:
        rows = rows.where(F.col("value") == value)
    return find_by_tag(rows, tag) if tag else rows


def objects(elements: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Tables, images, equations and drawings with kind and id; a rectangle with text in it is a text box."""
    boxed = elements.where("tag = 'drawText'").select(*SECTION, F.col("parent_pre").alias("pre")).distinct().withColumn("boxed", F.lit(True))
    c = F.col("tag")
    kind = (
        F.when(c == "tbl", "table").when(c == "pic", "image").when(c.isin("equation", "line", "ellipse"), c)
        .when((c == "rect") & F.col("boxed"), "textbox").when(c == "rect", "rectangle")
    )
    blank = lambda k: F.nullif(F.trim(F.col("attrs")[k]), F.lit(""))
    rows = elements.join(boxed, [*SECTION, "pre"], "left").withColumn("kind", kind).where("kind is not null").withColumn("object_id", F.coalesce(blank("id"), blank("instid"), blank("itemIDRef"), F.lit("")))
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def runs(elements: DataFrame, props: DataFrame) -> DataFrame:
    """Direct runs of body paragraphs with text and character properties; an unknown reference has the defaults."""
    r = elements.where("tag = 'run' and body_p_idx is not null and depth = 2").select(*SECTION, "pre", "body_p_idx", "run_idx", F.coalesce(F.nullif(F.trim(F.col("attrs")["charPrIDRef"]), F.lit("")), F.lit("0")).alias("id"))
    said = elements.where("tag = 't'").groupBy(*SECTION, F.col("parent_pre").alias("pre")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pre").alias("o"), "text"))), lambda x: x["text"]), "").alias("text"))
    out = r.join(said, [*SECTION, "pre"], "left").join(props, ["doc_id", "id"], "left")
    defaults = {"bold": False, "italic": False, "underline": False, "color": "#000000", "font": "", "size_pt": 10.0, "text": ""}
    return out.select(*SECTION, "body_p_idx", "run_idx", F.col("id").alias("char_pr_id"), *[F.coalesce(c, F.lit(d)).alias(c) for c, d in defaults.items()])


def find_runs_by_style(run_rows: DataFrame, *, bold=None, italic=None, underline=None, color=None, font=None, size_pt=None) -> DataFrame:
    """Runs that meet every given condition; at least one is needed."""
    wanted = [F.col(n) == v for n, v in (("bold", bold), ("italic", italic), ("underline", underline)) if v is not None]
    wanted += [F.lower(n) == v.lower() for n, v in (("color", color), ("font", font)) if v is not None]
    if size_pt is not None:
        wanted.append(F.abs(F.col("size_pt") - size_pt) < 0.01)
    if not wanted:
        raise ValueError("at least one condition is needed")
    for w in wanted:
        run_rows = run_rows.where(w)
    return run_rows


def report(entries: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, valid): required entries, spine references, manifest presence, section count."""
    docs = P.paths(entries).groupBy("doc_id").agg(F.collect_set("path").alias("paths"))
    missing = docs.select("doc_id", F.explode(F.array_except(F.array(*[F.lit(x) for x in P.REQUIRED]), "paths")).alias("x")).select("doc_id", F.lit("error").alias("level"), F.concat(F.lit("missing required entry: "), "x").alias("message"))
    items, order = P.resolved(P.manifest(entries), entries), P.spine(entries)
    lost = items.where(~F.col("exists")).select("doc_id", F.lit("warning").alias("level"), F.concat(F.lit("manifest item not found: "), "href").alias("message"))
    dangling = order.join(items.select("doc_id", F.col("id").alias("idref")), ["doc_id", "idref"], "left_anti").select("doc_id", F.lit("error").alias("level"), F.concat(F.lit("unknown spine reference: "), "idref").alias("message"))
    named = order.join(items.select("doc_id", F.col("id").alias("idref"), "path", "exists"), ["doc_id", "idref"])
    absent = named.where(~F.col("exists")).select("doc_id", F.lit("error").alias("level"), F.concat(F.lit("missing spine entry: "), "path").alias("message"))
    count = named.where(F.col("exists") & F.col("path").rlike(P.SECTIONS)).groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = P.declared_sections(entries).join(count, "doc_id", "left").where("declared is not null and declared <> coalesce(n, 0)").select("doc_id", F.lit("warning").alias("level"), F.lit("section count mismatch").alias("message"))
    told = missing.unionByName(lost).unionByName(dangling).unionByName(absent).unionByName(odd).groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("level") == k, F.col("message")))).alias(f"{k}s") for k in ("error", "warning")])
    none = F.array().cast("array<string>")
    return docs.select("doc_id").join(told, "doc_id", "left").select("doc_id", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings")).withColumn("valid", F.size("errors") == 0)


def risk_signals(entries: DataFrame, exact: bool = False, corpus=None) -> DataFrame:
    """Counts of markup that a round trip may damage, in the sections of the spine: by tag prefix as it has always been, or by exact tag.

    corpus: the same entries as stored, so that the spine need not be parsed again.
    """
    parts = entries.where(F.col("path").rlike(P.SECTIONS)).select("doc_id", "path", F.col("content").cast("string").alias("x"))
    n = lambda *tags: sum((F.regexp_count("x", F.lit(f"<hp:{tag}" + (r"[\s/>]" if exact else ""))) for tag in tags), F.lit(0))
    spans = F.regexp_count("x", F.lit('(?:rowSpan|colSpan)="(?!1")[^"]+"'))
    rows = parts.select("doc_id", "path", n("tbl").alias("t"), spans.alias("merged"), n("pic", "rect", "ellipse", "line", "equation", "container", "drawText").alias("objects"), n("header", "footer").alias("hf"), n("pageNum").alias("pages"), F.regexp_count("x", F.lit("목차")).alias("toc"))
    rows = rows.join(P.sections_of(entries if corpus is None else corpus).select("doc_id", "path"), ["doc_id", "path"], "left_semi")
    low = F.lower(F.col("content").cast("string"))
    marks = entries.where("path = 'Contents/header.xml'").select("doc_id", (F.regexp_count(low, F.lit("toc heading")) + F.regexp_count(low, F.lit("toc "))).alias("in_header"))
    out = rows.groupBy("doc_id").agg(
        F.count("*").alias("section_count"), F.sum("t").alias("table_count"), F.sum("merged").alias("merged_cell_count"), F.sum(F.greatest(F.col("t") - 1, F.lit(0))).alias("nested_table_count"),
        F.sum("objects").alias("object_count"), F.sum("hf").alias("header_footer_count"), F.sum("pages").alias("page_number_count"), F.sum("toc").alias("toc_marker_count"),
    )
    out = out.join(marks, "doc_id", "left").withColumn("toc_marker_count", F.col("toc_marker_count") + F.coalesce("in_header", F.lit(0))).drop("in_header")
    hint = lambda cond, name: F.when(F.expr(cond), F.lit(name))
    return out.withColumn("hints", F.array_compact(F.array(
        hint("section_count > 1", "section-risk"), hint("toc_marker_count > 0", "toc-risk"), hint("merged_cell_count > 0 or nested_table_count > 0 or table_count >= 20", "table-risk"),
        hint("object_count > 0 or header_footer_count > 0 or page_number_count > 0", "layout-risk"),
    )))


def plain_text(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): the own lines of every paragraph that has some, in section and document order; a nested one comes after the one it is in."""
    return paragraphs.where("text_lines <> ''").groupBy("doc_id").agg(lines_of("text"))


def lines_of(name: str) -> Column:
    """An aggregate over paragraphs of a document: the text of ``plain_text``, empty where no paragraph has lines."""
    told = F.when(F.col("text_lines") != "", F.struct("section_idx", "pre", "text_lines"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text_lines"]), "\n").alias(name)


def blocks(paragraphs: DataFrame, table_rows: DataFrame, cell_rows: DataFrame, style_rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Export blocks in order: headings and paragraphs of the body, then each one's objects: tables as rows of cells, others as text."""
    body = paragraphs.where("depth = 1 and body_p_idx is not null").join(style_rows.select("doc_id", F.col("id").alias("style_id"), "name"), ["doc_id", "style_id"], "left")
    level = F.coalesce(T.heading_level(F.coalesce("name", F.lit(""))), F.lit(0))
    none = F.lit(None).cast("array<array<string>>").alias("rows")
    texts = body.select(*SECTION, "pre", level.alias("level"), T.normalize_inline(F.col("text_direct")).alias("text"), none).where("text <> ''")
    # objects that are direct children of a run of a body paragraph
    direct = elements.where("depth = 3 and run_idx is not null and body_p_idx is not null")
    line = cell_rows.groupBy(*SECTION, "table_idx", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", T.normalize_inline(F.col("text_all")).alias("text")))), lambda x: x["text"]).alias("line"), F.min("pre").alias("at"))
    whole = line.groupBy(*SECTION, "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("rows"))
    of_tables = direct.where("tag = 'tbl'").select(*SECTION, "table_idx", "pre").join(whole, [*SECTION, "table_idx"]).select(*SECTION, "pre", F.lit(0).alias("level"), F.lit("").alias("text"), "rows")
    boxes = elements.where("tag = 'drawText'").select(*SECTION, F.col("pre").alias("d0"), F.col("last").alias("d1"), F.col("parent_pre").alias("pre"))
    lists = elements.where("tag = 'subList'").select(*SECTION, F.col("pre").alias("s0"), F.col("parent_pre").alias("d0"))
    inner = elements.where("tag = 'p'").select(*SECTION, F.col("pre").alias("p0"), F.col("parent_pre").alias("s0"), T.normalize_inline(F.col("text_direct")).alias("said"))
    boxed = boxes.join(lists, [*SECTION, "d0"]).join(inner.where("said <> ''"), [*SECTION, "s0"]).groupBy(*SECTION, "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p0", "said"))), lambda x: x["said"]), "\n").alias("boxed"))
    blank = lambda k: F.nullif(F.trim(F.col("attrs")[k]), F.lit(""))
    image = F.coalesce(blank("binItemIDRef"), blank("binaryItemIDRef"), blank("itemIDRef"))
    formula = F.nullif(T.normalize_inline(F.col("text_all")), F.lit(""))
    c = F.col("tag")
    said = (
        F.when(c == "pic", F.coalesce(F.concat(F.lit("[Image: "), image, F.lit("]")), F.lit("[Image]"))).when(c == "equation", F.coalesce(F.concat(F.lit("[Equation: "), formula, F.lit("]")), F.lit("[Equation]")))
        .when(c == "rect", F.coalesce("boxed", F.lit("[Rectangle]"))).when(c == "line", "[Line]").when(c == "ellipse", "[Ellipse]")
    )
    others = direct.where("tag in ('pic', 'equation', 'rect', 'line', 'ellipse')").join(boxed, [*SECTION, "pre"], "left").select(*SECTION, "pre", F.lit(0).alias("level"), said.alias("text"), none)
    return texts.unionByName(of_tables).unionByName(others)


def export(block_rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, out): Markdown or HTML of every document."""
    widest = F.aggregate("rows", F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
    padded = F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))
    if kind == "markdown":
        pipe = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, T.markdown_cell), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), widest), " | "), F.lit(" |"))
        made = F.transform(padded, pipe)
        table = F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, 2, F.greatest(F.size(made), F.lit(1)))), "\n")
        text = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text"))
        glue = "\n\n"
    else:
        cell = lambda tag: lambda c: F.concat(F.lit(f"<{tag}>"), F.replace(T.html_escape(c), F.lit("\n"), F.lit("<br />")), F.lit(f"</{tag}>"))
        row = lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.array_join(F.transform(r, cell("th")), "")).otherwise(F.array_join(F.transform(r, cell("td")), "")), F.lit("</tr>"))
        table = F.concat(F.lit("<table>"), F.array_join(F.transform(padded, row), ""), F.lit("</table>"))
        tag = F.when(F.col("level") > 0, F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise(F.lit("p"))
        text = F.concat(F.lit("<"), tag, F.lit(">"), F.replace(T.html_escape(F.col("text")), F.lit("\n"), F.lit("<br />")), F.lit("</"), tag, F.lit(">"))
        glue = "\n"
    made_rows = block_rows.withColumn("b", F.when(F.col("rows").isNotNull(), table).otherwise(text))
    return made_rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "pre", "b"))), lambda x: x["b"]), glue).alias("out"))
