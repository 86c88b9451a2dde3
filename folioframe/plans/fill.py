"""Template filling as a relational plan: statements ("select a target, write a value") against flattened packages.

A mapping is a list that the driver parsed, so its rows are few by construction (MAX_STATEMENTS,
MAX_BYTES); paragraphs and cells are the large side and are never gathered. Selectors are found by
one automaton (``matching``), so no text is joined with all of them; labels are those of the planner
(of runs without objects and text boxes, uncut).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators.document import SECTION
from folioframe.operators.matching import MAX_BYTES, folded, matched
from folioframe.operators.rectangles import covering
from folioframe.sources.store import kept, stored

PLACE = [*SECTION, "all_p_idx", "table_idx", "row", "col"]
MAX_STATEMENTS = 10_000
#: The modes of each selector, with the step from the anchor.
STEPS = {"right": (0, 1), "down": (1, 0), "left": (0, -1), "up": (-1, 0)}
TABLE_MODES = {f"table-{d}{end}": d for end in ("", "-repeat") for d in STEPS} | {"table-right-grid": "right", "table-down-grid": "down", "table-down-records": "down"}
#: Modes that may add rows, and modes with one target.
EXPAND_MODES = ("table-down", "table-down-repeat", "table-down-grid", "table-down-records")
PARAGRAPH_MODES = ("paragraph-next", "paragraph-replace", "paragraph-next-repeat", "paragraph-replace-repeat")
STATEMENT = (
    "rid int, kind string, mode string, selector string, exact boolean, table_label string, table_idx_wanted int, occurrence int, required boolean, "
    "direction string, many boolean, single boolean, expands boolean, vals array<struct<k:int,i:int,j:int,value:string>>"
)


def statement(rid: int, s: dict) -> tuple:
    """One mapping entry, checked: exactly one selector, one kind of value, and a mode that suits both."""
    chosen = [(kind, s[key].strip()) for kind, key in (("placeholder", "placeholder"), ("near-text", "nearText"), ("anchor", "anchor")) if (s.get(key) or "").strip()]
    given = [k for k in ("value", "values", "grid", "records") if s.get(k)]
    if len(chosen) != 1 or len(given) != 1:
        raise ValueError(f"entry {rid}: exactly one selector and one kind of value are needed")
    (kind, selector), what = chosen[0], given[0]
    shape = {"value": "", "values": "-repeat", "grid": "-grid", "records": "-records"}[what]
    usual = {"placeholder": "replace", "near-text": "paragraph-next" + shape, "anchor": ("table-down" if what == "records" else "table-right") + shape}[kind]
    mode = (s.get("mode") or usual).strip().lower().replace("_", "-")
    allowed = {"placeholder": ("replace",), "near-text": PARAGRAPH_MODES, "anchor": tuple(TABLE_MODES)}[kind]
    ends = {"value": lambda m: not m.endswith(("-repeat", "-grid", "-records")), "values": lambda m: m.endswith("-repeat"), "grid": lambda m: m.endswith("-grid"), "records": lambda m: m.endswith("-records")}
    if mode not in allowed or not ends[what](mode):
        raise ValueError(f"entry {rid}: mode {mode} does not take {what} with this selector")
    if s.get("expand") and mode not in EXPAND_MODES:
        raise ValueError(f"entry {rid}: mode {mode} adds no rows")
    if what == "records" and "expand" in s and not s["expand"]:
        raise ValueError(f"entry {rid}: records need expand")
    if s.get("unique") and what != "value":
        raise ValueError(f"entry {rid}: unique is for one value")
    if s.get("occurrence") is not None and s["occurrence"] < 1:
        raise ValueError(f"entry {rid}: occurrences count from 1")
    if (s.get("matchMode") or "contains").strip().lower() not in ("exact", "contains"):
        raise ValueError(f"entry {rid}: unknown match mode")
    if what == "records":
        blank = s.get("fallbackValue") or ""
        grid = [[(str(r.get(f) or "").strip() and str(r[f])) or blank for f in s["fields"]] for r in s["records"]]
    else:
        grid = [[s["value"]]] if what == "value" else [[v] for v in s["values"]] if what == "values" else s["grid"]
    cells = [(i, j, v) for i, line in enumerate(grid) for j, v in enumerate(line)]
    vals = [(k, i, j, str(v)) for k, (i, j, v) in enumerate(cells)]
    return (rid, kind, mode, selector, (s.get("matchMode") or "").strip().lower() == "exact", (s.get("tableLabel") or "").strip(), s.get("tableIndex"), s.get("occurrence"), bool(s.get("required")), TABLE_MODES.get(mode), what != "value", bool(s.get("unique")), bool(s.get("expand")) or what == "records", vals)


def statements(spark: SparkSession, mapping: list[dict]) -> DataFrame:
    rows = [statement(i, s) for i, s in enumerate(mapping)]
    if len(rows) > MAX_STATEMENTS or sum(len((r[3] + r[5]).encode()) for r in rows) > MAX_BYTES:
        raise ValueError(f"a mapping holds at most {MAX_STATEMENTS} entries, and {MAX_BYTES} bytes of selectors and labels")
    return spark.createDataFrame(rows, STATEMENT)


def selectors(asked: DataFrame) -> DataFrame:
    """Statements without their values: at most MAX_STATEMENTS rows and MAX_BYTES of texts, so they may be sent to every task."""
    return asked.withColumn("n", F.size("vals")).drop("vals")


def values_of(asked: DataFrame) -> DataFrame:
    return asked.select("rid", F.explode("vals").alias("x")).select("rid", "x.*")


def says(text: Column, selector: Column, exact: Column) -> Column:
    """Case and outer blanks aside: equal, or contains; an empty side never matches."""
    a, b = folded(text), folded(selector)
    return (a != "") & (b != "") & F.when(exact, a == b).otherwise(a.contains(b))


def _nth(matches: DataFrame, *order: str) -> DataFrame:
    """Matches of the wanted occurrence, counted from 1 over all sections of a document."""
    w = W.partitionBy("rid", "doc_id").orderBy("section_idx", *order)
    return matches.withColumn("nth", F.row_number().over(w)).where("occurrence is null or nth = occurrence")


def placeholder_changes(paragraphs: DataFrame, asked: DataFrame) -> DataFrame:
    """Every paragraph that says the placeholder; the text is replaced as it is written, so a match in another case changes nothing but counts."""
    rows = paragraphs.select(*SECTION, "all_p_idx", F.col("table_idx"), F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), "text_tbt")
    met = matched(rows, "text_tbt", selectors(asked.where("kind = 'placeholder'")))
    met = _nth(met, "all_p_idx").join(values_of(asked).where("k = 0").select("rid", "value"), "rid")
    new = F.replace(F.col("text_tbt"), F.col("selector"), F.col("value"))
    return met.withColumn("new_text", new).where("new_text <> text_tbt").select("rid", *PLACE, F.lit(0).alias("k"), F.col("text_tbt").alias("old_text"), "new_text")


def paragraph_changes(paragraphs: DataFrame, asked: DataFrame) -> DataFrame:
    """Body paragraphs near a text: the k-th value goes to the k-th fillable paragraph from the match, or from the one after it."""
    order = W.partitionBy(*SECTION).orderBy("all_p_idx")
    body = paragraphs.where("depth = 1 and body_p_idx is not null").select(*SECTION, "all_p_idx", "text_tbt").withColumn("f", F.row_number().over(order))
    met = _nth(matched(body, "text_tbt", selectors(asked.where("kind = 'near-text'"))), "all_p_idx")
    start = met.select("rid", *SECTION, (F.col("f") + F.when(F.col("mode").startswith("paragraph-next"), 1).otherwise(0)).alias("f0"))
    to = start.join(values_of(asked).select("rid", "k", F.col("value").alias("new_text")), "rid").select("rid", *SECTION, (F.col("f0") + F.col("k")).alias("f"), "k", "new_text")
    none = [F.lit(None).cast("int").alias(c) for c in ("table_idx", "row", "col")]
    return to.join(body, [*SECTION, "f"]).select("rid", *SECTION, "all_p_idx", *none, "k", F.col("text_tbt").alias("old_text"), "new_text")


def met_anchors(table_rows: DataFrame, cell_rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Cells that say an anchor, with the place (r0, c0) where writing starts; several values start at a table's first match only."""
    kin = table_rows.select(*SECTION, "table_idx", "parent_table_idx", F.col("fill_label").alias("label"))
    texts = cell_rows.select(*SECTION, "table_idx", "row", "col", "row_span", "col_span", "pre", "text")
    met = matched(texts, "text", selectors(asked.where("kind = 'anchor'"))).join(kin, [*SECTION, "table_idx"])
    met = met.where("table_idx = table_idx_wanted or (table_idx_wanted is null and parent_table_idx is null)")
    met = _nth(met.where((F.col("table_label") == "") | says(F.col("label"), F.col("table_label"), F.col("exact"))), "pre")
    first = F.row_number().over(W.partitionBy("rid", *SECTION, "table_idx").orderBy("pre"))
    met = met.withColumn("first", first).where("not many or first = 1")
    d = F.col("direction")
    met = met.withColumn("r0", F.when(d == "down", F.col("row") + F.col("row_span")).when(d == "up", F.col("row") - 1).otherwise(F.col("row")))
    met = met.withColumn("c0", F.when(d == "right", F.col("col") + F.col("col_span")).when(d == "left", F.col("col") - 1).otherwise(F.col("col")))
    return met.select("rid", *SECTION, "table_idx", "mode", "direction", "expands", "n", "r0", "c0", "first")


def grown(table_rows: DataFrame, cell_rows: DataFrame, spans: DataFrame, asked: DataFrame, met: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(section, table_idx, rows) of tables that statements with ``expand`` need more rows of, and spans with the cells of these rows.

    New rows are copies of the last one, which must have no merged cells and no table in it; that is checked when the rows are added.
    met: ``met_anchors`` of these, if they are at hand.
    """
    met = (met_anchors(table_rows, cell_rows, asked) if met is None else met).where("expands")
    have = spans.groupBy(*SECTION, "table_idx").agg((F.max("row_to") + 1).alias("have"))
    below = spans.select(*SECTION, "table_idx", "col", "col_to", "row_to", F.struct("anchor_row", "anchor_col").alias("a"))
    ahead = met.join(below, [*SECTION, "table_idx"]).where("c0 between col and col_to and row_to >= r0").groupBy("rid", *SECTION, "table_idx", "first").agg(F.countDistinct("a").alias("free"))
    high = values_of(asked).groupBy("rid").agg((F.max("i") + 1).alias("high"))
    need = met.join(have, [*SECTION, "table_idx"]).join(ahead, ["rid", *SECTION, "table_idx", "first"], "left").join(high, "rid")
    rows = F.when(F.col("mode").endswith("-repeat"), F.col("have") + F.greatest(F.col("n") - F.coalesce("free", F.lit(0)), F.lit(0))).otherwise(F.greatest("have", F.col("r0") + F.col("high")))
    more = need.groupBy(*SECTION, "table_idx", "have").agg(F.max(rows).cast("int").alias("rows")).where("rows > have")
    last = spans.join(more, [*SECTION, "table_idx"]).where("row_to = have - 1 and row = row_to and col = col_to")
    new = last.select(*SECTION, "table_idx", F.explode(F.expr("sequence(have, cast(rows as bigint) - 1)")).alias("row"), "col", "col_to", "dead")
    new = new.select("*", F.col("row").alias("row_to"), F.col("row").cast("int").alias("anchor_row"), F.col("col").cast("int").alias("anchor_col"))
    return more.drop("have"), spans.select(*new.columns).unionByName(new)


def boxed_cells(met: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """Targets of one value, a grid or records: a rectangle up to its first cell out of range."""
    boxed = met.where("not mode like '%-repeat'").join(values_of(asked), "rid")
    boxed = boxed.select("rid", *SECTION, "table_idx", "first", (F.col("r0") + F.col("i")).alias("r"), (F.col("c0") + F.col("j")).alias("c"), "k", F.col("value").alias("new_text"))
    boxed = covering(boxed, spans)
    out = F.min(F.when(F.col("row").isNull(), F.col("k"))).over(W.partitionBy("rid", *SECTION, "table_idx", "first"))
    return boxed.withColumn("out", out).where("row is not null and (out is null or k < out)").select("rid", *SECTION, "table_idx", "first", "row", "col", "k", "new_text")


def line_cells(met: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """Targets of several values: the k-th distinct cell along a direction."""
    d = F.col("direction")
    along = F.when(d.isin("right", "left"), F.expr("r0 between row and row_to")).otherwise(F.expr("c0 between col and col_to"))
    ahead = F.when(d == "right", F.expr("if(col_to >= c0, greatest(col, c0) - c0, -1)")).when(d == "left", F.expr("if(col <= c0, c0 - least(col_to, c0), -1)"))
    ahead = ahead.when(d == "down", F.expr("if(row_to >= r0, greatest(row, r0) - r0, -1)")).otherwise(F.expr("if(row <= r0, r0 - least(row_to, r0), -1)"))
    line = met.where("mode like '%-repeat'").join(spans, [*SECTION, "table_idx"]).where(along & (ahead >= 0)).withColumn("ahead", ahead)
    line = line.select("rid", *SECTION, "table_idx", "first", F.col("anchor_row").alias("row"), F.col("anchor_col").alias("col"), "ahead")
    line = line.groupBy("rid", *SECTION, "table_idx", "first", "row", "col").agg(F.min("ahead").alias("ahead"))
    line = line.withColumn("k", F.row_number().over(W.partitionBy("rid", *SECTION, "table_idx", "first").orderBy("ahead", "row", "col")) - 1)
    return line.join(values_of(asked).select("rid", "k", F.col("value").alias("new_text")), ["rid", "k"]).select("rid", *SECTION, "table_idx", "first", "row", "col", "k", "new_text")


def table_changes(table_rows: DataFrame, cell_rows: DataFrame, spans: DataFrame, asked: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Cells beside an anchor: one, the k-th distinct cell along a direction, or a rectangle up to its first cell out of range. met: as ``grown`` takes it."""
    repeats = {r["x"] for r in asked.where("kind = 'anchor'").select(F.col("mode").like("%-repeat").alias("x")).distinct().collect()} or {True, False}  # two at most
    if met is None:
        met = met_anchors(table_rows, cell_rows, asked)
        met = kept(met, "anchors") if len(repeats) > 1 else met  # read by both kinds of modes
    both = reduce(DataFrame.unionByName, [(line_cells if x else boxed_cells)(met, spans, asked) for x in sorted(repeats)])
    once = F.row_number().over(W.partitionBy("rid", *SECTION, "table_idx", "first", "row", "col").orderBy("k"))
    both = both.withColumn("once", once).where("once = 1")
    old = cell_rows.select(*SECTION, "table_idx", "row", "col", F.col("text").alias("old_text"))
    return both.join(old, [*SECTION, "table_idx", "row", "col"], "left").select("rid", *SECTION, F.lit(None).cast("int").alias("all_p_idx"), "table_idx", "row", "col", "k", "old_text", "new_text")


def planned(paragraphs: DataFrame, table_rows: DataFrame, cell_rows: DataFrame, spans: DataFrame, asked: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """All changes of all statements, one row for each statement and target; spans are those of the cells (or their grid, a row a place). met: as ``grown`` takes it."""
    if "row_to" not in spans.columns:
        spans = spans.withColumns({"row_to": F.col("row").cast("bigint"), "col_to": F.col("col").cast("bigint"), "dead": F.lit(False)})
    of = {"placeholder": lambda: placeholder_changes(paragraphs, asked), "near-text": lambda: paragraph_changes(paragraphs, asked), "anchor": lambda: table_changes(table_rows, cell_rows, spans, asked, met)}
    kinds = {r["kind"] for r in asked.select("kind").distinct().collect()} or set(of)  # three at most
    return reduce(DataFrame.unionByName, [of[k]() for k in of if k in kinds])


def last_wins(changes: DataFrame) -> DataFrame:
    """One change a place: the last statement's, at the place in the order that the first one had."""
    seq = F.struct("rid", "k")
    return changes.groupBy(*PLACE).agg(F.min(seq).alias("seq"), F.max_by(F.struct("rid", "old_text", "new_text"), seq).alias("x")).select(*PLACE, "seq", "x.*")


def misses(docs: DataFrame, table_rows: DataFrame, changes: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, rid, kind, mode, selector, reason, requested, matched) where a document has fewer targets than values."""
    told = selectors(asked)
    rids = F.split(F.lit(",".join(str(r["rid"]) for r in asked.select("rid").collect())), ",").cast("array<int>")  # as many as the mapping has
    done = changes.groupBy("doc_id", "rid").agg(F.count("*").alias("matched")).join(F.broadcast(told.select("rid", "n")), "rid")
    met = done.groupBy("doc_id").agg(F.collect_list(F.when(F.col("matched") >= F.col("n"), F.col("rid"))).alias("full"), F.collect_list(F.struct("rid", "matched")).alias("some"))
    held = table_rows.groupBy("doc_id").agg(F.collect_set("table_idx").alias("indexes"), F.collect_set("fill_label").alias("labels"))
    lost = F.array_except(rids, F.coalesce("full", F.array().cast("array<int>")))  # a row only for what a document misses
    rows = docs.select("doc_id").distinct().join(met, "doc_id", "left").join(held, "doc_id", "left").withColumn("rid", F.explode(lost))
    rows = rows.withColumn("matched", F.coalesce(F.get(F.transform(F.filter("some", lambda x: x["rid"] == F.col("rid")), lambda x: x["matched"]), F.lit(0)), F.lit(0))).drop("full", "some")
    rows = rows.join(F.broadcast(told), "rid").withColumn("requested", F.col("n"))
    named = F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: says(x, F.col("table_label"), F.col("exact")))
    has = F.coalesce(F.array_contains("indexes", F.col("table_idx_wanted")), F.lit(False))
    anchor = F.col("kind") == "anchor"
    reason = (
        F.when(F.col("matched") > 0, "insufficient-target-capacity").when(F.col("required"), "required-target-not-found").when(F.col("occurrence").isNotNull(), "occurrence-not-found")
        .when(anchor & F.col("table_idx_wanted").isNotNull() & ~has, "table-index-not-found").when(anchor & (F.col("table_label") != "") & ~named, "table-label-not-found")
        .otherwise(F.concat("kind", F.lit("-not-found")))
    )
    return rows.select("doc_id", "rid", "kind", "mode", "selector", reason.alias("reason"), "requested", "matched")


def ambiguous(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, rid, matched) of ``unique`` statements with more than one target in a document."""
    once = asked.where("single").select("rid")
    return changes.join(F.broadcast(once), "rid").groupBy("doc_id", "rid").agg(F.count("*").alias("matched")).where("matched > 1")


def summary(changes: DataFrame, table_rows: DataFrame, missed: DataFrame) -> DataFrame:
    """(doc_id, what, name, table_idx, label, changes): by section, by kind of target, by table, and misses by reason."""
    kind = F.when(F.col("table_idx").isNotNull() & F.col("all_p_idx").isNull(), "table-cell").otherwise("paragraph")
    told = changes.withColumn("kind", kind).join(table_rows.select(*SECTION, "table_idx", "label"), [*SECTION, "table_idx"], "left")
    sets = told.groupingSets([[*SECTION], ["doc_id", "kind"], [*SECTION, "table_idx", "label"]], *SECTION, "kind", "table_idx", "label")
    rows = sets.agg(F.count("*").alias("changes"), F.grouping("kind").alias("gk"), F.grouping("table_idx").alias("gt")).where("gt = 1 or table_idx is not null")
    what = F.when(F.col("gk") == 0, "kind").when(F.col("gt") == 0, "table").otherwise("section")
    out = rows.select("doc_id", what.alias("what"), F.coalesce("kind", "section_path").alias("name"), "table_idx", "label", "changes")
    reasons = missed.groupBy("doc_id", "reason").agg(F.count("*").alias("changes"))
    return out.unionByName(reasons.select("doc_id", F.lit("miss").alias("what"), F.col("reason").alias("name"), F.lit(None).cast("int").alias("table_idx"), F.lit(None).cast("string").alias("label"), "changes"))


def gated(elements: DataFrame, expected: dict | None) -> tuple[DataFrame, DataFrame | None]:
    """(elements of the documents that a contract's fingerprint fits, (doc_id, issues) of the others)."""
    from folioframe.plans import contract

    if not expected:
        return elements, None
    refused = kept(contract.fingerprint_issues(contract.fingerprints(elements), expected), "refused")
    return elements.join(refused.select("doc_id"), "doc_id", "left_anti"), refused


def fill(entries: DataFrame, mapping: list[dict], fingerprint: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan and apply a mapping to packages: (entries with ``error``, the changes).

    A ``unique`` statement with several targets leaves its document as it was, and so does a
    fingerprint (of the contract that the mapping was compiled from) that does not fit it.
    """
    from folioframe.operators import document as D
    from folioframe.operators import edit

    asked = statements(entries.sparkSession, mapping)
    told = [dict(zip(asked.columns, statement(i, s), strict=True)) for i, s in enumerate(mapping)]
    labelled = any(s["table_label"] for s in told)
    tags = {"tc", "tbl"} | ({"p"} if labelled or fingerprint or any(s["kind"] != "anchor" for s in told) else set()) | ({"tr"} if fingerprint else set())  # what the plan reads
    elements, refused = gated(stored(entries, tags=tags).elements, fingerprint)  # parsed once, not once for each list of rows
    paragraphs, cell_rows = D.paragraph_texts(elements), D.cells(elements)
    table_rows = D.table_kin(elements, paragraphs if labelled else None)
    spans, more = D.spans(cell_rows), None
    met = kept(met_anchors(table_rows, cell_rows, asked), "anchors")
    if any(s["expands"] for s in told):
        more, spans = grown(table_rows, cell_rows, kept(spans, "spans"), asked, met)
        more = kept(more, "grown")
    changes = kept(planned(paragraphs, table_rows, cell_rows, spans, asked, met), "changes")
    final = kept(edit.fill_statements(last_wins(changes), more, ambiguous(changes, asked) if any(s["single"] for s in told) else None, refused), "statements")  # read three times
    return edit.apply(entries, final), changes
