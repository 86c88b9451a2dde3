"""Differences of two snapshots of a corpus by position: digests of documents, then of blocks of positions, then rows where these differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import document as D
from folioframe.operators.document import section_paths
from folioframe.sources import package as P
from folioframe.sources.store import Corpus, kept, stored

#: Tags of the signatures, in order, and the counts that are compared.
OBJECTS = ("tbl", "pic", "equation", "rect", "line", "ellipse")
CONTROLS, HEADER_FOOTER = ("ctrl",), ("header", "footer")
COUNTS = ("section-count", "table-count", "paragraph-count", "placeholder-count", "guide-count", "object-count", "control-count", "header-count", "footer-count", "text-length", "line-count")
ISSUE = ["doc_id", "code", "position", "before", "after"]
#: All elements that a snapshot is made of, besides the roots of parts.
SNAPSHOT = {"p", "tc", "tr", "tbl", *OBJECTS, *CONTROLS, *HEADER_FOOTER}
#: Positions of a list under one digest.
BLOCK = 64


def ordered_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, position, said): non-empty paragraphs with their place and style, numbered over all sections."""
    rows = paragraphs.where(T.says(F.col("text_t")))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "all_p_idx")) - 1
    return rows.select("doc_id", place.alias("position"), T.signature(F.col("section_path"), F.col("table_idx"), F.col("cell_row"), F.col("cell_col"), F.col("style_id"), T.trim_unicode(F.col("text_t"))).alias("said"))


def ordered_cells(cell_rows: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "table_idx", "pre")) - 1
    return cell_rows.select("doc_id", place.alias("position"), T.signature(*[F.col(c) for c in ("section_path", "table_idx", "row", "col", "row_span", "col_span", "paragraph_count", "text")]).alias("said"))


def ordered_tables(table_rows: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "table_idx")) - 1
    return table_rows.select("doc_id", place.alias("position"), T.signature(*[F.col(c) for c in ("section_path", "table_idx", "parent_table_idx", "rows", "cols", "merged_cells", "label")]).alias("said"))


def blocks(listed: DataFrame) -> DataFrame:
    """(doc_id, kind, block, n, digest): the level below a list, BLOCK positions each; no document's rows are gathered whole."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "said"))), lambda x: x["said"])
    return listed.groupBy("doc_id", "kind", F.expr(f"position div {BLOCK}").alias("block")).agg(F.count("*").alias("n"), F.sha2(F.to_json(lines), 256).alias("digest"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues ``count-changed``, ``added``, ``removed`` and ``changed``, each after its kind, between two states of lists (doc_id, kind, position, said).

    Digests of blocks of positions are joined first, rows only in the blocks that differ.
    """
    key = ["doc_id", "kind"]
    a, b = blocks(before).withColumnsRenamed({"n": "n1", "digest": "d1"}), blocks(after).withColumnsRenamed({"n": "n2", "digest": "d2"})
    pair = a.join(b, [*key, "block"], "full_outer")
    sums = pair.groupBy(*key).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("string").alias(m) for n, m in (("n1", "before"), ("n2", "after"))]).where("before <> after")
    count = sums.select("doc_id", F.concat("kind", F.lit("-count-changed")).alias("code"), F.lit(None).cast("int").alias("position"), "before", "after")
    differ = pair.where("not (d1 <=> d2)").select(*key, "block")
    only = lambda rows, name: rows.withColumn("block", F.expr(f"position div {BLOCK}")).join(differ, [*key, "block"], "left_semi").select(*key, "position", F.col("said").alias(name))
    rows = only(before, "before").join(only(after, "after"), [*key, "position"], "full_outer").where("not (before <=> after)")
    end = F.when(F.col("before").isNull(), "-added").when(F.col("after").isNull(), "-removed").otherwise("-changed")
    return count.select(*ISSUE).unionByName(rows.withColumn("code", F.concat("kind", end)).select(*ISSUE))


def compare(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """``compared`` for one list (doc_id, position, said) in two states."""
    named = lambda rows: rows.select("doc_id", F.lit(kind).alias("kind"), "position", "said")
    return compared(named(before), named(after))


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id): documents whose entries are not the same bytes under the same names; no others can have issues."""
    digest = lambda entries, name: entries.select("doc_id", F.struct("path", F.sha2("content", 256).alias("d")).alias("e")).groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias(name))
    return digest(before, "a").join(digest(after, "b"), "doc_id", "full_outer").where("not (a <=> b)").select("doc_id")


def signatures(elements: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(doc_id, position, said, kind): elements of the tags as kind, section and text; by section, then tag, then document order."""
    rank = reduce(lambda c, x: c.when(F.col("tag") == x[1], x[0]), enumerate(tags), F)
    text = T.truncate_bytes(T.trim_unicode(F.coalesce("text_t", F.lit(""))), 120)
    rows = elements.where(F.col("tag").isin(*tags)).select("doc_id", "section_idx", rank.alias("rank"), "pre", F.col("tag").alias("kind"), T.signature(F.col("tag"), F.col("section_path"), text).alias("said"))
    return rows.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "rank", "pre")) - 1).alias("position"), "said", "kind")


def lists(elements: DataFrame) -> DataFrame:
    """(doc_id, kind, position, said): the ordered rows that two states are compared by: paragraphs, tables, cells, objects, headers and footers, controls."""
    paragraphs, cell_rows = D.paragraph_texts(elements), D.cells(elements)
    of = {
        "paragraph": ordered_paragraphs(paragraphs), "table": ordered_tables(D.tables(elements, paragraphs, cell_rows)), "cell": ordered_cells(cell_rows),
        "object": signatures(elements, OBJECTS), "header-footer": signatures(elements, HEADER_FOOTER), "control": signatures(elements, CONTROLS),
    }
    return reduce(DataFrame.unionByName, [rows.select("doc_id", F.lit(kind).alias("kind"), "position", "said") for kind, rows in of.items()])


#: The digests of a snapshot, by the list they are over.
DIGESTS = {"paragraph": "paragraph_digest", "table": "table_digest", "object": "object_digest", "header-footer": "header_footer_digest", "control": "control_digest"}


def snapshots(entries: DataFrame, corpus: Corpus | None = None, listed: DataFrame | None = None) -> DataFrame:
    """One row a document: validity, render safety, section paths, risk hints, all counts and six digests: of the text and of the lists in DIGESTS."""
    corpus = corpus or stored(entries, tags=SNAPSHOT)
    elements = corpus.elements
    paragraphs = D.paragraph_texts(elements)
    count = lambda name, *tags: F.count_if(F.col("tag").isin(*tags)).alias(name)
    out = elements.groupBy("doc_id").agg(
        section_paths(), count("table_count", "tbl"), count("object_count", *OBJECTS), count("control_count", *CONTROLS), count("header_count", "header"), count("footer_count", "footer")
    )
    rows = lists(elements) if listed is None else listed
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "said"))), lambda x: x["said"]), "\n")
    every = rows.where(F.col("kind").isin(*DIGESTS)).groupBy("doc_id", "kind").agg(F.sha2(lines, 256).alias("d"))
    out = out.join(every.groupBy("doc_id").agg(*[F.max(F.when(F.col("kind") == kind, F.col("d"))).alias(name) for kind, name in DIGESTS.items()]), "doc_id", "left")
    out = out.withColumns({name: F.coalesce(name, F.sha2(F.lit("").cast("binary"), 256)) for name in DIGESTS.values()})
    said = T.trim_unicode(F.col("text_t"))
    met = lambda name, mark: F.count_if((said != "") & mark.isNotNull()).alias(name)
    counts = [F.count_if(T.says(F.col("text_t"))).alias("paragraph_count"), met("placeholder_count", T.is_placeholder(said)), met("guide_count", T.is_guide(F.lower(said)))]
    out = out.join(paragraphs.groupBy("doc_id").agg(*counts, D.lines_of("text")), "doc_id", "left")
    out = out.join(D.report(corpus).select("doc_id", "valid"), "doc_id", "left").join(D.risk_signals(entries, corpus=corpus).select("doc_id", F.col("hints").alias("risk_hints")), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    return out.fillna(0).withColumns({
        "section_count": F.size("section_paths").cast("long"), "text_length": F.octet_length(text).cast("long"), "line_count": F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long"),
        "text_digest": F.sha2(text.cast("binary"), 256), "risk_hints": F.coalesce("risk_hints", F.array().cast("array<string>")), "render_safe": F.size(F.coalesce("risk_hints", F.array().cast("array<string>"))) == 0,
    }).drop("text")


def round_trip(before: DataFrame, after: DataFrame) -> DataFrame:
    """Coded issues (doc_id, code, position, before, after) between two states of the entries of a corpus.

    Only documents whose bytes differ are parsed, once each.
    """
    changed = kept(touched(before, after), "touched")
    before, after = (x.join(changed, "doc_id", "left_semi") for x in (before, after))
    ca, cb = stored(before, tags=SNAPSHOT), stored(after, tags=SNAPSHOT)
    la, lb = kept(lists(ca.elements), "lists"), kept(lists(cb.elements), "lists")
    a, b = snapshots(before, ca, la), snapshots(after, cb, lb)
    name = lambda code: code.replace("-", "_")
    told = [name(c) for c in COUNTS] + ["valid", "render_safe", "text_digest", "section_paths", "risk_hints"]
    pair = a.select("doc_id", *[F.col(c).alias(f"a_{c}") for c in told]).join(b.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in told]), "doc_id", "full_outer")
    checks = [(f"{c}-changed", name(c)) for c in COUNTS] + [("validity-changed", "valid"), ("render-safe-changed", "render_safe"), ("text-digest-changed", "text_digest")]
    none = F.lit(None).cast("int")
    issue = lambda code, x, y, at=none: F.struct(F.lit(code).alias("code"), at.alias("position"), x.cast("string").alias("before"), y.cast("string").alias("after"))
    plain = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), issue(code, F.col(f"a_{c}"), F.col(f"b_{c}"))) for code, c in checks]))
    nothing = F.lit(None).cast("string")
    paths = F.filter(F.transform(F.col("a_section_paths"), lambda x, i: F.when(i >= F.size("b_section_paths"), issue("section-path-removed", x, nothing, i.cast("int"))).when(x != F.get("b_section_paths", i), issue("section-path-changed", x, F.get("b_section_paths", i), i.cast("int")))), lambda x: x.isNotNull())
    added = F.transform(F.array_except("b_risk_hints", "a_risk_hints"), lambda x: issue("risk-added", nothing, x))
    removed = F.transform(F.array_except("a_risk_hints", "b_risk_hints"), lambda x: issue("risk-removed", x, nothing))
    parts = [F.coalesce(x, F.array().cast("array<struct<code:string,position:int,before:string,after:string>>")) for x in (plain, paths, added, removed)]
    out = [pair.select("doc_id", F.explode(F.concat(*parts)).alias("x")).select("doc_id", "x.*").select(*ISSUE)]
    code = F.col("code")  # of structures any difference has one code; counts are in the snapshots but for cells
    found = compared(la, lb).where(~code.endswith("-count-changed") | (code == "cell-count-changed"))
    structures = [F.when(code.startswith(kind), F.lit(f"{kind}-changed")) for kind in ("object", "header-footer", "control")]
    out.append(found.withColumn("code", F.coalesce(*structures, code)).select(*ISSUE))
    return reduce(DataFrame.unionByName, out)


def gate(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, blocked): why a document is not packed: invalid, not safe to render, or changed by a round trip (errors, not risks)."""
    bad = issues.where(~F.col("code").isin("risk-added", "risk-removed")).select("doc_id").distinct().withColumn("bad", F.lit(True))
    rows = snapshots(entries).select("doc_id", "valid", "render_safe").join(bad, "doc_id", "left")
    why = F.array_compact(F.array(F.when(~F.coalesce("valid", F.lit(False)), F.lit("invalid")), F.when(~F.col("render_safe"), F.lit("render-safe=false")), F.when(F.col("bad"), F.lit("roundtrip-check-failed"))))
    return rows.select("doc_id", why.alias("blocked"))


def safe_pack(entries: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(archives of the documents that pass the gate, the gate's rows); force packs all."""
    packed = P.pack(P.packable(entries))
    stopped = gate(entries, round_trip(entries, P.unzipped(packed)))
    return (packed if force else packed.join(stopped.where(F.size("blocked") > 0), "doc_id", "left_anti")), stopped
