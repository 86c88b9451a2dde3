"""Order of reading, the stored corpus, ancestor labels, pattern search, misses, planner labels and the fingerprint gate."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import diff as X
from folioframe.operators import document as D
from folioframe.operators import edit as E
from folioframe.operators import matching as M
from folioframe.plans import contract, fill
from folioframe.sources import package as P
from folioframe.sources import store
from tests.test_document import cell, para

NS = 'xmlns:hp="p" xmlns:hs="s"'


def package(doc_id: str, order: list[str], bodies: dict[str, str], items: dict[str, str] | None = None) -> list[tuple[str, str, bytes]]:
    """order: ids of the spine; bodies: part -> section content; items: id -> href (a part's name without its folder)."""
    items = items if items is not None else {p: f"Contents/{p}.xml" for p in bodies}
    hpf = "<p:package xmlns:p='p' xmlns:o='o'><o:manifest>" + "".join(f'<o:item id="{i}" href="{h}"/>' for i, h in items.items()) + "</o:manifest><o:spine>" + "".join(f'<o:itemref idref="{i}"/>' for i in order) + "</o:spine></p:package>"
    parts = {"mimetype": b"m", "version.xml": b"<v/>", "Contents/header.xml": b"<head><style id='0' name='Normal'/><style id='1' name='Heading 1'/></head>", "Contents/content.hpf": hpf.encode()}
    return [(doc_id, p, c) for p, c in (parts | {f"Contents/{p}.xml": (c if c.startswith("<bad") else f"<hs:sec {NS}>{c}</hs:sec>").encode() for p, c in bodies.items()}).items()]


NAMES = [f"section{n}" for n in (7, 11, 2, 0, 10, 5, 1, 9, 3, 8, 4, 6)]


@pytest.fixture(scope="module")
def entries(spark):
    long = package("long", NAMES, {n: para(f"in {n}", "1") + para("same words") for n in NAMES} | {"section99": para("stray")})
    odd = package("odd", ["b", "gone", "unknown", "a", "b", "c", "h"], {"section0": para("a text"), "section1": para("b text"), "section2": "<bad"}, {"a": "/Contents/section0.xml", "b": "section1.xml", "gone": "section9.xml", "c": "Contents/section2.xml", "h": "Contents/header.xml"})
    bare = [("bare", "Contents/section0.xml", f"<hs:sec {NS}>{para('x')}</hs:sec>".encode()), ("bare", "BinData/i.png", b"\x89PNG")]
    return spark.createDataFrame(long + odd + bare, P.ENTRIES).cache()


@pytest.fixture(scope="module")
def corpus(entries):
    return store.stored(entries, 3)


@pytest.mark.parametrize("kind", ["entries", "stored"])
def test_order_of_reading(entries, corpus, kind):
    source = entries if kind == "entries" else corpus
    elements = P.flatten(source).cache()
    paragraphs, cells = D.paragraph_texts(elements), D.cells(elements)
    said = {r.doc_id: r.text.split("\n") for r in D.plain_text(paragraphs).collect()}
    assert said == {"long": [x for n in NAMES for x in (f"in {n}", "same words")], "odd": ["b text", "a text"]}
    out = {r.doc_id: r.out for r in D.export(D.blocks(paragraphs, D.tables(elements, paragraphs, cells), cells, P.styles(source), elements), "markdown").collect()}
    assert out["long"].split("\n\n") == [x for n in NAMES for x in (f"# in {n}", "same words")]
    found = D.find_by_path(elements, "//p[1]").where("doc_id = 'long'").orderBy("match_index").collect()
    assert [(r.section_idx, r.section_path) for r in found] == [(i, f"Contents/{n}.xml") for i, n in enumerate(NAMES)]
    assert [r.text for r in D.headings(paragraphs, P.styles(source)).where("doc_id = 'long'").orderBy("nth").collect()] == [f"in {n}" for n in NAMES]
    assert [(r.section_idx, r.tag) for r in elements.where("tag = '#error'").collect()] == [(2, "#error")]
    assert P.sections_only(elements, 3).where("doc_id = 'long' and tag = 't' and text like 'in%'").first().text == f"in {NAMES[3]}"
    assert {r.doc_id: r.section_count for r in contract.fingerprints(elements).collect()} == {"long": 12, "odd": 3}


def test_guides_of_a_section(spark):
    rows = package("g", ["s1", "s0"], {"s0": "", "section0": para("※ 작성요령 a"), "section1": para("※ 작성요령 b")}, {"s0": "Contents/section0.xml", "s1": "Contents/section1.xml"})
    paragraphs = D.paragraph_texts(P.flatten(spark.createDataFrame(rows, P.ENTRIES)))
    assert [r.text[-1] for r in D.find_guides(paragraphs, "Guide-Marker", 0).collect()] == ["b"] and D.find_guides(paragraphs).count() == 2


def test_occurrence_counts_in_reading_order(spark, corpus):
    elements = corpus.elements
    paragraphs, cells = D.paragraph_texts(elements), D.cells(elements)
    asked = fill.statements(spark, [{"nearText": "same words", "value": "x", "mode": "paragraph-replace", "occurrence": 2}])
    got = fill.planned(paragraphs, D.tables(elements, paragraphs, cells), cells, D.grid(cells), asked).collect()
    assert [(r.doc_id, r.section_idx, r.section_path) for r in got] == [("long", 1, f"Contents/{NAMES[1]}.xml")]


def test_diff_in_reading_order(spark, entries):
    """The spine turned round: every text is there before and after, at other places."""
    turned = spark.createDataFrame(package("long", NAMES[::-1], {n: para(f"in {n}", "1") + para("same words") for n in NAMES}), P.ENTRIES)
    got = X.round_trip(entries.where("doc_id = 'long' and path not like '%99%'"), turned)
    codes = {r.code: r.n for r in got.groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert codes == {"text-digest-changed": 1, "section-path-changed": 12, "paragraph-changed": 24}


def test_stored_corpus_is_parsed_once(spark, corpus):
    elements = corpus.elements
    plan = elements.groupBy("doc_id", "section_idx").count()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan
    assert {r.path for r in corpus.paths().where("doc_id = 'bare'").collect()} == {"Contents/section0.xml", "BinData/i.png"}
    assert {r.doc_id: r.valid for r in D.report(corpus).collect()} == {"long": True, "odd": False, "bare": False}
    other = store.stored(spark.createDataFrame(P.blank(), P.ENTRIES))
    assert other.elements.count() == 4
    other.drop()
    assert not spark.catalog.tableExists(other.name)


def test_descendants_by_ancestor_labels(spark):
    """Random trees against ElementTree, and the plan."""
    rnd, rows, wanted = random.Random(4), [], {}

    def grow(depth: int) -> str:
        tag = rnd.choice(("tr", "p", "tc", "x"))
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(rnd.randrange(4) if depth else 0)) + f"</{tag}>"

    for i in range(12):
        body = "".join(grow(6) for _ in range(5))
        rows += package(f"d{i}", ["section0"], {"section0": body})
        root = ET.fromstring(f"<sec>{body}</sec>")
        number = {e: n for n, e in enumerate(root.iter())}
        wanted[f"d{i}"] = {path: sorted({number[e] for e in root.findall(f".{path}")}) for path in ("//tr//p", "//tr//tr//x", "//tc/p//tr")}
    elements = P.flatten(spark.createDataFrame(rows, P.ENTRIES)).cache()
    for path in ("//tr//p", "//tr//tr//x", "//tc/p//tr"):
        found = D.find_by_path(elements, path)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got: dict = {}
        for r in found.orderBy("doc_id", "match_index").collect():
            got.setdefault(r.doc_id, []).append(r.pre)
        assert got == {d: w[path] for d, w in wanted.items() if w[path]}


def test_finder_against_all_pairs():
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(n)))
    for _ in range(30):
        patterns = {i: (word(5), rnd.random() < 0.3) for i in range(60)}
        parts: dict = {}
        wholes: dict = {}
        for i, (p, exact) in patterns.items():
            if p:
                (wholes if exact else parts).setdefault(p, []).append(i)
        find = M.Finder(parts, wholes)
        for text in (word(20) for _ in range(30)):
            assert (find(text) or []) == [i for i, (p, exact) in patterns.items() if p and text and (p == text if exact else p in text)]
    assert M.Finder({}, {})("x") is None and M.Finder({"a": [1]}, {})(None) is None


def test_ten_thousand_selectors(spark):
    texts = spark.range(3_000).select(F.concat(F.lit("  Row "), F.col("id").cast("string"), F.lit(" of the List ")).alias("text"), "id")
    asked = fill.selectors(fill.statements(spark, [{"nearText": f"row {i} OF", "value": "x", "matchMode": "exact" if i % 2 else "contains"} for i in range(10_000)]))
    found = M.matched(texts, "text", asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.id, r.rid) for r in found.collect()) == [(i, i) for i in range(0, 3_000, 2)]
    with pytest.raises(ValueError):
        fill.statements(spark, [{"nearText": "x", "value": "y"}] * 10_001)
    with pytest.raises(ValueError):
        fill.statements(spark, [{"nearText": "x" * (17 << 20), "value": "y"}])


TABLE = '<hp:tbl rowCnt="1" colCnt="2"><hp:tr>' + cell(0, 0, "Name") + cell(0, 1, "") + "</hp:tr></hp:tbl>"


def table_of(label: str, box: str = "") -> str:
    inner = f"<hp:rect><hp:drawText><hp:subList>{para(box)}</hp:subList></hp:drawText></hp:rect>" if box else ""
    apart = "" if box else "</hp:run></hp:p><hp:p><hp:run>"  # a box's own paragraph would be the last text
    return f"<hp:p><hp:run><hp:t>{label}</hp:t>{inner}{apart}{TABLE}</hp:run></hp:p>"


@pytest.fixture(scope="module")
def labelled(spark):
    """Labels of 130 bytes that differ in the last, and one with a text box in its paragraph."""
    long = "l" * 129
    rows = package("a", ["section0"], {"section0": table_of(long + "a") + table_of(long + "b") + table_of("boxed", "not said")})
    rows += package("b", ["section0", "section1"], {"section0": table_of(long + "a"), "section1": para("{{X}}")})
    return long, spark.createDataFrame(rows, P.ENTRIES).cache()


def test_planner_labels(spark, labelled):
    long, entries = labelled
    elements = store.stored(entries).elements
    paragraphs, cells = D.paragraph_texts(elements), D.cells(elements)
    tables = D.tables(elements, paragraphs, cells)
    asked = fill.statements(spark, [
        {"anchor": "Name", "value": "v", "tableLabel": long + "b", "matchMode": "exact"}, {"anchor": "Name", "value": "w", "tableLabel": "boxed", "matchMode": "exact"}, {"anchor": "Name", "value": "x", "tableLabel": "not said"},
    ])
    changes = fill.planned(paragraphs, tables, cells, D.grid(cells), asked).cache()
    assert sorted((r.doc_id, r.rid, r.table_idx) for r in changes.collect()) == [("a", 0, 1), ("a", 1, 2)]
    assert len(tables.where("table_idx = 1 and doc_id = 'a'").first().label) < 130  # reports cut it
    missed = fill.misses(entries, tables, changes, asked)
    plan = missed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.doc_id, r.rid, r.reason, r.requested, r.matched) for r in missed.collect()) == [("a", 2, "table-label-not-found", 1, 0), *[("b", i, "table-label-not-found", 1, 0) for i in range(3)]]


def test_misses_against_all_pairs(spark):
    rnd = random.Random(3)
    asked = fill.statements(spark, [{"anchor": f"a{i}", "values": ["x"] * rnd.randrange(1, 4), "mode": "table-down-repeat", "required": i % 5 == 0} for i in range(40)])
    docs = spark.createDataFrame([(f"d{i}",) for i in range(30)], "doc_id string")
    made = [(f"d{rnd.randrange(30)}", rnd.randrange(40)) for _ in range(900)]
    none = spark.createDataFrame([], "doc_id string, table_idx int, fill_label string")
    got = {(r.doc_id, r.rid): (r.requested, r.matched, r.reason) for r in fill.misses(docs, none, spark.createDataFrame(made, "doc_id string, rid int"), asked).collect()}
    wanted = {}
    for s in asked.collect():
        for i in range(30):
            m = made.count((f"d{i}", s.rid))
            if m < len(s.vals):
                wanted[f"d{i}", s.rid] = (len(s.vals), m, "insufficient-target-capacity" if m else "required-target-not-found" if s.required else "anchor-not-found")
    assert got == wanted


def test_fingerprint_gate(spark, labelled):
    long, entries = labelled
    expected = {"sectionCount": 2, "placeholderTexts": ["{{X}}"]}
    done, changes = fill.fill(entries, [{"anchor": "Name", "value": "v"}], expected)
    errors = {r.doc_id: r.error for r in done.select("doc_id", "error").distinct().collect()}
    assert errors["b"] is None and errors["a"].startswith("statement 0 (fail): fingerprint: ")
    assert {r.doc_id for r in changes.collect()} == {"b"}


def test_edits_that_would_break_a_document(spark):
    entries = spark.createDataFrame(P.blank("a") + P.blank("b"), P.ENTRIES)
    bad = [("append-text", {"texts": ["nul \x00"]}), ("embed-image", {"data": "iVBORw0KGgo="}), ("embed-image", {"data": "R0lGODlhAAAAAA=="}), ("set-paragraph-layout", {"index": 0, "layout": {"align": None}}), ("set-paragraph-text", {"index": [], "text": 3})]
    for name, args in bad:
        asked = E.statements(spark, [("a", name, args), ("b", "append-text", {"texts": ["fine"]})])
        rows = E.apply(entries, asked).collect()
        errors = {r.doc_id: r.error for r in rows}
        assert errors["b"] is None
        if errors["a"] is None:
            assert name == "set-paragraph-layout" or name == "embed-image"
        for r in rows:
            if r.path.endswith((".xml", ".hpf")):
                ET.fromstring(bytes(r.content))


def test_no_text_fails_a_job(spark):
    from folioframe.functions import text as T

    df = spark.createDataFrame([("heading 99999999999",), ("Heading 3",), ("title",), ("x",), (None,)], "s string")
    assert [r.n for r in df.select(T.heading_level(F.col("s")).alias("n")).collect()] == [6, 3, 1, None, None]
    sizes = spark.createDataFrame([(96, 48, None), (96, 48, 100.0), (96, 48, 1000.0), (0, 5, None), (10, 0, 0.0)], "w int, h int, mm double")
    assert [(r.s.width, r.s.height) for r in sizes.select(T.image_units(F.col("w"), F.col("h"), F.col("mm")).alias("s")).collect()] == [(22677, 11339), (28346, 14173), (42520, 21260), (22677, 22677), (22677, 22677)]


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    """A larger corpus has more buckets, not larger ones; the rows are the same."""
    entries = spark.createDataFrame([(str(i), p, c) for i in range(40) for _, p, c in P.blank()], P.ENTRIES)
    few = store.stored(entries)
    monkeypatch.setattr(store, "BUCKET_BYTES", 20_000)
    many = store.stored(entries)
    count = lambda c: int(spark.sql(f"describe formatted {c.name}").where("col_name = 'Num Buckets'").first()["data_type"])
    assert count(few) == int(spark.conf.get("spark.sql.shuffle.partitions")) and count(many) > 2 * count(few)
    told = lambda c: sorted(map(repr, c.rows.select("doc_id", "section_idx", "section_path", "pre", "tag", "text_all").collect()))
    assert told(few) == told(many)
    largest = many.elements.groupBy(F.spark_partition_id()).agg(F.countDistinct("doc_id").alias("n")).agg(F.max("n")).first()[0]
    assert largest < 20


def test_rows_of_some_tags(spark):
    """Rows of some tags are those of all tags that are left after a filter, in order of the spine."""
    from folioframe import engine

    entries = engine.packages(spark, "/root/testdata/sf0.001").where("cast(doc_id as long) < 30").cache()
    told = lambda rows: sorted(map(repr, rows.select("doc_id", "section_idx", "section_path", "pre", "last", "above", "tag", "attrs", "all_p_idx", "table_idx", "cell_row", "text_t", "text_all", "text_direct").collect()))
    some = told(P.flatten(entries, tags={"p", "tc"}))
    assert some and some == told(P.flatten(entries).where("tag in ('p', 'tc')")) == told(P.flatten(store.stored(entries), tags={"p", "tc"}))


def test_paragraph_diff_stores_no_corpus(spark, monkeypatch):
    """Two states are compared by their paragraphs; the other elements are never stored."""
    from folioframe import engine

    def refused(*_):
        raise AssertionError("a whole corpus was stored")

    monkeypatch.setattr(store, "stored", refused)
    assert engine.jon_9_paragraph_diff(spark, "/root/testdata/sf0.001").where("code = 'paragraph-changed'").count() > 0


def test_nested_tables_are_walked_in_time_of_their_size():
    """Texts of an element are put together from those below it, not read anew at every level."""
    import time

    inner = "<p><run><t>a</t></run></p>"
    for _ in range(600):
        inner = f"<p><run><tbl><tr><tc>{inner}<cellAddr rowAddr='1' colAddr='0'/></tc></tr></tbl></run></p>"
    root, rows, began = ET.fromstring(f"<sec>{inner}</sec>"), [], time.process_time()
    P._walk_part("d", "s", root, rows)
    assert time.process_time() - began < 2
    assert len(rows) == 600 * 6 + 4


def test_large_partitions_are_dealt_out_in_shares(spark, monkeypatch):
    """However large the partitions of the parsed rows, a task deals out a bounded share; the stored rows are the same."""
    entries = spark.createDataFrame([(str(i), p, c) for i in range(40) for _, p, c in P.blank()], P.ENTRIES).coalesce(1)
    rows = P.walked(entries, P.PARSED, listed=True).cache()
    whole, largest = store._bytes(rows)
    assert whole == largest > 0 and rows.rdd.getNumPartitions() == 1
    told = lambda x: sorted(map(repr, x.select("doc_id", "section_idx", "section_path", "pre", "tag", "text_all").collect()))
    before = told(store.stored(entries).rows)
    monkeypatch.setattr(store, "DEALT_BYTES", largest // 5 + 1)
    assert told(store._dealt(rows, 6, largest)) == told(rows)
    assert store._dealt(rows, 6, largest)._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 5
    assert told(store.stored(entries).rows) == before


def test_packages_are_parsed_in_partitions_by_size(spark, monkeypatch):
    from folioframe import engine

    docs = lambda: {(r.doc_id, r.path, bytes(r.content)) for r in engine.packages(spark, "/root/testdata/sf0.001").collect()}
    before = docs()
    monkeypatch.setattr(engine, "TURNS_BYTES", 10_000)
    assert engine.packages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert docs() == before


def test_snapshots_store_only_what_they_read(spark, monkeypatch):
    """A snapshot's corpus holds the tags it is made of and the roots; the snapshot is that of a whole corpus, also of documents without text, with errors or without a spine."""
    from folioframe import engine

    mark = para("{{name}}") + para("※ write here") + para("")
    odd = package("no spine", [], {"section0": para("x")}) + package("empty", ["section0", "section1"], {"section0": "", "section1": para("")}) + package("bad", ["section0", "section1"], {"section0": "<bad", "section1": mark})
    entries = engine.drawn(engine.packages(spark, "/root/testdata/sf0.001").where("cast(doc_id as long) < 15")).unionByName(spark.createDataFrame(odd, P.ENTRIES)).cache()
    made, real = [], X.stored
    monkeypatch.setattr(X, "stored", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    few = X.snapshots(entries)
    whole = store.stored(entries)
    told = lambda rows: sorted(map(repr, rows.collect()))
    assert told(few) == told(X.snapshots(entries, whole).select(*few.columns)) and few.count() > 10
    kept = {r.tag for r in made[0].elements.where("depth > 0").select("tag").distinct().collect()}
    assert {"p", "tc"} <= kept <= X.SNAPSHOT and 2 * made[0].rows.count() < whole.rows.count()


@pytest.mark.parametrize("query, tags", [("prj_9_cells", {"tc"}), ("snk_6_plain_text", {"p"}), ("snk_7_markdown", {"p", "tc", "tbl"}), ("snk_8_html", {"p", "tc", "tbl"}), ("win_11_headings", {"p"}), ("agg_6_fingerprint", {"p", "tc", "tr", "tbl"}), ("agg_4_risks", set()), ("flt_12_by_path", {"tr", "tc", "subList", "p"})])
def test_queries_store_only_what_they_read(spark, monkeypatch, query, tags):
    """No element of a tag that a query does not read is stored; its rows are those over a corpus stored whole."""
    from folioframe import engine

    made, real = [], store.stored
    monkeypatch.setattr(store, "stored", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    told = lambda: sorted(map(repr, engine.QUERIES[query](spark, "/root/testdata/sf0.001").collect()))
    few = told()
    assert few and {r.tag for r in made[0].elements.where("depth > 0").select("tag").distinct().collect()} == tags | ({"subList"} if query in ("snk_7_markdown", "snk_8_html") else set())
    monkeypatch.setattr(store, "stored", lambda entries, tags=None: real(entries))
    assert told() == few


def test_labels_are_trimmed_of_tables_only(spark):
    """What says something is what trimming leaves something of; labels pass over blank paragraphs, and only tables' labels are evened out."""
    texts = ["", " ", "\u3000\u00a0\r\n\t", "a", " \n a \r\n\r\n\r\n\r\n b\u3000 ", "\u200b", "\x1c", "\x85\u2028"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.says(F.col("t")).alias("x"), (T.trim_unicode(F.col("t")) != "").alias("y"), (T.trim_unicode(T.normalize_inline(F.col("t"))) != "").alias("z")).collect()
    assert all(r.x == r.y == r.z for r in rows) and {r.x for r in rows} == {True, False, None}
    table = "<hp:p><hp:run><hp:tbl rowCnt='1' colCnt='1'><hp:tr>" + cell(0, 0, "c") + "</hp:tr></hp:tbl></hp:run></hp:p>"
    entries = spark.createDataFrame(package("d", ["section0"], {"section0": para("&#160; a &#13;&#10; b &#160;") + para("&#12288; ") + table}), P.ENTRIES)
    elements = P.flatten(entries)
    paragraphs = D.paragraph_texts(elements)
    found = D.tables(elements, paragraphs, D.cells(elements)).first()
    assert (found.label, found.fill_label) == ("a\nb", "a \r\n b")
    plan = D.table_labels(D.paragraph_texts(store.stored(entries).elements))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "regexp_replace" not in plan
