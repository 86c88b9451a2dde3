"""Packages (ZIP files or folders of XML parts) as rows, and rows back to packages.

One task reads one package; every later step is relational. Names match by local part, whatever the
namespace prefix.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import zipfile
import zlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.sources import archives

#: Fixed values of the format.
MIMETYPE = "application/hwp+zip"
REQUIRED = ("mimetype", "version.xml", "Contents/content.hpf", "Contents/header.xml")
ENTRIES = "doc_id string, path string, content binary"
ELEMENTS = (
    "doc_id string, section_path string, section_idx int, pre int, parent_pre int, above array<int>, last int, depth int, tag string, path string, attrs map<string,string>, text string, tail string, "
    "all_p_idx int, body_p_idx int, run_idx int, table_idx int, parent_table_idx int, cell_row int, cell_col int, in_tables array<int>, has_secpr boolean, "
    "text_t string, text_tbt string, text_lines string, text_direct string, text_fill string, text_all string, "
    "paragraph_count int, row_span int, col_span int, width int, height int"
)
#: Elements whose texts are gathered, and those that are objects of a run.
TEXTED = {"p", "tc", "tbl", "pic", "equation", "rect", "line", "ellipse", "ctrl", "header", "footer", "drawText"}
OBJECTS = {"tbl", "pic", "equation", "rect", "line", "ellipse"}
#: Elements that are one character, and those whose texts are not just those of what is in them.
_SIGNS = {"lineBreak": "\n", "tab": "\t"}
_OWN = {"t", "script", *_SIGNS}
_UNTOLD = (None,) * 7
#: The one entry of an archive that can't be read; its content is the reason.
BROKEN = archives.BROKEN
#: The kinds of pictures that are read.
PICTURES = ("png", "jpg", "gif")
#: Parts that are sections, and all parts that are parsed; the tag of a row that only names an entry.
SECTIONS = r"(^|/)section[^/]*\.xml$"
PARSED = SECTIONS + r"|^Contents/(content\.hpf|header\.xml)$|^version\.xml$"
ENTRY = "#entry"
#: Elements that the order of the sections and the manifest are read from.
ORDERING = {"item", "itemref"}
INTERNAL = r"(^|/)(\.[^/]*\.lock|\.[^/]*\.tmp)$"


def read_archives(spark: SparkSession, glob: str, names: str | None = None, **options) -> DataFrame:
    """entries of every archive, or those whose names match; doc_id is the archive's path. Folder entries are skipped.

    By the ``archives`` source where tasks can seek in the files, else whole archives as rows of at
    most 2 GB each. Of an archive without a readable directory one entry BROKEN holds the reason; an
    entry that can't be inflated has a null content, which is an error where it is parsed.
    """
    if archives.known(glob):
        return archives.load(spark, glob, **options, **({"names": names} if names else {})).select("doc_id", "path", "content")
    found = entries_of(spark.read.format("binaryFile").load(glob))
    return found.where(F.col("path").rlike(names) | (F.col("path") == BROKEN)) if names else found


def _inflated(doc_id: str, content: bytes | None) -> list[tuple[str, str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return [(doc_id, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, struct.error, zlib.error) as e:
        return [(doc_id, BROKEN, str(e).encode())]


def entries_of(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """files(path, content) -> the entries of the archives; of a file that is none, one entry BROKEN with the reason."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, archive in zip(batch["doc_id"], batch["archive"], strict=True):
                yield pd.DataFrame(_inflated(doc_id, archive), columns=["doc_id", "path", "content"])

    return files.select(F.col(name).alias("doc_id"), F.col(content).alias("archive")).mapInPandas(unzip, ENTRIES)


def unzipped(archives: DataFrame) -> DataFrame:
    """(doc_id, archive) -> entries; a broken or null archive has one entry BROKEN."""
    return entries_of(archives, "doc_id", "archive")


def images(entries: DataFrame) -> DataFrame:
    """(doc_id, path, format, width, height) of embedded pictures, in pixels; null where the format is unknown."""
    from folioframe.operators.edit import EditError, image_size

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, path, content in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
                try:
                    kind, *size = image_size(bytes(content))
                    rows.append((doc_id, path, *((kind, *size) if kind in PICTURES else (None, None, None))))
                except (EditError, ValueError, IndexError, struct.error):
                    rows.append((doc_id, path, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "path", "format", "width", "height"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return entries.where(F.col("path").startswith("BinData/")).mapInPandas(scan, "doc_id string, path string, format string, width int, height int")


def entry_names(entries: DataFrame) -> DataFrame:
    return paths(entries).groupBy("doc_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def next_ids(elements: DataFrame, tag: str | None = None, start: int = 1) -> DataFrame:
    """(doc_id, next_id): one more than the greatest numeric id (of a tag), start if there is none."""
    rows = elements if tag is None else elements.where(F.col("tag") == tag)
    found = rows.groupBy("doc_id").agg((F.max(F.expr("try_cast(attrs['id'] as bigint)")) + 1).alias("next_id"))
    return elements.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("next_id", F.lit(start)).alias("next_id"))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """entries of one unpacked package, with paths relative to root; lock and temporary files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "")
    return files.select(F.lit(root).alias("doc_id"), relative.alias("path"), "content").where(~F.col("path").rlike(INTERNAL))


def read(spark: SparkSession, target: str) -> DataFrame:
    """entries of a folder of parts, of one archive, or of all archives that a pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if "*" not in target and path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read_folder(spark, target)
    return read_archives(spark, target)


def safe_path(path: str) -> bool:
    parts = PurePosixPath(path).parts
    return bool(parts) and not path.startswith("/") and ".." not in parts


def pack(entries: DataFrame) -> DataFrame:
    """(doc_id, archive binary, reason): ``mimetype`` first and stored, the rest deflated in path order; a document with an unsafe entry name has a reason instead of an archive."""

    def zipped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        parts = {p: bytes(c) for p, c in zip(rows["path"], rows["content"], strict=True)}
        if bad := sorted(p for p in parts if not safe_path(p)):
            return pd.DataFrame([(key[0], None, f"unsafe entry names: {bad[:3]}")], columns=["doc_id", "archive", "reason"])
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(parts, key=lambda p: (p != "mimetype", p)):
                info = zipfile.ZipInfo(p, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_STORED if p == "mimetype" else zipfile.ZIP_DEFLATED
                z.writestr(info, parts[p])
        return pd.DataFrame([(key[0], out.getvalue(), None)], columns=["doc_id", "archive", "reason"])

    return entries.groupBy("doc_id").applyInPandas(zipped, "doc_id string, archive binary, reason string")


def unpack(entries: DataFrame, root: str) -> DataFrame:
    """Write every entry to root/(folder of the document)/path; (doc_id, path, folder, written, reason) of what was and was not.

    The folder is the document's base name and a digest of its whole name, so documents of one base
    name keep apart. Names that leave it are refused. root must be a folder that all executors
    share; a file appears under its name once it is whole, so a task that is run again does no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, path, content in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
                stem = os.path.splitext(os.path.basename(doc_id))[0] or "document"
                folder = f"{stem}-{hashlib.sha256(doc_id.encode()).hexdigest()[:12]}"
                if not safe_path(path) or not safe_path(folder):
                    out.append((doc_id, path, folder, False, "unsafe name"))
                    continue
                to = os.path.join(root, folder, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.tmp"
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, to)
                out.append((doc_id, path, folder, True, None))
            yield pd.DataFrame(out, columns=["doc_id", "path", "folder", "written", "reason"])

    return entries.select("doc_id", "path", "content").mapInPandas(write, "doc_id string, path string, folder string, written boolean, reason string")


def packable(entries: DataFrame) -> DataFrame:
    """entries without locks and temporary files."""
    return entries.where(~F.col("path").rlike(INTERNAL))


def blank(doc_id: str = "new", title: str = "") -> list[tuple[str, str, bytes]]:
    """The entries of an empty package of one section."""
    ns = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph" xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section"'
    parts = {
        "mimetype": MIMETYPE,
        "version.xml": '<v:version xmlns:v="http://www.hancom.co.kr/hwpml/2011/version" appVersion="1.0" hwpxVersion="1.0"/>',
        "Contents/content.hpf": (
            '<p:package xmlns:p="http://www.hancom.co.kr/schema/2011/hpf" xmlns:o="http://www.idpf.org/2007/opf/" xmlns:d="http://purl.org/dc/elements/1.1/">'
            f"<o:metadata><d:title>{title}</d:title></o:metadata><o:manifest>"
            '<o:item id="header" href="Contents/header.xml" media-type="application/xml"/><o:item id="section0" href="Contents/section0.xml" media-type="application/xml"/>'
            '</o:manifest><o:spine><o:itemref idref="section0"/></o:spine></p:package>'
        ),
        "Contents/header.xml": '<h:head xmlns:h="http://www.hancom.co.kr/hwpml/2011/head" secCnt="1"/>',
        "Contents/section0.xml": f'<hs:sec {ns}><hp:p id="1" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t/></hp:run></hp:p></hs:sec>',
    }
    return [(doc_id, p, c.encode()) for p, c in parts.items()]


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def walked(entries: DataFrame, only: str = SECTIONS, listed: bool = False, tags: set[str] | None = None) -> DataFrame:
    """One row an element of the parts that ``only`` names, in document order, with the coordinates and texts that every later operator uses.

    all_p_idx counts paragraphs at any depth; body_p_idx counts direct children of the root without
    a section property in a direct run; table_idx counts tables at any depth; cells by address;
    ``above`` holds the numbers of all ancestors, the root's first. Texts of a paragraph, cell or
    object: of ``t`` only, with line breaks and tabs, of its own lines (not of paragraphs in it,
    scripts included), of its own runs without objects (and without text boxes), and all. A part
    that is no XML is one row of tag ``#error`` with the reason as text. section_idx is the number
    in the part's name, 0 without one; ``flatten`` puts the place in the spine there. listed: a row
    of tag ENTRY besides, for every entry of any kind. tags: rows of these tags only (and errors,
    and, where entries are listed, the roots of the parts), where nothing else is asked for; what
    they hold is the same.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            columns = dict(zip([c for c, _ in _COLUMNS], zip(*rows, strict=True) if rows else ((),) * len(_COLUMNS), strict=True))
            ends = lambda c: pa.array([0, *accumulate(map(len, columns[c]))], pa.int32())
            flat = lambda values: pa.array(list(chain.from_iterable(values)))
            made = {
                "above": lambda x: pa.ListArray.from_arrays(ends("above"), flat(x).cast(pa.int32())),
                "attrs": lambda x: pa.MapArray.from_arrays(ends("attrs"), flat(x).cast(pa.string()), flat(d.values() for d in x).cast(pa.string())),
            }
            return pa.RecordBatch.from_arrays([made[c](columns[c]) if c in made else pa.array(columns[c], _ARROW[t]) for c, t in _COLUMNS], [c for c, _ in _COLUMNS])

        def bare(doc_id: str, section: str, pre: int, tag: str, text: str) -> tuple:
            return (doc_id, section, None, pre, -1, (), 0, 0, tag, "", {}, text, "", *[None] * (len(_COLUMNS) - 13))

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, section, content in zip(*(batch.column(c) for c in ("doc_id", "path", "content")), strict=True):
                doc_id, section = doc_id.as_py(), section.as_py()
                if listed:
                    rows.append(bare(doc_id, section, -1, ENTRY, ""))
                if content.is_valid:
                    try:
                        _walk_part(doc_id, section, ET.fromstring(content.as_py()), rows, tags, listed)
                    except (ET.ParseError, ValueError, LookupError) as e:
                        rows.append(bare(doc_id, section, 0, "#error", str(e)))
                if len(rows) > 20_000:
                    yield told()
                    rows.clear()
        yield told()

    parsed = F.col("path").rlike(only)
    content = F.when(parsed, F.coalesce("content", F.lit(b"")))
    told = (entries if listed else entries.where(parsed)).select("doc_id", "path", content.alias("content")).mapInArrow(walk, ELEMENTS)
    number = F.coalesce(F.expr("try_cast(regexp_extract(section_path, '([0-9]+)[.]xml$', 1) as int)"), F.lit(0))
    return told.withColumn("section_idx", number)


def section_order(rows: DataFrame) -> DataFrame:
    """(doc_id, sections): the section parts in the order of the spine; rows are those of the package part, with entries listed.

    An item of the spine names an item of the manifest (of several with its id the last), whose part
    must exist; parts that the spine does not name have no place. One that it names twice has the first.
    """
    a = F.col("attrs")
    at = lambda tag, *more: F.array_sort(F.collect_list(F.when((F.col("tag") == tag) & (F.col("section_path") == "Contents/content.hpf"), F.struct("pre", *more))))
    items = at("item", a["id"].alias("id"), F.regexp_replace(F.coalesce(a["href"], F.lit("")), "^/", "").alias("href"))
    kept = rows.where(F.col("tag").isin("item", "itemref", ENTRY)).groupBy("doc_id").agg(
        items.alias("items"), at("itemref", a["idref"].alias("id")).alias("refs"), F.collect_set(F.when(F.col("tag") == ENTRY, F.col("section_path"))).alias("paths")
    )
    href = F.transform("refs", lambda r: F.get(F.transform(F.reverse(F.filter("items", lambda i: i["id"] == r["id"])), lambda i: i["href"]), F.lit(0)))
    path = lambda h: F.when(F.array_contains("paths", h), h).when(F.array_contains("paths", F.concat(F.lit("Contents/"), h)), F.concat(F.lit("Contents/"), h))
    found = F.filter(F.transform(href, path), lambda x: x.isNotNull() & x.rlike(SECTIONS))
    return kept.select("doc_id", F.array_distinct(found).alias("sections"))


def spined(elements: DataFrame, order: DataFrame) -> DataFrame:
    """Elements of sections with their place in the spine; those of parts outside it leave."""
    place = F.array_position("sections", F.col("section_path"))
    met = elements.join(order, "doc_id").withColumn("section_idx", (place - 1).cast("int")).where("section_idx >= 0")
    return met.select(*elements.columns)


def flatten(source, only: str = SECTIONS, tags: set[str] | None = None) -> DataFrame:
    """Elements (see ``walked``) of entries or of a stored corpus: the sections in the order of the spine, or the parts that ``only`` names; of some tags only, if given.

    What reads one kind of element once needs no stored corpus: rows of other tags never leave the parser then.
    """
    if hasattr(source, "parts"):
        found = source.parts(only)
        return found.where(F.col("tag").isin(*tags, "#error")) if tags else found
    rows = walked(source, only, tags=tags)
    return spined(rows, section_order(walked(source, r"^Contents/content\.hpf$", listed=True))) if only == SECTIONS else rows


def paths(source) -> DataFrame:
    """(doc_id, path) of all entries."""
    return source.paths() if hasattr(source, "paths") else source.select("doc_id", "path")


def sections_of(source) -> DataFrame:
    """(doc_id, section_idx, path) of the sections in the spine."""
    if hasattr(source, "parts"):
        return source.elements.select("doc_id", "section_idx", F.col("section_path").alias("path")).distinct()
    order = section_order(walked(source, r"^Contents/content\.hpf$", listed=True))
    return order.select("doc_id", F.posexplode("sections").alias("section_idx", "path"))


def documents(source) -> DataFrame:
    """(doc_id), once each."""
    return paths(source).select("doc_id").distinct()


_COLUMNS = [tuple(c.split()) for c in ELEMENTS.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<int>": pa.list_(pa.int32())}


def sections_only(elements: DataFrame, index: int | None = None, every: bool = False) -> DataFrame:
    """Elements of one section by its place in the spine, of all, or of the first one; one index or all, not both."""
    if index is not None and every:
        raise ValueError("one section or all sections, not both")
    return elements if every else elements.where(F.col("section_idx") == (index or 0))


def _int(value: str | None, default: int) -> int:
    try:
        return n if abs(n := int(value)) < 1 << 31 else default
    except (TypeError, ValueError):
        return default


#: The texts of an element without any, as ``_gathered`` has them.
_SILENT = ("",) * 7


def _heard(e: ET.Element, tag: str, kids: list[tuple]) -> tuple:
    """The seven texts of an element from its children's, as they are inside it.

    Of ``t``; of ``t`` with breaks and tabs; all; all without objects; without objects and text boxes;
    own lines outside of ``t`` and ``script``; own lines inside of these.
    """
    text, sign = e.text or "", _SIGNS.get(tag)
    if not kids:
        t = both = lines = ""
        told = whole = bare = fill = text
    else:
        t, both, lines = ("".join([k[c] for k in kids]) for c in (0, 1, 5))
        if any(c.tail for c in e):
            tails = [c.tail or "" for c in e]
            whole, bare, fill, told = (text + "".join([x for k, tail in zip(kids, tails, strict=True) for x in (k[c], tail)]) for c in (2, 3, 4, 6))
        else:
            whole, bare, fill, told = (text + "".join([k[c] for k in kids]) for c in (2, 3, 4, 6))
    if sign is not None:
        return (t, sign + both, sign, sign, sign, sign + lines, sign + told)
    if tag == "t":
        return (text + t, text + both, whole, bare, fill, told, told)
    if tag == "script":
        return (t, both, whole, bare, fill, told, told)
    return (t, both, whole, bare, fill, lines, told)


def _passed(tag: str, heard: tuple) -> tuple:
    """What an element's texts are to the one around it."""
    if tag in OBJECTS:
        return (*heard[:3], "", "", *heard[5:])
    if tag == "drawText":
        return (*heard[:4], "", *heard[5:])
    return (*heard[:5], "", "") if tag == "p" else heard


def _gathered(order: list[ET.Element], names: list[str], size: list[int], wanted: set[str]) -> dict[int, tuple]:
    """Number -> (text_t, text_tbt, text_lines, text_direct, text_fill, text_all, has_secpr) of the elements of the wanted tags, each text put together once from those below.

    size is filled with how many elements each one is, itself included.
    """
    if wanted.isdisjoint(names):  # only the sizes
        for i in range(len(order) - 1, -1, -1):
            j = i + 1
            for _ in order[i]:
                j += size[j]
            size[i] = j - i
        return {}
    said, out = [_SILENT] * len(order), {}
    for i in range(len(order) - 1, -1, -1):
        e, tag = order[i], names[i]
        if not len(e) and tag not in wanted:  # a leaf, as most elements are
            if tag == "t":
                said[i] = (e.text,) * 7 if e.text else _SILENT
                continue
            if not e.text and tag not in _OWN:
                continue
        if len(e) == 1 and i and tag not in wanted and not e.text and tag not in _OWN and not e[0].tail:  # says what its only child does
            size[i], heard, said[i + 1] = size[i + 1] + 1, said[i + 1], _SILENT
            if heard is not _SILENT:
                said[i] = _passed(tag, heard)
            continue
        below, j = [], i + 1
        for _ in e:
            below.append(j)
            j += size[j]
        size[i] = j - i
        kept = tag in wanted
        if not i and not kept:
            break  # nothing asks for the texts of a whole part
        loud = [said[k] for k in below if said[k] is not _SILENT]
        if len(loud) < 2 and not e.text and tag not in _OWN and not any(c.tail for c in e):
            heard = loud[0] if loud else _SILENT
        elif tag == "t" and not below:
            heard = (e.text or "",) * 7
        else:
            heard = _heard(e, tag, [said[k] for k in below])
        if kept:
            lines = direct = fill = secpr = None
            if tag == "p":
                runs = [k for k in below if names[k] == "run"]
                lines, direct, fill = heard[5], "".join([said[k][3] for k in runs]), "".join([said[k][4] for k in runs])
                secpr = any(_local(x.tag) == "secPr" for k in runs for x in order[k])
            out[i] = (heard[0], heard[1], lines, direct, fill, heard[2], secpr)
        for k in below:
            said[k] = _SILENT
        said[i] = _passed(tag, heard)
    return out


def _walk_part(doc_id: str, section: str, root: ET.Element, rows: list[tuple], tags: set[str] | None = None, rooted: bool = False) -> None:
    """Append the rows of a part, values in the order of ELEMENTS; of the given tags only (and of the root, if rooted), if any are given."""
    order = list(root.iter())
    names = [_local(e.tag) for e in order]
    size = [1] * len(order)
    texts = _gathered(order, names, size, TEXTED if tags is None else TEXTED & tags)
    before = list(accumulate((tag == "p" for tag in names), initial=0))  # paragraphs before each element
    # elements before each one that are asked for or counted: what holds none is not walked (paragraphs are counted beforehand, but those of the body)
    met = None if tags is None else [0, *accumulate(tag in tags or tag == "tbl" for tag in names)]
    n_body = n_tbl = 0
    # of each element: parent's number, depth, path, numbers of ancestors, coordinates
    todo: list = [None] * len(order)
    todo[0] = (-1, 0, names[0], (), (None, None, None, None, None, None, None, ()))
    for pre, (e, tag) in enumerate(zip(order, names, strict=True)):
        if todo[pre] is None:
            continue
        (parent, depth, path, above, at), todo[pre] = todo[pre], None
        text_t, text_tbt, text_lines, text_direct, text_fill, text_all, has_secpr = texts.get(pre, _UNTOLD)
        paragraph_count = row_span = col_span = width = height = None
        if tag == "p":
            body = at[1]
            if depth == 1:
                secpr = any(_local(x.tag) == "secPr" for r in e if _local(r.tag) == "run" for x in r) if has_secpr is None else has_secpr
                body = None if secpr else n_body
                n_body += not secpr
            at = (before[pre], body, *at[2:])
        elif tag == "tbl":
            at = (*at[:3], n_tbl, at[3], None, None, (*at[7], n_tbl))
            n_tbl += 1
        elif tag == "tc":
            part = {}
            for x in e:
                part.setdefault(_local(x.tag), x)
            address, span, cell_size = (part.get(name, {}) for name in ("cellAddr", "cellSpan", "cellSz"))
            at = (*at[:5], _int(address.get("rowAddr"), 0), _int(address.get("colAddr"), 0), at[7])
            paragraph_count = before[pre + size[pre]] - before[pre]
            row_span, col_span = max(1, _int(span.get("rowSpan"), 1)), max(1, _int(span.get("colSpan"), 1))
            width, height = _int(cell_size.get("width"), 0), _int(cell_size.get("height"), 0)
        if tags is None or tag in tags or rooted and not pre:
            rows.append((
                doc_id, section, None, pre, parent, above, pre + size[pre] - 1, depth, tag, path, {_local(k): v for k, v in e.attrib.items()} if e.attrib else {}, e.text or "", e.tail or "", *at, has_secpr,
                text_t, text_tbt, text_lines, text_direct, text_fill, text_all, paragraph_count, row_span, col_span, width, height,
            ))
        if size[pre] > 1 and (met is None or not pre or met[pre + size[pre]] > met[pre + 1]):
            over, seen, runs, j = (*above, pre), {}, 0, pre + 1
            body_p = tag == "p" and depth == 1
            for _ in e:
                name = names[j]
                k = seen.get(name, 0)
                seen[name] = k + 1
                inner = at
                if body_p and name == "run":
                    inner = (*at[:2], runs, *at[3:])
                    runs += 1
                if met is None or met[j + size[j]] > met[j] or not pre and name == "p":
                    todo[j] = (pre, depth + 1, f"{path}/{name}[{k}]", over, inner)
                j += size[j]


def manifest(entries: DataFrame) -> DataFrame:
    """(doc_id, pos, id, href, media_type), href resolved against the entries there are."""
    parts = flatten(entries, r"^Contents/content\.hpf$").where("tag = 'item'")
    return parts.select("doc_id", F.col("pre").alias("pos"), F.col("attrs")["id"].alias("id"), F.regexp_replace(F.col("attrs")["href"], "^/", "").alias("href"), F.col("attrs")["media-type"].alias("media_type"))


def spine(entries: DataFrame) -> DataFrame:
    parts = flatten(entries, r"^Contents/content\.hpf$").where("tag = 'itemref'")
    return parts.select("doc_id", F.col("pre").alias("pos"), F.col("attrs")["idref"].alias("idref"))


def resolved(items: DataFrame, entries: DataFrame) -> DataFrame:
    """items with ``path``: the href as it is, else under Contents/; the first that exists, else the href itself."""
    there = paths(entries)
    bare = there.select("doc_id", F.col("path").alias("href"), F.col("path").alias("_bare"))
    under = there.where("path like 'Contents/%'").select("doc_id", F.expr("substring(path, 10)").alias("href"), F.col("path").alias("_under")).where("href not like 'Contents/%' and href not like 'BinData/%'")
    return items.join(bare, ["doc_id", "href"], "left").join(under, ["doc_id", "href"], "left").withColumn("path", F.coalesce("_bare", "_under", "href")).withColumn("exists", F.col("_bare").isNotNull() | F.col("_under").isNotNull()).drop("_bare", "_under")


def metadata(entries: DataFrame) -> DataFrame:
    """(doc_id, name, value) of the metadata, the title among it."""
    rows = flatten(entries, r"^Contents/content\.hpf$").where(F.col("path").rlike(r"/metadata\[\d+\]/") & (F.trim("text") != ""))
    return rows.select("doc_id", F.coalesce(F.col("attrs")["name"], F.col("tag")).alias("name"), F.trim("text").alias("value"))


def versions(entries: DataFrame) -> DataFrame:
    root = flatten(entries, r"^version\.xml$").where("depth = 0")
    return root.select("doc_id", F.col("attrs")["appVersion"].alias("app_version"), F.col("attrs")["hwpxVersion"].alias("format_version"))


def declared_sections(entries: DataFrame) -> DataFrame:
    root = flatten(entries, r"^Contents/header\.xml$").where("depth = 0")
    return root.select("doc_id", F.expr("try_cast(attrs['secCnt'] as int)").alias("declared"))


def styles(entries: DataFrame) -> DataFrame:
    """(doc_id, id, name, para_pr_id, char_pr_id); of several with an id the last stands."""
    s = flatten(entries, r"^Contents/header\.xml$").where("tag = 'style'")
    a = F.col("attrs")
    s = s.select("doc_id", "pre", F.trim(a["id"]).alias("id"), F.trim(a["name"]).alias("name"), a["paraPrIDRef"].alias("para_pr_id"), a["charPrIDRef"].alias("char_pr_id")).where("id <> '' and name <> ''")
    return s.groupBy("doc_id", "id").agg(*[F.max_by(c, "pre").alias(c) for c in ("name", "para_pr_id", "char_pr_id")])


def char_props(entries: DataFrame) -> DataFrame:
    """(doc_id, id, bold, italic, underline, color, font, size_pt), with the implicit id 0."""
    e = flatten(entries, r"^Contents/header\.xml$")
    pr = e.where("tag = 'charPr'").select("doc_id", "pre", "last", F.col("attrs")["id"].alias("id"), F.upper(F.coalesce(F.col("attrs")["textColor"], F.lit("#000000"))).alias("color"), (F.coalesce(F.expr("try_cast(attrs['height'] as double)"), F.lit(1000.0)) / 100).alias("size_pt"))
    kids = e.where("tag in ('bold', 'italic', 'underline', 'fontRef')").select("doc_id", F.col("parent_pre").alias("pre"), "tag", "attrs")
    flags = kids.groupBy("doc_id", "pre").agg(
        F.max(F.col("tag") == "bold").alias("bold"), F.max(F.col("tag") == "italic").alias("italic"),
        F.max((F.col("tag") == "underline") & (F.coalesce(F.upper(F.col("attrs")["type"]), F.lit("")) != "NONE")).alias("underline"),
        F.max(F.when(F.col("tag") == "fontRef", F.coalesce(F.nullif(F.col("attrs")["hangul"], F.lit("")), F.col("attrs")["latin"]))).alias("font_id"),
    )
    hangul = e.where("tag = 'fontface' and upper(attrs['lang']) = 'HANGUL'").select("doc_id", F.col("pre").alias("parent_pre"))
    fonts = e.where("tag = 'font'").join(hangul, ["doc_id", "parent_pre"]).groupBy("doc_id", F.col("attrs")["id"].alias("font_id")).agg(F.max_by(F.col("attrs")["face"], "pre").alias("font"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    found = pr.join(flags, ["doc_id", "pre"], "left").join(fonts, ["doc_id", "font_id"], "left").select("doc_id", "id", no("bold"), no("italic"), no("underline"), "color", F.coalesce("font", F.lit("")).alias("font"), "size_pt")
    rest = documents(entries).join(found.where("id = '0'").select("doc_id"), "doc_id", "left_anti")
    return found.unionByName(rest.select("doc_id", F.lit("0").alias("id"), *[F.lit(False).alias(c) for c in ("bold", "italic", "underline")], F.lit("#000000").alias("color"), F.lit("").alias("font"), F.lit(10.0).alias("size_pt")))
