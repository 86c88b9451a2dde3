"""Scalar text rules as column expressions: trimming, truncation, normalising, keys, levels, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a placeholder or a guide, and the words that make a marked line a guide.
PLACEHOLDER = r"\{\{[^{}]+\}\}|_{3,}|□{1,}|▢{1,}"
GUIDE_MARK = "※"
MARKED_GUIDE_WORDS = ("작성", "기재", "참고")
GUIDE_PHRASES = ("작성요령", "작성 요령", "작성예시", "작성 예시", "기재요령", "기재 요령", "유의사항")
#: First characters that a table label never has.
NO_LABEL_STARTS = ("※", "*", "-", "<", "(", "ㅇ")


def trim_unicode(c: Column) -> Column:
    """Strips every Unicode blank, NBSP and U+3000 included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def says(c: Column) -> Column:
    """Whether ``trim_unicode`` leaves anything, found at the first character that is no blank."""
    return c.rlike(r"(?U)\S")


def truncate_bytes(c: Column, n: int, mark: str = "...") -> Column:
    """Texts over n bytes are cut to n bytes (a cut character becomes U+FFFD), trimmed and marked."""
    head = F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(trim_unicode(head), F.lit(mark)))


def collapse_blanks(c: Column) -> Column:
    return trim_unicode(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_inline(c: Column) -> Column:
    """Line ends to \\n, every line trimmed, runs of blank lines to one, outer blanks gone."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), trim_unicode)
    return trim_unicode(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def split_paragraphs(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")


def field_key(c: Column, ordinal: Column) -> Column:
    """Letters and digits between anything else: none field_N, one a, two a.b, more a.b_c."""
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    first, rest = F.element_at(parts, 1), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "_")
    return (
        F.when(F.size(parts) == 0, F.concat(F.lit("field_"), ordinal.cast("string")))
        .when(F.size(parts) == 1, first)
        .otherwise(F.concat_ws(".", first, rest))
    )


def heading_level(style: Column, cap: int | None = 6, title: bool = True) -> Column:
    """title is 1 (if asked for); ``heading N`` and ``개요 N`` are N, at most cap."""
    low = F.lower(F.trim(style))
    n = F.regexp_extract(low, r"^(?:heading|개요)\s*(\d+)", 1)
    level = F.coalesce(n.try_cast("int"), F.lit(2**31 - 1))  # more digits than an int has
    level = F.when(n != "", F.least(level, F.lit(cap)) if cap else level)
    return F.when(low == "title", F.lit(1)).otherwise(level) if title else level


def is_placeholder(c: Column) -> Column:
    return (
        F.when(c.contains("{{") & c.contains("}}"), F.lit("mustache-pattern"))
        .when(c.rlike(PLACEHOLDER), F.lit("placeholder-pattern"))
    )


def is_guide(c: Column) -> Column:
    any_of = lambda words: F.lit(False) if not words else _any([c.contains(w) for w in words])
    return F.when(c.startswith(GUIDE_MARK) & any_of(MARKED_GUIDE_WORDS), F.lit("guide-marker")).when(any_of(GUIDE_PHRASES), F.lit("guide-text"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def keeps_anchor(c: Column) -> Column:
    """Non-empty, at most 32 code points, neither placeholder nor guide, with a letter."""
    return (F.length(c) > 0) & (F.length(c) <= 32) & is_placeholder(c).isNull() & is_guide(c).isNull() & c.rlike(r"\p{L}")


def paragraph_anchor_shape(c: Column) -> Column:
    return F.length(c) <= F.when(c.contains(" "), F.lit(18)).otherwise(F.lit(24))


def date_like(c: Column) -> Column:
    return c.rlike(r"(?U)^[\d\s.\-/:]+$") & c.rlike(r"(?U)\d")


def mm_to_unit(mm: Column) -> Column:
    return F.when(mm > 0, F.floor(mm * 7200.0 / 25.4 + 0.5)).otherwise(F.lit(0)).cast("int")


def distribute(total: Column, n: Column) -> Column:
    """n even parts, the remainder in the last."""
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.floor(total / n) + F.when(i == n - 1, F.pmod(total, n)).otherwise(F.lit(0))).cast("long"),
    )


def section_role(tables: Column, top: Column, paragraphs: Column, placeholders: Column, guides: Column) -> Column:
    return (
        F.when((placeholders > 0) | (guides > 0), F.lit("template-form"))
        .when((top >= 2) & (paragraphs <= top * 2 + 2), F.lit("table-form"))
        .when((top > 0) & (paragraphs <= top + 2), F.lit("table-sheet"))
        .when((tables == 0) & (paragraphs >= 3), F.lit("narrative"))
        .otherwise(F.lit("mixed"))
    )


def table_role(depth: Column, rows: Column, cols: Column) -> Column:
    return (
        F.when(depth > 0, F.lit("nested"))
        .when((rows <= 2) & (cols <= 2), F.lit("key-value"))
        .when((rows >= 2) & (cols >= 2), F.lit("matrix"))
        .otherwise(F.lit("single-axis"))
    )


def keeps_label(c: Column) -> Column:
    """At most 48 code points, no replacement character, neither placeholder, guide nor date, not a list mark first."""
    return (
        (F.length(c) > 0) & (F.length(c) <= 48) & ~c.contains("\ufffd") & is_placeholder(c).isNull() & is_guide(c).isNull()
        & ~date_like(c) & ~F.substring(c, 1, 1).isin(*NO_LABEL_STARTS)
    )


def cell_anchor(row: Column, col: Column) -> Column:
    pick = lambda role, score: F.struct(F.lit(role).alias("role"), F.lit(score).alias("score"))
    return F.when((row == 0) & (col == 0), pick("header-cell", 95)).when(row == 0, pick("column-label", 90)).when(col == 0, pick("row-label", 88))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def html_escape(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def local_name(c: Column) -> Column:
    return F.substring_index(c, ":", -1)


def signature(*parts: Column) -> Column:
    """Parts joined by ``|``; a null part is ``-``, so that different coordinates can't collide."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


#: What is taken out of a selector before it becomes a key.
KEY_DROPS = ("{", "}", "[", "]", "<", ">")
KEY_BLANKS = ("□", "▢", "※")


def key_source(c: Column) -> Column:
    """A selector's words: cut at ``*``, without brackets, box marks, company marks and runs of zeros, in lower case."""
    c = F.trim(F.regexp_replace(trim_unicode(F.replace(c, F.lit("\n"), F.lit(" "))), r"\*.*$", ""))
    c = F.translate(c, "".join(KEY_DROPS), "")
    c = F.translate(c, "".join(KEY_BLANKS), " " * len(KEY_BLANKS))
    c = F.regexp_replace(F.regexp_replace(c, r"\(\s*주\s*\)|（\s*주\s*）", " "), r"0{2,}", " ")
    return F.lower(trim_unicode(c))


def template_id(path: Column) -> Column:
    """A file's name as an identifier."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    key = F.replace(field_key(key_source(name), F.lit(0)), F.lit("."), F.lit("_"))
    return F.when(key == "field_0", F.lit("template_contract")).when(key.rlike(r"^\p{Nd}"), F.concat(F.lit("template_"), key)).otherwise(key)


def matrix(c: Column) -> Column:
    """``a,b;c,d`` as an array of rows."""
    return F.transform(F.split(c, ";"), lambda r: F.transform(F.split(r, ","), lambda x: F.trim(x)))


#: Units of a picture of no asked width, and of the text of a page.
IMAGE_WIDTH, PAGE_WIDTH = 22677, 42520


def image_units(pixels_wide: Column, pixels_high: Column, width_mm: Column | None = None) -> Column:
    """struct(width, height) in units: the asked width, else the usual one, at most a page's text; the shape is that of the pixels, square where these are none."""
    asked = F.lit(0) if width_mm is None else F.coalesce(mm_to_unit(width_mm), F.lit(0))
    width = F.least(F.when(asked > 0, asked).otherwise(F.lit(IMAGE_WIDTH)), F.lit(PAGE_WIDTH))
    height = F.when((pixels_wide > 0) & (pixels_high > 0), F.floor(width * pixels_high / pixels_wide + 0.5))
    return F.struct(width.cast("int").alias("width"), F.when(height > 0, height).otherwise(width).cast("int").alias("height"))


def border_strength(kind: Column, width_mm: Column) -> Column:
    """Of a visible line: a hundred times its width, and its kind's rank; 0 for none."""
    kind = F.upper(F.trim(kind))
    rank = F.when(kind == "DOUBLE_SLIM", 30).when(kind == "SOLID", 20).when(kind == "DASH", 10).otherwise(5)
    return F.when(kind.isin("NONE", ""), F.lit(0.0)).otherwise(width_mm * 100 + rank)


def within_units(a: Column, b: Column, parts: Column) -> Column:
    """Equal but for the rounding of so many parts."""
    return F.abs(a - b) <= parts


def rfc3339(ts: Column) -> Column:
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def role_hints(role: Column, **flags: Column) -> Column:
    """The role, then the name of each condition that holds, in order."""
    return F.array_compact(F.array(role, *[F.when(c, F.lit(n.replace("_", "-"))) for n, c in flags.items()]))
