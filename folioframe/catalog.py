"""All queries over the driver's tables, with their SQL counterparts.

The driver's tables hold no packages, so the relational half of every operator runs over stand-ins:
lines of ``documents`` are paragraphs, ``conversations`` turns are ordered paragraphs of a section,
``lineitem`` rows are grid cells, ``nation`` and ``region`` are style dictionaries, ``events.props``
is payload JSON, ``pages.html`` is markup. Package parsing has fixtures in the tests instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import matching

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: every line of every document, with its place."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.withColumn("line_no", F.col("line_no").cast("long"))


LINES = "(select doc_id, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_carried_label(spark, sf_dir)


@query(f"""select doc_id, line_no, last_value(case when length(line) <= 24 and length(line) > 0 then line end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as carried from {LINES}""")
def win_carried_label(spark, sf_dir):
    """Every line with the last label up to it."""
    label = F.when((F.length("line") <= 24) & (F.length("line") > 0), F.col("line"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines(spark, sf_dir).select("doc_id", "line_no", F.last(label, ignorenulls=True).over(w).alias("carried"))


@query(f"""with l as {LINES}, m as (select *, case when length(line) <= 24 and length(line) > 0 then line end as label from l),
 c as (select *, last_value(label ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as carried from m)
 select doc_id, count(*) as n_lines, count(distinct carried) as n_labels, sum(length(line))::bigint as n_chars from c group by doc_id""")
def win_label_counts(spark, sf_dir):
    """Labels carried forward are the distinct labels themselves, so a document needs no other row: no shuffle."""
    d = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    labels = F.array_distinct(F.filter("lines", lambda x: (F.length(x) <= 24) & (F.length(x) > 0)))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(labels).cast("long").alias("n_labels"), chars.alias("n_chars"))


@query(f"select doc_id, line_no from {LINES} where contains(lower(trim(line)), 'apache license')")
def flt_contains_normalized(spark, sf_dir):
    return lines(spark, sf_dir).where(F.lower(F.trim("line")).contains("apache license")).select("doc_id", "line_no")


@query(f"select doc_id, line_no, line from {LINES} where length(line) > 0 and length(line) <= case when contains(line, ' ') then 18 else 24 end")
def flt_anchor_shape(spark, sf_dir):
    c = F.col("line")
    return lines(spark, sf_dir).where((F.length(c) > 0) & T.paragraph_anchor_shape(c))


@query(f"""select doc_id, line_no, case when contains(line, '{{{{') and contains(line, '}}}}') then 'mustache-pattern'
 when regexp_matches(line, '_{{3,}}|□|▢') then 'placeholder-pattern' else 'none' end as reason from {LINES}""")
def flt_placeholder_detect(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", F.coalesce(T.is_placeholder(F.col("line")), F.lit("none")).alias("reason"))


_SAID = """(select p_partkey, case p_size % 5 when 0 then '※ 이 항목을 작성: ' || p_name when 1 then p_name || ' 유의사항' when 2 then '※ ' || p_name when 3 then '  ※ 참고 ' || p_name else p_name end as said from part)"""


@query(f"""select p_partkey, case when starts_with(trim(said), '※') and (contains(said, '작성') or contains(said, '기재') or contains(said, '참고')) then 'guide-marker'
 when contains(said, '작성요령') or contains(said, '유의사항') then 'guide-text' else 'none' end as reason from {_SAID}""")
def flt_guide_detect(spark, sf_dir):
    name, k = F.col("p_name"), F.col("p_size") % 5
    said = F.when(k == 0, F.concat(F.lit("※ 이 항목을 작성: "), name)).when(k == 1, F.concat(name, F.lit(" 유의사항"))).when(k == 2, F.concat(F.lit("※ "), name)).when(k == 3, F.concat(F.lit("  ※ 참고 "), name)).otherwise(name)
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.is_guide(F.lower(T.trim_unicode(said))), F.lit("none")).alias("reason"))


@query("select page_id, url, regexp_matches(url, '^[0-9 ./:-]+$') as date_like, length(url) <= 48 and left(url, 1) not in ('※','*','-','<','(','ㅇ') as keeps_label from pages")
def flt_label_keep(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", "url", T.date_like(u).alias("date_like"), T.keeps_label(u).alias("keeps_label"))


@query("""with c as (select doc_id, text, list_max(list_filter(range(0, 121), lambda k: strlen(left(text, k)) <= 120)) as k from documents)
 select doc_id, case when strlen(text) <= 120 then text else regexp_replace(left(text, k) || case when strlen(left(text, k)) < 120 then chr(65533) else '' end, '^\\s+|\\s+$', '', 'g') || '...' end as preview from c""")
def sca_truncate_bytes(spark, sf_dir):
    """Every document; a character that the cut at 120 bytes falls into becomes U+FFFD."""
    return t(spark, sf_dir, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 120).alias("preview"))


@query("select doc_id, length(text) as code_points, strlen(text) as bytes, len(string_split(text, chr(10))) as line_count, sha256(text) as digest from documents")
def agg_text_stats(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.length(c).cast("long").alias("code_points"), F.octet_length(c).cast("long").alias("bytes"), F.size(F.split(c, "\n")).cast("long").alias("line_count"), F.sha2(c.cast("binary"), 256).alias("digest")
    )


@query("""select conv_id, turn, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as body from conversations""")
def sca_collapse_blanks(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse_blanks(F.col("text")).alias("body"))


@query("""with p as (select p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as a from part)
 select p_partkey, case when len(a) = 0 then 'field_' || p_partkey when len(a) = 1 then a[1] else a[1] || '.' || array_to_string(a[2:], '_') end as field_key from p""")
def sca_field_key(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", T.field_key(F.col("p_name"), F.col("p_partkey")).alias("field_key"))


@query("""select p_partkey, least(p_size, 6) as heading_level from part where p_size > 0 and ('heading ' || p_size) <> ''""")
def sca_heading_level(spark, sf_dir):
    style = F.concat(F.lit("Heading "), F.col("p_size").cast("string"))
    return t(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", T.heading_level(style).alias("heading_level"))


@query("""with s as (select p_partkey, p_size as n, cast(floor(p_retailprice * 100) as bigint) as total from part where p_size > 0)
 select p_partkey, i, (total // n) + case when i = n - 1 then total % n else 0 end as part_size from s, lateral (select unnest(range(n)) as i)""")
def sca_distribute_size(spark, sf_dir):
    p = t(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.floor(F.col("p_retailprice") * 100).cast("long").alias("total"), "p_size")
    return p.select("p_partkey", F.posexplode(T.distribute(F.col("total"), F.col("p_size"))).alias("i", "part_size")).withColumn("i", F.col("i").cast("long"))


@query("select p_partkey, cast(case when p_retailprice > 0 then floor(p_retailprice * 7200.0::double / 25.4::double + 0.5) else 0 end as integer) as units from part")
def sca_mm_to_unit(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", T.mm_to_unit(F.col("p_retailprice")).alias("units"))


@query("""with r as (select *, row_number() over (partition by conv_id order by turn, role, text) as place from conversations)
 select conv_id, place, turn, lead(turn) over w as next_turn, first_value(case when role = 'user' then place end ignore nulls) over (partition by conv_id order by place rows between 1 following and unbounded following) as next_fillable
 from r window w as (partition by conv_id order by place)""")
def win_next_fillable(spark, sf_dir):
    """Rows that share a turn are told apart by role and text."""
    c = t(spark, sf_dir, "conversations").withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    w = W.partitionBy("conv_id").orderBy("place")
    after = w.rowsBetween(1, W.unboundedFollowing)
    return c.select("conv_id", "place", "turn", F.lead("turn").over(w).alias("next_turn"), F.first(F.when(F.col("role") == "user", F.col("place")), ignorenulls=True).over(after).alias("next_fillable"))


@query("""select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag, l_suppkey order by l_orderkey, l_linenumber, l_partkey) as occurrence from lineitem""")
def win_occurrence(spark, sf_dir):
    """The ordinal of every match."""
    w = W.partitionBy("l_returnflag", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("occurrence"))


@query("""with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as k from part)
 select p_partkey, case when k = 1 then p_brand else p_brand || '_' || k end as unique_key from r""")
def win_key_uniquify(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return t(spark, sf_dir, "part").withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("p_brand")).otherwise(F.concat_ws("_", "p_brand", "k")).alias("unique_key"))


@query("""with g as (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag, unnest(range(len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)))) as pre from pages)
 select page_id, pre, lower(tag) as tag, row_number() over (partition by page_id, lower(tag) order by pre) - 1 as ordinal from g""")
def win_sibling_ordinal(spark, sf_dir):
    g = t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("pre", "tag"))
    g = g.select("page_id", F.col("pre").cast("long").alias("pre"), F.lower("tag").alias("tag"))
    return g.withColumn("ordinal", (F.row_number().over(W.partitionBy("page_id", "tag").orderBy("pre")) - 1).cast("long"))


@query("select page_id, len(regexp_extract_all(html, '<p')) as p_prefix, len(regexp_extract_all(html, '<li[ >]')) as li_tags, len(regexp_extract_all(html, '<div')) as div_prefix from pages")
def agg_risk_signals(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t(spark, sf_dir, "pages").select("page_id", n("<p").alias("p_prefix"), n("<li[ >]").alias("li_tags"), n("<div").alias("div_prefix"))


@query(f"""select doc_id, count(*) filter (where line = '') as blank, count(*) filter (where length(line) > 200) as long_lines, count(*) filter (where contains(line, '|')) as rows_like from {LINES} group by doc_id""")
def agg_section_counts(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    n = lambda f, name: F.size(F.filter("lines", f)).cast("long").alias(name)
    return d.select("doc_id", n(lambda x: x == "", "blank"), n(lambda x: F.length(x) > 200, "long_lines"), n(lambda x: x.contains("|"), "rows_like"))


@query(f"select doc_id, sha256(array_to_string(list_sort(list_distinct(list(line))), chr(10))) as digest, count(distinct line) as n_labels from {LINES} where line <> '' group by doc_id")
def agg_fingerprint(spark, sf_dir):
    once = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))
    d = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", once.alias("once")).where("size(once) > 0")
    return d.select("doc_id", F.sha2(F.array_join(F.array_sort("once"), "\n").cast("binary"), 256).alias("digest"), F.size("once").cast("long").alias("n_labels"))


@query(f"select doc_id, sha256(string_agg(trim(line, ' '), chr(10) order by line_no)) as text_digest, count(*) as paragraphs from {LINES} group by doc_id")
def agg_snapshot_digest(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("lines"))  # F.trim itself would take the line's number as what to trim
    return d.select("doc_id", F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("text_digest"), F.size("lines").cast("long").alias("paragraphs"))


@query("""select l_returnflag as kind, l_linestatus as section, count(*) as changes, grouping(l_returnflag)::integer as g_kind, grouping(l_linestatus)::integer as g_section
 from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""")
def agg_preview_summary(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("section"))
    g = li.groupingSets([["kind"], ["section"], []], "kind", "section")
    return g.agg(F.count("*").alias("changes"), F.grouping("kind").cast("int").alias("g_kind"), F.grouping("section").cast("int").alias("g_section"))


@query("""select l_suppkey, max(l_quantity * 100 + l_linenumber) as strength, arg_max(l_partkey, (l_quantity * 100 + l_linenumber) * 1000000000 - l_orderkey * 10 - l_linenumber) as winner from lineitem group by l_suppkey""")
def agg_strongest_edge(spark, sf_dir):
    s = F.col("l_quantity") * 100 + F.col("l_linenumber")
    key = s * 1000000000 - F.col("l_orderkey") * 10 - F.col("l_linenumber")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max(s).alias("strength"), F.max_by("l_partkey", key).alias("winner"))


@query("select p_brand, max(p_partkey) + 1 as next_id from part group by p_brand")
def agg_next_id(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_brand").agg((F.max("p_partkey") + 1).alias("next_id"))


@query("""select c_custkey, case when c_nationkey is null then '' else coalesce(n_name, 'style#' || c_nationkey) end as style
 from customer left join (select * from nation where n_regionkey <> 1) on n_nationkey = c_nationkey""")
def join_style_lookup(spark, sf_dir):
    styles = t(spark, sf_dir, "nation").where("n_regionkey <> 1").select("n_nationkey", "n_name")
    c = t(spark, sf_dir, "customer").join(styles, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return c.select("c_custkey", F.when(F.col("c_nationkey").isNull(), "").otherwise(F.coalesce("n_name", F.concat(F.lit("style#"), F.col("c_nationkey").cast("string")))).alias("style"))


@query("select s_suppkey, coalesce(n_name, '#000000') as color from supplier left join (select * from nation where n_regionkey = 2) on n_nationkey = s_nationkey")
def join_style_default(spark, sf_dir):
    n = t(spark, sf_dir, "nation").where("n_regionkey = 2")
    return t(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("#000000")).alias("color"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def join_manifest_anti(spark, sf_dir):
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def join_bookmark_semi(spark, sf_dir):
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query(f"""with l as {LINES}, a as (select doc_id, line_no, line from l), b as (select doc_id - 1 as doc_id, line_no, line from l)
 select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.line_no, b.line_no) as line_no, case when a.line is null then 'paragraph-added' when b.line is null then 'paragraph-removed' else 'paragraph-changed' end as code
 from a full join b on a.doc_id = b.doc_id and a.line_no = b.line_no where a.line is distinct from b.line""")
def join_positional_diff(spark, sf_dir):
    l = lines(spark, sf_dir)
    a, b = l.withColumnRenamed("line", "a"), l.select((F.col("doc_id") - 1).alias("doc_id"), "line_no", F.col("line").alias("b"))
    code = F.when(F.col("a").isNull(), "paragraph-added").when(F.col("b").isNull(), "paragraph-removed").otherwise("paragraph-changed")
    return a.join(b, ["doc_id", "line_no"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "line_no", code.alias("code"))


@query("""select a.l_orderkey, a.l_linenumber, b.l_linenumber as next_col from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey""")
def join_grid_neighbors(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("next_col"))
    return li.join(b, ["l_orderkey", "l_linenumber"]).where("l_partkey <> p").select("l_orderkey", "l_linenumber", "next_col")


#: Stands for a mapping's selectors.
SELECTORS = ("apache license", "idiot", "worthless", "the the", "| er")


@query(f"select doc_id, line_no, selector from {LINES} join (select unnest({list(SELECTORS)}) as selector) on contains(lower(line), selector)")
def join_theta_contains(spark, sf_dir):
    """Lines joined with the selectors that they hold: one pass of an automaton, then an equi-join."""
    asked = spark.createDataFrame([(i, x, False) for i, x in enumerate(SELECTORS)], "rid int, selector string, exact boolean")
    return matching.matched(lines(spark, sf_dir), "line", asked).select("doc_id", "line_no", "selector")


@query("""select o_orderkey, r, c from (select o_orderkey, (o_custkey % 3 + 1)::integer as rs, (o_orderkey % 4 + 1)::integer as cs from orders), lateral (select unnest(range(rs)) as r), lateral (select unnest(range(cs)) as c)""")
def grid_span_expand(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3 + 1).alias("rs"), (F.col("o_orderkey") % 4 + 1).alias("cs"))
    o = o.select("o_orderkey", "cs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rs") - 1)).alias("r"))
    return o.select("o_orderkey", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cs") - 1)).alias("c"))


@query("""with a as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k, o_custkey from orders)
 select o_orderkey, 'v' || k as value from a where k <= 3""")
def fill_repeat(spark, sf_dir):
    """The k-th of three values goes to the k-th distinct anchor of a run."""
    anchors = t(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    values = spark.sql("select posexplode(array('v1', 'v2', 'v3')) as (k, value)").select((F.col("k") + 1).alias("k"), "value")
    return anchors.join(F.broadcast(values), "k").select("o_orderkey", "value")


@query("""select l_orderkey, l_linenumber, 'r' || (l_orderkey % 3) || 'c' || (l_linenumber - 1) as value from lineitem where l_orderkey % 3 < 2 and l_linenumber <= 2""")
def fill_grid(spark, sf_dir):
    """A 2 by 2 grid written over (order modulo 3, line) coordinates; cells out of its range are left alone."""
    grid = spark.sql("select posexplode(array(array('r0c0', 'r0c1'), array('r1c0', 'r1c1'))) as (r, row)").select("r", F.posexplode("row").alias("c", "value"))
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 3).alias("r"), (F.col("l_linenumber") - 1).alias("c"))
    return li.join(F.broadcast(grid), ["r", "c"]).select("l_orderkey", "l_linenumber", "value")


@query("select l_suppkey, l_partkey, l_orderkey from (select *, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) as k from lineitem) where k = 1")
def srt_keep_first(spark, sf_dir):
    w = W.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber")
    return t(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1").select("l_suppkey", "l_partkey", "l_orderkey")


@query("""select l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) as first_seq, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) as value from lineitem group by all""")
def srt_last_wins(spark, sf_dir):
    """The last in order of line, then of quantity: lines may have the same number."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(seq).alias("first_seq"), F.max_by("l_quantity", F.struct(seq, "l_quantity")).alias("value"))


@query("""select o_custkey, list(o_orderkey order by o_totalprice desc, o_orderkey)[1:8] as hints from orders group by o_custkey""")
def srt_topk_hints(spark, sf_dir):
    ranked = t(spark, sf_dir, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 8")
    return ranked.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda e: e["o_orderkey"]).alias("hints"))


@query(f"""select doc_id, line_no, row_number() over (partition by doc_id order by length(line) desc, line, line_no) as rank from {LINES} where length(line) between 1 and 32""")
def srt_anchor_order(spark, sf_dir):
    w = W.partitionBy("doc_id").orderBy(F.desc(F.length("line")), "line", "line_no")
    return lines(spark, sf_dir).where("length(line) between 1 and 32").select("doc_id", "line_no", F.row_number().over(w).cast("long").alias("rank"))


@query("select o_custkey, list_sort(list_filter(['F', 'O', 'P'], lambda x: not list_contains(list(o_orderstatus), x))) as missing from orders group by o_custkey")
def set_required_except(spark, sf_dir):
    need = F.array(*[F.lit(x) for x in "FOP"])
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.array_except(need, F.collect_set("o_orderstatus"))).alias("missing"))


@query("select l_suppkey, list_has_all(list(distinct l_returnflag), ['A', 'N', 'R']) as holds from lineitem group by l_suppkey")
def set_fingerprint_subset(spark, sf_dir):
    need = F.array(*[F.lit(x) for x in "ANR"])
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.size(F.array_except(need, F.collect_set("l_returnflag"))) == 0).alias("holds"))


@query("select page_id, len(regexp_extract_all(html, '<a[ >]')) as matches from pages where regexp_matches(html, '<a[ >]')")
def find_by_tag(spark, sf_dir):
    return t(spark, sf_dir, "pages").where(F.col("html").rlike("<a[ >]")).select("page_id", F.regexp_count("html", F.lit("<a[ >]")).cast("long").alias("matches"))


@query("""select page_id, unnest(regexp_extract_all(html, '\\b(class|href|id)="([^"]*)"', 2)) as value from pages""")
def find_by_attr(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('\\b(class|href|id)="([^"]*)"'), 2)).alias("value"))


@query("""select conv_id, string_agg('| ' || turn || ' | ' || replace(replace(role, '|', '\\|'), chr(10), '<br>') || ' |', chr(10) order by turn, role, text) as markdown from conversations group by conv_id""")
def export_markdown(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumn("row", F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), T.markdown_cell(F.col("role")), F.lit(" |")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "row"))), lambda e: e["row"])
    return c.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("markdown"))


@query("""select doc_id, '<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') || '</p>' as html from documents""")
def export_html(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p>"), T.html_escape(F.col("text")), F.lit("</p>")).alias("html"))


@query("select event_id, props::json ->> '$.k' as k from events")
def payload_path(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')").alias("k"))
