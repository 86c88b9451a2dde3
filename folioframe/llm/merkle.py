"""Op 13. Merkle manifest of a dataset: roots, and an authentication path for every row.

A row is a leaf: H (lowercase hex SHA-256; digests enter as hex text) over its columns. Per
language leaves are ordered by doc_id and every FAN consecutive nodes become one, up to a subroot;
subroots in the order of their languages likewise become the root.

The leaves are hashed by the JVM, numbered in their language by a range sort and gathered in aligned
blocks of FAN^BLOCK leaves, so that a block is a whole subtree. Every block gives its root to the
upper tree, which grows by one aggregation a level; its siblings are joined back to the blocks.
Within a block the paths come from a fractal traversal: the block is cut into levels of subtrees of
SUBTREE heights; a stack of existing subtrees holds every sibling of the current leaf, while the
desired ones that follow are built by one leaf a step, so two subtrees a level are held. A leaf's
path is what the stack gives, then the block's upper siblings.

Null columns enter as ``-``; an empty text as ``0:``; null and empty languages are languages of
their own; a null doc_id comes first; rows that share a doc_id are leaves each, in the order of
their digests (equal rows are interchangeable); a lone leaf is its language's subroot, a lone subroot
the root; no siblings at all hash as the empty text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import crc_mod, placed, stage, table

FAN, BLOCK, SUBTREE = 8, 4, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("leaf", "subroot", "root", "proof_sha256", "folded_root")


def joined_hash(*values: bytes) -> bytes:
    """H of digests, which are hex text."""
    return hashlib.sha256(b"".join(values)).hexdigest().encode()


def height_of(n: int) -> int:
    """Levels above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


class Growing:
    """A subtree that takes leaf by leaf; its nodes between heights ``low`` and ``high`` are kept, those below are not."""

    def __init__(self, leaves: list[bytes], low: int, high: int, index: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.end = index * FAN**high, min((index + 1) * FAN**high, len(leaves))
        self.rows: list[list[bytes]] = [[] for _ in range(high - low + 1)]
        self.runs: list[list[bytes]] = [[] for _ in range(high)]

    def put(self, node: bytes, height: int) -> None:
        if height >= self.low:
            self.rows[height - self.low].append(node)
        if height < self.high:
            run = self.runs[height]
            run.append(node)
            if len(run) == FAN:
                self.put(joined_hash(*run), height + 1)
                run.clear()

    def step(self) -> None:
        if self.next >= self.end:
            return
        self.put(self.leaves[self.next], 0)
        self.next += 1
        if self.next == self.end:  # the last runs may be short
            for height, run in enumerate(self.runs):
                if run:
                    node = joined_hash(*run)
                    run.clear()
                    self.put(node, height + 1)

    def whole(self) -> Growing:
        while self.next < self.end:
            self.step()
        return self


def paths(leaves: list[bytes], height: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Of every leaf in order: its place in its run and the run's others, height by height."""
    levels = [(low, min(low + SUBTREE, height)) for low in range(0, height, SUBTREE)]
    existing = [Growing(leaves, low, high, 0).whole() for low, high in levels]
    desired = [Growing(leaves, low, high, 1) for low, high in levels]
    for i in range(len(leaves)):
        path = []
        for (low, high), subtree in zip(levels, existing, strict=True):
            for at in range(low, high):
                k = i // FAN**at
                here = k - (i // FAN**high) * FAN ** (high - at)  # the place in the subtree's row
                slot, row = here % FAN, subtree.rows[at - low]
                path.append((slot, row[here - slot : here] + row[here + 1 : here - slot + FAN]))
        yield path
        for x, (low, high) in enumerate(levels):
            desired[x].step()
            if (i + 1) % FAN**high == 0:
                existing[x], desired[x] = desired[x].whole(), Growing(leaves, low, high, (i + 1) // FAN**high + 1)


def folded(node: bytes, path) -> bytes:
    for slot, others in path:
        node = joined_hash(*others[:slot], node, *others[slot:])
    return node


def leaf(text: Column) -> Column:
    """H of a row's columns, with this text."""
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (text if c == "text" else F.col(c).cast("string") for c in FIELDS)]
    return F.sha2(F.concat(*told), 256)


def upward(nodes: DataFrame, group: str, label: str) -> tuple[DataFrame, DataFrame]:
    """nodes(group, pos, digest, n: nodes of the group) -> (group, pos, path) and (group, digest of its top)."""
    most = nodes.agg(F.max("n")).first()[0] or 1  # one number
    now = nodes.select(group, "pos", "digest", "n")
    step = "array<struct<slot:int,others:array<string>>>"
    found = nodes.select(group, "pos", F.col("pos").alias("_at"), F.expr(f"cast(array() as {step})").alias("path"))
    for k in range(height_of(most)):
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        runs = stage(now.where("n > 1").groupBy(group, F.expr(f"pos div {FAN}").alias("_up")).agg(run.alias("run"), F.first("n").alias("n")), f"{label}-{k}")
        slot = F.expr(f"cast(_at % {FAN} as int)")
        others = F.concat(F.slice("run", 1, slot), F.slice("run", slot + 2, FAN))
        met = found.withColumn("_up", F.expr(f"_at div {FAN}")).join(runs.drop("n"), [group, "_up"], "left")
        grown = F.concat("path", F.array(F.struct(slot.alias("slot"), others.alias("others"))))
        found = met.select(group, "pos", F.when(F.col("run").isNull(), F.col("_at")).otherwise(F.col("_up")).alias("_at"), F.when(F.col("run").isNull(), F.col("path")).otherwise(grown).alias("path"))
        above = runs.select(group, F.col("_up").alias("pos"), F.sha2(F.array_join("run", ""), 256).alias("digest"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        now = now.where("n = 1").unionByName(above)
    return found.drop("_at"), now.select(group, "digest")


def leaves_of(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered): g orders languages bytewise, null first; tampered is null where the row is left alone."""
    low = F.translate("text", UPPER, LOWER)
    g = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select(g.alias("g"), "doc_id", leaf(F.col("text")).alias("leaf"), F.when(crc_mod(3) == 0, leaf(low)).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    size = FAN**BLOCK
    leaves = stage(leaves_of(docs).withColumn("_m", F.monotonically_increasing_id()), "leaves")  # texts are read once
    rows = placed(leaves, "g", ["doc_id", "leaf", "_m"], "placed")
    held = F.array_sort(F.collect_list(F.struct("i", "doc_id", "leaf", "tampered")))
    blocks = stage(rows.groupBy("g", F.expr(f"i div {size}").alias("pos")).agg(held.alias("held"), F.first("n").alias("n")), "blocks")
    height = lambda n: BLOCK if n > size else height_of(n)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for n, held in zip(batch.column("n").to_pylist(), batch.column("leaves"), strict=True):
                known = [x.encode() for x in held.as_py()]
                tops.append(Growing(known, high := height(n), high, 0).whole().rows[0][0].decode())
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("pos"), pa.array(tops, pa.string()), pa.array([-(-n // size) for n in batch.column("n").to_pylist()], pa.int64())], ["g", "pos", "digest", "n"])

    tops = stage(blocks.select("g", "pos", "n", F.col("held.leaf").alias("leaves")).mapInArrow(roots, "g string, pos long, digest string, n long"), "tops")
    upper, subroots = upward(tops, "g", "upper")
    ordered = placed(subroots.withColumn("c", F.lit(0)), "c", ["g"], "subroots").withColumnRenamed("i", "pos")
    above, root = upward(ordered, "c", "root")
    over = ordered.select("c", "pos", "g", F.col("digest").alias("subroot")).join(above.withColumnRenamed("path", "above"), ["c", "pos"]).join(root.withColumnRenamed("digest", "root"), "c").drop("c", "pos")
    whole = blocks.join(upper, ["g", "pos"]).join(over, "g").select("held", "n", F.concat("path", "above").alias("path"), "subroot", "root")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                held = batch.column("held")[at].values
                n, subroot, root = (batch.column(c)[at].as_py() for c in ("n", "subroot", "root"))
                upper = [(x["slot"], [o.encode() for o in x["others"]]) for x in batch.column("path")[at].as_py()]
                ids, tail = held.field("doc_id"), [o for _, others in upper for o in others]
                known = [x.encode() for x in held.field("leaf").to_pylist()]
                proofs, tops = [], []
                for path, own, other in zip(paths(known, height(n)), known, held.field("tampered").to_pylist(), strict=True):
                    proofs.append(joined_hash(*(o for _, others in path for o in others), *tail).decode())
                    tops.append(folded(folded(other.encode() if other else own, path), upper).decode())
                told = [held.field("leaf").to_pylist(), [subroot] * len(known), [root] * len(known), proofs, tops]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.string()) for x in told), pa.array([x == root for x in tops], pa.bool_())], ["doc_id", *RESULT, "verified"])

    return whole.mapInArrow(prove, f"doc_id {kind}, {', '.join(f'{c} string' for c in RESULT)}, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir))


def _level(nodes: str, state: str, k: str, up_nodes: str, up_state: str) -> str:
    """One level in SQL: runs of 8, their digests, and every row's path and folded digest; a lone node stays."""
    return f"""
 {k} as (select g, p // 8 as q, list(h order by p) as run, max(n) as n from {nodes} where n > 1 group by g, p // 8),
 {up_nodes} as (select g, q as p, sha256(array_to_string(run, '')) as h, (n + 7) // 8 as n from {k} union all select g, p, h, n from {nodes} where n = 1),
 {up_state} as (select s.* exclude (p, cur, proof), case when r.q is null then s.p else s.p // 8 end as p,
   case when r.q is null then cur else sha256(array_to_string(run[1:s.p % 8], '') || cur || array_to_string(run[s.p % 8 + 2:], '')) end as cur,
   case when r.q is null then proof else proof || array_to_string(run[1:s.p % 8], '') || array_to_string(run[s.p % 8 + 2:], '') end as proof
   from {state} s left join {k} r on r.g = s.g and r.q = s.p // 8)"""


def _oracle(levels: int = 7, tops: int = 3) -> str:
    """DuckDB: levels of 8 within a language (2 million rows of one), then over languages (512)."""
    told = lambda text: " || ".join(f"coalesce(octet_length(encode({x}))::varchar || ':' || {x}, '-')" for x in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))
    crc = """list_reduce(list_concat([4294967295], flatten([[-ascii(x), -1000, -1000, -1000, -1000, -1000, -1000, -1000, -1000] for x in string_split(doc_id::varchar, '')])),
   lambda c, x: case when x > -1000 then xor(c, -x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    sql = f"""with d as (select doc_id, coalesce('=' || lang, '') as g, sha256({told("text")}) as leaf, case when xor({crc}, 4294967295) % 3 = 0 then sha256({told(low)}) end as other from documents),
 s0 as (select doc_id, g, leaf, coalesce(other, leaf) as cur, '' as proof, row_number() over (partition by g order by doc_id) - 1 as p from d),
 l0 as (select g, p, leaf as h, count(*) over (partition by g) as n from s0),"""
    sql += ",".join(_level(f"l{k}", f"s{k}", f"r{k}", f"l{k + 1}", f"s{k + 1}") for k in range(levels))
    sql += f""", t0 as (select 0 as g, row_number() over (order by g) - 1 as p, h, count(*) over () as n, g as lang from l{levels}),
 u0 as (select doc_id, leaf, cur, proof, t0.h as subroot, 0 as g, t0.p as p from s{levels} s join t0 on t0.lang = s.g),"""
    sql += ",".join(_level(f"t{k}", f"u{k}", f"q{k}", f"t{k + 1}", f"u{k + 1}") for k in range(tops))
    return sql + f" select doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, cur as folded_root, cur = t.h as verified from u{tops} u join t{tops} t on t.g = u.g"


ORACLE_SQL = {"op13_merkle_manifest": _oracle()}
