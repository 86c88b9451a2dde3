"""Op 5. SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes the vector of its 32 two-bit segments' popcounts. Manhattan distance of two
vectors never exceeds the Hamming distance of the fingerprints, so radius-2 neighbours are found by
a range join on a grid of unit cells over that space: two vectors within distance 2 differ in at
most 2 of ``BANDS`` bands of segments, so they share a cell of at least one sub-grid that leaves two
bands out. Pairs that meet in a cell are cut by the Manhattan bound, then verified by the exact
Hamming distance.

Only distinct fingerprints are joined. A cell with more than ``CELL_PAIRS`` of them is not paired
up; it is solved exactly by bridges: two fingerprints are within 2 bits if and only if some 64-bit
value is within 1 bit of both, so each member is linked to the least member that shares a bridge.
The work is linear (65 bridges a fingerprint) and no link's connectivity is lost.

Null and empty texts have fingerprint zero and link like any other; texts of under three words are
one shingle; repeated rows and repeated ids are ordinary rows; an empty table gives no rows; null
ids never name a component unless all its ids are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import LOWER, drop_stage, stage, table, text_bytes
from folioframe.llm.graph import components

RADIUS = 2
BANDS = 6
SEGMENT_BITS = 2
CELL_PAIRS = 32
#: For texts linked by similarity: bands of least shingle hashes, and the similarity as a fraction.
BANDS_OF_MINIMA, ROWS, SIMILAR = 16, 4, (4, 5)
#: Rounds of one pivot a bucket before all pairs that are not connected, and the members of a bucket dealt as one slice.
PIVOT_ROUNDS, SLICE = 2, 256
#: A similarity of 4/5 needs a symmetric difference of at most 1/9 of both sizes; every slot that only one
#: of two sets fills holds a member of that difference, so no pair at 4/5 is ruled out.
SLOTS = 1024
_SHAPES_ALLOW = (
    f"({' + '.join(f'bit_count(shape.b{i} ^ other.b{i})' for i in range(SLOTS // 64))}) * {SIMILAR[1] + SIMILAR[0]} <= (shape.n + other.n) * {SIMILAR[1] - SIMILAR[0]}"
    f" and least(shape.n, other.n) * {SIMILAR[1]} >= greatest(shape.n, other.n) * {SIMILAR[0]}"
)
_RANDOM = np.random.default_rng(42)
FLIPS = _RANDOM.integers(0, 1 << 64, BANDS_OF_MINIMA * ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS_OF_MINIMA * ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words: the whole sequence; none: no hash."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value of the bits set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of 255 bits fit a byte
        block = hashes[at : at + 255].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long: the fingerprint's 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text")):
                out[i] = majority(shingle_hashes(text_bytes(text.as_py()).translate(LOWER).split(), k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _popcount_vector(fp):
    """Array of 32 segment popcounts, as two packed longs of nibbles would hold them."""
    odd = fp.bitwiseAND(F.lit(0x5555555555555555))
    even = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return odd, even


def hamming_edges(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fps(fp)`` -> edges (u, v) whose components are those of all pairs within RADIUS.

    The edges read a stage; ``drop_stage`` of them deletes it once they have been used.
    """
    per_band = -(-64 // BANDS // SEGMENT_BITS) * SEGMENT_BITS  # whole segments in each band
    masks = [sum(1 << b for b in range(i * per_band, min(64, (i + 1) * per_band))) for i in range(BANDS)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    odd, even = _popcount_vector(F.col("fp"))
    # A segment's popcount is 0, 1 or 2: (odd XOR even) marks 1 and (odd AND even) marks 2, both in segment positions.
    ones, twos = odd.bitwiseXOR(even), odd.bitwiseAND(even)
    vector = ones.bitwiseOR(F.shiftleft(twos, 1))
    kept = [signed(sum(masks[i] for i in c)) for c in combinations(range(BANDS), BANDS - RADIUS)]
    grids = F.array(
        *[F.struct(F.xxhash64(F.lit(i), vector.bitwiseAND(F.lit(m))).alias("cell")) for i, m in enumerate(kept)]
    )
    cells = fps.select("fp", vector.alias("vec"), F.explode(grids).alias("g")).select("g.cell", "fp", "vec")
    full = cells.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    met = stage(cells.join(full, "cell"), "cells")

    few = met.where(F.col("members") <= CELL_PAIRS)
    a, b = few.select("cell", F.col("fp").alias("u"), F.col("vec").alias("x")), few.select("cell", F.col("fp").alias("v"), F.col("vec").alias("y"))
    # Manhattan distance of packed two-bit counts: |difference| summed over the segments.
    x1, x2 = F.col("x").bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned("x", 1).bitwiseAND(F.lit(0x5555555555555555))
    y1, y2 = F.col("y").bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned("y", 1).bitwiseAND(F.lit(0x5555555555555555))
    # unary code of a count: 0 -> 00, 1 -> 01, 2 -> 11; XOR of unary codes has |difference| bits.
    unary = lambda one, two: one.bitwiseOR(two).bitwiseOR(F.shiftleft(two, 1))
    manhattan = F.bit_count(unary(x1, x2).bitwiseXOR(unary(y1, y2)))
    close = (
        a.join(b, "cell")
        .where(F.col("u") < F.col("v"))
        .where(manhattan <= RADIUS)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
        .select("u", "v")
    )
    many = met.where(F.col("members") > CELL_PAIRS).select("fp").distinct()
    flips = [signed(1 << i) for i in range(64)]
    bridges = many.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])).alias("bridge")
    )
    least = bridges.groupBy("bridge").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    star = bridges.join(least, "bridge").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    edges = close.union(star)
    edges._stage_path = met._stage_path
    return edges


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs -> (doc_id, fp, component_id): component_id is the least doc_id reachable over links of RADIUS bits."""
    marked = stage(fingerprints(docs, k), "fp")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = hamming_edges(marked.select("fp").distinct())
    roots = components(edges)
    drop_stage(edges)
    grouped = first.join(roots, first.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = grouped.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def band_hashes(hashes: np.ndarray) -> list[int]:
    """One hash for each of BANDS_OF_MINIMA bands of ROWS least values; a text without words has one band of its own."""
    if len(hashes) == 0:
        return [0]
    least = np.full(BANDS_OF_MINIMA * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at : at + 2048, None] ^ FLIPS) * FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), i + 1) - (1 << 63) for i, b in enumerate(least.reshape(-1, ROWS))]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs(node, row, text) -> the same without text, and (fp, bands, shape: count of distinct shingles and the slots they fill) by k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, sizes, slots = np.zeros(batch.num_rows, np.uint64), [], [], np.zeros((batch.num_rows, SLOTS), bool)
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_hashes(text_bytes(text.as_py()).translate(LOWER).split(), k)
                fps[i] = majority(hashes)
                once = np.unique(hashes)
                bands.append(band_hashes(once))
                sizes.append(len(once))
                slots[i, once % SLOTS] = True
            words = np.packbits(slots, axis=1, bitorder="little").view("<i8")
            shape = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *(pa.array(w.copy()) for w in words.T)], ["n", *(f"b{w}" for w in range(words.shape[1]))])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("row"), pa.array(fps.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), shape], ["node", "row", "fp", "bands", "shape"])

    slots_of = ", ".join(f"b{w}: long" for w in range(SLOTS // 64))
    return docs.select("node", "row", "text").mapInArrow(run, f"node long, row long, fp long, bands array<long>, shape struct<n: long, {slots_of}>")


def alike(pairs: DataFrame, k: int) -> DataFrame:
    """pairs(u, v, x, y) whose texts x and y have k-word shingle sets of Jaccard similarity SIMILAR or more -> (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: tuple = (None, None)
        of = lambda text: np.unique(shingle_hashes(text_bytes(text).translate(LOWER).split(), k))
        for batch in batches:
            keep = []
            for v, x, y in zip(batch.column("v"), batch.column("x"), batch.column("y"), strict=True):
                if told[0] != v.as_py():
                    told = (v.as_py(), of(y.as_py()))
                a, b = of(x.as_py()), told[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0])
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def candidate_buckets(marked: DataFrame) -> DataFrame:
    """marked(node, fp, bands) -> (band, node, members) such that candidates are the pairs that share a band.

    Bands are those of least shingle hashes, a fingerprint, and, for fingerprints with another within RADIUS
    bits, every value within 1 bit of it: two fingerprints are within 2 bits if and only if they share such a value.
    """
    by_minima = marked.select(F.explode("bands").alias("band"), "node")
    by_print = marked.select(F.xxhash64(F.lit("fp"), "fp").alias("band"), "node")
    links = hamming_edges(marked.select("fp").distinct())
    near = marked.join(links.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi")
    flips = [m - (1 << 64) if m >> 63 else m for m in (1 << i for i in range(64))]
    values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])
    by_bridge = near.select(F.explode(values).alias("value"), "node").select(F.xxhash64(F.lit("bridge"), "value").alias("band"), "node")
    every = by_minima.union(by_print).union(by_bridge)
    shared = every.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = stage(every.join(shared, "band"), "buckets")
    drop_stage(links)
    return met


def pairs_with_pivots(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """left(band, node, shape, degree, root) -> pairs (u, v) of every member with its bucket's pivot, and (band, pivot)."""
    first = F.min(F.struct((-F.col("degree")).alias("less"), "node", "shape", "root")).alias("first")
    pivots = left.groupBy("band").agg(first).select("band", F.col("first.node").alias("pivot"), F.col("first.shape").alias("other"), F.col("first.root").alias("r"))
    pairs = left.join(pivots, "band").where("node <> pivot and root <> r").where(_SHAPES_ALLOW)
    return pairs.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), pivots.select("band", F.col("pivot").alias("node"))


def pairs_of_all(left: DataFrame) -> DataFrame:
    """left(band, node, shape, root) -> every pair (u, v) that shares a bucket and is not connected yet; large buckets are salted."""
    slices = left.groupBy("band").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sliced = left.join(slices, "band")
    one = sliced.select("band", "node", "shape", "root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int").alias("slice"))
    other = sliced.select("band", F.col("node").alias("v"), F.col("shape").alias("other"), F.col("root").alias("r"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    pairs = one.join(other, ["band", "slice"]).where("node > v and root <> r").where(_SHAPES_ALLOW)
    return pairs.select(F.col("node").alias("u"), "v").distinct()


def similar_texts(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs(node, row, text), node naming the text and row the row -> (node, root): texts linked by a similarity of 0.8 or more.

    Candidates are fingerprints within RADIUS bits and texts with a band of least shingle hashes in
    common: at a similarity of 0.8 fingerprints lie some ten bits apart, too far for any grid; of two
    texts at 0.8 all bands differ once in 5,000 times. Every candidate pair is verified on the exact
    shingle sets unless verified links connect it already or the shapes of their sets rule 0.8 out, so the
    components are those of all candidate pairs at 0.8. Texts without words are alike.

    To connect a large group in few pairs, each bucket's members are first tested against one pivot,
    the member that meets most others over all its buckets. Only pivots leave their bucket: a member
    linked to one may still be the only link of others. Pairs that are not connected after
    PIVOT_ROUNDS are all tested.
    """
    # of copies the least row stands for the text; copies meet before they are shuffled
    sketched = stage(sketches(docs, k).groupBy("node").agg(F.min("row").alias("row"), *[F.any_value(c).alias(c) for c in ("fp", "bands", "shape")]), "sketch")
    met = candidate_buckets(sketched.select("node", "fp", "bands"))
    degrees = met.groupBy("node").agg(F.sum("members").alias("degree"))
    nodes = stage(sketched.select("node", "row", "shape").join(degrees, "node"), "nodes")
    left = met.join(nodes.drop("row"), "node").select("band", "node", "shape", "degree", F.col("node").alias("root"))
    # written, so that only candidates' texts are shuffled, one row a text
    wanted = docs.join(nodes.select("node", "row"), ["node", "row"], "left_semi").select("node", "text")
    texts = stage(wanted.groupBy("node").agg(F.any_value("text").alias("text")), "texts")
    made = [sketched, met, nodes, texts]

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "pairs")
        first = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
        found = stage(alike(first.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v"), k), "alike")
        drop_stage(pairs)
        made.append(found)
        return found

    links = None
    for _ in range(PIVOT_ROUNDS):
        left = stage(left, "left")
        made.append(left)
        pairs, pivots = pairs_with_pivots(left)
        found = verified(pairs)
        links = found if links is None else links.union(found)
        roots = stage(components(links), "roots")
        made.append(roots)
        rest = left.join(pivots, ["band", "node"], "left_anti").join(roots.withColumnRenamed("root", "now"), "node", "left")
        rest = rest.select("band", "node", "shape", "degree", F.coalesce("now", "node").alias("root"))
        apart = rest.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
        left = rest.join(apart, "band", "left_semi")
    left = stage(left, "left")
    made.append(left)
    out = stage(components(links.union(verified(pairs_of_all(left)))), "roots")
    for df in made:
        drop_stage(df)
    return out


def representatives(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate group (the least doc_id; of rows that share it, the least key).

    Groups are those of ``similar_texts``. Every row has a key of doc_id and text; rows alike in both are
    one row. Other columns pass through, whatever their names. Texts of equal 64-bit hashes count as equal.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("node"), F.xxhash64("doc_id", "text").alias("row"))
    roots = similar_texts(rows.select("node", "row", F.col("doc.text").alias("text")), k)
    doc_id = F.col("doc.doc_id")
    best = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("row").alias("key"))).alias("best")
    texts = rows.groupBy("node").agg(best)
    grouped = texts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    kept = rows.join(grouped.select(F.col("best.key").alias("row")), "row", "left_semi")
    return kept.dropDuplicates(["row"]).select("doc.*")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
