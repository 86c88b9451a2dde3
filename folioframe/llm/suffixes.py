"""Op 10. Suffix-array dedup: 50-byte strings by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Suffixes are only ever compared on their first LENGTH bytes, so the array is built by
buckets that tasks can refine apart:

1. Every window of LENGTH bytes has an initial bucket, the q-gram of least hash in it (with its
   place in the window); equal windows are in the same bucket. Only the q-grams' hashes are
   shuffled, packed, and buckets that a single document owns are done: nothing in them is shared.
2. For the rest, the bytes around each q-gram (the windows it stands for, about 65 bytes) are
   gathered once for each distinct content, with the least document that has it, and each task
   refines its buckets: suffixes are sorted by (bucket, bucket identifier of a later offset), the
   new buckets replace the old ones at once for the next offset, and buckets of one content drop
   out, until LENGTH bytes are compared. Hash collisions only enlarge initial buckets; the
   refinement compares the bytes themselves.
3. Windows whose final bucket has a smaller document mark their bytes.

A passage that a third of the documents share has few distinct contents, and those are combined
before the shuffle. Null texts are empty; rows with a null doc_id take no part and are kept whole;
rows that share a doc_id are one document (neither is smaller); texts under LENGTH bytes stay;
very long texts are processed in overlapping pieces, with the same result; an empty table gives no
rows; doc_ids are whole numbers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import drop_stage, stage, table, text_bytes

LENGTH = 50
Q = 24
#: Initial buckets are shuffled in parts of about PART_BYTES of text, at least 2^10 and at most 2^22 of them
#: (a part's entries are held by a task); 40 more bits of the hash travel with each.
PART_BYTES, LEAST_BITS, MOST_BITS = 32 << 20, 10, 22
PIECE = 1 << 20
#: Contents that a task solves together (whole buckets, so there may be more).
SOLVED = 20_000
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = (1 << 28) - 1


def initial_buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end (starts: where each begins): the q-grams of least hash of their windows.

    Returns their hashes, places, and the first and last window start that each stands for.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        power, h, size, whole, done = np.uint64(_BASE), _BYTE[data], 1, None, 0
        left = Q
        while True:  # the hash of q bytes from those of powers of two
            if left & size:
                if whole is None:
                    whole, done = h, size
                else:
                    n = len(data) - done - size + 1
                    whole = whole[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + h[done : done + n]
                    done += size
            if 2 * size > left:
                break
            n = len(h) - size
            h = h[:n] * power + h[size : size + n]
            power = power * power
            size *= 2
        whole = whole ^ (whole >> np.uint64(29))
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        whole ^= whole >> np.uint64(32)
    wide = LENGTH - Q + 1
    least = (whole & ~np.uint64(_PLACE)) | np.arange(len(whole), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: size - wide], least[wide - size :])
    at = (least & np.uint64(_PLACE)).astype(np.int64)  # of each window start
    valid = np.zeros(len(at), bool)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True):
        valid[a : max(a, b - LENGTH + 1)] = True
    edge = np.flatnonzero((at[1:] != at[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(at)]]) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return whole[at[first]], at[first], first, last


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in pieces of about PIECE bytes: bytes, starts, text numbers, offset of each start in its text."""
    held, rows, offsets, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            held.append(part)
            rows.append(i)
            offsets.append(at)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held[:-1])]), np.array(rows), np.array(offsets)
                held, rows, offsets, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held[:-1])]), np.array(rows), np.array(offsets)


def part_bits(size: int) -> int:
    """As many bits as the parts of so many bytes of text need."""
    return min(MOST_BITS, max(LEAST_BITS, (-(-size // PART_BYTES)).bit_length()))


def bucket_numbers(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The part of a hash (bits) and 40 bits within it."""
    return hashes >> np.uint64(64 - bits - 40)


def _planes(a: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, one plane of bytes after the other."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def shared_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """rows(tid, text) -> (tid, bucket): initial buckets that at least two distinct texts have a suffix in."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)

        def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, r = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
            h, r = h[new], r[new]
            part = (h >> np.uint64(40)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs, names = [], part[at]
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(h)], strict=True):
                ids, which = np.unique(r[a:b], return_inverse=True)
                raw = len(ids).to_bytes(4, "little") + (b - a).to_bytes(4, "little") + ids.astype("<i8").tobytes() + which.astype("<u4").tobytes() + _planes(h[a:b], 5)
                blobs.append(press.compress(raw))
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

        found, size = [], 0
        for batch in batches:
            rid = batch.column("tid").to_numpy()
            for lo in range(0, batch.num_rows, 256):
                texts = [text_bytes(t.as_py()) for t in batch.column("text").slice(lo, 256)]
                for data, starts, owner, _ in pieces(texts):
                    hashes, at, _, _ = initial_buckets(data, starts)
                    if len(at):
                        found.append((bucket_numbers(hashes, bits), rid[lo + owner[np.searchsorted(starts, at, "right") - 1]]))
                        size += len(at)
                if size > 600_000:
                    yield packed(found)
                    found, size = [], 0
        if found:
            yield packed(found)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; a part is held at a time."""
        open_part, blobs, unpress = None, [], zstandard.ZstdDecompressor()

        def shared() -> pa.RecordBatch:
            hs, rs = [], []
            for blob in blobs:
                raw = np.frombuffer(unpress.decompress(blob), np.uint8)
                k, n = raw[:8].view("<u4").tolist()
                ids = raw[8 : 8 + 8 * k].view("<i8")
                rs.append(ids[raw[8 + 8 * k : 8 + 8 * k + 4 * n].view("<u4")])
                hs.append(_unplanes(raw[8 + 8 * k + 4 * n :], n, 5))
            h, r = np.concatenate(hs), np.concatenate(rs)
            order = np.argsort(h, kind="stable")
            h, r = h[order], r[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(r, at) != np.maximum.reduceat(r, at)
            keep = np.repeat(several, np.diff(np.append(at, len(h))))
            bucket = (h[keep] | np.uint64(open_part << 40)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(r[keep]), pa.array(bucket)], ["tid", "bucket"])

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                if part != open_part:
                    if blobs:
                        yield shared()
                    open_part, blobs = part, []
                blobs.append(blob.as_py())
        if blobs:
            yield shared()

    packed = rows.select("tid", "text").mapInArrow(gather, "part int, blob binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(owned, "tid long, bucket long")


def contents(rows: DataFrame, buckets: DataFrame, first: DataFrame, bits: int) -> DataFrame:
    """(rid, doc_id, start, lead, bucket, content): the bytes around every q-gram of a shared bucket, once for each distinct text."""
    wanted = buckets.groupBy("tid").agg(F.collect_list("bucket").alias("buckets")).join(first, "tid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, doc_id = batch.column("rid").to_numpy(), batch.column("doc_id").to_numpy()
            flat, off = batch.column("buckets").flatten().to_numpy(), batch.column("buckets").offsets.to_numpy()
            for lo in range(0, batch.num_rows, 256):
                texts = [text_bytes(t.as_py()) for t in batch.column("text").slice(lo, 256)]
                for data, starts, owner, offsets in pieces(texts):
                    hashes, at, first, last = initial_buckets(data, starts)
                    if not len(at):
                        continue
                    number = bucket_numbers(hashes, bits).astype(np.int64)
                    which = np.searchsorted(starts, at, "right") - 1
                    text = lo + owner[which]
                    keep = np.zeros(len(at), bool)
                    edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        i = text[a]
                        keep[a:b] = np.isin(number[a:b], flat[off[i] - off[0] : off[i + 1] - off[0]])
                    if not keep.any():
                        continue
                    first, last, text, which, number, at = (x[keep] for x in (first, last, text, which, number, at))
                    raw = data.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[text]), pa.array(doc_id[text]), pa.array((first - starts[which] + offsets[which]).astype(np.int64)), pa.array((at - first).astype(np.int32)), pa.array(number),
                         pa.array([raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())],
                        ["rid", "doc_id", "start", "lead", "bucket", "content"],
                    )

    return rows.join(wanted, ["tid", "doc_id"]).select("rid", "doc_id", "text", "buckets").mapInArrow(cut, "rid long, doc_id long, start long, lead int, bucket long, content binary")


def refine(bucket: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Final bucket of each suffix (its first LENGTH bytes): suffixes at[i] of data, in initial buckets bucket[i].

    Sorts by (bucket, identifier of the bytes at the next offset); buckets of one suffix are final.
    """
    word = data[: len(data) - 7].astype(np.uint64)
    for j in range(1, 8):
        word = (word << np.uint64(8)) | data[j : len(data) - 7 + j]
    final = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    todo, top = np.arange(len(at)), len(at)
    for offset in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        count = np.bincount(final[todo], minlength=0)
        todo = todo[count[final[todo]] > 1]
        if not len(todo):
            break
        b, w = final[todo], word[at[todo] + offset]
        order = np.lexsort((w, b))
        b, w = b[order], w[order]
        new = np.concatenate([[False], (b[1:] != b[:-1]) | (w[1:] != w[:-1])])
        final[todo[order]] = top + np.cumsum(new)  # used at once for the next offset
        final[todo] -= final[todo].min()
        rest = np.setdiff1d(np.arange(len(at)), todo, assume_unique=True)
        if len(rest):  # done: numbers above all others
            final[rest] = final[todo].max() + 1 + np.arange(len(rest))
    return final


def least_documents(found: DataFrame) -> DataFrame:
    """(bucket, key, least array<long>): for each distinct content, the least document of each of its windows.

    Only contents that some document has besides the least one of all their windows.
    """
    distinct = found.groupBy("bucket", "lead", "content").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(b: list, lead: list, content: list, doc: list, most: list) -> pa.RecordBatch:
            sizes = np.array([len(c) for c in content])
            data = np.frombuffer(b"".join(content) + bytes(8), np.uint8)
            starts, windows = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
            owner = np.repeat(np.arange(len(sizes)), windows)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            # the place of the q-gram in the window is part of the initial bucket
            place = np.array(lead)[owner] - step
            final = refine(np.array(b)[owner] * 64 + place, data, starts[owner] + step)
            order = np.argsort(final, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], final[order][1:] != final[order][:-1]]))
            docs = np.array(doc)[owner]
            least = np.empty(len(owner), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(docs[order], at), np.diff(np.append(at, len(order))))
            ends = np.cumsum(windows)
            lists = [least[e - w : e] for e, w in zip(ends.tolist(), windows.tolist(), strict=True)]
            keep = [i for i, x in enumerate(lists) if x.min() < most[i]]
            return pa.RecordBatch.from_arrays(
                [pa.array([b[i] for i in keep], pa.int64()), pa.array([lead[i] for i in keep], pa.int32()), pa.array([content[i] for i in keep], pa.binary()), pa.array([lists[i] for i in keep], pa.list_(pa.int64()))],
                ["bucket", "lead", "content", "least"],
            )

        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lead", "content", "doc_id", "most")), strict=True):
                if len(held[0]) >= SOLVED and row[0] != held[0][-1]:
                    yield solved(*held)
                    held = [[], [], [], [], []]
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if held[0]:
            yield solved(*held)

    return distinct.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(solve, "bucket long, lead int, content binary, least array<long>")


def removals(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (rid, lo array, hi array): byte ranges to remove, overlapping ones not yet joined."""
    rows = docs.where("doc_id is not null").where(F.octet_length("text") >= LENGTH).select(
        F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("text").alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    # copies of a whole text: all of their strings start in the least document that has it
    narrow = rows.select("rid", F.xxhash64(F.lit(1), "text").alias("tid2"), "tid", "doc_id", F.octet_length("text").cast("long").alias("hi"))
    first = narrow.groupBy("tid", "tid2").agg(F.min("doc_id").alias("doc_id"))
    copies = narrow.join(first.withColumnRenamed("doc_id", "least"), ["tid", "tid2"]).where("doc_id > least").select("rid", F.lit(0).cast("long").alias("lo"), "hi")

    bits = part_bits(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    buckets = stage(shared_buckets(rows, bits), "buckets")
    found = stage(contents(rows, buckets, first.select("tid", "doc_id").distinct(), bits), "contents")
    drop_stage(buckets)
    key = lambda d, *c: d.select(F.xxhash64("bucket", "lead", "content").alias("k1"), F.xxhash64(F.lit(1), "content", "bucket").alias("k2"), *c)
    least = stage(key(least_documents(found), "least"), "least")
    # windows with a smaller document, as ranges of neighbouring starts
    marked = key(found, "rid", "doc_id", "start").join(least, ["k1", "k2"]).select(
        "rid", "start", F.expr("filter(transform(least, (x, i) -> if(x < doc_id, i, -1)), i -> i >= 0)").alias("w")
    ).where("size(w) > 0")
    first = F.expr("filter(w, (x, i) -> i = 0 or w[i - 1] <> x - 1)")
    last = F.expr("filter(w, (x, i) -> i = size(w) - 1 or w[i + 1] <> x + 1)")
    ranges = marked.select("rid", "start", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("r"))
    ranges = ranges.select("rid", (F.col("start") + F.col("r.a")).alias("lo"), (F.col("start") + F.col("r.b") + LENGTH).alias("hi")).union(copies)
    spans = stage(ranges.groupBy("rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "removals")
    drop_stage(found)
    drop_stage(least)
    return spans


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary)."""
    spans = removals(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, removed, counts, kept = [], [], [], []
                for text, lo, hi in zip(batch.column("text"), batch.column("lo"), batch.column("hi"), strict=True):
                    raw = text_bytes(text.as_py())
                    runs: list[list[int]] = []
                    for a, b in sorted(zip(lo.as_py() or (), hi.as_py() or (), strict=True)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(kept[-1]))
                    counts.append(len(runs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("rid")).join(spans, "rid", "left")
    return joined.select("doc_id", "text", "lo", "hi").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
