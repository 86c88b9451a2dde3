"""Op 7. Benchmark decontamination by item-sized SimHash windows.

Words are lower-cased and stripped of ASCII punctuation; shingles are five words (a shorter item is
one shingle). A window of an item's size can only reach the similarity if it shares a shingle with
the item, so windows are laid where a shared shingle puts the item's start. Each window is
fingerprinted, a multi-index over Hamming blocks (radius RADIUS, so some of the BLOCKS blocks differs in at
most RADIUS // BLOCKS bits) finds all items within the radius among those that share a shingle with the
document (others can't be similar: at this radius the blocks alone would let most items pass), and the
exact weighted Jaccard similarity of shingle counts verifies them.

The benchmark is the stated query side: its distinct texts go to the executors in blocks of at most
about ITEMS texts and BYTES bytes, so what is sent has a bound whatever the benchmark's size; item_ids are joined
to the matches afterwards; documents are never shuffled.

Null, empty and wordless texts and items match nothing; repeated items are matched each; a document
is one row per matched item, with its best window (the first of equals); repeated rows match alike;
empty tables give no rows; very long texts are scanned whole; other columns are ignored, or pass through
``decontaminate`` whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import PLAIN, stage, table, text_bytes, unused
from folioframe.llm.simhash import majority

K, SIMILARITY = 5, 0.8
#: Similarity 0.8 puts a window about 10 bits from its item; 22 bits leave four standard deviations.
RADIUS, BLOCKS = 22, 8
ITEMS, BYTES = 20_000, 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(PLAIN).split()


def shingles(words: list[bytes], k: int = K) -> list[bytes]:
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def fingerprint(counts: Counter) -> int:
    """SimHash of a shingle bag: a shingle counts as often as it occurs."""
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s, n in counts.items() for _ in range(n)], np.uint64)
    return majority(h)


def similarity(a: Counter, b: Counter) -> float:
    least = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


class Index:
    """Items by shingle (to lay windows) and by block of their fingerprints (to find all within RADIUS)."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = [(i, w, Counter(shingles(w))) for i, w in items if w]
        self.vocabulary: dict[bytes, int] = {}
        self.starts: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)  # shingle -> (words before it, item's words)
        self.holders: dict[tuple[int, ...], set[int]] = defaultdict(set)
        seen: dict[tuple[int, ...], set] = defaultdict(set)
        for n, (_, w, _) in enumerate(self.items):
            ids = tuple(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w)
            k = min(K, len(w))
            for at in range(len(w) - k + 1):
                seen[ids[at : at + k]].add((at, len(w)))
                self.holders[ids[at : at + k]].add(n)
        self.starts = {s: sorted(v) for s, v in seen.items()}
        self.lengths = sorted({len(s) for s in self.starts})
        self.keys = {k: np.array(sorted(self._key(np.array([s], np.uint64), k)[0] for s in self.starts if len(s) == k), np.uint64) for k in self.lengths}
        self.width = 64 // BLOCKS
        self.flips = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(self.width), r)]
        self.fps = [fingerprint(c) for _, _, c in self.items]
        self.blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for n, fp in enumerate(self.fps):
            for b in range(BLOCKS):
                self.blocks[b][self._block(fp, b)].append(n)

    def _block(self, fp: int, b: int) -> int:
        return fp >> (b * self.width) & ((1 << self.width) - 1)

    @staticmethod
    def _key(windows: np.ndarray, k: int) -> np.ndarray:
        """One number a row of k word numbers."""
        key = np.zeros(len(windows), np.uint64)
        for j in range(k):
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (windows[:, j] + np.uint64(1))
            key ^= key >> np.uint64(29)
        return key

    def near(self, fp: int, among: set[int]) -> list[tuple[int, int]]:
        """(item, distance) of every item of among within RADIUS bits.

        Few items are compared as they are; of many, those that the index finds.
        """
        found = among
        if len(among) > BLOCKS * len(self.flips):
            found = {n for b in range(BLOCKS) for f in self.flips for n in self.blocks[b].get(self._block(fp, b) ^ f, ()) if n in among}
        return [(n, d) for n in sorted(found) if (d := (fp ^ self.fps[n]).bit_count()) <= RADIUS]

    def matches(self, text: str | None) -> list[tuple[int, int, float, int]]:
        """(item's place, first word, similarity, bits) of each matched item's best window."""
        words = words_of(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        windows: set[tuple[int, int]] = set()
        met: set[int] = set()
        for k in self.lengths:
            if len(ids) < k:
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, k)
            at = np.flatnonzero((rows != 0).all(axis=1))
            key = self._key(rows[at], k)
            keys = self.keys[k]
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            for i in at[hit].tolist():
                shingle = tuple(ids[i : i + k].tolist())
                met |= self.holders.get(shingle, set())
                for before, size in self.starts.get(shingle, ()):
                    # a window that runs over an end of the text is cut there
                    windows.add((max(0, i - before), min(len(words), i - before + size)))
        best: dict[int, tuple[float, int, int]] = {}
        for start, end in sorted(windows):
            bag = Counter(shingles(words[start:end]))
            for n, bits in self.near(fingerprint(bag), met):
                s = similarity(bag, self.items[n][2])
                if s >= SIMILARITY and (n not in best or s > best[n][0]):
                    best[n] = (s, start, bits)
        return [(n, start, s, bits) for n, (s, start, bits) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, bits) for each document and item it holds a passage of."""
    spark, out = docs.sparkSession, None
    items = benchmark.where("text is not null").select(F.xxhash64("text").alias("key"), F.col("item_id").cast("long").alias("item_id"), "text")
    texts = items.select("key", "text").distinct()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-size // BYTES))
    for part in range(parts):
        rows = texts.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(parts)) == part).collect()  # about ITEMS distinct texts at most
        shared = spark.sparkContext.broadcast([(r["key"], words_of(r["text"])) for r in sorted(rows)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column("text")):
                    for m in index.matches(text.as_py()):
                        at.append(i)
                        found.append(m)
                n = [m[0] for m in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([index.items[i][0] for i in n], pa.int64()), pa.array([m[2] for m in found], pa.float64()),
                     pa.array([m[1] for m in found], pa.int64()), pa.array([len(index.items[i][1]) for i in n], pa.int64()), pa.array([m[3] for m in found], pa.int32())],
                    ["doc_id", "key", "similarity", "first_word", "n_words", "bits"],
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, similarity double, first_word long, n_words long, bits int")
        out = got if out is None else out.union(got)
    return out.join(items.select("key", "item_id"), "key").select("doc_id", "item_id", "similarity", "first_word", "n_words", "bits")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a passage of the benchmark; rows with a null doc_id are judged by their text."""
    row = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))
    hits = stage(contaminated(docs.select(row.alias("doc_id"), "text"), benchmark).select("doc_id").distinct(), "hits")
    name = unused(docs, "_row")
    return docs.withColumn(name, row).join(hits.withColumnRenamed("doc_id", name), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))
