"""Op 12. Hard negatives by branch and bound over ball trees.

Scores are inner products of integer vectors (each component floor(SCALE x)). Every task builds ball
trees over its rows, TREE at a time. A node holds its centre, its radius and the least and greatest
label in it; with |a| the length of an anchor, no row of the node scores outside
``a.centre ± |a| radius``. So a node is left out for a query if that range misses the query's window,
if its upper end is strictly beneath the query's present k-th score (an equal score may win by its
id), or if its labels can't suit. All queries of a block go down a tree together, each node with
those that still need it; leaves are scored exactly, so the result is exact.

First come each anchor's positives (its best rows of the same label), then, for each of them, the
best rows of other labels in the window that the positive's score gives. The k-th scores start from
those of at most about SCOUTS rows drawn by a hash of the id, which only spares work: the k-th best
of a part can't beat that of the whole. Anchors come in blocks of ANCHORS, the only rows that pass
the driver. Rows never move.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors
of different lengths have no score; empty vectors score 0. Rows that share an id are rows each, but
never each other's others; anchors that share an id are queried each. Ties go to the smaller id.
Scores beyond a long saturate. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.llm.common import placed, stage, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative scores between LOW and HIGH hundredths of the positive.
LOW, HIGH = 30, 90
#: A gap of this share of an axis parts clusters.
GAP = 0.1
LEAF, TREE, ANCHORS, SCOUTS = 128, 32_768, 4_096, 16_384
FOUND = "query int, anchor_id long, positive_id long, positive_score long, id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integer vectors) of the rows that take part, by length of their vectors."""
    batch = batch.filter(pc.and_(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("label"))), pc.is_valid(batch.column("embedding"))))
    ids, labels, lists = (batch.column(c) for c in ("vec_id", "label", "embedding"))
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    row = np.repeat(np.arange(len(size)), size)
    whole = np.bincount(row[~np.isfinite(flat)], minlength=len(size)) == 0
    first = np.cumsum(size) - size
    for n in np.unique(size[whole]).tolist():
        at = np.flatnonzero(whole & (size == n))
        yield ids.take(pa.array(at)).to_numpy(), labels.take(pa.array(at)).to_numpy(), np.floor(SCALE * flat[first[at][:, None] + np.arange(n)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer vectors, exact."""
    if a.size == 0 or b.size == 0 or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, LEAST, MOST).astype(np.int64)


class Ball:
    """A node: rows[start:end] of its tree."""

    __slots__ = ("start", "end", "centre", "radius", "low", "high", "kids")


class Tree:
    """Rows of one length, sorted so that every node's are together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        self.ids, self.labels, self.points = ids, labels, points
        order = np.arange(len(ids))
        self.root = self._node(order, 0, len(ids))
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]

    def _node(self, order: np.ndarray, start: int, end: int) -> Ball:
        own = order[start:end]
        points, labels = self.points[own], self.labels[own]
        ball = Ball()
        ball.start, ball.end, ball.centre, ball.kids = start, end, points.mean(axis=0), ()
        ball.radius = float(np.sqrt(((points - ball.centre) ** 2).sum(axis=1).max()))
        ball.low, ball.high = labels.min(), labels.max()
        if end - start > LEAF and (ball.radius > 0 or ball.low < ball.high):
            # labels apart first, so that nodes of one label can be left out; then along the widest axis,
            # at its widest gap between the outer sixteenths (clusters stay whole), else in the middle
            apart = ball.low < ball.high and (ball.radius == 0 or end - start > 4 * LEAF)
            key = labels if apart else points[:, np.argmax(points.max(axis=0) - points.min(axis=0))]
            sort = np.argsort(key, kind="stable")
            order[start:end] = own[sort]
            edge, middle = (end - start) // 16, (start + end) // 2
            gaps = np.diff(key[sort][edge : end - start - edge])
            if len(gaps) and gaps.max() > GAP * (key.max() - key.min()):
                middle = start + edge + int(np.argmax(gaps)) + 1
            ball.kids = (self._node(order, start, middle), self._node(order, middle, end))
        return ball


class Search:
    """The best k rows of every query, over any number of trees.

    A query has an anchor (its vector, its id), a label, whether rows must have it or must not, and
    a window of scores. All vectors have one length.
    """

    def __init__(self, points, anchor, own, label, same: bool, low, high, start, k: int):
        self.points, self.anchor, self.own, self.label, self.same = points, anchor, own, label, same
        self.low, self.high, self.kth, self.k = low, high, start.copy(), k
        self.length = np.sqrt((points**2).sum(axis=1))
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, score, id
        self.nodes = self.scored = 0

    def needs(self, ball: Ball, active: np.ndarray) -> tuple[np.ndarray, float]:
        """The queries that must go into a node, and how high it may score them."""
        label = self.label[active]
        active = active[(ball.low <= label) & (label <= ball.high) if self.same else (ball.low != label) | (ball.high != label)]
        mid = (self.points @ ball.centre)[self.anchor[active]]
        reach = self.length[self.anchor[active]] * ball.radius
        reach += 1e-9 * (reach + np.abs(mid)) + 1e-6  # rounding
        up = mid + reach
        keep = (up >= self.low[active]) & (mid - reach <= self.high[active]) & (up >= self.kth[active])
        self.nodes += len(keep)
        return active[keep], float(np.minimum(up, self.high[active])[keep].sum() / max(1, keep.sum()))

    def add(self, tree: Tree) -> None:
        active, _ = self.needs(tree.root, np.arange(len(self.anchor)))
        todo = [(tree.root, active)]
        while todo:
            ball, active = todo.pop()
            active = active[self.kth[active] <= self.ceiling(ball, active)] if len(active) else active
            if not len(active):
                continue
            if not ball.kids:
                self.score(tree, ball, active)
                continue
            below = [(kid, *self.needs(kid, active)) for kid in ball.kids]
            todo += [(kid, some) for kid, some, _ in sorted(below, key=lambda x: x[2]) if len(some)]

    def ceiling(self, ball: Ball, active: np.ndarray) -> np.ndarray:
        """Upper ends again: the k-th scores may have risen since the node was put aside."""
        mid = (self.points @ ball.centre)[self.anchor[active]]
        return mid + self.length[self.anchor[active]] * ball.radius * (1 + 1e-9) + 1e-9 * np.abs(mid) + 1e-6

    def score(self, tree: Tree, ball: Ball, active: np.ndarray) -> None:
        rows = slice(ball.start, ball.end)
        anchors, at = np.unique(self.anchor[active], return_inverse=True)
        scores = products(self.points[anchors], tree.points[rows])[at]
        self.scored += scores.size
        labels, ids = tree.labels[rows][None, :], tree.ids[rows][None, :]
        suits = (labels == self.label[active][:, None]) if self.same else (labels != self.label[active][:, None])
        suits &= (ids != self.own[active][:, None]) & (scores >= self.low[active][:, None]) & (scores <= self.high[active][:, None]) & (scores >= self.kth[active][:, None])
        q, r = np.nonzero(suits)
        if not len(q):
            return
        query, score, found = active[q], scores[q, r], tree.ids[rows][r]
        touched = np.zeros(len(self.anchor), bool)
        touched[query] = True
        old = touched[self.best[0]]
        mine = [np.concatenate([b[old], new]) for b, new in zip(self.best, (query, score, found), strict=True)]
        order = np.lexsort((mine[2], -mine[1], mine[0]))
        mine = [x[order] for x in mine]
        first = np.flatnonzero(np.append(True, mine[0][1:] != mine[0][:-1]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        full = rank == self.k - 1
        self.kth[mine[0][full]] = np.maximum(self.kth[mine[0][full]], mine[1][full])
        self.best = tuple(np.concatenate([b[~old], x[rank < self.k]]) for b, x in zip(self.best, mine, strict=True))


def rows_of(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """The columns that the search reads."""
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null and embedding is not null")


def searched(rows: DataFrame, queries: dict[int, dict], k: int, same: bool) -> DataFrame:
    """FOUND: of each query its best k rows in each task. queries: by length of vectors, the arrays of Search and what to say of each query."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        search = {n: Search(q["points"], q["anchor"], q["own"], q["label"], same, q["low"], q["high"], q["start"], k) for n, q in asked.items()}
        held: dict[int, list] = {n: [] for n in asked}

        def grow(n: int) -> None:
            if held[n]:
                search[n].add(Tree(*(np.concatenate(x) for x in zip(*held[n], strict=True))))
                held[n].clear()

        for batch in batches:
            for ids, labels, points in vectors(batch):
                n = points.shape[1]
                if n in asked:
                    held[n].append((ids, labels, points))
                    if sum(len(x[0]) for x in held[n]) >= TREE:
                        grow(n)
        for n, q in asked.items():
            grow(n)
            query, score, found = search[n].best
            told = [q["query"][query], q["anchor_id"][query], q["positive_id"][query], q["positive_score"][query], found, score]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(told, [pa.int32(), *[pa.int64()] * 5], strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query over all tasks, with ``rank`` from 1."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def started(scouts: DataFrame, queries: dict[int, dict], k: int, same: bool) -> dict[int, dict]:
    """queries with the k-th scores that the scouts give."""
    found = best(searched(scouts, queries, k, same), k).where(F.col("rank") == k).select("query", "score").toPandas()  # one number a query of the block
    for q in queries.values():
        mine = found[found["query"].isin(q["query"])]
        q["start"][mine["query"].to_numpy() - q["query"][0]] = mine["score"]
    return queries


def queries_of(anchors: pa.Table) -> dict[int, dict]:
    """A query for every anchor, numbered within the block: rows of its label, any score."""
    held: dict[int, list] = {}
    for batch in anchors.combine_chunks().to_batches():
        for ids, labels, points in vectors(batch):
            held.setdefault(points.shape[1], []).append((ids, labels, points))
    out, number = {}, 0
    for length, found in held.items():
        ids, labels, points = (np.concatenate(x) for x in zip(*found, strict=True))
        n = len(ids)
        out[length] = {
            "points": points, "anchor": np.arange(n), "own": ids, "label": labels, "low": np.full(n, LEAST), "high": np.full(n, MOST), "start": np.full(n, LEAST),
            "query": np.arange(number, number + n, dtype=np.int32), "anchor_id": ids, "positive_id": ids, "positive_score": np.zeros(n, np.int64),
        }
        number += n
    return out


def windows_of(anchors: dict[int, dict], positives: list) -> dict[int, dict]:
    """A query for every anchor and positive: rows of other labels whose scores lie in the window."""
    out, by_query = {}, {}
    for r in positives:
        by_query.setdefault(r["query"], []).append((r["id"], r["score"]))
    number = 0
    for n, a in anchors.items():
        pairs = [(i, *p) for i, query in enumerate(a["query"].tolist()) for p in by_query.get(query, ())]
        if not pairs:
            continue
        at = np.array([p[0] for p in pairs])
        score = np.array([p[2] for p in pairs], np.int64)
        exact = [p[2] for p in pairs]
        out[n] = {
            "points": a["points"], "anchor": at, "own": a["own"][at], "label": a["label"][at], "low": np.array([-(-LOW * s // 100) for s in exact], np.int64), "high": np.array([HIGH * s // 100 for s in exact], np.int64),
            "start": np.full(len(pairs), LEAST), "query": np.arange(number, number + len(pairs), dtype=np.int32), "anchor_id": a["anchor_id"][at], "positive_id": np.array([p[1] for p in pairs], np.int64), "positive_score": score,
        }
        number += len(pairs)
    return out


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows, anchors (vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    asked = placed(anchors.select("vec_id", "label", "embedding", F.lit(0).alias("g"), F.xxhash64("embedding").alias("_h"), F.monotonically_increasing_id().alias("_m")), "g", ["vec_id", "_h", "_m"], "anchors")
    asked = stage(asked.select("vec_id", "label", "embedding", F.expr(f"i div {ANCHORS}").alias("block")), "asked")
    blocks, total = asked.agg(F.max("block")).first()[0], rows.count()
    scouts = stage(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // SCOUTS))) == 0), "scouts")
    out = []
    for block in range(-1 if blocks is None else blocks + 1):
        queries = queries_of(asked.where(F.col("block") == block).select("vec_id", "label", "embedding").toArrow())
        told = best(searched(rows, started(scouts, queries, positives, True), positives, True), positives).select("query", "id", "score").collect()  # at most ANCHORS x positives rows
        pairs = windows_of(queries, told)
        found = best(searched(rows, started(scouts, pairs, negatives, False), negatives, False), negatives)
        out.append(stage(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not out:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where("vec_id % 100 = 0"))


ORACLE_SQL = {
    "op12_hard_negatives": f"""with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor({SCALE} * x::double) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
 s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
 p as (select anchor_id, id as positive_id, score as positive_score from s where label = own qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES})
 select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::int as rank, s.id as negative_id, positive_score, s.score as negative_score
 from p join s on s.anchor_id = p.anchor_id and s.label <> own and {LOW} * positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * positive_score
 qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) <= {NEGATIVES}"""
}
