"""Op 3. Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, are learned from labelled rows. A class's bigrams back off to
its unigrams, and these to one unigram model that both classes share. All counts are continuation
counts (a word counts once for each word that it follows, a pair once for each word before it),
which copies of a text don't raise. As in Kneser-Ney smoothing the shared counts are what the
discounts took from both classes, so rare expressions cost both models the same. The discount of a
class is DISCOUNT plus COMMON times the lesser of both classes' counts: what both classes have is
shared as well. (With constant discounts the noise of ordinary words outweighs the few toxic ones of
a long text.) Every distribution sums to one. The larger class's counts are scaled to the number of
documents of the smaller, so a discount means the same in both.

A document's evidence is the difference of its log-likelihoods, over its length and over the square
root of it; a logistic curve, fitted on labelled rows that the counts have not seen, turns it into a
score.

Fit is bounded by SAMPLE_PER_CLASS labelled rows a class (drawn by hash of doc_id); whatever those
rows hold is counted. A word or pair whose count the discounts take whole has the shared probability
in both models, so only the others are sent. Scoring covers every whole text.

Null, empty and wordless texts have no evidence and get the curve's value for none; words are
lower-cased and stripped of ASCII punctuation; label rows that are null or disagree for a doc_id
count once each; repeated rows score alike; null doc_ids count as held in; with no toxic or no
ordinary label the score is 0 for all; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import PLAIN, crc_mod, drop_stage, stage, table, text_bytes, unused

SAMPLE_PER_CLASS = 4000
#: Discounts of continuation counts and of pairs, and the share of the lesser count beside them.
WORD_DISCOUNT, PAIR_DISCOUNT, COMMON = 5.0, 6.0, 2.0


def tokens(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(PLAIN).split()


class KneserNey:
    """Class bigrams -> class unigrams (continuation counts) -> unigrams shared by both classes.

    Word 0 is the start of a text; word 1 any word that the discounts take whole. Columns: ordinary, toxic.
    """

    def __init__(self, words: list[tuple[bytes, float, float, float]], kinds: np.ndarray, taken: np.ndarray, contexts: dict[bytes, tuple[float, float]], pairs: list[tuple[bytes, bytes, float, float]]):
        """words: (word, what is left of its count in either class, what was taken in both); kinds, taken: each
        class's total; contexts: each class's total of a first word; pairs: (first, second, what is left in either class)."""
        self.ids = {w[0]: i + 2 for i, w in enumerate(words)}
        for u in contexts:
            if u:
                self.ids.setdefault(u, len(self.ids) + 2)
        n = self.size = len(self.ids) + 2
        self.gamma = taken / kinds
        self.low = np.tile(self.gamma, (n, 1))  # a probability that both share is a factor of both
        shared = np.array([w[3] for w in words]) / taken.sum()
        left = np.array([w[1:3] for w in words], float).reshape(-1, 2)
        self.low[2 : len(words) + 2] = left / kinds + self.gamma * shared[:, None]
        self.rest = 1 - shared.sum()  # what the shared model gives to all words that are not here
        rows = sorted((self.number(u) * n + self.ids[v], *np.array(h) / np.maximum(contexts[u], 1e-300)) for u, v, *h in pairs)
        self.pairs = np.array([r[0] for r in rows], np.int64)
        self.high = np.array([r[1:] for r in rows], float).reshape(-1, 2)
        self.back = np.ones((n, 2))
        np.subtract.at(self.back, self.pairs // n, self.high)

    def number(self, word: bytes) -> int:
        return self.ids.get(word, 1) if word else 0

    def evidence(self, words: list[bytes]) -> tuple[float, float]:
        """The log-likelihood ratio of toxic to ordinary, over the number of words and over its square root."""
        if not words:
            return 0.0, 0.0
        get = self.ids.get
        v = np.fromiter((get(w, 1) for w in words), np.int64, len(words))
        u = np.concatenate([[0], v[:-1]])
        p = self.back[u] * self.low[v]
        if len(self.pairs):
            key = u * self.size + v
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            p[hit] += self.high[at[hit]]
        p = np.maximum(p, 1e-300)
        ratio = float(np.log(p[:, 1] / p[:, 0]).sum())
        return ratio / len(words), ratio / len(words) ** 0.5


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> np.ndarray:
    """Newton's method for P(y) = 1 / (1 + exp(-(a + b . x))) with a small ridge."""
    x1 = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + 1e-3 * np.eye(len(b)), x1.T @ (weight * (y - p)) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, float]:
    """(text, toxic, part): labelled rows that may be learned from, thinned by hash to about per_class a class.

    part is 0 for the rows that fit the curve and 1 for those that are counted. Also returns the log
    odds of toxic among all rows that may be learned from.
    """
    rows = docs.select("doc_id").join(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").where(crc_mod(5) != 0)
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for c, n in found.items():
        share = F.when(F.col("toxic") == c, min(1.0, per_class / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    picked = rows.where(draw < share).select("doc_id", "toxic").distinct()
    sample = docs.select("doc_id", "text").join(picked, "doc_id").select("text", "toxic", (crc_mod(5) != 1).cast("int").alias("part"))
    return sample, float(np.log(max(found.get(1, 0), 0.5) / max(found.get(0, 0), 0.5)))


def fit(sample: DataFrame, log_odds: float) -> tuple[KneserNey, np.ndarray] | None:
    """The models, and the curve's weights; None if a class is missing."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[bytes, bytes, bytes, int]] = set()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = tokens(text.as_py())
                seen.update((t, u, v, toxic) for t, u, v in zip([b"", b"", *words], [b"", *words], words, strict=False))
            columns = list(zip(*seen, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns[:3]), pa.array(columns[3], pa.int32())], ["t", "u", "v", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in sample.where("part = 1").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    scale = [min(sizes.values()) / sizes[c] for c in (0, 1)]
    discounted = lambda n0, n1, d: [
        (F.greatest(n - (d + COMMON * F.least(n0, n1)), F.lit(0.0)).alias(f"left{c}"), F.least(n, d + COMMON * F.least(n0, n1)).alias(f"taken{c}")) for c, n in enumerate((n0, n1))
    ]
    # a pair counts once for each word before it, so copies of a text count once
    met = sample.where("part = 1").mapInArrow(triples, "t binary, u binary, v binary, toxic int").groupBy("t", "u", "v").agg(*[F.max((F.col("toxic") == c).cast("long")).alias(f"n{c}") for c in (0, 1)])
    counted = met.groupBy("u", "v").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)])
    scaled = [F.col(f"n{c}") * F.lit(scale[c]) for c in (0, 1)]
    counted = stage(counted.select("*", *[x[0] for x in discounted(*scaled, F.lit(PAIR_DISCOUNT))]), "pairs")
    kept = counted.where("left0 > 0 or left1 > 0")
    words = counted.groupBy("v").agg(*[(F.count_if(F.col(f"n{c}") > 0) * F.lit(scale[c])).alias(f"k{c}") for c in (0, 1)])
    words = words.select("*", *[x for pair in discounted(F.col("k0"), F.col("k1"), F.lit(WORD_DISCOUNT)) for x in pair])
    totals = words.agg(*[F.sum(c).alias(c) for c in ("k0", "k1", "taken0", "taken1")]).first()
    if not (totals["k0"] and totals["k1"]):
        drop_stage(counted)
        return None
    # what is left by the discounts: as many as the bounded sample has, and all of them
    needed = words.join(kept.select("v", F.lit(True).alias("paired")).distinct(), "v", "left").where("left0 > 0 or left1 > 0 or paired")
    needed = needed.select("v", "left0", "left1", (F.col("taken0") + F.col("taken1")).alias("shared")).toPandas().sort_values("v")
    contexts = counted.join(kept.select("u").distinct(), "u").groupBy("u").agg(*[(F.sum(f"n{c}") * F.lit(scale[c])).alias(f"n{c}") for c in (0, 1)]).toPandas().sort_values("u")
    pairs = kept.select("u", "v", "left0", "left1").toPandas()
    drop_stage(counted)
    model = KneserNey(
        [(bytes(v), a, b, s) for v, a, b, s in needed.itertuples(index=False)], np.array([totals["k0"], totals["k1"]]), np.array([totals["taken0"], totals["taken1"]]),
        {bytes(u): (a, b) for u, a, b in contexts.itertuples(index=False)}, [(bytes(u), bytes(v), a, b) for u, v, a, b in pairs.itertuples(index=False)],
    )
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def weigh(text):
        return text.map(lambda t: shared.value.evidence(tokens(t)))

    held = sample.where("part = 0").select("toxic", weigh("text").alias("x")).toPandas()  # three numbers a sampled row
    if held["toxic"].nunique() < 2:
        return None
    y = held["toxic"].to_numpy(float)
    curve = logistic(np.array(held["x"].tolist()), y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    curve[0] += log_odds  # the classes weigh the same in the fit
    return model, curve


def score(docs: DataFrame, model: tuple[KneserNey, np.ndarray] | None, name: str = "_score") -> DataFrame:
    """docs with every column, and one called name between 0 and 1 (``unused`` finds a free name)."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text):
        kn, curve = shared.value
        x = np.array([(1.0, *kn.evidence(tokens(t))) for t in text]).reshape(-1, 3)
        return type(text)(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))))

    return docs.withColumn(name, rate("text"))


def ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score as toxic; the columns stay."""
    name = unused(docs, "_score")
    model = fit(*labelled_sample(docs, labels, SAMPLE_PER_CLASS))
    return score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels"), SAMPLE_PER_CLASS))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )
