"""Op 8. Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, all else is a blank; n-grams of 1 to 3 characters are hashed to DIMENSIONS
features and weighted by relative frequency times inverse document frequency. The frequencies are
counted over all learnable documents; the regression is trained by follow-the-regularised-leader
with elastic-net penalties on a sample of at most about SAMPLE rows, an equal share for each
language, and a temperature fitted on rows of the sample kept aside calibrates the scores.

Null texts and texts without a letter are ``und`` with score 1; rows with null lang or doc_id don't
teach; very long texts are read whole; repeated rows are scored alike; with nothing to learn from,
every row is ``und`` with score 0; a single language is predicted for all; ties go to the language
that sorts first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import crc_mod, table

ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 15
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SCALE = 20.0


def _plain_table() -> np.ndarray:
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_PLAIN: list[np.ndarray] = []


def codes(text: str | None) -> np.ndarray:
    """The text's letters, lower-cased, with a blank for anything else and at both ends."""
    if not _PLAIN:
        _PLAIN.append(_plain_table())
    raw = np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if raw.max(initial=0) < 1 << 16:
        return _PLAIN[0][raw]
    high = np.array([ord(c.lower()[:1]) if c.isalpha() else 32 for c in map(chr, raw[raw >= 1 << 16])], np.uint32)
    out = _PLAIN[0][np.minimum(raw, 0xFFFF)]
    out[raw >= 1 << 16] = high
    return out


def grams(c: np.ndarray) -> np.ndarray:
    """Feature numbers of all n-grams with a letter; a feature occurs as often as its n-grams do."""
    letter = c != 32
    key, some, found = c.astype(np.uint32), letter, []
    for n in ORDERS:
        if n > 1:
            key = key[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
            some = some[:-1] | letter[n - 1 :]
        h = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
        found.append((h >> np.uint32(17))[some])
    return np.concatenate(found).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader (proximal), one weight column per language."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null and doc_id is not null").where(crc_mod(4) != 2)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each feature, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                has = np.zeros(DIMENSIONS, bool)
                has[grams(codes(text.as_py()))] = True
                total += has
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["at", "n"])

    df, rows = np.zeros(DIMENSIONS, np.int64), 0
    for r in docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a feature
        if r["at"] < 0:
            rows = r["n"]
        else:
            df[r["at"]] = r["n"]
    return df, rows


def sample(docs: DataFrame, size: int) -> DataFrame:
    """About size rows, drawn by hash of doc_id, with an equal quota for each language."""
    found = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in found.items():
        share = F.when(F.col("lang") == lang, min(1.0, size / len(found) / n)).otherwise(share)
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1_000_000 < share)


def fit(docs: DataFrame, size: int = SAMPLE) -> tuple[list[str], np.ndarray] | None:
    """Languages, and the weight that one occurrence of a feature adds to each (IDF and temperature included)."""
    docs = learnable(docs)
    df, rows = document_frequencies(docs)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for text in batch.column("text"):
                g = np.unique(grams(codes(text.as_py())), return_counts=True)
                at.append(g[0].astype(np.int32))
                n.append((g[1] / max(1, g[1].sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["id", "lang", "at", "tf"])

    got = sample(docs, size).select("doc_id", "lang", "text").mapInArrow(counts, "id string, lang string, at array<int>, tf array<float>").toPandas()  # about size rows
    if not len(got):
        return None
    got = got.sort_values(["id", "lang"], kind="stable")
    languages = sorted(got["lang"].unique())
    idf = np.log((1 + rows) / (1 + df)) + 1
    data = [(np.asarray(a, np.int64), SCALE * idf[a] * np.asarray(t, float), languages.index(y)) for a, t, y in zip(got["at"], got["tf"], got["lang"], strict=True)]
    order = np.random.default_rng(8).permutation(len(data))
    aside, model = set(order[: len(order) // 5].tolist()) if len(order) >= 50 else set(), Ftrl(len(languages))
    for _ in range(EPOCHS):
        for i in order:
            if i not in aside:
                model.learn(*data[i])
    w = model.weights()
    logits = [(x @ w[at], y) for i, (at, x, y) in enumerate(data) if i in aside]
    heat = 1.0
    if logits:
        loss = lambda t: -sum(np.log(softmax(v / t)[y] + 1e-12) for v, y in logits)
        heat = min(np.geomspace(0.05, 20, 61), key=loss)
    return languages, (w * SCALE * idf[:, None] / heat).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """docs with every column, and _lang struct(lang, score)."""
    if model is None:
        return docs.withColumn("_lang", F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(text):
        import pandas as pd

        languages, w = shared.value
        lang, score = [], []
        for t in text:
            g = grams(codes(t))
            if not len(g):
                lang.append("und")
                score.append(1.0)
                continue
            # frequencies times weights: only the features that occur, however long the text
            n = np.bincount(g, minlength=DIMENSIONS)
            at = np.flatnonzero(n)
            p = softmax((n[at] / len(g)) @ w[at].astype(float))
            lang.append(languages[int(p.argmax())])
            score.append(float(p.max()))
        return pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn("_lang", guess("text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", (crc_mod(4) == 2).alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score")
    )
