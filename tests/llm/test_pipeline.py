"""The pipeline's stages on small tables, and single models against their formulas written out."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from folioframe.llm import hmm, langid, suffixes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(folder, documents, labels, benchmark):
    kinds = {"documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())], "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())], "benchmark": [("item_id", pa.int64()), ("text", pa.string())]}
    for name, rows in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds[name])
        pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds[name], strict=True)], [n for n, _ in kinds[name]]), folder / f"{name}.parquet")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """600 documents of a few sentences: every tenth is toxic, some are copies, near copies, share a passage or hold a benchmark item; one null, one empty."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 7)))
    vocabulary = [word() for _ in range(400)]
    sentence = lambda: " ".join(r.choices(vocabulary, k=9)).capitalize() + ". "
    texts = ["".join(sentence() for _ in range(12)) for _ in range(600)]
    for i in range(0, 600, 10):
        texts[i] += "vile scum " * 4
    texts[101] = texts[102] = texts[99]
    edited = texts[111].split()
    edited[50] = "changed"
    texts[112] = " ".join(edited)
    passage = "".join(sentence() for _ in range(8))
    for i in (201, 203, 207):
        texts[i] += passage
    item = " ".join(vocabulary[:40])
    texts[301] += " " + item
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(700, None, None, None, None), (701, "", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("tables")
    write(folder, rows, [(i, 1, int(i % 10 == 0)) for i in range(600)], [(1, item), (2, None)])
    return str(folder), texts, passage


def test_stages_hand_over_what_they_keep(spark, made):
    folder, texts, passage = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, at = lambda df: {x.doc_id for x in df.select("doc_id").collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        assert name == "sentencepiece" or docs.columns == COLUMNS
        at[name] = docs
    everything = set(range(600)) | {700, 701}
    toxic = everything - ids(at["toxicity"])
    assert toxic <= set(range(0, 600, 10)) and len(toxic) > 50
    once = ids(at["toxicity"]) - ids(at["simhash_near_dedup"])
    assert once == {101, 102, 112, 701} - toxic
    cut = {x.doc_id: x.text for x in at["substring_dedup"].collect()}
    assert ids(at["substring_dedup"]) == ids(at["simhash_near_dedup"]) and passage.strip()[20:-20] in cut[201]
    assert all(len(cut[i]) < len(texts[i]) - 0.8 * len(passage) for i in (203, 207)) and all(cut[i] == texts[i] for i in (1, 2, 99))
    assert ids(at["substring_dedup"]) - ids(at["benchmark_decontamination"]) == {301}
    last = at["sentencepiece"]
    assert all((x.ids is None) == (x.text is None) for x in last.collect()) and last.columns[: len(COLUMNS)] == COLUMNS
    assert sorted((x.doc_id, x.n_ids) for x in corpus_pipeline.run(spark, folder).collect()) == sorted((x.doc_id, x.n_ids) for x in last.collect())


def test_empty_tables(spark, tmp_path):
    write(tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_regression_against_its_formulas():
    """Follow-the-regularised-leader, one coordinate at a time in plain Python."""
    r = np.random.default_rng(3)
    model, z, n = langid.Ftrl(3), {}, {}
    a, b, l1, l2 = langid.ALPHA, langid.BETA, langid.L1, langid.L2
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((b + math.sqrt(n[k])) / a + l2)
    for _ in range(60):
        at = np.sort(r.choice(12, 4, replace=False))
        x, y = r.random(4), int(r.integers(3))
        w = {(i, c): weight((i, c)) for i in at.tolist() for c in range(3)}
        logits = [sum(x[j] * w[i, c] for j, i in enumerate(at.tolist())) for c in range(3)]
        total = sum(math.exp(v) for v in logits)
        for j, i in enumerate(at.tolist()):
            for c in range(3):
                g = x[j] * (math.exp(logits[c]) / total - (c == y))
                s = (math.sqrt(n.get((i, c), 0.0) + g * g) - math.sqrt(n.get((i, c), 0.0))) / a
                z[i, c] = z.get((i, c), 0.0) + g - s * w[i, c]
                n[i, c] = n.get((i, c), 0.0) + g * g
        model.learn(at, x, y)
    got = model.weights(np.arange(12))
    assert all(math.isclose(got[i, c], weight((i, c)), rel_tol=1e-9, abs_tol=1e-12) for i in range(12) for c in range(3))


def test_document_frequencies_and_features(spark):
    texts = ["Abc abc", "bcd", "", "123", "éa É"]
    df, rows = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(langid.DIMENSIONS, np.int64)
    for t in texts:
        want[np.unique(langid.grams(langid.codes(t)))] += 1
    assert rows == 5 and (df == want).all()
    low = langid.codes("Ab1É")
    assert low.tolist() == [32, ord("a"), ord("b"), 32, ord("é"), 32] and len(langid.grams(low)) == 3 + 5 + 4


def test_parts_follow_the_input():
    assert [suffixes.part_bits(n) for n in (0, 1 << 30, 30 << 30, 10**14)] == [10, 10, 10, 22]


def test_shares_of_a_class_sum_to_one():
    """What the table's tokens and unseen ones get of their class, in every state."""
    r = np.random.default_rng(1)
    c, packed = r.integers(1, 9, 50), r.integers(1, 256, (50, hmm.STATES)).astype(np.uint8)
    states = hmm.states_of(packed.reshape(-1).view("<i8"))
    seen, share = (c[:, None] * states).sum(axis=0), c.sum() + 50 + 1
    each = (1 - hmm.OWN) * c[:, None] * states / seen + hmm.OWN * ((c + 1) / share)[:, None]
    assert np.allclose(each.sum(axis=0) + hmm.OWN * 1 / share, 1)
