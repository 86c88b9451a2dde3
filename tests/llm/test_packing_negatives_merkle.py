"""Operators 11 to 13 against brute force and, where DuckDB can say it, against its rows."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import merkle, negatives, packing, registry

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check_pieces(rows, wanted: dict, width: int) -> tuple[float, int]:
    """Every id in one piece, sequences gapless and of at most width; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(wanted)
    for doc, ids in wanted.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    return padding / sum(map(len, wanted.values())), len(by_sequence)


def test_packing_of_the_documents(spark, model):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wanted = {d: [*e.ids, 1] for d, e in zip(docs, model.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    share, _ = check_pieces(registry.QUERIES["op11_packing"](spark, SF).collect(), wanted, packing.WIDTH)
    assert share < 0.02


def test_packing_edges(spark, model):
    word = lambda n: " ".join(random.Random(n).choice(("alpha", "beta 12", "gam'ma", "d-e", "é", "語")) for _ in range(n))
    texts = [None, "", " ", "\n\n", "One. Two! Three?", word(30_000), "x" * 50_000, "no stop " * 9_000, "<|endoftext|> is text", "a. " * 20_000, "same.", "same."]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, start long, length string")
    wanted = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for width in (16, 2048):
        check_pieces(packing.pack(docs, PATH, width).collect(), wanted, width)
    ordered = packing.pack(docs.repartition(3), PATH, order=("doc_id",)).collect()
    check_pieces(ordered, wanted, 2048)
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.fixture(scope="module")
def tokens():
    with open(PATH, encoding="utf-8") as f:
        return packing.Tokens(f.read())


def test_ids_are_the_librarys_on_every_code_point(model, tokens):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    assert tokens.fast
    for at in range(0, len(points), 4_000):
        texts = ["".join(f"a{x}b {x}1 {x}{x}  {x} .{x}\n{x}'s" for x in points[i : i + 40]) for i in range(at, min(at + 4_000, len(points)), 40)]
        assert [x.tolist() for x in tokens.encode(texts)] == [[*e.ids, 1] for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def test_ids_of_odd_texts(model, tokens):
    rnd = random.Random(5)
    bits = ("a", "B", "word", " ", "  ", "\n", "é", "語", "'s", "'", "1", "½", ".", "_", "\t", "\u00a0", "\u2003", "\u180e", "\u200b", "\u0085", "\x1c", "<|endoftext|>", "😀", "\u0301", "\x00")
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(80))) for _ in range(2_000)] + [" " * 1_000_000, "x" * 300_000, "", "<|endoftext|>"]
    assert [x.tolist() for x in tokens.encode(texts)] == [[*e.ids, 1] for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    assert packing.ranks({"pre_tokenizer": {"type": "Metaspace"}, "model": {"type": "BPE"}}) is None


def test_windows_cost_least():
    """The queue against all transitions."""
    rnd = np.random.default_rng(3)
    for _ in range(60):
        width = int(rnd.choice([8, 12, 32]))
        b = np.concatenate([[0], np.cumsum(rnd.integers(1, min(8, width), 40))])
        price = rnd.choice([0, packing.IN_DOCUMENT, packing.IN_SENTENCE], len(b))
        padded = lambda n: 0 if n & (n - 1) == 0 else width - n
        cost = [0.0]
        for j in range(1, len(b)):
            cost.append(min(cost[i] + padded(int(b[j] - b[i])) for i in range(j) if b[j] - b[i] <= width) + price[j] + packing.PER_WINDOW)
        ends = packing.windows(b, price, width, True)
        got = sum(padded(int(b[j] - b[i])) + price[j] + packing.PER_WINDOW for i, j in zip([0, *ends], ends))  # noqa: B905
        assert ends[-1] == len(b) - 1 and got == cost[-1]


def test_packing_in_short_stretches():
    """Stretches that end within documents change nothing but the choice of cuts."""
    rnd, packer, out, docs = np.random.default_rng(1), packing.Packer(32, 100), [], {}
    for d in range(40):
        ids = rnd.integers(2, 50_000, int(rnd.choice([0, 1, 5, 40, 700]))).astype(np.uint32)
        docs[d] = np.append(ids, np.uint32(1))
        out += packer.add(d, docs[d], np.flatnonzero(rnd.random(len(ids)) < 0.1) + 1 if len(ids) > 1 else np.empty(0, np.int64))
    out += packer.flush(True)
    found, size = defaultdict(list), defaultdict(int)
    for d, start, ids, n, sequence, offset in out:
        assert n == len(docs[d]) and offset == size[sequence] and start == sum(map(len, found[d]))
        found[d].append(ids)
        size[sequence] += len(ids)
    assert all(np.array_equal(np.concatenate(found[d]), docs[d]) for d in docs) and max(size.values()) <= 32


def brute_negatives(rows) -> set:
    known = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for a, own, v in (x for x in known if x[0] % 100 == 0):
        scored = [(i, lab, sum(x * y for x, y in zip(v, w, strict=True))) for i, lab, w in known if i != a and len(w) == len(v)]
        for p, _, ps in sorted((x for x in scored if x[1] == own), key=lambda x: (-x[2], x[0]))[:5]:
            fit = sorted((x for x in scored if x[1] != own and 30 * ps <= 100 * x[2] <= 90 * ps), key=lambda x: (-x[2], x[0]))
            out |= {(a, p, k + 1, i, ps, s) for k, (i, _, s) in enumerate(fit[:10])}
    return out


KEYS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("leaf, tree, anchors", [(128, 32_768, 4_096), (4, 50, 2)])
def test_negatives_brute_force(spark, tmp_path, monkeypatch, leaf, tree, anchors):
    """Ties, equal vectors, negative and zero scores, other lengths, nulls, NaN, infinities; small trees and several blocks."""
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "SCOUTS", 60)
    rnd, rows = random.Random(7), []
    for i in range(700):
        v = [round(rnd.gauss(0, 0.2) + (0.3 if d == i % 5 else 0), 1) for d in range(6)]
        rows.append((i, rnd.randrange(4), [0.5, 0.25, 0.0, 0.0, 0.0, 0.5] if i % 3 == 0 else v))
    rows += [(None, 1, [0.1] * 6), (800, None, [0.1] * 6), (900, 1, None), (1000, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (1100, 2, [float("nan")] * 6), (1200, 2, [float("inf")] * 6), (1300, 1, [0.5, 0.5]), (1301, 1, [0.5, 0.25]), (1302, 2, [0.5, 0.125]), (1400, 0, []), (1500, 9, [3e4] * 6), (1501, 9, [3e4] * 6), (1503, 8, [2e4] * 6)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = negatives.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert [f for f in got[0].__fields__] == list(KEYS)
    assert {tuple(r) for r in got} == brute_negatives(rows) and len(got) == len({tuple(r) for r in got})


def test_negatives_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert negatives.op12_hard_negatives(spark, str(tmp_path)).count() == 0


def test_tree_leaves_nodes_out():
    """Pruning: clusters far from an anchor are never scored."""
    rnd = np.random.default_rng(0)
    points = np.concatenate([np.floor(rnd.normal(0, 4, (2_000, 8)) + 400 * np.eye(8)[k]) for k in range(8)])
    tree = negatives.Tree(np.arange(16_000), np.zeros(16_000, np.int64), points)
    q = negatives.Search(points[:3], np.arange(3), np.arange(3), np.zeros(3, np.int64), True, np.full(3, negatives.LEAST), np.full(3, negatives.MOST), np.full(3, negatives.LEAST), 5)
    q.add(tree)
    scores = points[:3] @ points.T
    for i in range(3):
        scores[i, i] = -np.inf
        assert sorted(q.best[1][q.best[0] == i])[::-1] == sorted(scores[i])[::-1][:5]
    assert q.scored < 3 * 16_000 / 4


def test_negatives_and_manifest_equal_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name in ("op12_hard_negatives", "op13_merkle_manifest"):
        got = registry.QUERIES[name](spark, SF).toPandas()
        want = con.execute(registry.ORACLE_SQL[name]).df()[list(got.columns)]
        assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def h(*values: str) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def brute_tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    paths = []
    for i in range(len(leaves)):
        path, k = [], i
        for row in rows[:-1]:
            run = row[k // 8 * 8 : k // 8 * 8 + 8]
            path.append((k % 8, run[: k % 8] + run[k % 8 + 1 :]))
            k //= 8
        paths.append(path)
    return rows[-1][0], paths


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 700])
def test_traversal_gives_every_path(n):
    leaves = [h(str(i)) for i in range(n)]
    root, wanted = brute_tree(leaves)
    got = list(merkle.paths([x.encode() for x in leaves], merkle.height_of(n)))
    assert [[(s, [o.decode() for o in others]) for s, others in p] for p in got] == wanted
    assert {merkle.folded(x.encode(), p).decode() for x, p in zip(leaves, got, strict=True)} == {root}


def test_traversal_holds_two_subtrees_a_level():
    """Memory follows the subtrees, not the block: nodes held at any time against the nodes of the block."""
    leaves = [b"x%d" % i for i in range(4096)]
    most, made = 0, []
    init = merkle.Growing.__init__

    def counted(self, *a):
        init(self, *a)
        made.append(self)

    merkle.Growing.__init__ = counted
    try:
        for _ in merkle.paths(leaves, 4):
            most = max(most, sum(len(r) for g in made[-4:] for r in g.rows))
    finally:
        merkle.Growing.__init__ = init
    assert most <= 4 * (64 + 8 + 1)


@pytest.mark.parametrize("block", [1, 4])
def test_manifest_brute_force(spark, monkeypatch, block):
    """Many languages, null columns, repeated ids and rows, a lone leaf; blocks of 8 so that the upper tree has levels."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rnd, rows = random.Random(2), []
    for i in range(600):
        lang = rnd.choice([None, "", "en", "en", "en", "EN", "de", "é"])
        rows.append((i, rnd.choice(["Abc", "", None, "é" * 5, "lower"]), lang, rnd.choice([None, 3]), rnd.choice(["s1", None])))
    rows += [(600, "Alone", "zz", 1, None), (601, "two", "en", 1, None), (601, "Two", "en", 1, None), (602, "same", "de", 2, "s"), (602, "same", "de", 2, "s"), (None, "No Id", "en", 1, "s")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, n_chars long, source string, leaf string, g int").repartition(4)
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    made = lambda r, text: h(told(r[0]), told(r[4]), told(r[2]), told(r[3]), told(text))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((-1 if r[0] is None else r[0], made(r, r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([leaf for _, leaf, _ in sorted(groups[x], key=lambda y: y[:2])]) for x in langs}
    root, above = brute_tree([trees[x][0] for x in langs])
    wanted = []
    for k, x in enumerate(langs):
        for (_, leaf, r), path in zip(sorted(groups[x], key=lambda y: y[:2]), trees[x][1], strict=True):
            whole = path + above[k]
            node = made(r, low(r[1])) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 else leaf
            for slot, others in whole:
                node = h(*others[:slot], node, *others[slot:])
            wanted.append((r[0], leaf, trees[x][0], root, h(*(o for _, others in whole for o in others)), node, node == root))
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(w[-1] for w in wanted) and not all(w[-1] for w in wanted)


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(3, "Text", "en", 4, "s")], "doc_id long, text string, lang string, n_chars long, source string")
    assert merkle.manifest(docs.limit(0)).count() == 0
    row = merkle.manifest(docs).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()


def test_manifest_of_long_texts(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Long é "), 1_000_000).alias("text"), F.lit("en").alias("lang"), F.lit(7).alias("n_chars"), F.lit(None).cast("string").alias("source"))
    text = "Long é " * 1_000_000
    got = {r.doc_id: r.leaf for r in merkle.manifest(docs).collect()}
    assert got == {i: h(f"1:{i}", "-", "2:en", "1:7", f"{len(text.encode())}:{text}") for i in range(3)}


def test_no_machine_folder(spark):
    assert os.listdir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
