"""The corpus operators against brute force, on small tables with nulls, blanks, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import decontaminate, hmm, langid, pieces, rules, sharding, simhash, spans, suffixes, toxicity
from folioframe.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, cell string, row long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "ids", "cell", "row"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(300)]
    sentence = lambda: " ".join(r.choices(vocabulary, k=r.randint(4, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    texts = [" ".join(sentence() for _ in range(r.randint(3, 30))) for _ in range(n)]
    texts[3] = texts[4] = texts[2]
    texts[6] = texts[5] + " One word more here now."
    texts[8] = texts[8] + "\n" + passage + "\n" + sentence()
    texts[11] = sentence() + "\n" + passage + "\n" + texts[11]
    texts += [None, "", " \t\n", "é한 \U0001f600 ▁x", "tick tock " * 3000, "A A A A A A " * 30, None]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), i, "c", i) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, a repeated row, and two texts under one id."""
    t = "Some words that repeat in here. And they go on and on for a while. Until the end of it comes. Or not at all."
    return spark.createDataFrame([(None, t), (1, t), (1, t), (1, t + " More."), (2, None)], "doc_id long, text string")


def test_features_and_rules(docs, none, odd):
    got = {r.doc_id: r for r in rules.quality(docs).collect()}
    for i, t in enumerate(corpus()):
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for j in range(3)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality(none).count() == 0 and rules.quality(odd).count() == 5


def test_em_learns_accuracies():
    r, patterns = random.Random(0), Counter()
    for _ in range(3000):
        good = r.random() < 0.8
        patterns[tuple((1 if good else -1) * (1 if r.random() < a else -1) for a in (0.95, 0.9, 0.55))] += 1
    prior, given = rules.fit(sorted(patterns.items()), 3)
    assert 0.7 < prior < 0.95 and given[0][-1][0] > given[2][-1][0]
    assert rules.posterior(prior, given, (1, 1, 1)) > 0.9 > 0.5 > rules.posterior(prior, given, (-1, -1, -1))


def test_spans(docs, none, odd):
    first, keep, long_cut = {}, {}, "word " * 30 + "and more of it here again" * 9
    for i, t in enumerate(corpus()):
        s = spans.parts(t or "")
        assert "".join(s) == (t or "")
        key = [" ".join(x.lower().split()) for x in s]
        gone = set()
        for a in range(len(s)):
            ends = (b for b in range(a + spans.SPAN, len(s) + 1) if sum(len(x.split()) for x in key[a:b]) >= spans.MIN_WORDS)
            if (b := next(ends, None)) and first.setdefault(tuple(key[a:b]), (i, a)) != (i, a):
                gone |= set(range(a, b))
        keep[i] = None if t is None else "".join(x for a, x in enumerate(s) if a not in gone)
    assert spans.parts("One, two; three: four.\nFive") == ["One, ", "two; ", "three: ", "four.\n", "Five"] and "".join(spans.parts(long_cut)) == long_cut
    out = spans.substring_dedup(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == keep and out.columns[:8] == COLUMNS and keep[3] == keep[4] == ""
    assert all(r._bytes == len((corpus()[i] or "").encode()) and (r._removed == 0) == (keep[i] == corpus()[i]) for i, r in got.items())
    assert spans.substring_dedup(none).count() == 0
    assert sorted(str(r.text) for r in spans.substring_dedup(odd).collect()) == sorted(str(r.text) for r in odd.collect())


def test_spans_inside_sentences(spark):
    """A passage quoted from the middle of a sentence, one without marks, and repeats within rows that share an id."""
    r = random.Random(9)
    w = lambda n: " ".join("".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(n))
    quoted, bare = ", ".join(w(7) for _ in range(12)), w(90)
    rows = [(1, f"{w(40)} {quoted} {w(30)}."), (2, f"{w(9)} {quoted} {w(50)}"), (3, f"{w(60)} {bare} {w(60)}"), (4, f"{w(70)} {bare} {w(50)}"), (5, w(400)), (6, quoted + ".\n" + quoted + "."), (6, w(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("x")).withColumn("_span", F.lit(1))
    got = spans.substring_dedup(docs).collect()
    left = {(x.doc_id, x._bytes): len(x.text.encode()) for x in got}
    size = lambda i: len(rows[i][1].encode())
    assert left[1, size(0)] == size(0) and left[3, size(2)] == size(2) and left[5, size(4)] == size(4) and left[6, size(6)] == size(6)
    assert size(1) - left[2, size(1)] > 0.8 * len(quoted) and size(3) - left[4, size(3)] > 0.6 * len(bare) and left[6, size(5)] < 0.2 * size(5)


def test_sharding(docs, none, odd):
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    rows = sharding.assign_shards(docs, 5).collect()
    texts = corpus()
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
    again = sharding.assign_shards(docs.repartition(7), 5).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.assign_shards(none).count() == 0 and sharding.assign_shards(odd).count() == 5


def brute_components(fps):
    best = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    return best


def test_simhash(docs, none, odd):
    fps = {}
    for i, t in enumerate(corpus()):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        s = [" ".join(w[a : a + 3]) for a in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(odd).count() == 5
    assert simhash.representatives(docs).columns == COLUMNS


def test_similar_texts_leave_one_of_a_group(spark, docs):
    """Against brute force: edits of one base are one group at a Jaccard similarity of 0.8 on five-word shingles."""
    r, rows = random.Random(9), []
    for base in range(25):
        text = [f"w{r.randrange(4000)}" for _ in range(r.randint(60, 400))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(base % 4):
            edited = list(text)
            for at in r.sample(range(len(text)), r.randint(1, 3 + len(text) // 40)):
                edited[at] = f"x{r.randrange(9999)}"
            rows.append((len(rows), " ".join(edited)))
    rows += [(100 + i, t) for i, t in enumerate((None, "", " ", "one two", "one  two", "one three"))]
    sets = {i: set(map(int, simhash.shingle_hashes((t or "").encode().split(), 5))) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {x.doc_id for x in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {find(i) for i in root}
    assert simhash.representatives(docs).columns == COLUMNS and simhash.representatives(docs.limit(0)).count() == 0


def test_similar_texts_link_through_any_member(spark):
    """A template whose 1,000 edits are strangers to each other, and a chain of edits, are one group each."""
    r = random.Random(11)

    def edit(text):
        new = list(text)
        for at in range(r.randrange(5, 45), 200, 50):
            new[at] = f"x{r.randrange(10**9)}"
        return new

    template, chain = ([f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(2))
    texts = [template, *(edit(template) for _ in range(1000)), chain]
    for _ in range(40):
        texts.append(edit(texts[-1]))
    sets = [set(zip(t, t[1:], t[2:], t[3:], t[4:], strict=False)) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(0, i) >= 0.8 for i in range(1, 1001)) and all(like(i, i + 1) >= 0.8 for i in range(1001, 1041))
    assert sum(like(i, i + 1) < 0.8 for i in range(1, 1000)) > 800
    kept = simhash.representatives(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1001]


def test_dense_cells_keep_every_link(spark):
    """A cell too full to pair up is solved by bridges, with the same components."""
    r = random.Random(5)
    base, fps = r.getrandbits(64), set()
    while len(fps) < 150:
        fps.add(base ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 5))))
    fps |= {r.getrandbits(64) for _ in range(30)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    found = components(simhash.hamming_edges(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    roots = {r.node: r.root for r in found}
    want = brute_components({f: f & (2**64 - 1) for f in signed})
    same = lambda m: {frozenset(x for x in signed if m.get(x, x) == k) for k in {m.get(x, x) for x in signed}}
    assert same(roots) == same(want)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_suffixes(docs, none, odd):
    seen, want = {}, {}
    for i, t in enumerate(corpus()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).digest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).digest()) for r in suffixes.suffix_dedup(docs).collect()}
    assert got == want
    assert suffixes.suffix_dedup(none).count() == 0 and {r.n_removed for r in suffixes.suffix_dedup(odd).collect()} == {0}


def test_hidden_markov(docs, none, odd):
    texts = corpus()
    tokens = {i: [*hmm.tokens(t), hmm.END] for i, t in enumerate(texts)}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in hmm.score(docs).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert hmm.score(none).count() == 0 and hmm.score(odd).count() == 5


def test_forward_and_expected_counts_are_exact_over_cuts(monkeypatch):
    """Against sums over all paths, and, for texts of many segments, against the plain recursions on the whole text."""
    r = np.random.default_rng(0)
    m = hmm.Model(np.ones(6 + hmm.CLASSES))
    m.start = r.dirichlet(np.ones(hmm.STATES))
    text = r.integers(0, 6, 3)
    total = 0.0
    for path in np.ndindex(*[hmm.STATES] * 3):
        p = m.start[path[0]] * m.emit[text[0], path[0]]
        for a, b, s in zip(path, path[1:], text[1:], strict=False):
            p *= m.move[a, b] * m.emit[s, b]
        total += p
    assert math.isclose(m.log10(np.array([3]), m.emit[text])[0], math.log10(total), rel_tol=1e-9)

    monkeypatch.setattr(hmm, "SEGMENT", 5)
    monkeypatch.setattr(hmm, "TOGETHER", 4)
    texts = [r.integers(0, 6, n) for n in (1, 5, 6, 23, 11, 40, 4)]
    sizes, ids = np.array([len(t) for t in texts]), np.concatenate(texts)
    into, want, logs, states = m.none(), m.none(), [], []
    for t in texts:
        e = m.emit[t]
        alpha, beta, log = np.empty((len(t), hmm.STATES)), np.ones((len(t), hmm.STATES)), 0.0
        for i in range(len(t)):
            alpha[i] = (alpha[i - 1] @ m.move if i else m.start) * e[i]
        for i in range(len(t) - 2, -1, -1):
            beta[i] = m.move @ (e[i + 1] * beta[i + 1])
        log = alpha[-1].sum()
        gamma = alpha * beta / log
        logs.append(math.log10(log))
        states.append(gamma)
        want[-1] += gamma[0]
        for i, s in enumerate(t):
            want[s] += gamma[i]
            if i:
                want[-hmm.STATES - 1 : -1] += alpha[i - 1][:, None] * m.move * (e[i] * beta[i]) / log
    got = m.expected(sizes, m.emit[ids], ids, into)
    assert np.allclose(into, want) and np.allclose(got, np.concatenate(states)) and np.allclose(m.log10(sizes, m.emit[ids]), logs)
    long = r.integers(0, 6, 3000)
    assert np.isfinite(m.log10(np.array([3000]), 1e-12 * m.emit[long])).all()


def test_training_helps():
    m = hmm.Model(np.ones(6 + hmm.CLASSES))
    texts = [np.tile([0, 1, 2, 3], 40), np.tile([4, 5], 30)]
    sizes, ids = np.array([len(t) for t in texts]), np.concatenate(texts)
    was = m.log10(sizes, m.emit[ids]).sum()
    for _ in range(20):
        into = m.none()
        m.expected(sizes, m.emit[ids], ids, into)
        m.update(into)
    assert m.log10(sizes, m.emit[ids]).sum() > was + 10 and np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_rare_tokens_have_emissions_of_their_own(docs, monkeypatch):
    """With a vocabulary of 20 tokens nearly all are in the table: base columns stay exact, and so do the table's counts."""
    plain = {r.doc_id: r for r in hmm.score(docs).collect()}
    monkeypatch.setattr(hmm, "VOCABULARY", 20)
    got = {r.doc_id: r for r in hmm.score(docs).collect()}
    assert all((r.n_known, r.n_tokens) == (plain[i].n_known, plain[i].n_tokens) and math.isclose(r.base_score, plain[i].base_score, rel_tol=1e-9) for i, r in got.items())
    again = {r.doc_id: r.score for r in hmm.score(docs.repartition(7)).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-3) for i, r in got.items())  # states are kept in a byte each


def test_decontamination(spark, docs, none, odd):
    texts = corpus()
    item = " ".join(words(texts[20])[5:35])
    short = "Tick, TOCK tick"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, short), (5, "words that are not in any text at all here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(20, 1), (44, 4)}
    kept = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {20, 44} and kept.columns == COLUMNS
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.decontaminate(odd, bench).count() == 5
    assert decontaminate.decontaminate(odd, bench.where("false")).count() == 5


def test_near_windows_are_all_found():
    """Items of 40 to 200 words with words replaced, put into other words: all that stay at 0.8 by brute force are found."""
    r = random.Random(3)
    items = [[f"w{r.randint(0, 999)}".encode() for _ in range(r.randint(40, 200))] for _ in range(200)]
    index = decontaminate.Index(list(enumerate(items)))
    bag, wanted = lambda w: Counter(zip(*(w[i:] for i in range(5)), strict=False)), 0
    for n, item in enumerate(items):
        changed = list(item)
        for at in r.sample(range(len(item)), r.randint(0, len(item) // 40)):
            changed[at] = b"other"
        a, b = bag(item), bag(changed)
        same = (a & b).total() / (a | b).total()
        found = index.matches(" ".join(x.decode() for x in [b"x", b"y", *changed, b"z"]))
        assert [f[0] for f in found] == ([n] if same >= 0.8 else [])
        wanted += same >= 0.8
        if found:
            assert found[0][1] == 2 and math.isclose(found[0][2], same)
    assert wanted > 100
    many = set(range(len(items)))
    index.flips, few = index.flips, [index.near(fp, {n}) for n, fp in enumerate(index.fps)]
    assert all((n, 0) in index.near(fp, many) and few[n] == [(n, 0)] for n, fp in enumerate(index.fps))


def test_index_and_comparison_agree(monkeypatch):
    r = random.Random(4)
    index = decontaminate.Index([(i, [f"w{r.randint(0, 60)}".encode() for _ in range(30)]) for i in range(400)])
    every = set(range(400))
    for fp in index.fps[:20]:
        by_index = index.near(fp, every)
        assert by_index == [(n, (fp ^ f).bit_count()) for n, f in enumerate(index.fps) if (fp ^ f).bit_count() <= decontaminate.RADIUS]


def test_extra_columns_of_any_name_pass_through(spark):
    """Columns that are called as an operator's own ones might be come back as they were."""
    names = ["_row", "_key", "_score", "_span_cut", "_span_gone", "key", "doc", "cut", "gone", "node", "root", "h"]
    text = "One sentence is here for a start. " * 2 + "Another of them follows, it has more words. And a third one ends it at last."
    rows = [(i, f"{text} {i * 7919} {'abc ' * i}", *[f"{n}{i}" for n in names]) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, "nothing of this is anywhere")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    for out in (decontaminate.decontaminate(d, bench), simhash.representatives(d), spans.substring_dedup(d, counts=False), toxicity.ordinary(d, labels)):
        assert out.columns == d.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def brute_kneser_ney(rows):
    """The models of toxicity in plain Python: per class {(u, v): p} for all u and v seen, and the shared unigrams."""
    tri = [{x for t, y in rows if y == c for w in [toxicity.tokens(t)] for x in zip([b"", b"", *w], [b"", *w], w, strict=False)} for c in (0, 1)]
    sizes = Counter(y for _, y in rows)
    scale = [min(sizes.values()) / sizes[c] for c in (0, 1)]
    pair = [{k: n * scale[c] for k, n in Counter((u, v) for _, u, v in tri[c]).items()} for c in (0, 1)]
    uni = [{k: n * scale[c] for k, n in Counter(v for _, v in {(u, v) for _, u, v in tri[c]}).items()} for c in (0, 1)]
    take = lambda n, m, d: min(n, d + toxicity.COMMON * min(n, m))
    words = set(uni[0]) | set(uni[1])
    taken = [{v: take(uni[c].get(v, 0), uni[1 - c].get(v, 0), toxicity.WORD_DISCOUNT) for v in words} for c in (0, 1)]
    both = sum(sum(x.values()) for x in taken)
    total = [sum(x.values()) for x in uni]
    shared = {v: (taken[0][v] + taken[1][v]) / both for v in words}
    low = [{v: (uni[c].get(v, 0) - taken[c][v]) / total[c] + sum(taken[c].values()) / total[c] * shared[v] for v in words} for c in (0, 1)]
    out = []
    for c in (0, 1):
        left = {k: n - take(n, pair[1 - c].get(k, 0), toxicity.PAIR_DISCOUNT) for k, n in pair[c].items()}
        of = Counter()
        for (u, _), n in pair[c].items():
            of[u] += n
        back = {u: 1 - sum(n for (x, _), n in left.items() if x == u) / of[u] for u in of}
        out.append(lambda u, v, c=c, left=left, of=of, back=back: (left.get((u, v), 0) / of[u] if u in of else 0) + back.get(u, 1) * low[c][v])
    return out, words, {u for u, _ in set(pair[0]) | set(pair[1])}


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Every conditional sums to one, and the evidence of every text is that of the models written out in full."""
    monkeypatch.setattr(toxicity, "WORD_DISCOUNT", 1.0)
    monkeypatch.setattr(toxicity, "PAIR_DISCOUNT", 1.0)
    r = random.Random(6)
    rows = [(i, " ".join(r.choices("abcdefgh", k=12) + (["vile", "scum"] * 2 if i % 4 == 0 else [])), int(i % 4 == 0), 1 if i % 3 else 0) for i in range(80)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int, part int")
    kn, _ = toxicity.fit(sample.drop("doc_id"), -1.0)
    p, words, contexts = brute_kneser_ney([(t, y) for _, t, y, part in rows if part == 1])
    for c in (0, 1):
        assert all(math.isclose(sum(p[c](u, v) for v in words), 1, rel_tol=1e-9) for u in contexts)
        seen = kn.low[2 : 2 + sum(w in kn.ids for w in words), c].sum()
        assert math.isclose(seen + kn.gamma[c] * kn.rest, 1, rel_tol=1e-9)
    assert len(kn.pairs) and kn.back.min() < 1
    for _, t, _, _ in rows:
        w = toxicity.tokens(t)
        if set(w) <= words:
            want = sum(math.log(p[1](u, v) / p[0](u, v)) for u, v in zip([b"", *w], w, strict=False))
            assert math.isclose(kn.evidence(w)[0], want / len(w), rel_tol=1e-9, abs_tol=1e-12)


def test_language(docs, none, odd):
    assert langid.op8_language_id is not None
    got = {r.doc_id: r._lang for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[40].lang == got[41].lang == got[42].lang == "und" and all(0 <= x.score <= 1 for x in got.values())
    assert langid.predict(none, langid.fit(none)).count() == 0
    t = "der die das und nicht", "the and of to in"
    model = langid.fit(docs.sparkSession.createDataFrame([(i, t[i % 2] * 3, "de" if i % 2 == 0 else "en") for i in range(200)], "doc_id long, text string, lang string"))
    out = langid.predict(docs.sparkSession.createDataFrame([(1, "und das"), (2, "the of and")], "doc_id long, text string"), model)
    assert {r.doc_id: r._lang.lang for r in out.collect()} == {1: "de", 2: "en"}


def test_pieces_equal_the_library_and_round_trip(docs, none):
    import sentencepiece

    p, library = pieces.Pieces(pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in corpus() if t and "▁" not in t] + ["Hello   world\n\n tab\there", "가나다 日本語 🙂 naïve", " lead and trail  ", "x" * 500]
    for t, ids in zip(texts, p.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t) and p.decode(ids.tolist()) == t
    odd = ["▁▁a ▁ b", "\x00\x01", "▁"]
    assert [p.decode(i.tolist()) for i in p.encode(odd)] == odd
    rows = {r.doc_id: r for r in pieces.encoded(docs).collect()}
    assert rows[40].ids is None and rows[41].ids == [] and all(r.exact in (True, None) for r in rows.values())
    assert pieces.encoded(none).count() == 0 and pieces.with_ids(docs).count() == len(corpus())


def test_toxicity(spark, docs, none, odd):
    r = random.Random(2)
    plain = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(600):
        w = r.choices(plain, k=60)
        if i % 5 == 0:
            w[10:14] = ["vile", "scum", "vile", "scum"]
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.labelled_sample(d, labels, 1000))
    scored = toxicity.score(d, model).collect()
    assert sum((r._score >= 0.5) == (r.doc_id % 5 == 0) for r in scored) >= 590
    assert toxicity.score(odd, model).count() == 5 and toxicity.score(none, model).count() == 0
    assert toxicity.fit(*toxicity.labelled_sample(d, labels.where("toxic = 0"), 1000)) is None
