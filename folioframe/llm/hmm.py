"""Op 6. A hidden Markov language model.

Every token of the training corpus has emission probabilities of its own in each state. Those of the
VOCABULARY most frequent are held by every task; all others stay in a table, one row a token, that is
joined to the documents in each pass and replaced by the pass's expected counts: it grows with the
corpus and is never broadcast or collected. A token of the table emits as its class (CLASSES, by
length and final punctuation) does, times its share of the class in that state,
(expected count + OWN * (c + 1) / (N_class + V_class + 1)) / (class's expected count + OWN), which
leaves unseen tokens a share, too.

Baum-Welch counts of whole texts are gathered from every training document in PASSES passes and
summed across partitions. Long texts are cut into segments so that many advance side by side, and the
segments' transfer matrices carry the forward and the backward state over the cuts: results are those
of the whole sequence. The passes start from a model fitted on the driver to START documents, drawn
by hash of doc_id and text. The scaled forward recursion then gives the exact log10 probability of
every whole text.

Null and empty texts are one end token; repeated rows are scored each and teach each; null doc_ids
teach as the empty id; with no training document all counts are 0, base and score are those of
unknown tokens; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import LOWER, crc_mod, drop_stage, stage, table, text_bytes

STATES = 8
VOCABULARY = 100_000
CLASSES = 12
#: What a token's corpus count weighs beside its expected count in a state.
OWN = 0.5
#: Hashes of rare tokens that a task holds before it sends their counts.
SENT = 300_000
START, START_STEPS, START_TOKENS = 600, 12, 400_000
PASSES = 2
#: Symbols that one segment holds, segments that advance together, and symbols that are held at a time.
SEGMENT, TOGETHER, HELD = 1024, 512, 400_000
#: The end of a text, which no word can be, and its symbol.
END = b" "
STOPS = b".,!?;:"
_K = [f"k{k}" for k in range(STATES)]


def tokens(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(LOWER).split()


def rare_class(word: bytes) -> int:
    return min(len(word) // 4, CLASSES // 2 - 1) * 2 + (word[-1] in STOPS)


def token_counts(training: DataFrame) -> DataFrame:
    """(w binary, c long): tokens of all training texts; partial counts leave a task once, not once a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["w", "n"])
        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > 500_000:
                    yield rows()
                    seen.clear()
        yield rows()

    return training.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


class Model:
    """start (K), move (K, K) and emit (symbols, K), columns summing to 1; symbols: the end, frequent tokens, then classes."""

    def __init__(self, frequency: np.ndarray, seed: int = 6):
        rng = np.random.default_rng(seed)
        # each class counts one more in the corpus, for tokens that it has not seen
        self.new = np.zeros((len(frequency), 1))
        self.new[-CLASSES:, 0] = 1 / max(frequency.sum(), 1) / STATES
        p = (frequency + 0.1) / (frequency + 0.1).sum()
        self.start = np.full(STATES, 1 / STATES)
        self.move = rng.dirichlet(np.full(STATES, 5.0), STATES)
        self.emit = p[:, None] * rng.uniform(0.5, 1.5, (len(p), STATES))
        self.emit /= self.emit.sum(axis=0)
        self.base = p[:, None]
        self.seen: np.ndarray | None = None  # expected counts of the classes' tokens that the table holds

    def none(self) -> np.ndarray:
        return np.zeros((len(self.base) + STATES + 1, STATES))

    def update(self, counts: np.ndarray) -> None:
        """counts: (symbols + STATES + 1, STATES): emissions, then moves by row, then starts.

        A pseudo-count in proportion to corpus frequency keeps every symbol possible in every state.
        """
        emit = counts[: -STATES - 1] + 5.0 * self.base + self.new * counts[: -STATES - 1].sum()
        self.emit = emit / emit.sum(axis=0)
        move = counts[-STATES - 1 : -1] + 0.1
        self.move = move / move.sum(axis=1, keepdims=True)
        start = counts[-1] + 0.1
        self.start = start / start.sum()

    def expected(self, sizes: np.ndarray, e: np.ndarray, ids: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Add the Baum-Welch counts of texts laid end to end to into; returns each symbol's state probabilities.

        A factor of a symbol that all states share changes nothing, so e may be scaled to fit its type.
        """
        cut = Segments(self, sizes, e)
        begin, finish = (x.astype(e.dtype) for x in cut.carried())
        out, moves, move, start = np.empty_like(e), np.zeros((STATES, STATES)), cut.move, cut.start
        back_move = np.ascontiguousarray(move.T)
        for group in cut.groups():
            place, live = cut.laid(group)
            first, n, size = cut.first[group], len(group), len(live)
            ge = e[np.minimum(place, len(e) - 1)]
            alpha, scale = np.empty_like(ge), np.empty((size, n, 1), e.dtype)
            a = np.where(first[:, None], start, begin[group] @ move) * ge[0]
            for t in range(size):
                if t:
                    a = (a[: live[t]] @ move) * ge[t, : live[t]]
                scale[t, : live[t]] = s = a.sum(axis=1, keepdims=True)
                a = a / s
                alpha[t, : live[t]] = a
            beta, known = np.empty((n, STATES), e.dtype), 0
            for t in range(size - 1, -1, -1):
                now = live[t]
                if now > known:
                    last = finish[group[known:now]]
                    beta[known:now] = last / (alpha[t, known:now] * last).sum(axis=1, keepdims=True)
                    known = now
                back = ge[t, :now] * beta[:now] / scale[t, :now]
                out[place[t, :now]] = alpha[t, :now] * beta[:now]
                before = alpha[t - 1, :now] if t else np.where(first[:, None], e.dtype.type(0), begin[group])
                moves += before.T @ back
                beta[:now] = back @ back_move
        for k in range(STATES):
            into[: -STATES - 1, k] += np.bincount(ids, weights=out[:, k], minlength=len(into) - STATES - 1)
        into[-STATES - 1 : -1] += moves * self.move
        into[-1] += out[np.cumsum(sizes) - sizes].sum(axis=0)
        return out

    def log10(self, sizes: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Exact log10 probability of each of the texts laid end to end, by the scaled forward recursion."""
        cut = Segments(self, sizes, e)
        cut.carried(backward=False)
        return cut.logs / np.log(10)


class Segments:
    """Texts laid end to end, cut into segments, and what passes over the cuts."""

    def __init__(self, model: Model, sizes: np.ndarray, e: np.ndarray):
        self.move, self.start, self.e = model.move.astype(e.dtype), model.start.astype(e.dtype), e
        starts, parts = np.cumsum(sizes) - sizes, -(-sizes // SEGMENT)
        self.text = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = nth == 0
        self.lo = starts[self.text] + nth * SEGMENT
        self.size = np.minimum(SEGMENT, sizes[self.text] - nth * SEGMENT)
        self.logs = np.zeros(len(sizes))

    def groups(self, of: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Segments of about the same size, longest first."""
        some = np.arange(len(self.text)) if of is None else of
        order = some[np.argsort(-self.size[some], kind="stable")]
        for at in range(0, len(order), TOGETHER):
            yield order[at : at + TOGETHER]

    def laid(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(step, segment) -> place in the texts, and how many segments each step has."""
        steps = np.arange(self.size[group[0]])
        return self.lo[group] + steps[:, None], (self.size[group] > steps[:, None]).sum(axis=1)

    def transfer(self, group: np.ndarray, rows: np.ndarray, moved: bool) -> tuple[np.ndarray, np.ndarray]:
        """rows (segment, row, state) carried through their segments, and the logarithms taken out of them."""
        place, live = self.laid(group)
        logs = np.zeros(len(group))
        for t, now in enumerate(live.tolist()):
            x = rows[:now]
            if t or moved:
                x = (x.reshape(-1, STATES) @ self.move).reshape(x.shape)
            x = x * self.e[place[t, :now], None, :]
            if t % 8 == 7 or t + 1 == len(live) or live[t + 1] < now:
                s = x.max(axis=(1, 2))
                logs[:now] += np.log(s)
                x /= s[:, None, None]
            rows[:now] = x
        return rows, logs

    def carried(self, backward: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The forward state before each segment (any for first ones), and the backward state after it."""
        n = len(self.text)
        begin, finish = np.full((n, STATES), 1 / STATES), np.ones((n, STATES))
        alone = np.bincount(self.text, minlength=len(self.logs))[self.text] == 1
        firsts = np.flatnonzero(self.first & ~alone if backward else self.first)
        end, end_logs = np.empty((n, STATES)), np.zeros(n)
        for group in self.groups(firsts):
            rows, logs = self.transfer(group, np.tile(self.start, (len(group), 1, 1)), False)
            end[group], end_logs[group] = rows[:, 0], logs
        later = np.flatnonzero(~self.first)
        through, logs_of, at = np.empty((len(later), STATES, STATES)), np.zeros(len(later)), np.full(n, -1)
        at[later] = np.arange(len(later))
        for group in self.groups(later):
            rows, logs = self.transfer(group, np.tile(np.eye(STATES, dtype=self.e.dtype), (len(group), 1, 1)), True)
            through[at[group]], logs_of[at[group]] = rows, logs
        a = None
        for i in range(n):
            if self.first[i]:
                if backward and alone[i]:
                    continue
                a, log = end[i], end_logs[i]
            else:
                begin[i] = a
                a, log = a @ through[at[i]], logs_of[at[i]]
            s = a.sum()
            a = a / s
            self.logs[self.text[i]] += np.log(s) + log
        for i in later[::-1] if backward else ():
            b = through[at[i]] @ finish[i]
            finish[i - 1] = b / b.sum()
        return begin, finish


def coded(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids: the text's symbols and its end, packed; rare array<long>: distinct hashes of words outside the vocabulary).

    The symbol of such a word is the vocabulary's size, plus its class, plus CLASSES times its place in rare.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, len(shared.value)
        end, press = shared.value[END], zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                ids, rare = [], []
                for text in batch.column("text"):
                    words = tokens(text.as_py())
                    at = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    seen: dict[bytes, int] = {}
                    for i in np.flatnonzero(at < 0).tolist():
                        w = words[i]
                        at[i] = size + rare_class(w) + CLASSES * seen.setdefault(w, len(seen))
                    ids.append(press.compress(np.ascontiguousarray(np.append(at, np.int32(end)).astype("<i4").view(np.uint8).reshape(-1, 4).T)))  # by bytes of one place
                    rare.append(np.array([xxhash.xxh64_intdigest(w, 42) for w in seen], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], ["doc_id", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, rare array<long>")


def unpacked(ids: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


def with_counts(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """rows with ``found``: (place in rare, c, states) of each of its words that the table holds."""
    wanted = rows.select("row", F.posexplode("rare").alias("at", "h"))
    found = stage(wanted.join(rare, "h").groupBy("row").agg(F.collect_list(F.struct("at", "c", "states")).alias("found")), "found")
    return rows.select("doc_id", "held_out", "row", "ids", F.size("rare").alias("n_rare")).join(found, "row", "left").drop("row")


def lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and how many each has (null: none)."""
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Texts:
    """Rows of about HELD symbols: texts laid end to end, and the places of rare words in them."""

    def __init__(self, batch: pa.RecordBatch, texts: list[np.ndarray], known: int):
        self.batch, self.sizes = batch, np.array([len(t) for t in texts])
        self.ids = np.concatenate(texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.flatnonzero(self.ids >= known)
        rest = self.ids[self.at] - known
        self.kind, nth = rest % CLASSES, rest // CLASSES
        self.ids[self.at] = known + self.kind
        self.rare = batch.column("n_rare").to_numpy().astype(np.int64)
        self.entry = np.repeat(np.cumsum(self.rare) - self.rare, np.bincount(np.searchsorted(self.starts, self.at, "right") - 1, minlength=len(texts))) + nth


def chunks(batches: Iterator[pa.RecordBatch], known: int) -> Iterator[Texts]:
    for batch in batches:
        held, size, lo = [], 0, 0
        for i, ids in enumerate(batch.column("ids")):
            held.append(unpacked(ids.as_py()))
            size += len(held[-1])
            if size > HELD:
                yield Texts(batch.slice(lo, i + 1 - lo), held, known)
                held, size, lo = [], 0, i + 1
        if held:
            yield Texts(batch.slice(lo), held, known)


def states_of(packed: np.ndarray) -> np.ndarray:
    """A token's distribution over the states, from one byte each."""
    b = packed.astype("<i8").view(np.uint8).reshape(-1, STATES).astype(float)
    return b / b.sum(axis=1, keepdims=True)


def emissions(texts: Texts, model: Model, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The emission probabilities of each symbol, and the rare words' corpus counts; share: N + V + 1 of each class."""
    e = model.emit[texts.ids]
    c, states = np.zeros(texts.rare.sum()), np.zeros((texts.rare.sum(), STATES))
    items, held = lists(texts.batch.column("found"))
    if len(items):
        to = np.repeat(np.cumsum(texts.rare) - texts.rare, held) + items.field("at").to_numpy()
        c[to] = items.field("c").to_numpy()
        states[to] = states_of(items.field("states").to_numpy())
    own = OWN * ((c[texts.entry] + 1) / share[texts.kind])[:, None]
    if model.seen is not None:
        own = (1 - OWN) * c[texts.entry, None] * states[texts.entry] / np.maximum(model.seen[texts.kind], 1e-9) + own
    e[texts.at] *= own
    return e, c[texts.entry]


def baum_welch(rows: DataFrame, model: Model, known: int, words: bool) -> DataFrame:
    """The expected counts of all rows, summed across partitions: (symbol, at, k0..): one row a symbol, and, if asked, one a hash of a rare word.

    Here a rare word emits as its class does: its share of the class is taken as equal in all states.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        emit = (model.emit / model.emit.max(axis=1, keepdims=True)).astype(np.float32)
        into, held, size = model.none(), [], 0

        def told(symbol: bool, at: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            k = np.round(k * 256) / 256  # few digits are sent in few bytes
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), symbol)), pa.array(at), *[pa.array(k[:, i]) for i in range(STATES)]], ["symbol", "at", *_K])

        def summed(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            once, which = np.unique(h, return_inverse=True)
            return once, np.column_stack([np.bincount(which, weights=k[:, i], minlength=len(once)) for i in range(STATES)])

        for texts in chunks(batches, known):
            gamma = model.expected(texts.sizes, emit[texts.ids], texts.ids, into)
            if words:
                held.append(summed(texts.batch.column("rare").flatten().to_numpy()[texts.entry], gamma[texts.at]))
                size += len(held[-1][0])
                if size > SENT:
                    yield told(False, *summed(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if size:
            yield told(False, *summed(*map(np.concatenate, zip(*held, strict=True))))
        at = np.flatnonzero(into.any(axis=1))
        yield told(True, at, into[at])

    columns = ["ids", F.size("rare").alias("n_rare"), *(["rare"] if words else [])]
    out = rows.select(*columns).mapInArrow(run, "symbol boolean, at long, " + ", ".join(f"{k} double" for k in _K))
    return out.groupBy("symbol", "at").agg(*[F.sum(k).alias(k) for k in _K])


def frequent(counts: DataFrame, most: int) -> list:
    """The tokens above the least count that at most ``most`` tokens reach: found from a histogram, so no task sends more."""
    level = F.floor(F.log2("c") * 64)
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # 64 levels a power of two
    reached, least = 0, None
    for r in sorted(histogram, reverse=True):
        reached += r["n"]
        if reached > most:
            break
        least = r["level"]
    return [] if least is None else sorted(counts.where(level >= least).collect(), key=lambda r: (-r["c"], r["w"]))


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the base and the model's log10 probability of every text, with what they count."""
    held = crc_mod(7) == 2
    counts = stage(token_counts(docs.where(~held)), "tokens")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("w") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = frequent(counts.where(F.col("w") != F.lit(END)), VOCABULARY)
    vocabulary = {END: 0} | {bytes(r["w"]): i + 1 for i, r in enumerate(top)}
    frequency = np.array([ends, *[r["c"] for r in top]], float)
    known = len(vocabulary)
    # training tokens and types of each class of rare words
    least = min((r["c"] for r in top), default=None)
    last = F.hex(F.expr("substring(w, -1, 1)"))
    kind = F.least(F.floor(F.octet_length("w") / 4), F.lit(CLASSES // 2 - 1)) * 2 + last.isin([f"{b:02X}" for b in STOPS]).cast("int")
    # every token of the count of the least frequent one in the vocabulary is in it, too
    others = counts.where((F.col("w") != F.lit(END)) & (F.lit(True) if least is None else F.col("c") < F.lit(least)))
    of_all = {int(r["k"]): (r["n"], r["v"]) for r in others.groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    rare_n, rare_v = (np.array([of_all.get(k, (0, 0))[i] for k in range(CLASSES)], float) for i in (0, 1))
    share = rare_n + rare_v + 1

    rows = stage(coded(docs, vocabulary).withColumns({"held_out": held, "row": F.monotonically_increasing_id()}), "coded")
    training = rows.where(~F.col("held_out"))
    model = Model(np.concatenate([frequency, rare_n]))
    few, seen = [], 0
    drawn = F.xxhash64("doc_id", "ids", "rare")
    for r in training.select("ids", drawn.alias("h")).orderBy("h").limit(START).toLocalIterator():
        ids = unpacked(r["ids"])
        few.append(np.where(ids < known, ids, known + (ids - known) % CLASSES))
        seen += len(few[-1])
        if seen > START_TOKENS:
            break
    if few:
        sizes, ids = np.array([len(t) for t in few]), np.concatenate(few)
        for _ in range(START_STEPS):
            into = model.none()
            model.expected(sizes, model.emit[ids], ids, into)
            model.update(into)
    for turn in range(PASSES if few else 0):
        summed = stage(baum_welch(training, model, known, turn == PASSES - 1), "expected")
        into = model.none()
        for r in summed.where("symbol").collect():  # one row a symbol, whatever the corpus
            into[r["at"]] = r[2:]
        model.update(into)
        if turn < PASSES - 1:
            drop_stage(summed)
    uniform = int.from_bytes(b"\1" * STATES, "little")
    rare = others.select(F.xxhash64("w").alias("h"), kind.alias("kind"), "c")
    if few:
        whole = sum((F.col(k) for k in _K[1:]), F.col(_K[0]))
        packed = F.lit(0).cast("long")
        for i, k in enumerate(_K):
            packed = packed.bitwiseOR(F.shiftleft(F.round(F.col(k) / whole * 255).cast("long"), 8 * i))
        words = summed.where("not symbol").where(whole > 0).select(F.col("at").alias("h"), packed.alias("states"))
        spread = F.coalesce(F.nullif("states", F.lit(0)), F.lit(uniform)).alias("states")
        rare = emitted = stage(rare.join(words, "h", "left").select("h", "kind", "c", spread), "emissions")
        drop_stage(summed)
        drop_stage(counts)
        bytes_of = [F.shiftright("states", 8 * i).bitwiseAND(F.lit(255)) for i in range(STATES)]
        of = [F.sum(F.col("c") * b / sum(bytes_of[1:], bytes_of[0])) for b in bytes_of]
        model.seen = np.zeros((CLASSES, STATES))
        for r in rare.groupBy("kind").agg(*[x.alias(k) for x, k in zip(of, _K, strict=True)]).collect():
            model.seen[int(r["kind"])] = r[1:]
        rare = rare.drop("kind")
    else:
        rare = rare.select("h", "c", F.lit(uniform).alias("states"))

    base_of, there = np.log10(frequency + 1), frequency > 0
    shared = docs.sparkSession.sparkContext.broadcast((model, base_of, there, known, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base_of, there, known, share = shared.value
        of_symbol, is_known = np.append(base_of, np.zeros(CLASSES)), np.append(there, np.zeros(CLASSES, bool))
        for texts in chunks(batches, known):
            e, c = emissions(texts, model, share)
            base, knows = of_symbol[texts.ids], is_known[texts.ids]
            base[texts.at], knows[texts.at] = np.log10(c + 1), c > 0
            yield pa.RecordBatch.from_arrays(
                [texts.batch.column("doc_id"), texts.batch.column("held_out"), pa.array(texts.sizes), pa.array(np.add.reduceat(knows.astype(np.int64), texts.starts)), pa.array(np.add.reduceat(base, texts.starts)), pa.array(model.log10(texts.sizes, e))],
                ["doc_id", "held_out", "n_tokens", "n_known", "counts", "score"],
            )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    known_words = with_counts(rows, rare)
    if few:
        drop_stage(emitted)
    scored = known_words.mapInArrow(run, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, counts double, score double")
    all_types = float(np.log10(n + 1 * (v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("counts") - F.col("n_tokens") * all_types).alias("base_score"), "score",
    )


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir).select("doc_id", "text"))
