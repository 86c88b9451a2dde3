"""Op 11. Order-preserving packing of documents into token sequences by dynamic programming.

The documents of an input partition form one stream of tokens, in the order in which they are read
(``pack`` takes columns to order by first). Windows of the stream become sequences. They may end
after a document, after a sentence, or, where a sentence has more than GAP tokens (and at the end of
the stream, so that its last windows come out even), anywhere else at a price. The cuts chosen
minimise padding plus truncation penalties: a window of L tokens is padded to WIDTH unless L is a
power of two, and a cut costs 0 after a document, IN_DOCUMENT after a sentence in it, IN_SENTENCE
elsewhere; every window costs PER_WINDOW more, so that many tiny powers of two are not free.

With ``cost(j)`` the least cost of packing the first ``b[j]`` tokens, a padded window from i to j
costs ``cost(i) + WIDTH - (b[j] - b[i])``, so the best i is the least ``cost(i) + b[i]`` among those
within WIDTH: a monotone queue gives it in constant amortised time. Windows of a power of two are at
most 12 more transitions. Costs are solved exactly over stretches of STRETCH tokens; the windows up
to the cheapest state in the last WIDTH tokens stand, and what is behind it begins the next stretch,
so memory does not grow with the partition or with a document.

No row is shuffled: a sequence holds tokens of one partition, and its number is the partition's,
then its own. A null text is empty and has the end token only; empty texts likewise; long texts
are packed whole, over as many windows as they need; repeated rows are packed each; between equal costs the longer last window wins; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from json import loads

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.common import table

END = 1
WIDTH, STRETCH = 2048, 1 << 20
IN_DOCUMENT, IN_SENTENCE, PER_WINDOW = 16, 96, 4
#: Sentences of more than GAP tokens may be cut every STEP tokens.
GAP, STEP = 256, 64
#: Characters of the texts that are tokenised at once; one text may be longer.
BATCH = 1 << 20
PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: After these a sentence may end; the token behind must begin with a blank, as words do.
ENDS = re.compile(r"[.!?…。！？][\"')\]»”’]*$")


#: Fixed value: the word rule of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(file: dict) -> dict[bytes, int] | None:
    """The tokens of a plain byte-level BPE as bytes -> id; None for any other file."""
    kind, model = file.get("pre_tokenizer") or {}, file["model"]
    if (kind.get("type"), kind.get("add_prefix_space"), kind.get("use_regex", True), file.get("normalizer"), model.get("type")) != ("ByteLevel", False, True, None, "BPE"):
        return None
    ids = model["vocab"]
    made = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made) or len(ids) != 256 + len(made) or model.get("ignore_merges") or model.get("dropout"):
        return None
    # bytes that print stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)).difference(shown)))}
    return {bytes(byte[c] for c in name): i for name, i in ids.items() if i not in {t["id"] for t in file.get("added_tokens") or ()}}


class Tokens:
    """The tokenizer of a JSON file, and which of its tokens can end a sentence or stand behind one."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_str(json)
        self.model.encode_special_tokens = True  # their names in a text are text
        known = ranks(loads(json))
        self.fast = known and tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=known, special_tokens={})
        said = [self.model.decode([i], skip_special_tokens=False) for i in range(self.model.get_vocab_size())]
        self.line = np.array([s.endswith("\n") for s in said])
        self.last = np.array([bool(ENDS.search(s)) for s in said])
        self.first = np.array([s[:1].isspace() for s in said])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end token."""
        return [np.append(self.ids(t), np.uint32(END)) for t in texts]

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its word rule needs more stack than it has
                pass
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def cuts(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens of a document (its end token included) after which a sentence ends."""
        own = ids[:-1]
        places = np.flatnonzero(self.line[own[:-1]] | (self.last[own[:-1]] & self.first[own[1:]])) + 1
        return places.astype(np.int64)


def spread(bounds: np.ndarray, gap: int, step: int) -> np.ndarray:
    """Places between bounds that are more than gap apart, every step tokens."""
    wide = np.flatnonzero(np.diff(bounds) > gap)
    return np.concatenate([np.empty(0, np.int64), *(np.arange(bounds[i] + step, bounds[i + 1], step) for i in wide)])


def windows(b: np.ndarray, price: np.ndarray, width: int, closed: bool) -> list[int]:
    """Places in b (b[0] = 0, ascending, no gap over width) where the windows of least cost end.

    closed: the last window ends at b[-1]; else the windows end at the cheapest state in the last
    ``width`` tokens.
    """
    n, even = len(b), {}
    short = [1 << k for k in range(width.bit_length()) if 1 << k <= width]
    for p in short:
        at = np.searchsorted(b, b - p)
        for j in np.flatnonzero((b >= p) & (b[at] == b - p)).tolist():
            even.setdefault(j, []).append(int(at[j]))
    place, toll = b.tolist(), (price + PER_WINDOW).tolist()
    cost, back, queue = [0.0] * n, [0] * n, deque([0])
    level = [0.0] * n  # cost(i) + b[i]
    for j in range(1, n):
        here = place[j]
        while place[queue[0]] < here - width:
            queue.popleft()
        i = queue[0]
        best = level[i] + width - here
        for k in even.get(j, ()):
            if cost[k] < best or (cost[k] == best and k < i):
                best, i = cost[k], k
        cost[j], back[j] = best + toll[j], i
        level[j] = cost[j] + here
        while queue and level[queue[-1]] > level[j]:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not closed:
        j = min(range(max(1, int(np.searchsorted(b, b[-1] - width, "right"))), n), key=lambda x: (cost[x], -x))
    ends = []
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


class Packer:
    """One stream: documents go in, pieces (document, start, ids, its tokens, sequence, offset) come out."""

    def __init__(self, width: int = WIDTH, stretch: int = STRETCH):
        self.width, self.stretch, self.sequence = width, max(stretch, 4 * width), 0
        self.held: list[tuple] = []  # (document, its tokens, start, ids, places of sentence ends in ids)
        self.size = 0

    def add(self, doc, ids: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.stretch):  # a long document enters in parts
            part = ids[at : at + self.stretch]
            self.held.append((doc, len(ids), at, part, cuts[(cuts > at) & (cuts < at + len(part))] - at))
            self.size += len(part)
            if self.size >= self.stretch:
                yield from self.flush(False)

    def bounds(self, closed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may end in what is held, and the price of each place."""
        none, middle, after, free, at = np.empty(0, np.int64), [], [0], [], 0
        for _, tokens, start, ids, cuts in self.held:
            middle.append(cuts + at)
            at += len(ids)
            (after if start + len(ids) == tokens else free).append(at)
        sentences = np.concatenate([none, *middle])
        fixed = np.unique(np.concatenate([sentences, after, free]).astype(np.int64))
        tail = np.arange(max(1, at - 2 * self.width), at) if closed else none
        b = np.unique(np.concatenate([fixed, spread(fixed, min(GAP, self.width), min(STEP, self.width)), tail]))
        price = np.full(len(b), IN_SENTENCE)
        price[np.searchsorted(b, sentences)] = IN_DOCUMENT
        price[np.searchsorted(b, np.array(after))] = 0
        return b, price

    def flush(self, closed: bool) -> Iterator[tuple]:
        """The pieces of the windows that stand now; closed: of all that is held."""
        if not self.held:
            return
        b, price = self.bounds(closed)
        first, at, k = 0, 0, 0  # of the window, of the held part
        for end in b[windows(b, price, self.width, closed)].tolist():
            now = first
            while now < end:
                doc, tokens, start, ids, _ = self.held[k]
                to = min(end, at + len(ids))
                yield doc, start + now - at, ids[now - at : to - at], tokens, self.sequence, now - first
                if to == at + len(ids):
                    at, k = to, k + 1
                now = to
            first = end
            self.sequence += 1
        left, cut = self.held[k:], first - at
        if cut:
            doc, tokens, start, ids, cuts = left[0]
            left[0] = (doc, tokens, start + cut, ids[cut:], cuts[cuts > cut] - cut)
        self.held, self.size = left, sum(len(x[3]) for x in left)


_READY: dict[int, Tokens] = {}


def ready(json: str) -> Tokens:
    """One instance a Python worker."""
    key = hash(json)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Tokens(json)
    return _READY[key]


def pack(docs: DataFrame, path: str, width: int = WIDTH, order: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: see PIECES; with ``order`` the stream is sorted by these columns first."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        json = spark.sparkContext.broadcast(f.read())
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, base, ids_type = ready(json.value), Packer(width), TaskContext.get().partitionId() << 40, None
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [ids_type, *[pa.int64()] * 6], strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        def keep(pieces: Iterator[tuple]) -> None:
            for doc, start, ids, n, sequence, offset in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, base + sequence, offset))

        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            docs_here, texts, at = batch.column("doc_id").to_pylist(), batch.column("text"), 0
            while at < len(docs_here):
                some, size, begin = [], 0, at
                while at < len(docs_here) and (not some or size < BATCH):
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                for doc, ids in zip(docs_here[begin:at], tokens.encode(some), strict=True):
                    keep(packer.add(doc, ids, tokens.cuts(ids)))
                if len(out) > 20_000:
                    yield told()
        if ids_type is not None:
            keep(packer.flush(True))
            yield told()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
