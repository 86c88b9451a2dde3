"""Op 9. SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text gets its word mark (blanks become marks, one is put in front) and falls into marked words:
no piece of the vocabulary goes past a word's first marks, so words are encoded apart. The distinct
marked words of a block of texts are sorted, which lays them out as a trie in depth-first order, and
a forward table is kept along the current path: a word reuses the scores of the prefix that it
shares with the word before.

The vocabulary file holds a merge-ranked model, whose encoding is not the path of the best summed
score. So the forward score of a prefix is the last piece of its one encoding: a piece may end a
prefix only if the merge order leaves it and the piece before it apart, and exactly one does. The
result equals the model's own encoding; each pair of pieces is judged once and kept in a cache.

Characters without a piece become byte pieces; a literal mark (U+2581) in a text is written as bytes
too, so decoding always gives back the text. Null texts have null ids; empty texts have none; very
long texts are encoded whole; repeated rows are encoded alike; an empty table gives no rows; the
file's path is a parameter, and its content goes to the executors with the job.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bounds of a task's caches: they are emptied when full, which changes no result.
WORDS_KEPT, PAIRS_KEPT = 150_000, 500_000
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NEVER = float("-inf")
#: Stands for a literal mark of the text while words are cut; not a valid character of one.
LITERAL = "\udc81"


class Pieces:
    """One vocabulary: encoding of marked words, and decoding."""

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if model.is_byte(i)}
        usable = [i for i in range(len(self.names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.names[i]: i for i in usable}
        self.score = {self.names[i]: model.get_score(i) for i in usable}
        self.whole_words = all(MARK not in p.lstrip(MARK) for p in self.ids)
        # pieces by their reversed text, as a trie of dictionaries; key "" holds the piece
        self.ends: dict = {}
        for p in self.ids:
            node = self.ends
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[""] = p
        self.apart: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, tuple] = {}
        self.words: dict[str, bytes] = {}

    def steps(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """The model's rule on one piece alone: join the neighbours whose joint piece scores best, leftmost first.

        Gives each step's score, the first and the last part before each step and after all, and
        whether one part is left.
        """
        found = self.alone.get(piece)
        if found is None:
            parts, score, scores, first, last = list(piece), self.score, [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                best, at = max(((score.get(parts[i] + parts[i + 1], _NEVER), -i) for i in range(len(parts) - 1)))
                if best == _NEVER:
                    break
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            found = self.alone[piece] = ([*scores, _NEVER], first, last, len(parts) == 1)
        return found

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the rule, run on a and b together, never joins parts across their border.

        Until it does, either side goes through its own steps, the better score first.
        """
        a_scores, _, a_last, a_whole = self.steps(a)
        b_scores, b_first, _, b_whole = self.steps(b)
        if not (a_whole and b_whole):
            return False
        get, i, j = self.score.get, 0, 0
        while True:
            left, right = a_scores[i], b_scores[j]
            across = get(a_last[i] + b_first[j], _NEVER)
            if across > left and across >= right and across != _NEVER:
                return False
            if left >= right:
                if left == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def learn(self, words: list[str]) -> None:
        """Encode distinct words, sorted: depth-first over their trie."""
        ends, apart, last, before = self.ends, self.apart, [""], ""  # last[i]: the piece that ends the prefix of i characters
        if len(apart) > PAIRS_KEPT:
            apart.clear()
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared, len(word)):
                node, j, fit = ends.get(word[i]), i, []
                while node is not None:
                    if "" in node:
                        fit.append(node[""])
                    j -= 1
                    if j < 0:
                        break
                    node = node.get(word[j])
                got = word[i]
                for piece in reversed(fit):
                    j = i + 1 - len(piece)
                    if j:
                        pair = last[j], piece
                        ok = apart.get(pair)
                        if ok is None:
                            ok = apart[pair] = self.stay_apart(*pair)
                    else:
                        ok = self.steps(piece)[3]
                    if ok:
                        got = piece
                        break
                last.append(got)
            before = word
            out, i = [], len(word)
            while i:
                piece = last[i]
                out.append(piece)
                i -= len(piece)
            self.words[word] = self.numbers(out[::-1])

    def numbers(self, parts) -> bytes:
        ids: list[int] = []
        for p in parts:
            n = self.ids.get(p)
            if n is not None:
                ids.append(n)
            else:
                raw = MARK.encode() if p == LITERAL else p.encode("utf-8", "surrogatepass")
                ids.extend(self.bytes[b] for b in raw)
        return array("i", ids).tobytes()

    def marked(self, text: str) -> list[str]:
        return WORD.findall((" " + text).replace(MARK, LITERAL).replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.marked(t) if t else [] for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        new = set().union(*cut)
        new.difference_update(self.words)
        self.learn(sorted(new))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]

    def decode(self, ids) -> str:
        """Pieces joined; runs of byte pieces are UTF-8; marks are blanks, and the one in front goes."""
        if not hasattr(self, "raw"):
            back = {i: bytes([b]) for b, i in self.bytes.items()}
            self.raw = [back.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_READY: dict[int, Pieces] = {}


def ready(proto: bytes) -> Pieces:
    """One instance a Python worker."""
    key = hash(proto)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Pieces(proto)
    return _READY[key]


BLOCK = 512


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>, exact boolean: decoding gives the text back)."""
    proto = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ready(proto.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                texts = batch.column("text").to_pylist()
                ids = pieces.encode(texts)
                exact = [None if t is None else pieces.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
                column = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()),
                    mask=pa.array([t is None for t in texts]),
                )
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(exact, pa.bool_())], ["doc_id", "ids", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, exact boolean")


def with_ids(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with every column, ``ids`` and ``n_ids`` added (columns of these names are replaced)."""
    proto = docs.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = ready(proto.value)
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), BLOCK):
                block = [None if t is None or t != t else t for t in texts.iloc[at : at + BLOCK]]
                out += [None if t is None else i for t, i in zip(block, pieces.encode(block), strict=True)]
            yield pd.Series(out, dtype=object)

    return docs.withColumn("ids", encode("text")).withColumn("n_ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir)).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.col("exact").alias("round_trip")
    )
