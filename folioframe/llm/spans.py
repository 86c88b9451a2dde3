"""Op 1. Substring dedup by sliding sentence spans.

A text is cut into sentences, and these at their commas, semicolons and colons, since passages are
often quoted from the middle of a sentence; a part of over LONG words is also cut after each word
whose CRC-32 is divisible by LONG_CUT. The cuts depend on what is near them alone and keep every
character. At every part starts a run: the shortest of at least SPAN consecutive parts and MIN_WORDS
words. Runs are hashed, the hashes are joined over all documents, and a part goes if some run that
covers it is a repeat that is not the first (in order of doc_id, then position).

Only (hash, doc_id) is shuffled for the search, once per document and hash. The least doc_id of a
hash comes from an aggregate with map-side combining, and the join back has that unique side, so a
passage that a third of the documents share is split by adaptive execution. A document gets the
set of its own repeated hashes, which is never larger than its text. Equal 64-bit hashes are taken
as equal runs.

Null and empty texts have no part and stay as they are; rows with a null doc_id take no part and
are kept whole; rows that share a doc_id count as one document (runs equal between them are not
repeats, those within one row are); very long texts are read whole; an empty table gives no rows;
other columns pass through, whatever their names (without the counts, which have fixed names).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import stage, table

SPAN = 2
MIN_WORDS = 20
LONG, LONG_CUT = 16, 6
#: Every character is in exactly one match.
PART = re.compile(r"[^.!?,;:\n]*[.!?,;:\n]+[ \t\r]*|[^.!?,;:\n]+")
WORD = re.compile(r"\S+\s*")


def parts(text: str) -> list[str]:
    out = []
    for part in PART.findall(text):
        words = WORD.findall(part) if len(part) > 2 * LONG else ()
        if len(words) <= LONG:
            out.append(part)
            continue
        at = 0
        ends = [m.end() for m in WORD.finditer(part) if crc32(m.group().rstrip().lower().encode("utf-8", "surrogatepass")) % LONG_CUT == 0]
        for end in [*ends, len(part)]:
            if end > at:
                out.append(part[at:end])
                at = end
    return out


def runs(cut: list[str], span: int = SPAN, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(hash, end) of the run that starts at each part, without regard to case and blanks; late parts start none."""
    keys = [x.lower().split() for x in cut]
    hashes = array("Q", [xxhash.xxh64_intdigest(" ".join(k).encode("utf-8", "surrogatepass")) for k in keys])
    out, end, words = [], 0, 0
    for at in range(len(cut)):
        while end < len(cut) and (end - at < span or words < min_words):
            words += len(keys[end])
            end += 1
        if end - at < span or words < min_words:
            break
        out.append((xxhash.xxh64_intdigest(hashes[at:end].tobytes()) - (1 << 63), end))
        words -= len(keys[at])
    return out


def spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h): the distinct run hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # so that what leaves stays about as large as the texts
                some = batch.slice(at, 500)
                found = [np.fromiter({h for h, _ in runs(parts(t.as_py()), span, min_words)}, np.int64) for t in some.column("text")]
                ids = some.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found))], ["doc_id", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, h long")


def repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gone array<long>): the hashes of each document's runs that a document of smaller doc_id has too."""
    found = stage(spans(docs, span, min_words), "spans")
    first = found.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "least")
    return found.join(first, "h").where("doc_id > least").groupBy("doc_id").agg(F.collect_set("h").alias("gone"))


def substring_dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """docs with ``text`` less its repeated parts, and, if asked, ``_sentences``, ``_removed`` and ``_bytes`` (before) beside it."""

    @F.pandas_udf("text string, sentences long, removed long")
    def cut(text: pd.Series, known: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, judged, hashes in zip(text, known, gone, strict=True):
            if t is None:
                out.append((None, 0, 0))
                continue
            seen = set() if hashes is None else set(hashes.tolist())
            bits, done, kept = parts(t), 0, []
            for at, (h, end) in enumerate(runs(bits, span, min_words) if judged else ()):
                if h in seen:  # parts at .. end go; those before at that no repeat covers stay
                    kept += bits[done:at]
                    done = max(done, end)
                seen.add(h)
            kept += bits[done:]
            out.append(("".join(kept), len(bits), len(bits) - len(kept)))
        return pd.DataFrame(out, columns=["text", "sentences", "removed"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id")
    out = packed.join(repeats(docs, span, min_words), "doc_id", "left").withColumn("cut", cut("doc.text", F.col("doc_id").isNotNull(), "gone"))
    added = [
        F.col("cut.sentences").alias("_sentences"), F.col("cut.removed").alias("_removed"), F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("_bytes"),
    ]
    return out.select(*[F.col("cut.text").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns], *(added if counts else []))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id",
        F.col("_sentences").alias("n_sentences"),
        F.col("_removed").alias("n_removed"),
        (F.col("_sentences") - F.col("_removed")).alias("n_kept"),
        (F.col("_bytes") - F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
