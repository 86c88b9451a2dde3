"""Op 4. Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get a global number (the order of doc_id, text CRC and size; equal rows are interchangeable),
the number is permuted by a keyed bijection of ``[0, n)``, and shard and slot are computed from the
permuted number alone: ``shard = p mod shards``, ``slot = p div shards``. So law ``rows`` holds:
shard counts differ by one at most and slots have no gaps. Texts never move: only id, size and CRC
are sorted.

Null texts have size 16 and CRC 0; null ids sort first; repeated rows are separate rows with
numbers of their own; an empty table gives no rows; other columns are ignored. Equal texts are
reported by equal (size, text_crc32) and are not kept together: the law is on rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import stage, table

ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    state, keys = seed & (2**64 - 1), []
    for _ in range(rounds):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        keys.append(state >> 33)
    return keys


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Bijection of [0, n) for an array of int64 row numbers.

    A Feistel network permutes ``[0, 2^(2h))``, the least even power that holds n (under 4n);
    a value outside [0, n) is walked along its cycle until it is inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), [np.uint64(k) for k in round_keys(seed)]
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            t = ((right ^ k) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            t ^= t >> np.uint64(15)
            t = (t * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
            t ^= t >> np.uint64(13)
            left, right = right, left ^ (t & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[int, int], int]:
    """doc_id, size, text_crc32 with (part, at); each part's first global number; the number of rows."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(
        "*",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    )
    rows = stage(rows, "rows")
    first, total = {}, 0
    for part, count in sorted(rows.groupBy("part").count().collect()):  # one row a partition
        first[part], total = total, total + count
    return rows, first, total


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 20_24) -> DataFrame:
    rows, first, total = numbered(docs)

    @F.pandas_udf("long")
    def place(part: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(permute(part.map(first).to_numpy(np.int64) + at.to_numpy(np.int64), total, seed))

    return rows.withColumn("p", place("part", "at")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir))
