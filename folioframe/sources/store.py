"""Flattened packages written once: every later query reads rows and parses nothing.

``stored`` parses the XML parts of a corpus in one pass, puts the place in the spine on every
section's elements and writes them as a table bucketed by doc_id. Grouping by document (and more
columns) needs no exchange then, and a join by document meets buckets of one number on both sides.
Binary parts never reach a Python worker; only their names do.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.sources import package as P

_LOCAL: list[str] = []
#: Rows of a bucket, in bytes: three sorts of so many stay far below the memory of a task.
BUCKET_BYTES = 32 << 20
#: Rows that a task deals out to the buckets, in bytes: of over 200 buckets Spark holds them all while it sorts them.
DEALT_BYTES = 512 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where both are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="shared-"))
        found = _LOCAL[0]
    return found.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: what is read several times is worked out once, and a lost executor costs only its part."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Corpus:
    """A stored corpus; the functions of ``package`` and ``document`` take it in place of entries."""

    spark: SparkSession
    name: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def elements(self) -> DataFrame:
        """The sections in the order of the spine."""
        return self.rows.where("section_idx >= 0")

    def parts(self, only: str) -> DataFrame:
        if only == P.SECTIONS:
            return self.elements
        return self.rows.where((F.col("tag") != P.ENTRY) & F.col("section_path").rlike(only))

    def paths(self) -> DataFrame:
        return self.rows.where(F.col("tag") == P.ENTRY).select("doc_id", F.col("section_path").alias("path"))

    def drop(self) -> None:
        """Delete the table; nothing may read it any more."""
        path = self.spark.sql(f"describe formatted {self.name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table if exists {self.name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _bytes(rows: DataFrame) -> tuple[int, int]:
    """About how many bytes the rows take in memory, all of them and those of the largest partition: texts, arrays and a fixed part each."""
    kinds = dict(rows.dtypes)
    size = [F.coalesce(F.octet_length(c), F.lit(0)) for c in kinds if kinds[c] == "string"] + [F.greatest(8 * F.size(c), F.lit(0)) for c in kinds if kinds[c].startswith(("array", "map"))]
    found = rows.groupBy(F.spark_partition_id()).agg(F.sum(sum(size, F.lit(400)).cast("long")).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("largest")).first()
    return found["all"] or 0, found["largest"] or 0


def _dealt(rows: DataFrame, n: int, largest: int) -> DataFrame:
    """rows in n partitions by document; where a partition is larger than DEALT_BYTES, several tasks deal out a share of it each."""
    shares = -(-largest // DEALT_BYTES)
    if shares < 2:
        return rows.repartition(n, "doc_id")
    share = F.expr(f"pmod(xxhash64(doc_id, section_path, pre), {shares})")
    return reduce(DataFrame.unionAll, [rows.where(share == i) for i in range(shares)]).repartition(n, "doc_id")


def stored(entries: DataFrame, buckets: int | None = None, tags: set[str] | None = None) -> Corpus:
    """Parse entries once and write the elements, ``buckets`` files of whole documents.

    As many as spark.sql.shuffle.partitions unless told, more if one would hold over BUCKET_BYTES: a
    task sorts a bucket, and so do the operators that read it, so what a task holds does not grow
    with the corpus; nor does what a task holds that deals rows out to the buckets (``_dealt``).

    A document whose package part names no section keeps its entries and other parts, and has no
    elements of sections. tags: elements of these tags only leave the parser, besides the roots of
    all parts, errors and what the order of reading needs; for what reads nothing else.
    """
    spark = entries.sparkSession
    rows = P.walked(entries, P.PARSED, listed=True, tags=None if tags is None else tags | P.ORDERING).persist(StorageLevel.DISK_ONLY)  # read again for the order, and to be written
    try:
        whole, largest = _bytes(rows)
        n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // BUCKET_BYTES))
        place = F.coalesce(F.array_position("sections", F.col("section_path")), F.lit(0)) - 1
        inner = (F.col("tag") != P.ENTRY) & F.col("section_path").rlike(P.SECTIONS)
        order = P.section_order(rows.repartition(n, "doc_id"))
        told = _dealt(rows, n, largest).join(order, "doc_id", "left").withColumn("section_idx", F.when(inner & (place >= 0), place).cast("int"))
        name = f"corpus_{uuid.uuid4().hex}"
        told = told.select(*rows.columns).sortWithinPartitions("doc_id", "section_idx", "pre")
        told.write.bucketBy(n, "doc_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    finally:
        rows.unpersist()
    return Corpus(spark, name)
