"""What the corpus operators share: input columns, word rules, shared-storage stages."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII control blanks 09 to 0D. ``bytes.split()``
#: follows the same rule; these are its regular expressions for JVM-side code.
BLANKS = r"[\x20\x09-\x0D]+"

#: Lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Lower-cases A-Z and turns ASCII punctuation and control characters into blanks.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _LOCAL[0] if _LOCAL else _LOCAL.append(tempfile.mkdtemp(prefix="shared-")) or _LOCAL[0]
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to shared storage and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    free_shuffles(spark)
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    free_shuffles(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage_path = path
    return back


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a past shuffle once its plan is collected as garbage, which may take long; so collect now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stage(df: DataFrame) -> None:
    """Delete a stage that nothing reads any more."""
    spark, path = df.sparkSession, df._stage_path
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def placed(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows with ``i``, the place in its group from 0, and ``n``, the group's rows; no group is gathered in one task."""
    keys = [group, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = stage(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), label)
    parts = marked.groupBy(group, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_lo"))
    w = W.partitionBy(group)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_part", "_lo", before.alias("_before"), F.sum("_c").over(w).alias("n"))
    return marked.join(parts, [group, "_part"]).withColumn("i", F.col("_at") - F.col("_lo") + F.col("_before")).drop("_part", "_at", "_lo", "_before")


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n (a null doc_id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")
