"""Packages as they arrive in a folder: an extension, with the same flattened form as the batch reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.sources import package as P

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000, glob: str = "*.zip") -> DataFrame:
    """A stream of the entries of archives that appear in a folder, at most per_trigger of them a batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return P.entries_of(files)


def flattened(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of elements, sections numbered by their names; every operator that needs one row at a time applies to it."""
    return P.walked(arriving(spark, folder, **options))
