"""Reading files into rows without collecting any file on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_path() -> Column:
    return F.col("_metadata.file_path")


def relative_to(root: str, path: Column) -> Column:
    """Part of a file path below ``root``; tolerates a scheme in front of the path."""
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(path, plain, -1)


def text_files(spark: SparkSession, root: str, glob: str = "*", whole: bool = True) -> DataFrame:
    """path, text: one row per file, or one per line when ``whole`` is off."""
    rows = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=whole)
    )
    return rows.select(file_path().alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, bytes, modified_ms; the content column is pruned, so no file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified_ms"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system for one path; nothing is listed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def first_existing(spark: SparkSession, *roots: str) -> str | None:
    """First path that exists."""
    return next((root for root in roots if path_exists(spark, root)), None)
