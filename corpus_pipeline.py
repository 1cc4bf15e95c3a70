"""Training-data pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm import decontaminate, language_id, line_dedup, near_copies, packing, simhash
from chronogrid.llm.common import stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or told with too little certainty go."""
    return language_id.keep_known(docs, language_id.train(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without duplicate lines; a document of which nothing is left goes, one that was empty stays."""
    cut = line_dedup.dedup_lines(docs)
    gone = (F.col("_lines.n_kept") == 0) & (F.col("_lines.n_lines") > 0)
    n_chars = [F.coalesce(F.char_length("text").cast("bigint"), F.lit(0).cast("bigint")).alias("n_chars")]
    return cut.where(~gone).select(*[n_chars[0] if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies.

    Fingerprints within three bits come first; they find few of the texts with
    0.8 of their runs of five words in common, so these are looked for among
    the documents that stay.
    """
    kept = stored(simhash.keep_one(docs), "fingerprints")
    return near_copies.keep_one(kept)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training with their token ids; one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: tokens, classes and trained filters are beyond SQL: tests hold every stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
