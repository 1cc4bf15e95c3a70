"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.session import scratch_path

MAX_BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once into the shared folder and read again: nothing behind it is ever computed twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side that was counted and is within ``limit``; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def hash_share(column: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) of a value."""
    return F.pmod(F.xxhash64(column, F.lit("share")), F.lit(1 << 30)) / F.lit(float(1 << 30))


REAL_KEY = "_real_key"


def own_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` where every row with a key has one of its own; of rows with equal key and equal text one stays.

    Keys are counted first: a table of unique keys comes back as it is, without
    moving a text. Otherwise the key becomes a number in the order of (key, hash
    of the text), written once, and the former key is carried in ``_real_key``
    until ``real_keys``; different texts under one key are different documents.
    The order is made by ranges of both, so a key on many rows is spread.
    """
    known = docs.where(F.col(key).isNotNull())
    if not known.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = known.groupBy(F.col(key).alias("k"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"), F.col(text).isNull().alias("none"))
    single = named.agg(F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns)))).alias("row"))
    ordered = single.repartitionByRange("k", "h", "none").sortWithinPartitions("k", "h", "none")
    numbered = ordered.select("row", F.monotonically_increasing_id().alias("place"))
    own = [F.col("place").alias(c) if c == key else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    placed = stored(numbered.select(*own, F.col(f"row.`{key}`").alias(REAL_KEY)), "placed")
    bare = docs.where(F.col(key).isNull()).withColumn(REAL_KEY, F.col(key))
    return placed.unionByName(bare.withColumn(key, F.col(key).cast("bigint")))


def real_keys(rows: DataFrame, key: str) -> DataFrame:
    """Back to the keys that ``own_keys`` replaced, if it did."""
    if REAL_KEY not in rows.columns:
        return rows
    return rows.select(*[F.col(f"`{REAL_KEY}`").alias(c) if c == key else F.col(f"`{c}`") for c in rows.columns if c != REAL_KEY])
