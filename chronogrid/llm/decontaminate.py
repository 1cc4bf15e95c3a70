"""Benchmark decontamination: prefix-filtered set join with exact verification.

The set of a window is its shingles. Containment must be whole, so the
necessary prefix of a window is its rarest shingle alone: a document that
holds the window holds that shingle, at a position from which the window still
fits into the document. Rarity is counted over all documents. Every candidate
is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import small_side, stored

WINDOW = 10
SHINGLE = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII that is neither a letter nor a digit, without the space itself
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 32)


def words_of(text: Column) -> Column:
    """Array of the words: A-Z in lower case, split at everything in ASCII but letters and digits."""
    spaced = F.translate(text, _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(F.coalesce(spaced, F.lit("")), " "), "")


def _runs(words: Column, length: int) -> Column:
    """Array of the hashes of all runs of ``length`` words; used to find, never to decide."""

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - F.lit(length - 1))
        run = F.transform(
            starts, lambda i: F.xxhash64(F.lit(length), *[F.element_at(w, i + F.lit(j)) for j in range(length)])
        )
        return F.when(F.size(w) >= length, run).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), hashed)[0]  # the words are bound once


def windows_of(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, words, length): the distinct windows of every item; an item without words has none."""
    listed = items.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w"))
    cut = F.transform(
        F.array("w"),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(window - 1), F.lit(1))),
            lambda i: F.slice(w, i, F.lit(window)),
        ),
    )[0]
    return (
        listed.where(F.size("w") > 0)
        .select("item", F.explode(cut).alias("words"))
        .distinct()
        .withColumn("length", F.size("words"))
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of ``docs``.

    Null and empty texts have no words and no hits. Items without words match
    nothing. Equal items all count. Repeated documents are judged each;
    rows with one key and different texts too. An empty table of items leaves
    every document clean. Other columns are not read.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = _judged(docs, items.select(F.col(item_key).alias("item"), F.col(item_text).alias("it")), "k", "t", window, shingle)
    return found.select(F.col("_row.k").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """All columns of the documents in which no window of an item occurs."""
    found = _judged(docs, items.select(F.col(item_key).alias("item"), F.col(item_text).alias("it")), key, text, window, shingle)
    return found.where(~F.col("contaminated")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _judged(docs: DataFrame, items: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """``_row`` with all columns of a document and the figures of ``contamination``."""
    passages = stored(windows_of(items, "item", "it", window), "windows")
    lengths = [r[0] for r in passages.select(F.least("length", F.lit(shingle)).alias("n")).distinct().collect()]  # at most `shingle` values
    empty = passages.where("false").select("item", "words", "length", F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("token"))
    tokens = empty
    for n in lengths:
        same = passages.where(F.least("length", F.lit(shingle)) == n)
        tokens = tokens.union(
            same.select("item", "words", "length", F.posexplode(_runs(F.col("words"), n)).alias("offset", "token"))
        )
    known = stored(tokens.select("token").distinct(), "tokens")
    n_known = known.count()
    split = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    runs = [_runs(F.col("w"), n) for n in lengths] or [F.array().cast("array<bigint>")]
    worded = split.select("k", words_of(F.col("t")).alias("w"))
    found = None
    for run in runs:
        part = worded.select("k", F.posexplode(run).alias("at", "token")).join(small_side(known, n_known), "token", "left_semi")
        found = part if found is None else found.union(part)
    found = stored(found, "found")
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        tokens.join(counts, "token", "left")
        .groupBy("item", "words", "length")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("offset"))).alias("rare"))
        .where("rare.n > 0")
        .groupBy("words", "length", F.col("rare.token").alias("token"), F.col("rare.offset").alias("offset"))
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    rarest = stored(rarest, "prefix")
    candidates = (
        found.join(small_side(rarest, rarest.count(), 50_000), "token")
        .withColumn("start", F.col("at") - F.col("offset"))
        .where("start >= 0")
        .select("k", F.struct("start", "length", "words", "items").alias("c"))
        .groupBy("k")
        .agg(F.collect_set("c").alias("cs"))
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = packed.join(candidates, F.col(f"_row.`{key}`").eqNullSafe(F.col("k")), "left").select(
        "_row", words_of(F.col(f"_row.`{text}`")).alias("w"), "cs"
    )
    checked = joined.select(
        "_row",
        F.size("w").cast("bigint").alias("n_words"),
        F.transform(
            F.array("w"),
            lambda w: F.array_sort(
                F.filter(
                    F.coalesce("cs", F.expr("array()").cast(dict(joined.dtypes)["cs"])),
                    lambda c: (c["start"] + c["length"] <= F.size(w))
                    & (F.slice(w, c["start"] + F.lit(1), c["length"]) == c["words"]),
                )
            ),
        )[0].alias("hits"),
    )
    # hits come in ascending start: what a window adds is what reaches past the furthest end so far
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["start"] + h["length"] - F.greatest(s["end"], h["start"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], h["start"] + h["length"]).alias("end"),
        ),
        lambda s: s["n"].cast("bigint"),
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return checked.select(
        "_row",
        "n_words",
        covered.alias("n_hit"),
        names.alias("item_ids"),
    ).select(
        "_row",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
