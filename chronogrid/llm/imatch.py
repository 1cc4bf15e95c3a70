"""I-Match fingerprints over randomised subsets of an idf band.

The lexicon holds the terms whose document frequency lies between two shares
of the collection. The terms of one document that occur in a share f of all
documents number at most its distinct terms, so the lexicon has at most
(mean distinct terms) / MIN_SHARE entries at any size of the collection: that
is the bound of the only broadcast. A term belongs to subset i by its own hash.
The distinct terms of a subset are sorted and hashed; the hashes in a row are
the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import small_side, stored
from chronogrid.llm.decontaminate import words_of
from chronogrid.operators.ordered import with_previous

MIN_SHARE = 1 / 1000
MAX_SHARE = 1 / 10
#: a subset holds one term in 2 ** rate of the lexicon: dense subsets tell short texts, thin ones long texts
RATES = (0, 1, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6, 7, 7, 7, 8, 8, 8, 9, 9)
NO_KEY = -(1 << 63)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w)))


def lexicon(
    docs: DataFrame, text: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE
) -> DataFrame:
    """(term): hashes of the terms in the idf band, by their document frequency over all rows of ``docs``."""
    total = docs.count()
    counts = docs.select(F.explode(_terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= max(2, min_share * total)) & (F.col("n") <= max(2, max_share * total))).select(
        "term"
    )


def _part(terms: Column, number: int, rate: int) -> Column:
    if rate == 0:
        return terms
    return F.filter(terms, lambda t: F.shiftrightunsigned(F.xxhash64(t, F.lit(number)), 64 - rate) == 0)


def fingerprint_of(terms: Column, whole: Column) -> Column:
    """Array of the subset hashes: null where a text has no term of the subset; ``whole`` stands in for the full set."""

    def hashed(part: Column) -> Column:
        return F.transform(F.array(part), lambda p: F.when(F.size(p) > 0, F.xxhash64(p)))[0]

    def all_of(ts: Column) -> Column:
        found = [hashed(_part(ts, number, rate)) for number, rate in enumerate(RATES)]
        return F.array(F.coalesce(found[0], whole), *found[1:])

    return F.transform(F.array(terms), all_of)[0]  # the sorted terms are bound once


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms in; subset 0 always counts."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    either = F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(either, lambda p: p["x"] == p["y"])
    return (F.size(same) / F.size(either)).cast("double")


def fingerprints(texts: DataFrame, keys: list[str], text: str, words: DataFrame) -> DataFrame:
    """``keys`` and (prints): rows of ``texts`` have to differ in ``keys`` and lie partitioned by the first of them."""
    terms = texts.select(*keys, _terms(F.col(text)).alias("ts"))
    # the hash of the whole set is made here, once a text, and not above the rows of the terms
    whole = terms.select(*keys, F.xxhash64(F.sort_array("ts")).alias("whole"), "ts")
    lexed = whole.select(*keys, "whole", F.explode_outer("ts").alias("term")).join(small_side(words.withColumn("in_band", F.lit(True)), words.count(), 2_000_000), "term", "left")
    sets = lexed.groupBy(*keys, "whole").agg(F.sort_array(F.collect_set(F.when(F.col("in_band"), F.col("term")))).alias("ts"))
    return sets.select(*keys, fingerprint_of(F.col("ts"), F.col("whole")).alias("prints"))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, next, t, edited): every document, the next one's key in descending order, and its edited text.

    Rows with one key count as one document with the smallest text. A missing
    key is the lowest. The order is found on the keys alone; of the next text
    only the part that is needed moves.
    """
    base = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY).cast("bigint")).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    single = base.groupBy("k").agg(F.min("t").alias("t"))
    keys = base.groupBy("k").agg(F.max(F.floor(F.char_length("t") / 3)).alias("most"))
    top = keys.agg(F.max("k")).first()[0]
    placed = with_previous(keys.select("k"), [], ["k"], ["k"])
    nexts = stored(placed.select("k", F.coalesce(F.col("prev.k"), F.lit(top).cast("bigint")).alias("next")), "nexts")
    needs = nexts.join(keys, "k").select("next", F.col("k").alias("asker"), "most")
    heads = (
        single.join(needs.withColumnRenamed("next", "k"), "k")
        .select(F.col("asker").alias("k"), F.expr("substring(t, 1, int(most))").alias("head"))
    )
    mine = single.join(nexts, "k")
    cut = F.floor(F.char_length("t") / 3).cast("int")
    return mine.join(heads, "k").select(
        "k",
        "next",
        "t",
        F.concat(
            F.substring("t", F.lit(1), F.char_length("t") - cut), F.substring("head", F.lit(1), cut)
        ).alias("edited"),
    )


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per key.

    Null texts count as empty. A text without a term of the band has, in place
    of the whole band's hash, the hash of all its distinct words, so that
    different texts stay apart. Equal texts have equal fingerprints. A single
    document is its own next one. An empty table gives an empty result. Other
    columns are not read.
    """
    words = stored(lexicon(docs.select(F.col(text).alias("t")), "t"), "lexicon")
    edited = with_edits(docs, key, text)
    both = edited.select(
        "k",
        F.inline(
            F.array(
                F.struct(
                    F.lit(False).alias("is_edited"),
                    F.col("t").alias("body"),
                    F.col("next").alias("next"),
                    F.char_length("t").cast("bigint").alias("n_chars"),
                    F.lit(None).cast("string").alias("sha"),
                ),
                F.struct(
                    F.lit(True).alias("is_edited"),
                    F.col("edited").alias("body"),
                    F.col("next").alias("next"),
                    F.lit(None).cast("bigint").alias("n_chars"),
                    F.sha2("edited", 256).alias("sha"),
                ),
            )
        ),
    )
    prints = fingerprints(both, ["k", "is_edited", "next", "n_chars", "sha"], "body", words)
    rows = prints.groupBy("k", "next").agg(
        F.max("n_chars").alias("n_chars"),
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(~F.col("is_edited"), F.col("prints"))).alias("own"),
        F.max(F.when(F.col("is_edited"), F.col("prints"))).alias("changed"),
    )
    rows = stored(rows, "prints")
    following = rows.select(F.col("k").alias("next"), F.col("own").alias("other"))
    joined = rows.join(following, "next")
    return joined.select(
        F.nullif(F.col("k"), F.lit(NO_KEY).cast("bigint")).alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("other")).alias("near_next"),
    )
