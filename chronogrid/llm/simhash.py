"""SimHash near-duplicate groups with pigeonring filtering.

A fingerprint is cut into a ring of four segments of 16 bits. When two
fingerprints differ in at most three bits, some segment starts a chain whose
first l segments together differ in at most floor(3 l / 4) bits: 0, 1, 2, 3.
The chain condition is turned into equality keys. The second segment holds at
most one difference and the second and third together at most two, so of their
four bytes two are equal, one of them in the second segment. A start and such a
choice of bytes give a key of 32 bits (chain length 3, 20 keys a fingerprint);
a length of 2 gives 24 bits and 8 keys, 4 gives 40 bits and 56 keys.
Rows that meet in a key are held against the whole chain condition and then
against the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import own_keys, real_keys, small_side, stored
from chronogrid.llm.components import components, tied_groups

MAX_BITS = 3
SHINGLE_WORDS = 3
CHAIN = 3
BLOCK = 1 << 16


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint; 0 for a text without words. Works in blocks, so memory does not follow the length."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    size = max(len(tokens) - words + 1, 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, size, BLOCK):
        stop = min(start + BLOCK, size)
        runs = [tokens[start + i : stop + i] for i in range(min(words, len(tokens)))]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(run), 42) for run in zip(*runs)), np.dtype(">u8"), stop - start
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > size).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): fp as signed 64-bit integer. Null text counts as empty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.fromiter((simhash(t, words) for t in batch["t"]), np.uint64, len(batch))
            yield pd.DataFrame({"k": batch["k"], "fp": prints.view(np.int64)})

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInPandas(work, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def _rotated(fp: Column, start: int) -> Column:
    if start == 0:
        return fp
    return F.shiftleft(fp, 16 * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * start))


def ring_keys(fp: Column, chain: int = CHAIN) -> Column:
    """Array of the equality keys of a fingerprint for a chain of ``chain`` segments."""
    followers = 2 * (chain - 1)
    picks = [
        pick
        for pick in combinations(range(followers), chain - 1)
        if all(sum(1 for p in pick if p < 2 * n) >= n for n in range(1, chain))
    ]
    keys = []
    for start in range(4):
        turned = _rotated(fp, start)
        for number, pick in enumerate(picks):
            key = F.shiftrightunsigned(turned, 48)
            for p in pick:
                key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(turned, 40 - 8 * p).bitwiseAND(F.lit(255)))
            # the tag of start and choice goes above the 16 + 8 (chain - 1) bits of the value
            keys.append(key.bitwiseOR(F.lit((start * len(picks) + number) << 48)))
    return F.array(*keys)


def passes_ring(a: Column, b: Column, max_bits: int = MAX_BITS) -> Column:
    """Some start has a chain within the proportional budgets at every length, and the whole is within max_bits."""
    diff = a.bitwiseXOR(b)
    starts = F.lit(False)
    for start in range(4):
        turned = _rotated(diff, start)
        chain = F.lit(True)
        for length in range(1, 5):
            chain = chain & (F.bit_count(F.shiftrightunsigned(turned, 64 - 16 * length)) <= max_bits * length // 4)
        starts = starts | chain
    return starts & (F.bit_count(diff) <= max_bits)


def near_links(prints: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join the same groups as all pairs within three bits."""
    stars, _, rest = _links_and_groups(prints, chain)
    return stars.union(rest.select("a", "b").distinct())


def near_groups(prints: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(vertex, root) of the fingerprints that have a link; root is the smallest fingerprint of the group."""
    _, roots, rest = _links_and_groups(prints, chain)
    return tied_groups(roots, rest)


def _links_and_groups(prints: DataFrame, chain: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the heads of keys, the groups that they make, and the links (a, b, ra, rb) between groups.

    First every member of a key is held against the smallest member only, which
    ties large groups without pairing them. Then only members of a key that are
    still in different groups are compared, all of them: a link between groups
    cannot be missed and a link inside a group would change nothing.
    """
    keyed = prints.select("fp", F.explode(ring_keys(F.col("fp"), chain)).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(heads.select("key", "head"), "key"), "ring")
    stars = (
        shared.where("fp <> head")
        .select(F.col("head").alias("a"), F.col("fp").alias("b"))
        .distinct()
        .where(passes_ring(F.col("a"), F.col("b")))
    )
    stars = stored(stars, "stars")
    roots = components(stars)
    placed = shared.select("key", "fp").join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("root")
    )
    split = placed.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("other")).where("main <> other")
    open_keys = placed.join(split.select("key", "main"), "key")
    left = open_keys.where("root <> main").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    right = open_keys.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    rest = (
        left.join(right, "key")
        .where((F.col("ra") != F.col("rb")) & passes_ring(F.col("a"), F.col("b")))
        .select("a", "b", "ra", "rb")
    )
    return stars, roots, rest


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Texts link at three or fewer differing bits; component_id is the smallest
    key reachable, itself included. Null and empty texts have fingerprint zero
    and link like any other. Rows with equal keys are separate members of their
    groups; a null key belongs to a group but never names one unless all are
    null. An empty table gives an empty result. Other columns are not read.
    """
    prints = stored(fingerprints(docs, key, text).withColumnRenamed(key, "_key"), "prints")
    classes = prints.groupBy("fp").agg(F.min("_key").alias("first"))
    roots = near_groups(classes.select("fp"), chain)
    tied = classes.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    tied = stored(tied, "classes")
    names = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents with the smallest key of each group.

    Of rows with equal key and equal text one counts; different texts
    under one key are different documents. Rows without a key
    cannot be named and stay.
    """
    docs = own_keys(docs, key, text)
    found = near_duplicates(docs.where(F.col(key).isNotNull()), key, text)
    gone = stored(found.where(F.col(key) != F.col("component_id")).select(key), "gone")
    return real_keys(docs.join(small_side(gone, gone.count()), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), key)
