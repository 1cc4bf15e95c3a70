"""Near copies by the Jaccard similarity of their word shingles.

The set of a text is that of its runs of five words. BANDS groups of ROWS
min-hashes give the keys of a text: two texts of similarity s share a key with
probability 1 - (1 - s ** ROWS) ** BANDS, which at 0.8 leaves out 5 pairs in a
million and fewer above. Texts that meet in a key are held against each other
by their whole sets, so no link rests on a hash of a few bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import own_keys, real_keys, small_side, stored
from chronogrid.llm.components import components, tied_groups

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
BLOCK = 512
HEADS = 3
_salts = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint64).astype(np.uint32)
_SALT, _FACTOR = _salts[0], _salts[1] | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending hashes of the distinct runs of ``words`` words; a shorter text is one run, one without words has none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in tokens), np.uint64, len(tokens))
    rolled = hashes
    for n in range(1, min(words, len(tokens))):
        rolled = rolled[:-1] * _STEP + hashes[n:]
    return np.unique(_mixed(rolled))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set; none for the empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    low, least = found.astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), BLOCK):
        block = (low[at : at + BLOCK] ^ _SALT) * _FACTOR
        np.minimum(least, block.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = _mixed(keys * _STEP + bands[:, row])
    return keys.view(np.int64)


def _sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(k, h, g, n, keys): h and g name the set, n is its size."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"].array, batch["t"]):
                found = shingles(t, words)
                name = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                rows.append((k, name[0], name[1], len(found), band_keys(found)))
            yield pd.DataFrame(rows, columns=["k", "h", "g", "n", "keys"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInPandas(work, f"k {kind}, h bigint, g bigint, n bigint, keys array<bigint>")


def _sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "s": [shingles(t, words).view(np.int64) for t in batch["t"]]})

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInPandas(work, f"k {kind}, s array<bigint>")


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least ``similarity`` alike."""
    left = sets.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b")


def _open_keys(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, k, n, root): the members of the band keys that hold members of several groups, with their groups so far."""
    placed = stored(shared.join(roots, "k", "left").select("key", "k", "n", F.coalesce("root", "k").alias("root")), "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return stored(placed.join(split.select("key"), "key", "left_semi"), "open")


def _strangers(held: DataFrame, sets: DataFrame, sizes_fit: Callable[[str, str], Column], similarity: float) -> DataFrame:
    """(ra, rb) of the groups that are tied by a link between members of a key."""
    crowded = held.join(sets, "k")
    main = held.groupBy("key").agg(F.min("root").alias("main"))
    left = crowded.join(main, "key").where("root <> main").select("key", F.col("k").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("s").alias("sa"))
    right = crowded.select("key", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("s").alias("sb"))
    other = (F.col("ra") != F.col("rb")) & sizes_fit("na", "nb")
    alike = F.when(other, _jaccard(F.col("sa"), F.col("sb")) >= similarity).otherwise(F.lit(False))
    return left.join(right, (left["key"] == right["key"]) & alike).select("ra", "rb").distinct()


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """(key, root) of the rows of ``docs`` that are in a group with others; root is the smallest key of the group.

    Keys are unique and not null. Texts of equal sets are one, also those
    without words. The members of a band key are held against HEADS of them at
    once, the smallest and others picked by hash: a fixed number of comparisons
    a member, however large a crowd is, and one search for groups. Only where a
    key still holds several groups after that are its members compared across
    groups, by their whole sets inside the join, so that links alone leave it
    and no link between groups is missed.
    """
    sketches = stored(_sketches(docs, key, text, words), "sketches")
    named = stored(sketches.groupBy("h", "g").agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("copies")), "sets")
    singles = sketches.join(named.select(F.col("node").alias("k")), "k", "left_semi")
    keyed = singles.select("k", "n", F.explode("keys").alias("key"))
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(keyed.join(crowds.select("key"), "key", "left_semi"), "bands")
    wanted = stored(shared.select("k").distinct(), "wanted")
    texts = docs.join(small_side(wanted.select(F.col("k").alias(key)), wanted.count()), key, "left_semi")
    sets = stored(_sets(texts, key, text, words), "shingles")

    def sizes_fit(m: str, n: str) -> Column:
        return F.least(m, n) >= F.greatest(m, n) * F.lit(similarity * (1 - 1e-9))

    orders = [F.xxhash64("k", F.lit(turn)) if turn else F.col("k") for turn in range(HEADS)]
    heads = shared.groupBy("key").agg(F.array(*[F.min_by(F.struct("k", "n"), order) for order in orders]).alias("heads"))
    met = shared.join(heads, "key").select("k", "n", F.explode(F.array_distinct("heads")).alias("head"))
    met = met.where((F.col("k") != F.col("head.k")) & sizes_fit("n", "head.n"))
    pairs = met.select(F.least("k", "head.k").alias("a"), F.greatest("k", "head.k").alias("b")).distinct()
    links = stored(_similar(pairs, sets, similarity), "near")
    roots = components(links)
    held = _open_keys(shared, roots.withColumnRenamed("vertex", "k"))
    if not held.isEmpty():
        roots = tied_groups(roots, _strangers(held, sets, sizes_fit, similarity))
    grouped = named.join(roots.withColumnRenamed("vertex", "node"), "node", "left").where("copies > 1 or root is not null")
    tied = grouped.select("h", "g", F.coalesce("root", "node").alias("root"))
    return sketches.select("k", "h", "g").join(tied, ["h", "g"]).select(F.col("k").alias(key), "root")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """All columns of the documents with the smallest key of each group.

    Of rows with equal key and equal text one counts; different texts
    under one key are different documents. Rows without a key
    cannot be named and stay. An empty table gives an empty result.
    """
    docs = own_keys(docs, key, text)
    found = near_groups(docs.where(F.col(key).isNotNull()), key, text, words, similarity)
    gone = stored(found.where(F.col(key) != F.col("root")).select(key), "gone")
    return real_keys(docs.join(small_side(gone, gone.count()), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), key)
