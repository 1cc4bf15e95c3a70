"""Language identification with a bit-sliced Bloom filter of character n-grams.

Slot s of the filter holds one bit per language. The n-grams that mark a
language set its bit in k slots each; AND over the k slots of an n-gram gives
all languages that contain it. A text is given to the language whose share of
contained n-grams is largest after the filter's own false positives, known from
its fill, are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import hash_share, stored

SIZES = (2, 3)
PROBES = 3
SLOT_BITS = 17
GRAMS_PER_LANG = 6000
DOCS_PER_LANG = 2000
MIN_LIFT = 0.5
MIN_SHARE = 0.2
BLOCK_CHARS = 1 << 18
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of letters, block by block; words are bounded by one space on either side."""
    text = text or ""
    table = _letter_table()
    for at in range(0, len(text), BLOCK_CHARS):
        block = text[at : at + BLOCK_CHARS].lower()
        codes = np.frombuffer(block.encode("utf-32-le", "replace"), "<u4")
        letter = table[codes]
        codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        if len(codes) < 3:
            continue
        rolled = codes
        for n in range(2, max(SIZES) + 1):
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n in SIZES and len(rolled):
                yield _mixed(rolled * np.uint64(2 * n + 1))


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    for i in range(PROBES):
        yield ((hashes + np.uint64(i) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``langs`` in order of their bit; ``slots`` by word of 64 languages; ``prior`` breaks ties."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share). ``und`` for no letter; share is the winner's corrected share of the text's
        n-grams, score its part of the shares of all languages."""
        counts, total, letters = np.zeros(len(self.langs)), 0, False
        for hashes in gram_hashes(text):
            letters = True
            total += len(hashes)
            for word in range(self.slots.shape[0]):
                found = None
                for slot in _slots(hashes):
                    hit = self.slots[word][slot]
                    found = hit if found is None else found & hit
                for bit in range(min(64, len(self.langs) - 64 * word)):
                    counts[64 * word + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        if not letters or not self.langs:
            return "und", 0.0, 0.0
        share = np.clip((counts / total - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0, float(share[best])


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG,
    grams_per_lang: int = GRAMS_PER_LANG,
) -> LanguageFilter:
    """Filter from about ``docs_per_lang`` labelled documents a language, picked by a hash of the key.

    Rows without language or text teach nothing. Of each language the most
    frequent ``grams_per_lang`` n-grams enter whose relative frequency is at
    least MIN_LIFT of that in any language. The filter has a fixed size.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")
    )
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    # ascending frequency of the label is no use of it in a prediction: it only orders ties
    langs = sorted(sizes, key=lambda name: (-sizes[name], name))
    if not langs:
        return LanguageFilter([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    bit = {name: i for i, name in enumerate(langs)}
    rate = F.lit(0.0)
    for name in langs:
        rate = F.when(F.col("l") == name, F.lit(docs_per_lang / sizes[name])).otherwise(rate)
    sample = rows.where(hash_share(F.col("k")) < rate).select("t", "l")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("l"):
                found = [h for t in part["t"] for h in gram_hashes(t)]
                if found:
                    grams, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"b": bit[name], "g": grams.view(np.int64), "n": n})

    counted = sample.mapInPandas(count, "b int, g bigint, n bigint").groupBy("b", "g").agg(F.sum("n").alias("n"))
    counted = stored(counted, "grams")
    totals = {r["b"]: r["n"] for r in counted.groupBy("b").agg(F.sum("n").alias("n")).collect()}
    relative = F.lit(0.0)
    for b, n in totals.items():
        relative = F.when(F.col("b") == b, F.col("n") / F.lit(float(n))).otherwise(relative)
    shares = counted.withColumn("f", relative)
    peaks = shares.groupBy("g").agg(F.max("f").alias("peak"))
    marks = shares.join(peaks, "g").where(F.col("f") >= MIN_LIFT * F.col("peak"))
    slots = np.zeros(((len(langs) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    for b in range(len(langs)):  # one bounded list per language
        top = marks.where(F.col("b") == b).orderBy(F.col("n").desc(), "g").limit(grams_per_lang).select("g").toPandas()
        for slot in _slots(top["g"].to_numpy(np.int64).view(np.uint64)):
            slots[b // 64][slot] |= np.uint64(1 << (b % 64))
    fill = np.array([np.count_nonzero(slots[b // 64] & np.uint64(1 << (b % 64))) for b in range(len(langs))])
    return LanguageFilter(langs, slots, (fill / (1 << SLOT_BITS)) ** PROBES)


def judge(spark: SparkSession, model: LanguageFilter, text: Column) -> Column:
    """Struct (lang_pred, score, share) of a whole text."""
    shared = spark.sparkContext.broadcast(model)  # a fixed number of slots

    @F.pandas_udf("lang_pred string, score double, share double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.judge(t) for t in texts]
        return pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "share": [f[2] for f in found]})

    return judged(text)


def predict(docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. A text of
    letters that no language marks gets the most frequent language with score 0.
    Equal texts have equal results; rows with equal or null keys are judged
    each. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("k"), judge(docs.sparkSession, model, F.col(text)).alias("j"))
    return rows.select(F.col("k").alias(key), "j.lang_pred", "j.score")


def keep_known(docs: DataFrame, model: LanguageFilter, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """All columns of the rows of whose n-grams their language holds at least ``min_share``.

    The share is that of one language by itself, so it does not fall as languages are added.
    """
    kept = docs.withColumn("_judged_language", judge(docs.sparkSession, model, F.col(text)))
    kept = kept.where((F.col("_judged_language.lang_pred") != "und") & (F.col("_judged_language.share") >= min_share))
    return kept.drop("_judged_language")
