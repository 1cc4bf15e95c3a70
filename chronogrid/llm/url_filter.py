"""URL filter: rules first, then naive Bayes over segmented host and path words.

Concatenated names are split by a unigram Viterbi search; the word counts come
from all titles and the parts of all hyphenated hosts and stay in a table, from
which a name is joined with the words that lie in it. A URL with a seed word
among its words is an example of the class to block. The others are not
labelled: the classes of multinomial naive Bayes over hashed words are fitted
to them by expectation and maximisation.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import small_side, stored

#: (rule, verdict); a rule is a host and a path prefix
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: words that mark a URL as an example of what to block
SEEDS = (
    "spam casino casinos poker gambling betting jackpot lottery slots bingo viagra cialis pills pharmacy porn "
    "xxx sex adult escort webcam nude hentai warez torrent crack keygen malware phishing scam loan loans payday "
    "replica counterfeit cheap clickbait linkfarm doorway "
    "bet bets roulette ad ads advert adverts adserver popup popups popunder tracker trackers tracking clicktrack"
).split()
#: lengths of the beginnings by which a word is looked up; a longer word goes by the greatest that it has
SHORT = 8
ROUNDS = 5
UNIT = 1_000_000
BUCKETS = 1 << 16
SMOOTHING = 0.01
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PART = r"(\p{L}[\p{L}\p{M}]*|\p{Nd}+)"


def host_of(url: Column) -> Column:
    rest = F.expr("substring(_u, locate('://', _u) + 3)")
    return F.when(F.expr("locate('://', _u)") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(_u, locate('://', _u) + 3)")
    return F.when(F.expr("locate('://', _u)") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def parse_urls(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path); null and texts without ``://`` have empty parts."""
    rows = pages.select(F.col(key).alias("_k"), F.coalesce(F.col(url), F.lit("")).alias("_u"))
    return rows.select(F.col("_k").alias(key), host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the smaller text on a tie; null where none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return found, verdict


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Most likely split of a name under a unigram model; a strange word costs more with every letter.

    ``counts`` holds at least the words that lie in the name. The best strange
    word up to a place is carried along, so words of any length are considered.
    """
    tenfold = math.log(10.0)
    strange = math.log(total) + tenfold
    cost = {w: -math.log(n / total) for w, n in counts.items()}
    sizes = sorted({len(w) for w in counts}, reverse=True)
    best, back = [0.0], [0]
    begun, begun_at = 0.0, 0  # least best[start] less the letters before it
    for end in range(1, len(name) + 1):
        found, start = begun + strange + end * tenfold, begun_at
        for size in sizes:
            if size <= end:
                known = cost.get(name[end - size : end])
                if known is not None and best[end - size] + known < found:
                    found, start = best[end - size] + known, end - size
        best.append(found)
        back.append(start)
        if found - end * tenfold < begun:
            begun, begun_at = found - end * tenfold, end
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(w, n) of all words of titles and hyphenated host labels over all pages; seeds at least once."""
    title = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), "(?is)<title[^>]*>([^<]*)", 1)
    from_titles = pages.select(F.explode(F.split(F.lower(title), r"[^\p{L}]+")).alias("w"))
    hosts = parse_urls(pages.select(F.lit(0).alias("n"), F.col(url).alias("u")), "n", "u").select("host").distinct()
    hyphened = hosts.select(F.explode(F.split("host", r"[.\-:@0-9]+")).alias("w"), "host").where("host like '%-%'").select("w")
    seeds = pages.sparkSession.createDataFrame([(w,) for w in SEEDS], "w string")
    seen = from_titles.union(hyphened).where(F.char_length("w") >= 2).union(seeds)
    return seen.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def segment(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, ws): the words of every distinct name of ``parts``.

    Every place of a name looks up its next 1 to 8, 16, 32, ... letters; a word
    is kept under its greatest such beginning and compared in full.
    """
    total = int(counts.agg(F.sum("n")).first()[0] or 1)

    def beginnings(most: Column) -> Column:
        longer = F.transform(F.sequence(F.lit(4), F.lit(30)), lambda e: F.call_function("shiftleft", F.lit(1), e))
        return F.filter(F.concat(F.sequence(F.lit(1), F.lit(SHORT)), longer), lambda size: size <= most)

    words = counts.select("w", "n", F.substring("w", F.lit(1), F.array_max(beginnings(F.char_length("w")))).alias("key"))
    chars = F.char_length("part")
    places = parts.select("part", F.explode(F.sequence(F.lit(1), chars)).alias("at"))
    asked = places.select("part", "at", F.explode(beginnings(chars - F.col("at") + 1)).alias("size"))
    asked = asked.select("part", "at", F.substring("part", F.col("at"), F.col("size")).alias("key"))
    lies = F.substring("part", F.col("at"), F.char_length("w")) == F.col("w")
    met = asked.join(words, "key").where(lies).select("part", "w", "n").distinct()
    inside = met.groupBy("part").agg(F.collect_list(F.struct("w", "n")).alias("inside"))  # words of one name

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(
            [
                split_name(t, {} if ws is None else {w["w"]: int(w["n"]) for w in ws}, total)
                for t, ws in zip(name, known)
            ]
        )

    return parts.join(inside, "part", "left").select("part", split("part", "inside").alias("ws"))


def url_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, path, words) of distinct hosts and paths; a number counts as one word for its length."""
    text = F.concat(F.col("host"), F.lit(" "), F.lower("path"))
    cut = urls.select("host", "path", F.posexplode_outer(F.regexp_extract_all(text, F.lit(_PART))).alias("at", "part"))
    cut = stored(cut, "parts")
    number = F.col("part").rlike(r"^\p{Nd}")
    names = cut.where(~number).select("part").distinct()
    split = stored(segment(names, counts), "names")
    joined = cut.join(small_side(split, split.count()), "part", "left")
    size = F.least(F.char_length("part"), F.lit(9))
    ws = F.when(number, F.array(F.concat(F.lit("#"), size))).otherwise(F.coalesce("ws", F.array().cast("array<string>")))
    grouped = joined.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("at", ws.alias("ws")))).alias("all"))
    return grouped.select("host", "path", F.flatten(F.col("all.ws")).alias("words"))  # the words of one URL


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules: tuple[tuple[str, str], ...] = RULES,
) -> DataFrame:
    """(key, host, path, rule, verdict, words, log_odds) of every row.

    Null or malformed URLs have an empty host and path, no rule and the verdict
    of the classifier's prior. Rows with equal or null keys are judged each. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = stored(parse_urls(pages, key, url).withColumnRenamed(key, "_k"), "rows")
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    known = url_words(urls.select("host", "path"), stored(word_counts(pages, url, html), "counts"))
    bucket = F.transform("words", lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(BUCKETS)).cast("int"))
    bad = F.arrays_overlap("words", F.array(*[F.lit(w) for w in SEEDS]))
    named = known.select("host", "path", "words", F.array_sort(bucket).alias("buckets"), bad.alias("bad"))
    named = stored(named.join(urls, ["host", "path"]), "urls")
    prior, odds = fit(named)
    scored = named.select("host", "path", "words", _log_odds(spark, prior, odds)("buckets").alias("log_odds"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(scored, ["host", "path"], "left")
    return judged.select(
        F.col("_k").alias(key),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "words",
        "log_odds",
    )


def _log_odds(spark: SparkSession, prior: float, odds: np.ndarray) -> Callable[..., Column]:
    ratio = spark.sparkContext.broadcast(odds)  # BUCKETS numbers

    @F.pandas_udf("double")
    def log_odds(buckets: pd.Series) -> pd.Series:
        return pd.Series([prior + float(ratio.value[np.asarray(b, np.int64)].sum()) for b in buckets], dtype="float64")

    return log_odds


def fit(urls: DataFrame, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior log odds and log odds a bucket, from (buckets, bad, n).

    The first fit takes unlabelled URLs for harmless, as a larger share to start
    with draws whole domains along; each round then weighs them by the share
    that the last fit gives them in the class to block.
    Weights are whole millionths, so that sums do not hang on their order.
    """
    share = F.when(F.col("bad"), F.lit(1.0)).otherwise(F.lit(0.0))
    for _ in range(rounds + 1):
        weight = (F.round(share * UNIT).cast("bigint")).alias("p")
        weighed = urls.select("buckets", "n", weight)
        block, whole = F.sum(F.col("p") * F.col("n")).alias("block"), F.sum(F.col("n") * UNIT).alias("whole")
        sizes = weighed.agg(block, whole).first()
        seen = np.zeros((2, BUCKETS))
        for r in weighed.select("p", "n", F.explode("buckets").alias("b")).groupBy("b").agg(block, whole).collect():
            seen[:, r["b"]] += (r["block"] / UNIT, (r["whole"] - r["block"]) / UNIT)  # at most BUCKETS rows
        seen[:, seen.sum(axis=0) > 0] += SMOOTHING  # the words that occur; no other bucket is ever looked up
        sums = np.maximum(seen.sum(axis=1, keepdims=True), SMOOTHING)
        odds = np.subtract(*np.log(np.maximum(seen, SMOOTHING) / sums))
        in_block, in_all = (sizes["block"] or 0) / UNIT, (sizes["whole"] or 0) / UNIT
        prior = math.log((in_block + 1) / (in_all - in_block + 1))
        told = _log_odds(urls.sparkSession, prior, odds)("buckets")
        share = F.when(F.col("bad"), F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(-told)))
    return prior, odds
