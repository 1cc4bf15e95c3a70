"""Line de-duplication with a segment-partition edit join.

Two lines within k edits, cut into k + 1 segments by the shorter one's length,
agree in one whole segment: k edits cannot touch k + 1 segments. Every distinct
line therefore puts its own k + 1 segments into an index that is keyed by
length, segment number and content, and probes the index of its own and the k
shorter lengths with the few substrings that can line up (the shift is bounded
from the left by the segments before and from the right by those behind).
Lines that meet are verified with banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import REAL_KEY, own_keys, real_keys, small_side, stored
from chronogrid.llm.components import components

MAX_EDITS = 2
MIN_CHARS = 20
HEAVY_SHARE = 10_000
MAX_BROADCAST_LINES = 400_000


def _divided(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by)).cast("int")


def with_segments(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """Add ``seg_<less>_<number>`` (1-based start) and ``size_<less>_<number>`` of the edits + 1 segments.

    ``less`` is by how much the length that is cut falls short of the line's own
    ``n`` code points; the last ``length mod (edits + 1)`` segments are one longer.
    """
    parts, columns = edits + 1, []
    for less in range(parts):
        length = F.col("n") - F.lit(less)
        size, longer = _divided(length, parts), (length % parts).cast("int")
        for number in range(parts):
            start = F.lit(1) + F.lit(number) * size + F.greatest(F.lit(number - parts) + longer, F.lit(0))
            extra = (longer >= F.lit(parts - number)).cast("int")
            columns += [start.alias(f"seg_{less}_{number}"), (size + extra).alias(f"size_{less}_{number}")]
    return lines.select("*", *columns)


def _key(less: int, number: int, shift: int = 0) -> Column:
    """Hash of length, segment number and content of one substring."""
    at = F.col(f"seg_{less}_{number}") + F.lit(shift)
    return F.xxhash64(F.col("n") - F.lit(less), F.lit(number), F.substring("line", at, F.col(f"size_{less}_{number}")))


def index_keys(edits: int = MAX_EDITS) -> Column:
    return F.array(*[_key(0, number) for number in range(edits + 1)])


def probe_keys(edits: int = MAX_EDITS) -> Column:
    """(sig, own) of the substrings that can equal a segment of a line shorter by 0 to ``edits``.

    ``own`` marks the line's own index keys, which are among its probes.
    """
    keys = []
    for less in range(edits + 1):
        for number in range(edits + 1):
            behind = edits - number
            for shift in range(max(-number, less - behind), min(number, less + behind) + 1):
                own = F.lit(less == 0 and shift == 0)
                keys.append(F.struct(_key(less, number, shift).alias("sig"), own.alias("own")))
    return F.array(*keys)


def within_edits(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """True when the code points of ``a`` and ``b`` are at most ``edits`` insertions, deletions or changes apart.

    Bit o of level d, after j characters of ``b``, says that the first
    j + o - edits characters of ``a`` are within d edits of them. A character
    of ``b`` updates all 2 edits + 1 diagonals of a level with a few bit operations.
    """
    width = 2 * edits + 1
    levels = [f"r{d}" for d in range(edits + 1)]

    def run(ps: Column, ts: Column) -> Column:
        def read(state: Column, j: Column) -> Column:
            same = F.lit(0)
            for o in range(width):
                row = j + F.lit(o - edits)  # place in a that meets this character of b on diagonal o
                same = same + F.when((row >= 0) & (F.get(ps, row) == F.get(ts, j)), F.lit(1 << o)).otherwise(F.lit(0))
            # bound once, then shared by all levels; without a bit left nothing can come back
            moved = F.get(F.transform(F.array(same), lambda m: _advance(state, m, levels, (1 << width) - 1)), 0)
            return F.when(state[levels[-1]] == 0, state).otherwise(moved)

        start = F.struct(
            *[F.lit(sum(1 << o for o in range(edits, edits + d + 1))).alias(n) for d, n in enumerate(levels)]
        )
        done = F.aggregate(F.sequence(F.lit(0), F.size(ts) - F.lit(1)), start, read)
        end = F.size(ps) - F.size(ts) + F.lit(edits)
        return F.call_function("shiftright", done[levels[-1]], end).bitwiseAND(F.lit(1)) == 1

    near = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    ends = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: _middles(s["a"], s["b"]))
    def judged(m: Column) -> Column:
        chars = F.array(F.struct(F.split(m["a"], "").alias("p"), F.split(m["b"], "").alias("t")))
        return F.get(F.transform(chars, lambda c: run(c["p"], c["t"])), 0)

    bound = F.transform(
        ends,
        lambda m: F.when(F.least(F.char_length(m["a"]), F.char_length(m["b"])) > 0, judged(m)).otherwise(F.greatest(F.char_length(m["a"]), F.char_length(m["b"])) <= edits),
    )
    return F.when(near, F.get(bound, 0)).otherwise(F.lit(False))


def _shared(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning, at most ``most``: steps of halving length are taken while they agree."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (step <= most - at) & (F.substring(a, at + F.lit(1), step) == F.substring(b, at + F.lit(1), step)), at + step
        ).otherwise(at),
    )


def _middles(a: Column, b: Column) -> Column:
    """Both texts without their common beginning and end; their distance is that of the middles."""

    def cut(head: Column) -> Column:
        rest_a = F.substring(a, head + F.lit(1), F.char_length(a))
        rest_b = F.substring(b, head + F.lit(1), F.char_length(b))
        turned = F.array(F.struct(rest_a.alias("a"), rest_b.alias("b"), F.reverse(rest_a).alias("ra"), F.reverse(rest_b).alias("rb")))
        return F.get(
            F.transform(
                turned,
                lambda r: F.get(
                    F.transform(
                        F.array(_shared(r["ra"], r["rb"], F.least(F.char_length(r["a"]), F.char_length(r["b"])))),
                        lambda tail: F.struct(
                            F.substring(r["a"], F.lit(1), F.char_length(r["a"]) - tail).alias("a"),
                            F.substring(r["b"], F.lit(1), F.char_length(r["b"]) - tail).alias("b"),
                        ),
                    ),
                    0,
                ),
            ),
            0,
        )

    head = F.array(_shared(a, b, F.least(F.char_length(a), F.char_length(b))))
    return F.get(F.transform(head, cut), 0)


def _advance(state: Column, same: Column, levels: list[str], mask: int) -> Column:
    """Next state: match or change stays on its diagonal, an extra character moves it down or up by one."""
    fields, above = [], None
    for d, name in enumerate(levels):
        now = state[name].bitwiseAND(same)
        if d:
            old = state[levels[d - 1]]
            now = now.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(above, 1))
            now = now.bitwiseAND(F.lit(mask))
        fields.append(now)
        above = now
    return F.struct(*[f.alias(n) for f, n in zip(fields, levels)])


def _lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc, at, line, n, h, g): the lines that can be duplicates, without spaces around them; h and g name the wording.

    A line under ``min_chars`` counts if it holds more than white space.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    cut = rows.select("doc", F.posexplode(F.split("t", "\n")).alias("at", "raw"))
    line = cut.select("doc", "at", F.trim("raw").alias("line"))
    sized = line.select("doc", "at", "line", F.char_length("line").alias("n"))
    sized = sized.where((F.col("n") >= min_chars) | F.col("line").rlike(r"\S"))
    return sized.select("*", F.xxhash64("line").alias("h"), _second_hash(F.col("line")).alias("g"))


def _second_hash(line: Column) -> Column:
    return F.xxhash64(F.lit("second"), line)


def line_links(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """Links between wordings, (ha, ga) to (hb, gb), that join the same classes as all pairs of lines within ``edits``.

    ``lines`` has line, n and h; copies do no harm. Every member of a key
    is first held against the smallest indexed member only. Members that are
    then still in different classes are compared in full inside the join, so
    that neither a large class is paired nor a link between classes missed.
    """
    lines = lines.select("h", "line", "n")
    cut = with_segments(lines, edits)
    heads = (
        cut.select("h", F.explode(index_keys(edits)).alias("sig"))
        .groupBy("sig")
        .agg(F.min("h").alias("head"), F.max("h").alias("top"))
    )
    probes = cut.select("h", F.inline(probe_keys(edits)))
    met = probes.join(heads, "sig").where("h <> head or head <> top")
    met = stored(met.groupBy("h", "sig", "head", "top").agg(F.max("own").alias("own")), "met")
    wanted = stored(met.select(F.explode(F.array("h", "head")).alias("h")).distinct(), "wanted")
    texts = lines.select("h", "line").join(small_side(wanted, wanted.count(), MAX_BROADCAST_LINES), "h", "left_semi")
    texts = stored(texts.distinct(), "texts")
    stars = met.where("h <> head").select(F.least("h", "head").alias("a"), F.greatest("h", "head").alias("b")).distinct()
    linked = _verified(stars, texts, edits)
    roots = components(linked).select(F.col("vertex").alias("h"), "root")
    # round two: an index with several members, of which some are in another class than others
    crowded = met.where("head <> top").join(roots, "h", "left").select("sig", "h", "own", F.coalesce("root", "h").alias("r"))
    split = crowded.groupBy("sig").agg(F.min("r").alias("main"), F.max("r").alias("other"))
    members = stored(crowded.join(split.where("main <> other").select("sig", "main"), "sig"), "members")
    members = members.join(texts, "h")
    return linked.unionByName(_strangers(members, edits)).drop("a", "b")


def _strangers(members: DataFrame, edits: int) -> DataFrame:
    """Links between members of a key that are in different classes; one of the two is indexed there.

    At least one is outside the key's main class, so members of one large class
    do not meet. The lines are compared as they meet: only links leave the join.
    """
    owners = members.where("own").select("sig", F.col("h").alias("o"), F.col("r").alias("ro"), F.col("line").alias("lo"), "main")
    differ = (F.col("r") != F.col("ro")) & within_edits(F.col("line"), F.col("lo"), edits)

    def met(askers: DataFrame, held: DataFrame) -> DataFrame:
        return askers.select("sig", "h", "r", "line").join(held.drop("main"), "sig").where(differ)

    both = met(members.where("r <> main"), owners).unionByName(met(members.where("r = main"), owners.where("ro <> main")))
    ha, hb = F.least("h", "o"), F.greatest("h", "o")
    la, lb = [F.when(F.col("h") == h, F.col("line")).otherwise(F.col("lo")) for h in (ha, hb)]
    named = both.select(
        ha.alias("a"), hb.alias("b"), ha.alias("ha"), _second_hash(la).alias("ga"), hb.alias("hb"), _second_hash(lb).alias("gb")
    )
    return stored(named.distinct(), "strangers")  # read twice: compared once


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of hashes whose lines are within ``edits``, with both hashes of both lines; ``texts`` has h and line."""
    left = texts.select(F.col("h").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("h").alias("b"), F.col("line").alias("lb"))
    checked = pairs.join(left, "a").join(right, "b").where(within_edits(F.col("la"), F.col("lb"), edits))
    named = checked.select(
        "a", "b", F.col("a").alias("ha"), _second_hash(F.col("la")).alias("ga"), F.col("b").alias("hb"), _second_hash(F.col("lb")).alias("gb")
    )
    return stored(named, "near")


def wording_classes(links: DataFrame) -> DataFrame:
    """(h, g, root) of every linked wording."""

    def name(h: str, g: str) -> Column:
        return F.concat(F.hex(h), F.lit("."), F.hex(g))

    roots = components(links.select(name("ha", "ga").alias("a"), name("hb", "gb").alias("b")))
    ends = links.select(F.col("ha").alias("h"), F.col("ga").alias("g")).union(links.select("hb", "gb")).distinct()
    return stored(ends.join(roots, name("h", "g") == F.col("vertex")).select("h", "g", "root"), "classes")


def judge_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(doc, at, own, first, near): for every line with more than white space its place and fate.

    Lines of equal wording are copies at any length; the edit join takes those of at least ``min_chars``.
    ``first`` marks the first line of its class, which stays; ``own`` is the
    document that holds that line; ``near`` marks a line that goes although it
    is the first of its exact wording.
    """
    if min_chars < (edits + 2) * (edits + 1):
        raise ValueError("lines have to be long enough for segments longer than the edits")
    lines = _lines(docs, key, text, min_chars)
    span = F.lit(1 << 31).cast("decimal(10,0)")
    place = (F.col("doc").cast("decimal(20,0)") * span + F.col("at")).cast("decimal(38,0)")
    places = stored(lines.select("doc", "at", "h", "g"), "places")
    seen = places.select("h", "g", place.alias("place"))
    wordings = stored(seen.groupBy("h", "g").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")), "wordings")
    total = wordings.agg(F.sum("n")).first()[0] or 0
    # at most HEAVY_SHARE wordings can make up a HEAVY_SHARE-th of all lines each: they enter the join once
    heavy = wordings.where(F.col("n") > F.lit(max(total // HEAVY_SHARE, 1))).select("h", "g")
    long = lines.where(F.col("n") >= min_chars)
    copies = stored(long.join(F.broadcast(heavy), ["h", "g"], "left_semi").select("line", "n", "h").distinct(), "copies")
    single = long.join(F.broadcast(heavy), ["h", "g"], "left_anti").select("line", "n", "h")
    classes = wording_classes(line_links(single.unionByName(copies), edits))
    n_linked = classes.count()
    linked = wordings.join(small_side(classes, n_linked), ["h", "g"]).select("h", "g", "root", "place")
    leads = linked.join(linked.groupBy("root").agg(F.min("place").alias("lead")), "root").select("h", "g", "lead")
    lead = F.coalesce("lead", "place")
    lead_at = F.pmod(lead, span)
    fates = wordings.join(small_side(stored(leads, "leads"), n_linked), ["h", "g"], "left").select(
        "h",
        "g",
        ((lead - lead_at) / span).cast("bigint").alias("own"),
        lead_at.cast("int").alias("own_at"),
        (F.pmod("place", span)).cast("int").alias("seen_at"),
        ((F.col("place") - F.pmod("place", span)) / span).cast("bigint").alias("seen_in"),
    )
    here = (F.col("doc") == F.col("own")) & (F.col("at") == F.col("own_at"))
    earliest = (F.col("doc") == F.col("seen_in")) & (F.col("at") == F.col("seen_at"))
    return places.join(fates, ["h", "g"]).select("doc", "at", "own", here.alias("first"), (earliest & ~here).alias("near"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its duplicate lines, and a struct ``_lines`` of figures.

    A class is a set of lines tied by links of at most ``edits`` edits, spaces
    around a line aside; its first line by (key, line number) stays, the
    others go, in the same document as well. Lines under ``min_chars`` code
    points are tied by equal wording alone, lines of white space are left as
    they are. Null texts stay null and empty ones empty. Of rows with equal key
    and equal text one stays; different texts under one key are documents of
    their own, in the order of their hash. Rows without a key
    pass unchanged and are no line's first place. ``_lines`` has n_lines,
    n_kept, n_exact, n_near and first_docs, the sorted keys that hold the first
    lines of the document's classes. An empty table gives an empty result.
    """
    docs = own_keys(docs, key, text)
    fates = judge_lines(docs, key, text, edits, min_chars)
    if REAL_KEY in docs.columns:
        keys = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("own"), F.col(REAL_KEY).alias("_own"))
        fates = fates.join(keys, "own").drop("own").withColumnRenamed("_own", "own")
    gone = fates.groupBy("doc").agg(
        F.collect_list(F.when(~F.col("first"), F.col("at"))).alias("gone"),
        F.coalesce(F.sum(F.col("near").cast("bigint")), F.lit(0)).alias("n_near"),
        F.array_sort(F.collect_set("own")).alias("first_docs"),
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = packed.join(gone, F.col(f"_row.`{key}`") == F.col("doc"), "left")
    raw = F.col(f"_row.`{text}`")
    cut = joined.select(
        "_row",
        F.split(raw, "\n").alias("ls"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - F.lit(1)), F.col("gone"))
    # the lines are bound once, so that no element access splits the text again
    joined_text = F.transform(
        F.array(F.struct("ls", stay.alias("stay"))),
        lambda s: F.array_join(F.transform(s["stay"], lambda i: F.get(s["ls"], i)), "\n"),
    )[0]
    n_gone = F.size("gone").cast("bigint")
    n_lines = F.when(raw.isNull(), F.lit(0)).otherwise(F.size("ls")).cast("bigint")
    out = cut.select(
        "_row",
        F.when(n_gone == 0, raw).otherwise(joined_text).alias("_text"),
        F.struct(
            n_lines.alias("n_lines"),
            (n_lines - n_gone).alias("n_kept"),
            (n_gone - F.col("n_near")).alias("n_exact"),
            F.col("n_near").alias("n_near"),
            F.col("first_docs").alias("first_docs"),
        ).alias("_lines"),
    )
    kept = out.select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "_lines"
    )
    return real_keys(kept, key)
