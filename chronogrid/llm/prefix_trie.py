"""Trie of conversation prefixes by van Emde Boas recursion over depth.

A block of 2^k turns is named from its two halves, so all cut prefixes get
their names in log2(depth) rounds: a sequence is cut at half depth, the upper
part's name is the tree in which the lower part is named. The totals come back
the same way. Going up the sizes, the lower half of every piece is summed into
the node it hangs from; then, from the largest size down, the totals of whole
lower forests are grafted onto the nodes halfway between. A round works on all
pieces of one size in all trees at once, and a piece twice the size comes half
as often, so the work stays in proportion to the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import small_side, stored
from chronogrid.operators.ordered import with_group_position

GROUP = 5
MAX_SHARED = 9
CHUNK_BITS = 9
ROOT = "root"
TOTALS = ("n_leaves", "saved_tokens")


def _named(*parts: Column | str) -> Column:
    """Name of a few names or of words told apart by their lengths: 128 bits as text."""
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 32)


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, at, e, size): 1-based places, the name of role and text, UTF-8 bytes of the text.

    Turns go by number, null first; of equal ones those with the smaller role
    and then text come first. A conversation of any length stays spread.
    """
    plain = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).isNotNull().alias("told"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    tied = plain.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = stored(tied.select(F.col("conv").alias("c"), F.col("turn").alias("t")), "tied")
    n_tied = tied.count()
    words = F.lit(None).cast("string")
    if n_tied:  # only turns with equal numbers carry their wording through the sort
        same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        plain = plain.join(small_side(tied, n_tied), same, "left")
        words = F.when(F.col("c").isNotNull(), F.struct("role", "text"))
    narrow = plain.select(
        "conv",
        "told",
        "turn",
        words.alias("words"),
        # equal rows are alike, so any number that tells them apart only helps to spread them
        F.monotonically_increasing_id().alias("row"),
        _named(F.char_length("role").cast("string"), "role", "text").alias("e"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    placed = with_group_position(narrow, ["conv"], ["told", "turn", "words", "row"], "at")
    return stored(placed.select("conv", "at", "e", "size"), "turns")


def rebuilt(numbered: DataFrame, group: int = GROUP, shared: int = MAX_SHARED) -> DataFrame:
    """(conv, at, e, size) of every conversation after it took over the first turns of the first of its group."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(shared))
    convs = numbered.select("conv").distinct()
    asked = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("from"))
    start = numbered.where(F.col("at") < shared).select(F.col("conv").alias("from"), "at", "e", "size")
    taken = stored(asked.join(start, "from").where("at <= h").select("conv", "at", "e", "size"), "taken")
    n_taken = taken.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    own = numbered.where(F.col("at") > h).join(n_taken, "conv", "left")
    # own turns follow those taken over, of which there can be fewer than h
    moved = own.select("conv", (F.col("at") - h + F.coalesce("n", F.lit(0))).cast("bigint").alias("at"), "e", "size")
    return stored(taken.unionByName(moved), "rebuilt")


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv, at, up, name, size): the name of the first ``at`` turns, and that of the prefix in whose tree they were cut.

    ``up`` is shorter by the largest power of two in ``at``.
    """
    longest = turns.agg(F.max("at")).first()[0] or 0
    # contents of whole blocks of 2^k turns, each from two of half the size
    blocks = [turns.select("conv", (F.col("at") - F.lit(1)).alias("block"), F.col("e").alias("content"))]
    while 1 << len(blocks) <= longest:
        lower = (F.col("block") % 2).cast("boolean")
        pairs = blocks[-1].groupBy("conv", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~lower, F.col("content"))).alias("upper"), F.max(F.when(lower, F.col("content"))).alias("lower")
        )
        whole = pairs.where("lower is not null").select("conv", "block", _named("upper", "lower").alias("content"))
        blocks.append(stored(whole, "blocks"))
    known = None
    for k in reversed(range(len(blocks))):
        # an odd multiple of 2^k turns: what lies before the last block has its name already
        ends = blocks[k].where("block % 2 = 0").select("conv", F.shiftleft("block", k).alias("before"), "content")
        cut = ends.select("*", F.lit(ROOT).alias("up"))
        if known is not None:
            upper = known.select("conv", F.col("at").alias("before"), F.col("name").alias("seen"))
            cut = ends.join(upper, ["conv", "before"], "left").select("*", F.coalesce("seen", F.lit(ROOT)).alias("up"))
        name = _named(F.lit(str(k)), "up", "content").alias("name")
        found = stored(cut.select("conv", (F.col("before") + F.lit(1 << k)).alias("at"), "up", name), "prefixes")
        known = found if known is None else known.unionByName(found)
    return stored(known.join(turns.select("conv", "at", "size"), ["conv", "at"]), "names")


def nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(name, depth, conv_id, n_convs, size, up, parent, n_children): one row per node, the root among them."""
    found = members.groupBy("name").agg(
        F.max("at").alias("depth"),
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("size").alias("size"),
        F.max("up").alias("up"),
    )
    found = stored(found, "found")
    above = members.select(F.col("conv").alias("conv_id"), (F.col("at") + F.lit(1)).alias("depth"), F.col("name").alias("above"))
    even = found.where("depth % 2 = 0").join(above, ["conv_id", "depth"]).withColumnRenamed("above", "parent")
    # the node above an odd depth is where the prefix was cut
    tied = even.unionByName(found.where("depth % 2 = 1").withColumn("parent", F.col("up")))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    root = root.select(
        F.lit(ROOT).alias("name"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("size"), nothing.alias("up"), nothing.alias("parent")
    )
    tied = stored(tied.unionByName(root), "tied")
    children = tied.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "name")
    counted = tied.join(children, "name", "left")
    return stored(counted.withColumn("n_children", F.coalesce("n_children", zero)), "nodes")


def _sums(rows: DataFrame, to: str) -> DataFrame:
    """What ``rows`` bring to the nodes they name in ``to``."""
    return rows.groupBy(F.col(to).alias("name")).agg(*[F.sum(c).alias(f"more_{c}") for c in TOTALS])


def _added(rows: DataFrame, brought: DataFrame) -> DataFrame:
    more = rows.join(brought, "name", "left")
    sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("bigint"))).alias(c) for c in TOTALS]
    return more.select("name", "depth", "conv_id", "up", *sums)


def subtree_totals(trie: DataFrame, members: DataFrame) -> DataFrame:
    """(name, n_leaves, saved_tokens): sums over the subtree of every node, its top included."""
    own = trie.select(
        "name",
        "depth",
        "conv_id",
        "up",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - F.lit(1)) * F.col("size")).alias("saved_tokens"),
    )
    deepest = trie.agg(F.max("depth")).first()[0] or 0
    levels = deepest.bit_length()
    # upwards: a node of level k, an odd multiple of 2^k deep, gets its next 2^k depths, then adds them where it was cut
    rest, upper = own, []
    for k in range(levels):
        odd = F.col("depth") % (2 << k) != 0
        upper.append(stored(rest.where(odd), "upper"))
        rest = stored(_added(rest.where(~odd), _sums(upper[k], "up")), "rest")
    # downwards: the whole subtrees that begin 2^k below such a node are grafted onto it; they are known from larger sizes
    done = rest
    for k in reversed(range(levels)):
        lower = done.where(F.col("depth") > 0)
        above = members.select(F.col("conv").alias("conv_id"), (F.col("at") + F.lit(1 << k)).alias("depth"), F.col("name").alias("above"))
        cut = above.where((F.col("depth") % (2 << k)) == 0)
        grafts = _sums(lower.join(cut, ["conv_id", "depth"]), "above")
        done = done.unionByName(stored(_added(upper[k], grafts), "grafted"))
    return done.select("name", *TOTALS)


def ends_digests(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(name, ends_sha256): hash of the ascending comma-joined numbers of the conversations that end in a node.

    The numbers are joined in short runs first. Only nodes with several runs
    pass through a task in order, run by run, which keeps one hash in memory.
    """
    last = members.groupBy("conv").agg(F.max_by("name", "at").alias("name"))
    ends = convs.join(last, "conv", "left").select("conv", F.coalesce("name", F.lit(ROOT)).alias("name"))
    runs = ends.groupBy("name", F.shiftright("conv", CHUNK_BITS).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("joined")
    )
    runs = stored(runs, "runs")
    several = runs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    single = runs.join(several, "name", "left_anti").select("name", F.sha2("joined", 256).alias("ends_sha256"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, digest = None, None
        for batch in batches:
            out = []
            for at, joined in zip(batch["name"], batch["joined"]):
                if at == name:
                    digest.update(b"," + joined.encode())
                    continue
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = at, hashlib.sha256(joined.encode())
            yield pd.DataFrame(out, columns=["name", "ends_sha256"])
        if name is not None:
            yield pd.DataFrame([(name, digest.hexdigest())], columns=["name", "ends_sha256"])

    crowded = runs.join(several, "name", "left_semi").repartition("name").sortWithinPartitions("name", "run")
    return single.unionByName(crowded.mapInPandas(work, "name string, ends_sha256 string"))


def prefix_trie(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    group: int = GROUP,
    shared: int = MAX_SHARED,
) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    Null roles and texts count as empty, null turns come first, turns of equal
    number go by role and text, and repeated rows are turns of their own. Rows
    without a conversation are in none. The remainder of a negative number is
    negative, as SQL has it. Conversations left without a turn end in the root.
    An empty table gives an empty result. Other columns are not read.
    """
    numbered = numbered_turns(turns, conv, turn, role, text)
    convs = stored(numbered.select("conv").distinct(), "convs")
    members = prefix_names(rebuilt(numbered, group, shared))
    trie = nodes(members, convs)
    parents = trie.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = trie.join(subtree_totals(trie, members), "name").join(ends_digests(members, convs), "name", "left")
    return whole.join(parents, "parent", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        *TOTALS,
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
