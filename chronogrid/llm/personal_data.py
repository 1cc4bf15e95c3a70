"""Personal data: generous generators, boosted trees that judge, thresholds that select.

Four patterns give the base spans, which always stay. Generators propose more
than these: parts of digit chains that run into a neighbouring number, phone
numbers without their plus, windows of dotted chains, addresses that spell out
their signs. The proposals of one place overlap. Boosted trees score each by
its form and its surroundings; they learn from the base spans (and from copies
of them in other spellings and places) against proposals that cut a base span
differently, lie inside a word or break the format. Thresholds are set for
each kind on rows kept from the training, and of overlapping proposals above
them the best stays.

All of it is column expressions on the row of the text: nothing is shuffled,
and the fitted trees are part of the expression.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import hash_share, stored

KINDS = ("email", "ip", "card", "phone")
# the patterns of the base spans; possessive, and entered at the start of a run only, so that no text takes quadratic time
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# the wider patterns of the generators
SPELLED = (
    r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?: ?[(\[{<] ?at ?[)\]}>] ?| at )[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[(\[{<] ?dot ?[)\]}>] ?| dot )[A-Za-z0-9-]++)++"
)
HINT = r"(?i)\bdot\b|[(\[{<] ?at ?[)\]}>]"
NO_DOMAIN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?!\.?[A-Za-z0-9-])"
DOTTED = r"(?<![0-9])[0-9]++(?:\.[0-9]++){4,}+"
LOCAL = r"(?<![0-9.+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
WORDS = {
    "email": r"e-?mail|mailto|contact|courriel|correo",
    "ip": r"\bip\b|addr|host|server|login",
    "card": r"card|visa|credit|karte|carte|tarjeta|iban",
    "phone": r"phone|tel|call|mobile|fax|whatsapp",
    "other": r"order|invoice|isbn|serial|version|token|sha|hash|\bid\b|ref|sku|doi",
}
AROUND = 40
CALIBRATION = 0.3
PRECISION = 0.98
TREES = 12
DEPTH = 3
BLOCK = 128


class Model(NamedTuple):
    """Trees as nested tuples (feature, threshold, left, right) or a leaf's value, with weights; a threshold for each kind."""

    trees: list
    weights: list[float]
    thresholds: dict[str, float]


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, ... numbers, in blocks, so that long arrays are not copied number by number."""
    nothing = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        last = lambda done: F.coalesce(F.get(done, F.size(done) - F.lit(1)), F.lit(0))
        return F.aggregate(block, nothing, lambda done, v: F.concat(done, F.array(last(done) + v)))

    def blocks(all_values: Column) -> Column:
        last = F.call_function("div", F.size(all_values) - F.lit(1), F.lit(BLOCK)).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), last), lambda b: within(F.slice(all_values, b * F.lit(BLOCK) + F.lit(1), BLOCK))
        )
        return F.when(F.size(all_values) == 0, nothing).otherwise(_bound(cut, joined))

    def joined(parts: Column) -> Column:
        ends = within(F.transform(parts, lambda p: F.get(p, F.size(p) - F.lit(1))))
        return _bound(
            ends,
            lambda e: F.flatten(
                F.transform(parts, lambda p, i: F.transform(p, lambda v: v + F.coalesce(F.get(e, i - F.lit(1)), F.lit(0))))
            ),
        )

    return _bound(values, blocks)


def islands(text: Column, pattern: str) -> Column:
    """(s, e, m, before, after) of the leftmost matches that do not overlap, in code points, with what stands around them."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("ms"), F.split(text, pattern, -1).alias("gaps"))

    def placed(b: Column) -> Column:
        ms, gaps = b["ms"], b["gaps"]
        steps = F.transform(
            ms, lambda m, i: F.char_length(F.get(gaps, i)) + F.coalesce(F.char_length(F.get(ms, i - F.lit(1))), F.lit(0))
        )
        empty = F.lit("")

        def one(starts: Column) -> Column:
            return F.transform(
                ms,
                lambda m, i: F.struct(
                    F.get(starts, i).alias("s"),
                    (F.get(starts, i) + F.char_length(m)).alias("e"),
                    m.alias("m"),
                    F.right(F.concat(F.coalesce(F.get(ms, i - F.lit(1)), empty), F.get(gaps, i)), F.lit(AROUND)).alias("before"),
                    F.left(F.concat(F.get(gaps, i + F.lit(1)), F.coalesce(F.get(ms, i + F.lit(1)), empty)), F.lit(AROUND)).alias("after"),
                ),
            )

        return F.when(F.size(ms) > 0, _bound(running_sums(steps), one)).otherwise(_no_islands())

    return _bound(both, placed)


def _no_islands() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _byte_parts(m: Column) -> Column:
    """All dotted parts are at most 255."""

    def fits(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+", "")
        return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), fits)


def _between(value: Column, low: int, high: int) -> Column:
    return (value >= low) & (value <= high)


def valid(kind: str, m: Column) -> Column:
    """A match of the base pattern is a base span."""
    if kind == "ip":
        return _byte_parts(m)
    if kind == "card":
        return _bound(_digits(m), lambda d: _between(F.length(d), 16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return _between(F.length(_digits(m)), 8, 15)
    return F.lit(True)


def _parts(
    island: Column, separator: str, most: int, low: int, high: int, from_first: bool = False, of_tokens: bool = False, luhn: bool = False
) -> Column:
    """Runs of neighbouring tokens of an island, as islands of their own.

    Tokens end with a ``separator`` character, which is not part of a run's
    end. A run has at most ``most`` tokens and ``low`` to ``high`` digits
    (``of_tokens``: tokens), with ``luhn`` only if the checksum holds. Runs are
    put together from their few tokens, so a long island costs no more a run.
    """

    def runs(t: Column) -> Column:
        bare = F.transform(t, _digits)

        def listed(b: Column) -> Column:
            ends, counts, digits = b["ends"], b["counts"], b["digits"]
            starts = F.array(F.lit(0)) if from_first else F.sequence(F.lit(0), F.size(t) - F.lit(1))

            def before(sums: Column, i: Column) -> Column:
                return F.coalesce(F.get(sums, i - F.lit(1)), F.lit(0))

            def joined(i: Column, n: Column | int, tokens: Column) -> Column:
                return F.array_join(F.slice(tokens, i + F.lit(1), n), "")

            def from_start(i: Column) -> Column:
                stops = F.sequence(i, F.least(i + F.lit(most - 1), F.size(t) - F.lit(1)))

                def fits(j: Column) -> Column:
                    enough = _between(F.get(counts, j) - before(counts, i), low, high)
                    return enough & F.call_function("luhn_check", joined(i, j - i + F.lit(1), digits)) if luhn else enough

                def made(j: Column) -> Column:
                    whole, behind = joined(i, j - i + F.lit(1), t), F.greatest(i - F.lit(AROUND), F.lit(0))
                    last = F.get(t, j)
                    m = F.regexp_replace(whole, f"{separator}$", "")
                    s = (island["s"] + before(ends, i)).cast("int")
                    left = F.concat(F.when(behind > 0, F.lit("")).otherwise(island["before"]), joined(behind, i - behind, t))
                    right = F.concat(
                        F.regexp_extract(last, f"{separator}$", 0), joined(j + F.lit(1), F.lit(AROUND), t), island["after"]
                    )
                    return F.struct(
                        s.alias("s"),
                        (s + F.char_length(m)).cast("int").alias("e"),
                        m.alias("m"),
                        F.right(left, F.lit(AROUND)).alias("before"),
                        F.left(right, F.lit(AROUND)).alias("after"),
                    )

                return F.transform(F.filter(stops, fits), made)

            return F.flatten(F.transform(starts, from_start))

        sums = F.struct(
            running_sums(F.transform(t, F.char_length)).alias("ends"),
            running_sums(F.transform(t, lambda x: F.lit(1) if of_tokens else F.length(_digits(x)))).alias("counts"),
            bare.alias("digits"),
        )
        return _bound(sums, listed)

    return _bound(F.split(island["m"], f"(?<={separator})", -1), runs)


def _edge_digits(cuts: Column) -> Column:
    return F.filter(cuts, lambda c: c["m"].rlike("[0-9]$"))


def proposals(kind: str, text: Column, base: Column) -> Column:
    """Overlapping islands that may be of ``kind``, on rows of ``_with_matches``; ``base`` has matches of the base pattern."""
    if kind == "email":
        spelled = F.when(F.col("spelled"), islands(text, SPELLED)).otherwise(_no_islands())
        return F.concat(base, F.when(F.col("at"), islands(text, NO_DOMAIN)).otherwise(_no_islands()), spelled)
    if kind == "ip":
        longer = F.when(F.col("digits"), islands(text, DOTTED)).otherwise(_no_islands())
        longer = F.flatten(F.transform(longer, lambda i: _parts(i, r"\.", 4, 4, 4, of_tokens=True)))
        return F.concat(base, longer)
    if kind == "card":
        chains = F.filter(base, lambda b: F.length(_digits(b["m"])) >= 13)
        whole = F.filter(chains, lambda b: F.length(_digits(b["m"])) <= 19)
        return F.array_distinct(F.concat(whole, F.flatten(F.transform(chains, lambda i: _parts(i, "[ -]", 19, 13, 19, luhn=True)))))
    starts = F.flatten(F.transform(base, lambda i: _edge_digits(_parts(i, " ", 8, 8, 15, from_first=True))))
    return F.concat(base, starts, F.when(F.col("digits"), islands(text, LOCAL)).otherwise(_no_islands()))


FEATURES = (
    "kind n_digits n_chars n_tokens longest first luhn bytes plus paren at_sign spelled labels last_label letters "
    "word_before word_after digit_before digit_after own_words other_words digits_before digits_after"
).split()


def features(kind: Column, m: Column, before: Column, after: Column) -> Column:
    """Array of FEATURES of a proposal: its form and what stands around it, no identity of the text."""

    def flag(c: Column) -> Column:
        return c.cast("int").cast("double")

    def number(c: Column) -> Column:
        return c.cast("double")

    def listed(b: Column) -> Column:
        digits, tokens, around = b["digits"], b["tokens"], b["around"]
        own = F.lit(False)
        for place, name in enumerate(KINDS):
            own = own | ((kind == place) & around.rlike(WORDS[name]))
        return F.array(
            number(kind),
            number(F.length(digits)),
            number(F.least(F.char_length(m), F.lit(100))),
            number(F.size(tokens)),
            number(F.array_max(F.transform(tokens, F.char_length))),
            number(F.char_length(F.get(tokens, 0))),
            flag(F.call_function("luhn_check", digits)),
            flag(F.when(kind == 1, _byte_parts(m)).otherwise(False)),
            flag(m.startswith("+")),
            flag(F.contains(m, F.lit("("))),
            flag(F.contains(m, F.lit("@"))),
            flag(m.rlike(r"(?i)\bat\b")),
            number(F.size(F.split(m, r"(?i)\.|\bdot\b"))),
            number(F.char_length(F.regexp_extract(m, "([A-Za-z]*)$", 1))),
            flag(m.rlike("[A-Za-z]")),
            flag(before.rlike("[A-Za-z0-9_]$")),
            flag(after.rlike("^[A-Za-z0-9_]")),
            flag(before.rlike("[0-9][^A-Za-z0-9\n]{0,2}$")),
            flag(after.rlike("^[^A-Za-z0-9\n]{0,2}[0-9]")),
            flag(own),
            flag(around.rlike(WORDS["other"])),
            number(F.length(_digits(F.right(before, F.lit(20))))),
            number(F.length(_digits(F.left(after, F.lit(20))))),
        )

    around = F.lower(F.concat(before, F.lit(" "), F.left(after, F.lit(10))))
    made = F.struct(_digits(m).alias("digits"), F.split(m, "[^A-Za-z0-9]+").alias("tokens"), around.alias("around"))
    return _bound(made, listed)


def _tree_score(tree, found: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(F.get(found, F.lit(feature)) <= threshold, _tree_score(left, found)).otherwise(_tree_score(right, found))


def score(model: Model, found: Column) -> Column:
    """Probability that a proposal with these features is personal data; 0 without trees."""
    if not model.trees:
        return F.lit(0.0)
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.weights):
        margin = margin + _tree_score(tree, found) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * F.lit(-2.0)))


def _nested(node) -> tuple | float:
    """A fitted node as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _nested(node.leftChild()), _nested(node.rightChild())


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _with_matches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, what may be in t, and for each kind all matches of its base pattern)."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    rows = rows.select("k", "t", t.rlike("[0-9]").alias("digits"), t.rlike(HINT).alias("spelled"), F.contains(t, F.lit("@")).alias("at"))
    rows = rows.select("*", (F.col("digits") | F.col("spelled") | F.col("at")).alias("any"))
    worth = {
        "email": (EMAIL, F.col("at")),
        "ip": (IP, F.col("digits")),
        "card": (CARD, F.col("digits")),
        "phone": (PHONE, F.col("digits") & F.contains(t, F.lit("+"))),
    }
    return rows.select("*", *[F.when(c, islands(t, p)).otherwise(_no_islands()).alias(f"all_{k}") for k, (p, c) in worth.items()])


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, m, before, after, label): proposals of all kinds, from one reading; label is null where nothing is known."""
    rows = _with_matches(docs, key, text).where("any")
    rows = rows.select("*", *[F.filter(f"all_{kind}", lambda b: valid(kind, b["m"])).alias(f"base_{kind}") for kind in KINDS])
    found = []
    for place, kind in enumerate(KINDS):

        def known(p: Column) -> Column:
            base = F.col(f"base_{kind}")
            is_base = F.exists(base, lambda b: (b["s"] == p["s"]) & (b["e"] == p["e"]))
            broken = {
                "email": lambda: ~p["m"].rlike(r"(?i)\.|\bdot\b"),
                "ip": lambda: ~_byte_parts(p["m"]),
                "card": lambda: ~F.call_function("luhn_check", _digits(p["m"])),
                "phone": lambda: ~valid("phone", p["m"]),
            }[kind]()
            in_word = p["before"].rlike("[A-Za-z0-9_]$") | p["after"].rlike("^[A-Za-z0-9_]")
            wrong = F.exists(base, lambda b: _overlap(b, p)) | broken | in_word
            label = F.when(is_base, F.lit(1.0)).when(wrong, F.lit(0.0))
            return F.struct(F.lit(place).alias("kind"), p["m"].alias("m"), p["before"].alias("before"), p["after"].alias("after"), label.alias("label"))

        found.append(F.transform(F.array_distinct(proposals(kind, F.col("t"), F.col(f"all_{kind}"))), known))
    return rows.select(F.inline(F.concat(*found)))


def other_places(known: DataFrame) -> DataFrame:
    """Copies of known spans as the generators meet them elsewhere.

    Phones without a prefix, addresses with their signs spelled out, and spans
    that a neighbouring number is joined to.
    """
    sure = known.where("label = 1")
    numbers = sure.where(F.col("kind") != KINDS.index("email"))
    behind = numbers.withColumn("before", F.concat("before", F.lit("4527 ")))
    ahead = numbers.withColumn("after", F.concat(F.lit(" 6081"), "after"))
    phones = sure.where(F.col("kind") == KINDS.index("phone")).withColumn("m", F.regexp_replace("m", r"^\+[0-9]{1,3} ?", ""))
    emails = sure.where(F.col("kind") == KINDS.index("email"))
    spelled = emails.withColumn("m", F.regexp_replace(F.regexp_replace("m", "@", " at "), r"\.(?=[A-Za-z0-9-]+(?:\.|$))", " dot "))
    bracketed = emails.withColumn("m", F.regexp_replace("m", "@", " [at] "))
    changed = phones.where(F.length(_digits(F.col("m"))) >= 7)
    for copies in (spelled, bracketed, behind, ahead):
        changed = changed.unionByName(copies)
    return changed


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kept, kind, found, label, n): every labelled proposal of every document, and its copies in other places.

    Proposals of equal features and label are one row of weight ``n``. ``kept`` marks the share that sets the
    thresholds; equal proposals with equal surroundings are on one side.
    """
    known = stored(labelled(docs, key, text).where("label is not null"), "proposals")
    share = hash_share(F.concat_ws("|", "kind", "m", "before", "after"))
    each = known.unionByName(other_places(known)).select(
        (share < CALIBRATION).alias("kept"), "kind", features(F.col("kind"), F.col("m"), F.col("before"), F.col("after")).alias("found"), "label"
    )
    return each.groupBy("kept", "kind", "found", "label").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Trees and thresholds from all labelled proposals of all documents.

    Without proposals of both labels there are no trees, and base spans alone are found.
    """
    nothing = Model([], [], {kind: 2.0 for kind in KINDS})
    # sorted, so that sums of fractions come out alike in every run
    rows = stored(training_rows(docs, key, text).sortWithinPartitions("found", "label"), "examples")
    fitted = rows.where("not kept").select(array_to_vector("found").alias("features"), "label", F.col("n").cast("double").alias("n"))
    if len(fitted.select("label").distinct().collect()) < 2:
        return nothing
    grower = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, stepSize=0.3, cacheNodeIds=False, weightCol="n")
    boosted = grower.fit(fitted)
    model = Model([_nested(t._call_java("rootNode")) for t in boosted.trees], list(boosted.treeWeights), nothing.thresholds)
    judged = rows.where("kept").select("kind", "label", "n", F.floor(score(model, F.col("found")) * 200).alias("step"))
    steps = judged.groupBy("kind", "step").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    return model._replace(thresholds={kind: _threshold([r for r in steps if r["kind"] == i]) for i, kind in enumerate(KINDS)})


def _threshold(steps: list, precision: float = PRECISION) -> float:
    """Lowest two-hundredth from one half up at and above which every step upwards keeps the precision; 2 if none does."""
    best, right, n = 2.0, 0.0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        right, n = right + r["right"], n + r["n"]
        if r["step"] < 100 or right < precision * n:
            break
        best = r["step"] / 200
    return best


def _selected(found: Column, kind: int, model: Model) -> Column:
    """Proposals of a kind with their scores, those at its threshold and above."""

    def judged(p: Column) -> Column:
        points = _bound(features(F.lit(kind), p["m"], p["before"], p["after"]), lambda f: score(model, f))
        return F.struct(F.lit(kind).alias("kind"), p["s"].alias("s"), p["e"].alias("e"), points.alias("score"))

    return F.filter(F.transform(found, judged), lambda c: c["score"] >= model.thresholds[KINDS[kind]])


def _best(found: Column) -> Column:
    """Of overlapping spans the one with the highest score, then the first, then the longest."""
    order = F.array_sort(
        F.transform(found, lambda c: F.struct((-c["score"]).alias("low"), c["s"].alias("s"), (-c["e"]).alias("back"), c["kind"].alias("kind")))
    )
    spans = F.transform(order, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), (-c["back"]).alias("e")))
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    return F.aggregate(spans, none, lambda kept, c: F.when(F.exists(kept, lambda o: _overlap(o, c)), kept).otherwise(F.concat(kept, F.array(c))))


def find_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): arrays of (kind, s, e), by kind and start, in code points with the end exclusive.

    Null text counts as empty and has no spans. Rows with equal or null keys
    are judged each on its own. An empty table gives an empty result. Other
    columns are not read. An added span overlaps no base span and no other
    added one.
    """
    rows = _with_matches(docs, key, text)
    base = [
        F.transform(
            F.filter(f"all_{kind}", lambda b: valid(kind, b["m"])),
            lambda b: F.struct(F.lit(place).alias("kind"), b["s"].alias("s"), b["e"].alias("e")),
        )
        for place, kind in enumerate(KINDS)
    ]
    rows = rows.select("*", F.concat(*base).alias("base"))
    found = []
    for place, kind in enumerate(KINDS):
        # a base span is not proposed again, and nothing that overlaps one could stay
        rest = F.filter(f"all_{kind}", lambda b: ~valid(kind, b["m"])) if kind != "email" else _no_islands()
        free = F.filter(proposals(kind, F.col("t"), rest), lambda p: ~F.exists("base", lambda b: _overlap(b, p)))

        found.append(_selected(free, place, model))
    none = F.array().cast("array<struct<kind:int,s:int,e:int,score:double>>")
    wanted = F.when(F.col("any"), F.concat(*found)).otherwise(none)
    rows = rows.select("k", "base", wanted.alias("wanted"))
    return rows.select(F.col("k").alias(key), "base", F.array_sort(_best(F.col("wanted"))).alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and hash of the base spans, then all spans.

    See ``find_spans`` for nulls, repeats and empty tables.
    """
    found = find_spans(docs, train(docs, key, text), key, text)
    kinds = F.transform("base", lambda b: b["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, F.lit(i)))).cast("bigint").alias(f"n_{kind}") for i, kind in enumerate(KINDS)
    ]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select(key, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(everything).alias("spans"))
