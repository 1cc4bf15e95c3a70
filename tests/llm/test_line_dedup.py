from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronogrid.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, edits=2, min_chars=20):
    """{doc_id: text} by all pairs of lines; keys are unique and not null here."""
    places = {}
    for key, text in sorted(rows):
        for at, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" ")
            if text is not None and line and not line.isspace():
                places.setdefault(line, []).append((key, at))
    lines = list(places)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                parent[find(a)] = find(b)
    first = {}
    for x in lines:
        first[find(x)] = min(first.get(find(x), (float("inf"), 0)), min(places[x]))
    gone = {p for x in lines for p in places[x] if p != first[find(x)]}
    return {
        key: None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (key, at) not in gone)
        for key, text in rows
    }


def mutated(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at = rng.randrange(len(chars) + 1)
        how = rng.randrange(3)
        if how == 0:
            chars.insert(at, rng.choice("abcé"))
        elif at < len(chars):
            if how == 1:
                del chars[at]
            else:
                chars[at] = rng.choice("abcé")
    return "".join(chars)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randint(0, 25)))
        pairs.append((a, mutated(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert r["near"] == (distance(r["a"], r["b"]) <= edits), r


def test_random_lines_match_brute_force(make_docs):
    rng = random.Random(9)
    stock = ["".join(rng.choices("abcde fgé", k=rng.randint(18, 60))).strip() + "." for _ in range(40)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(stock)
            lines.append(mutated(rng, line, rng.choice([0, 0, 1, 2, 3, 5])) if rng.random() < 0.7 else "short")
        rows.append((d, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_large_group_of_near_copies(make_docs):
    """Many lines that share a segment in one class and strangers that share it too."""
    head = "x" * 30
    rows = [(i, head + f"{i:030b}") for i in range(64)] + [(100 + i, head + f"{i * 37:030d}") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_crowded_segment_with_strangers_and_neighbours(make_docs):
    """A hundred lines share head and tail; their middles are strangers, but for some that are an edit or two apart."""
    rng = random.Random(12)
    head, tail = "the first part of this line " * 2, " and so it ends as all others do here"
    middles = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(70)]
    middles += [mutated(rng, m, rng.choice([1, 2])) for m in middles[:30]] + [mutated(rng, m, 4) for m in middles[30:50]]
    rows = [(i, head + m + tail) for i, m in enumerate(middles)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_edge_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_lines"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == out.count() == len({r[0] for r in odd_rows})  # one row per key
    assert rows[None]["text"].endswith("again")  # without a key: unchanged
    assert rows[1]["text"].startswith("the quick") and rows[2]["text"] == ""
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == " \n\t \n"
    assert rows[2]["_lines"]["n_kept"] == 0 and rows[2]["_lines"]["first_docs"] == [1]
    assert rows[10]["_lines"]["n_near"] == 1 and rows[10]["_lines"]["n_exact"] == 0
    assert rows[6]["text"] == dict((r[0], r[1]) for r in odd_rows)[6]
    assert rows[7]["_lines"]["n_kept"] == 1  # five characters more are no near copy


def test_empty_table(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).collect() == []


def test_repeats_inside_a_document(make_docs):
    line = "this line is said twice in here"
    got = line_dedup.dedup_lines(make_docs([(1, f"{line}\nother\n  {line}\t\nother\n{line} ")])).collect()
    assert got[0]["text"] == f"{line}\nother"


def test_short_lines_are_tied_by_equal_wording_alone(make_docs):
    rows = [(1, "Les.\nno\n \n"), (2, " Les.\nNo\n \nLes"), (3, "Les.\nthe end of it all comes here"), (4, "\t\n東京"), (5, "\t\n東京\nno")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)
    assert got[2] == "No\n \nLes" and got[3] == "the end of it all comes here" and got[5] == "\t"


def test_different_texts_under_one_key_all_stay(make_docs):
    """A third of the rows has one key; every text is judged as a document of its own, in the order of key and hash."""
    line = "this line is said by some of them all over again"
    rows = [(7, f"{c * 12} under the crowded key\n{line}") for c in "abcdefghijklmno"] + [(7, "twice the same")] * 3
    rows += [(3, line), (8, f"{line}\nlast of all"), (None, "twice the same")]
    out = line_dedup.dedup_lines(make_docs(rows))
    assert out.columns == [*make_docs([]).columns, "_lines"]
    got = out.collect()
    assert len(got) == 15 + 1 + 3 and sum(r["doc_id"] == 7 for r in got) == 16
    texts = sorted(r["text"] for r in got if r["doc_id"] == 7)
    assert texts == sorted([f"{c * 12} under the crowded key" for c in "abcdefghijklmno"] + ["twice the same"])
    by_key = {r["doc_id"]: r for r in got}
    assert by_key[3]["text"] == line and by_key[8]["text"] == "last of all" and by_key[None]["text"] == "twice the same"
    assert by_key[8]["_lines"]["first_docs"] == [3, 8]
