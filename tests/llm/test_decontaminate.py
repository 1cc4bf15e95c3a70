from __future__ import annotations

import hashlib
import random
import re

from chronogrid.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def words(text):
    return [w for w in WORD.findall((text or "").encode().lower())]


def plain(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    found |= windows[tuple(w[i : i + size])]
                    hit.update(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def check(spark, make_docs, rows, items):
    found = decontaminate.contamination(make_docs(rows), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, found.collect()), key=repr) == plain([r[:2] for r in rows], items)


def test_edge_rows_match_brute_force(spark, make_docs, odd_rows):
    items = [
        (1, "The quick, brown fox jumps over THE lazy dog while seven wizards"),
        (2, "ñandú 東京"),
        (3, None),
        (4, "--- "),
        (10, "and0 word1"),
        (10, "and0 word1"),
        (11, "x"),
        (12, " ".join(f"word{i % 977} and{i % 13}" for i in range(500, 530))),
    ]
    check(spark, make_docs, odd_rows, items)


def test_random_passages_match_brute_force(spark, make_docs):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 14])))) for i in range(25)]
    rows = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(items)[1].split()
            cut = rng.randint(0, 2)
            at = rng.randint(0, len(text))
            text[at:at] = passage[cut:]
        rows.append((d, " ".join(text)))
    check(spark, make_docs, rows, items)


def test_common_words_alone_match(spark, make_docs):
    """An item of one word repeated overlaps itself everywhere."""
    check(spark, make_docs, [(1, "a " * 50), (2, "a " * 9), (3, "b a b")], [(1, "a " * 12), (2, "b")])


def test_empty_tables(spark, make_docs, odd_rows):
    check(spark, make_docs, odd_rows, [])
    assert decontaminate.contamination(make_docs([]), spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []


def test_contaminated_rows_go_with_all_columns(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    items = spark.createDataFrame([(1, "quick brown fox")], ITEMS)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(r[0]) for r in odd_rows if "quick brown fox" not in (r[1] or "")
    )
