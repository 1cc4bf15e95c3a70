from __future__ import annotations

import random

import corpus_pipeline
from chronogrid.llm import near_copies, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(rows):
    sets = {k: plain_set(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k for k in sets if find(k) == k}


def copies(rng):
    rows, key = [], 0
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 30, 120, 400, 1500]))]
        for changed in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
            rows.append((key, " ".join(f"new{rng.random()}" if rng.random() < changed else w for w in words)))
            key += 1
    rng.shuffle(rows)
    return rows + [(key + 1, None), (key + 2, " ")]


def test_stage_drops_the_near_copies_of_brute_force(spark, make_docs):
    rows = copies(random.Random(4))
    docs = make_docs(rows)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    expected = plain_kept([r for r in rows if r[0] in left])
    assert {r["doc_id"] for r in kept.collect()} == expected
    # the contract of the fingerprints leaves many of these
    assert len(left - expected) > 20
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == plain_kept(rows)


def test_crowd_that_shares_a_passage(make_docs):
    """All share two thirds of their words, some differ in a word only."""
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(120))
    ends = [" ".join(f"e{rng.randrange(10_000)}" for _ in range(40)) for _ in range(40)]
    rows = [(i, f"{shared} {end}") for i, end in enumerate(ends + [e + " one more" for e in ends[:20]])]
    assert {r["doc_id"] for r in near_copies.keep_one(make_docs(rows)).collect()} == plain_kept(rows)


def test_groups_are_searched_twice_at_most(make_docs, monkeypatch):
    """Every search for groups leaves its plans with the driver, so their number does not follow the heads."""
    rng, searches, plain = random.Random(8), [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda *a: searches.append(1) or plain(*a))
    shared = " ".join(f"s{i}" for i in range(120))
    rows = [(i, f"{shared} " + " ".join(f"e{rng.randrange(10_000)}" for _ in range(40))) for i in range(30)]
    assert {r["doc_id"] for r in near_copies.keep_one(make_docs(rows)).collect()} == plain_kept(rows)
    assert len(searches) <= 2


def test_edge_rows(make_docs, odd_rows):
    kept = [r["doc_id"] for r in near_copies.keep_one(make_docs(odd_rows)).collect()]
    assert sorted(k for k in kept if k is not None) == [-5, 1, 3, 6, 8, 9] and kept.count(None) == 1
    assert near_copies.keep_one(make_docs([])).collect() == []
