from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from chronogrid.llm import simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_edge_rows_match_brute_force(make_docs, odd_rows):
    rows = odd_rows
    got = {}
    for r in simhash.near_duplicates(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    prints = [plain_print(r[1]) for r in rows]
    groups = plain_groups(prints)
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i] and rows[j][0] is not None]
        assert (f"{prints[i]:016x}", min(ids) if ids else None) in got[row[0]]


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    assert simhash.keep_one(make_docs([])).collect() == []


def test_links_of_close_prints_are_complete(spark):
    """Random prints around common centres, at all distances from 0 to 6: same groups as all pairs."""
    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    groups = plain_groups(prints)
    for chain in (2, 3, 4):
        links = simhash.near_links(df, chain).collect()
        index = {s: i for i, s in enumerate(signed)}
        assert all((prints[index[a]] ^ prints[index[b]]).bit_count() <= 3 for a, b in links)
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(index[a])] = find(index[b])
        found = [find(i) for i in range(len(prints))]
        assert len(set(zip(found, groups))) == len(set(found)) == len(set(groups))


def test_chain_condition_follows_from_distance():
    """Every difference of at most three bits has a start that keeps the budgets and shares a key."""
    for seed in range(300):
        rng = random.Random(seed)
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        segments = [(diff >> (48 - 16 * i) & 0xFFFF).bit_count() for i in range(4)]
        assert any(
            all(sum(segments[(s + j) % 4] for j in range(n)) <= 3 * n // 4 for n in range(1, 5)) for s in range(4)
        )


def test_keep_one_leaves_one_row_per_group_with_all_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect())
    found = simhash.near_duplicates(docs.where("doc_id is not null"))
    heads = sorted({r["component_id"] for r in found.collect()})
    assert ids == heads


def test_blocks_give_the_same_print(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(5000))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.simhash(text) == whole == plain_print(text)


def test_components_of_random_graphs_and_long_paths(spark):
    from chronogrid.llm.components import components

    rng = random.Random(5)
    graphs = [[(i, i + 1) for i in range(60)], [(0, 0)], [(rng.randrange(80), rng.randrange(80)) for _ in range(70)], [(9, i) for i in range(30)]]
    for edges in graphs:
        parent = {v: v for e in edges for v in e if e[0] != e[1]}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in edges:
            if x != y:
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
        assert got == {v: find(v) for v in parent}


def test_keep_one_tells_texts_of_one_key_apart(make_docs):
    rows = [(5, f"w{i} x{i} y{i} z{i} v{i} u{i}") for i in range(20)] + [(5, "w1 x1 y1 z1 v1 u1"), (9, "w3 x3 y3 z3 v3 u3")]
    kept = simhash.keep_one(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(rows[:20])


def test_second_search_takes_links_between_groups_alone(spark, monkeypatch):
    """Edges that made the groups are not searched again; a print in no group can tie two groups."""
    from chronogrid.llm import components as stars

    searched, plain = [], stars.components
    seen = lambda edges, *a: searched.append(edges.distinct().count()) or plain(edges, *a)
    monkeypatch.setattr(simhash, "components", seen)
    monkeypatch.setattr(stars, "components", seen)
    crowd = [0] + [1 << b for b in range(40)]  # every member is within three bits of the smallest
    prints = spark.createDataFrame([(p,) for p in crowd], "fp bigint")
    assert {tuple(r) for r in simhash.near_groups(prints).collect()} == {(p, 0) for p in crowd}
    assert searched == [40, 0]
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "vertex bigint, root bigint")
    ties = spark.createDataFrame([(5, 4), (4, 1), (5, 4), (20, 30)], "ra bigint, rb bigint")
    got = {tuple(r) for r in stars.tied_groups(roots, ties).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (8, 8), (9, 8), (20, 20), (30, 20)}
