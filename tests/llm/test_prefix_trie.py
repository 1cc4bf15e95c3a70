"""The trie against a plain version that walks Python tuples."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from chronogrid.llm import prefix_trie, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # names that the operator uses itself
        T.StructField("conv", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)


@pytest.fixture(scope="module")
def make_turns(spark):
    return lambda rows: spark.createDataFrame([(*r, "c", "a", "s", "n") for r in rows], TURNS)


def plain(rows):
    kept = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            kept[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(found)] for c, found in kept.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below)
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode())
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        above = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), above, len(members[node]), len(below), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def rows_of(found):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r[n] for n in names) for r in found.collect()], key=str)


@tables
def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = queries.op12_prefix_trie(spark, SF_DIR)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows_of(found) == plain([tuple(r) for r in rows])


def test_long_and_forked_conversations(make_turns):
    """Depths around powers of two; many conversations share long beginnings."""
    draw = random.Random(4)
    trunk = [("user", f"trunk {i}") for i in range(70)]
    rows = []
    for c in range(-7, 45):
        length = draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70])
        turns = [t if i < length - 2 or draw.random() < 0.5 else ("user", f"other {draw.randint(0, 2)} é") for i, t in enumerate(trunk[:length])]
        rows += [(c, i * 3 - 5, r, t) for i, (r, t) in enumerate(turns)]
    draw.shuffle(rows)
    assert rows_of(prefix_trie.prefix_trie(make_turns(rows))) == plain(rows)


def test_odd_rows(make_turns):
    """Nulls, equal numbers, repeated rows, conversations that end up empty, one that holds a third of all rows."""
    rows = [(c, i, "user", f"same {i}") for c in (5, 6, 7, 8, 9, 600, 601, 602) for i in range(6)]
    rows += [(11, None, None, None), (11, None, "user", "b"), (11, None, "user", "a"), (11, 1, "user", ""), (11, 1, "user", ""), (11, 1, None, "")]
    rows += [(None, 1, "user", "lost"), (22, 0, "a/b", "c"), (23, 0, "a", "b/c"), (24, 0, "1/a", "c")]
    rows += [(c, 0, "user", "short") for c in range(30, 50) if c % 5]
    rows += [(77, 2, "user", "again")] * 45 + [(77, 0, "user", "\U0001f600" * 9)]
    assert rows_of(prefix_trie.prefix_trie(make_turns(rows))) == plain(rows)


def test_many_conversations_end_in_one_node(make_turns):
    rows = [(c, i, "user", f"t{i}") for c in range(0, 6000, 5) for i in range(2)]
    found = rows_of(prefix_trie.prefix_trie(make_turns(rows)))
    assert found == plain(rows) and max(r[3] for r in found) == 1200


def test_empty_table(make_turns):
    assert rows_of(prefix_trie.prefix_trie(make_turns([]))) == []
    assert rows_of(prefix_trie.prefix_trie(make_turns([(None, 1, "user", "x")]))) == []
