"""Lineage over long and branching graphs against plain walks, and JSON text that is nested too deeply."""

from __future__ import annotations

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from chronogrid.functions import jsontext
from chronogrid.operators import integrity, reach


def frame(spark, edges):
    return spark.createDataFrame([(str(c), str(p)) for c, p in edges], "child_id string, parent_id string")


def plain_depths(edges, sources):
    below = defaultdict(set)
    for c, p in edges:
        below[str(p)].add(str(c))
    depth, todo = {str(s): 0 for s in sources}, deque(map(str, sources))
    while todo:
        at = todo.popleft()
        for child in below[at]:
            if child not in depth:
                depth[child] = depth[at] + 1
                todo.append(child)
    return {k: d for k, d in depth.items() if d}


def plain_core(edges):
    left = {(str(c), str(p)) for c, p in edges}
    while True:
        children, parents = {c for c, _ in left}, {p for _, p in left}
        kept = {(c, p) for c, p in left if p in children and c in parents}
        if kept == left:
            return left
        left = kept


def depths(spark, edges, sources):
    deleted = spark.createDataFrame([(str(s),) for s in sources], "artifact_id string")
    rows = integrity.invalidated(frame(spark, edges), deleted).collect()
    found = {r["artifact_id"]: r["depth"] for r in rows}
    assert len(found) == len(rows)
    return found


def core(spark, edges):
    rows = integrity.cyclic_edges(frame(spark, edges)).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_long_chain(spark, monkeypatch):
    n = 2_000  # edges
    chain = spark.range(n).select((F.col("id") + 1).cast("string").alias("child_id"), F.col("id").cast("string").alias("parent_id"))
    seen = []
    monkeypatch.setattr(reach, "runs", lambda *a, f=reach.runs: seen.append(f(*a)) or seen[-1])
    gone = spark.createDataFrame([("10",), ("1200",)], "artifact_id string")
    got = integrity.invalidated(chain, gone)
    node = F.col("artifact_id").cast("int")
    wrong = F.col("depth") != F.when(node < 1_200, node - 10).otherwise(node - 1_200)
    assert got.agg(F.count("*"), F.sum(wrong.cast("int"))).first()[:] == (n - 10 - 1, 0)
    assert len(seen) == 1 and seen[0].rounds <= 12


def test_random_graphs(spark):
    draw = random.Random(3)
    for n, m in ((50, 55),):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        edges += [(1000 + i + 1, 1000 + i) for i in range(30)] + [(1000, draw.randrange(n)), (draw.randrange(n), 1015)]
        sources = [draw.randrange(n) for _ in range(3)]
        assert depths(spark, edges, sources) == plain_depths(edges, sources)
        assert core(spark, edges) == plain_core(edges)


def test_ways_of_unlike_length(spark):
    """A long run and a short cut to the same node; a cycle that is reached, one that holds a source and one apart."""
    edges = [(i + 1, i) for i in range(20)] + [(15, "short"), ("short", 0), ("x", 20), ("y", "x"), ("z", "y"), ("x", "z")]
    edges += [("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "p"), ("s", "s")]
    assert depths(spark, edges, [0, "c"]) == plain_depths(edges, [0, "c"])
    assert core(spark, edges) == plain_core(edges)


def test_runs_that_only_a_raking_lays_bare(spark):
    """A spine whose side branches are raked off first, between two cycles."""
    edges = [(f"s{i + 1}", f"s{i}") for i in range(12)] + [(f"leaf{i}", f"s{i}") for i in range(12)] + [(f"s{i}", f"root{i}") for i in range(0, 12, 2)]
    edges += [("u", "v"), ("v", "u"), ("s0", "v"), ("w", "s12"), ("w", "w")]
    found = core(spark, edges)
    assert found == plain_core(edges) and ("s5", "s4") in found and ("leaf3", "s3") not in found


def test_no_edges(spark):
    assert depths(spark, [], [1]) == {} and core(spark, []) == set()
    assert depths(spark, [(1, 0), (2, 1)], []) == {} and core(spark, [(1, 0), (2, 1)]) == set()


def test_deeply_nested_json_counts_as_none(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = spark.createDataFrame([(1, deep), (2, '{"b":[1,"x"],"a":2}')], "id int, t string")
    facts = jsontext.json_facts(F.col("t"))
    found = rows.select("id", facts.alias("f"), jsontext.pretty_size("t").alias("n"), jsontext.canonical_json_exact("t").alias("c"))
    one, two = sorted(found.collect())
    assert tuple(one["f"]) == (None, None, None) and one["n"] is None and one["c"] is None
    assert tuple(two["f"]) == ('{"a":2,"b":[1,"x"]}', 3, 3) and two["c"] == '{"a":2,"b":[1,"x"]}'


def test_python_holds_few_texts_at_a_time(spark):
    from chronogrid.functions import jsontext
    from chronogrid.plans import jobs

    def engine(content):
        import sys

        frames, held = sys._getframe(), 0
        while frames:
            held = max([held] + [len(v) for v in frames.f_locals.values() if isinstance(v, (list, tuple)) or type(v).__name__ == "DataFrame"])
            frames = frames.f_back
        return {"text": str(held), "latency_ms": len(content)}

    pages = spark.range(0, 5_000, 1, 1).select("id", F.lit(b"abc").alias("content"))
    rows = jobs.transcribe(pages, engine).collect()
    assert len(rows) == 5_000 and {r["latency_ms"] for r in rows} == {3}
    assert max(int(r["ocr_text"]) for r in rows) <= 200
    plan = spark.range(3).select(*[f(F.col("id").cast("string")) for f in (jsontext.json_facts, jsontext.pretty_size, jsontext.canonical_json_exact)])
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString()
