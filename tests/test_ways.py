"""Ways through graphs: doubled tables, and the frontier past them, against plain search."""

from __future__ import annotations

import random

import pytest

from tracewell.operators import features, trace, transform


def _plain(pairs, sources):
    """(src, dst) -> the least path by (length, ids) of one or more edges."""
    out = {}
    for s in sources:
        front = {b: (a, b) for a, b in sorted(pairs) if a == s}
        while front:
            new = {}
            for path in front.values():
                out.setdefault((s, path[-1]), path)
            for path in front.values():
                for a, b in pairs:
                    if a == path[-1] and (s, b) not in out and (b not in new or path + (b,) < new[b]):
                        new[b] = path + (b,)
            front = new
    return out


@pytest.mark.parametrize("kind", ["chain", "sparse", "dense", "hub"])
def test_ways_of_any_shape(spark, kind):
    r = random.Random(5)
    pairs = {
        "chain": {(i, i + 1) for i in range(21)},
        "sparse": {(r.randrange(60), r.randrange(60)) for _ in range(30)},
        "dense": {(r.randrange(14), r.randrange(14)) for _ in range(40)},
        "hub": {(i, 0) for i in range(1, 12)} | {(0, i) for i in range(12, 24)},
    }[kind]
    sources = sorted({a for a, _ in pairs})[::2]
    edges = spark.createDataFrame([(g, a, b) for g in (1, 2) for a, b in pairs], "g long, src long, dst long")
    start = spark.createDataFrame([(1, s) for s in sources], "g long, node long")
    assert sorted((x.src, x.dst) for x in transform.closure(edges, ["g"], start).collect()) == sorted(_plain(pairs, sources))
    paths = {(x.src, x.dst): tuple(x.path) for x in trace.shortest_paths(edges, ["g"], start).collect()}
    apart = {(a, b) for a, b in pairs if a != b}
    assert paths == {k: p for k, p in _plain(apart, sources).items() if k[0] != k[1]} | {(s, s): (s,) for s in sources}


def test_few_rounds(spark, monkeypatch):
    """A way of 16 edges among many short ones: as many tables as its length has binary digits, not one an edge."""
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(16)] + [(1, 100 + 2 * i, 101 + 2 * i) for i in range(200)], "g long, src long, dst long")
    made, plain = [], transform.stored
    monkeypatch.setattr(transform, "stored", lambda df, name: made.append(name) or plain(df, name))
    assert transform.closure(edges, ["g"]).count() == 16 * 17 // 2 + 200
    assert len(made) <= 6


def test_walks_meet_one_table_a_step(spark, monkeypatch):
    """A step of a static walk is one lookup: neighbours carry their pair's operations and their own degree."""
    edges = spark.createDataFrame([(1, 2, "b"), (1, 2, None), (2, 3, "a"), (3, 3, "c")], "src long, dst long, op string")
    made, plain = [], features.stored
    monkeypatch.setattr(features, "stored", lambda df, name: made.append(name) or plain(df, name))
    walks = features.static_walks(edges, 3, 2).collect()
    assert made == ["near", "degree", "ways", "walks"]
    assert {x.node: sum(y.node == x.node for y in walks) for x in walks} == {1: 2, 2: 4, 3: 4}
    ops = {(1, 2): {"b", None}, (2, 3): {"a"}, (3, 3): {"c"}}
    for x in walks:
        for a, op, b in (x.path[:3], x.path[2:]):
            assert op in ops[min(int(a), int(b)), max(int(a), int(b))]


def test_walks_are_never_broadcast(spark, monkeypatch):
    """Small files of degrees and ways stand for many walks: no join may pass them through the driver."""
    edges = spark.createDataFrame([(0, 1 + i, "ab"[i % 2]) for i in range(300)] + [(1, 2, "c")], "src long, dst long, op string")
    plans, plain = {}, features.stored
    monkeypatch.setattr(features, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name))
    walks = features.static_walks(edges, 3, 2).collect()
    degree = {0: 300, 1: 2, 2: 2} | {i: 1 for i in range(3, 301)}
    assert sorted((x.node, x.walk) for x in walks) == [(n, w) for n, d in sorted(degree.items()) for w in range(1, 2 * d + 1)]
    assert all("SortMergeJoin" in plans[name] and "Broadcast" not in plans[name] for name in ("ways", "walks"))
