"""Decayed walks and node memory against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.vectors import combined  # noqa: F401
from tracewell.operators import features, learn, memory


def walk_by_loops(edges, starts, length, n_walks, half_life, forward):
    """The same draws by a search over all later edges of a node."""
    out = []
    at = {}
    for s, d, t, i in edges:
        a, b, w = (s, d, t) if forward else (d, s, -t)
        at.setdefault(a, []).append((w, i, b))
    for own in at.values():
        own.sort()
    for node in starts:
        for walk in range(n_walks):
            path, here, since = [node], node, -math.inf
            for k in range(1, length):
                options = [x for x in at.get(here, []) if x[0] > since]
                if not options:
                    break
                u = (int(hashlib.md5(f"0|{node}|{walk}|{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                age = [(x[0] - options[0][0]) / half_life for x in options]
                # level of an option: minus the logarithm of its weight and all after it
                level, total = [0.0] * len(options), -math.inf
                for j in range(len(options) - 1, -1, -1):
                    total = max(total, -age[j]) + math.log1p(math.exp(-abs(total + age[j]))) if total > -math.inf else -age[j]
                    level[j] = -total
                pick = max(j for j in range(len(options)) if level[j] <= level[0] - math.log(u))
                since, _, here = options[pick]
                path.append(here)
            out.append((node, walk, path))
    return sorted(out)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("half_life", [1e12, 4e12, 1e9, 1e16])
def test_decayed_walks_equal_loops(spark, half_life, forward):
    """Slow and fast decay; with the fastest, weights span far more than a double holds."""
    r = random.Random(int(math.log10(half_life)))
    edges = [(r.randrange(12) if k % 3 else 0, r.randrange(12), r.randrange(60) * 10**11 + (k % 5) * 10**13, k) for k in range(300)]
    table = spark.createDataFrame(edges, "src long, dst long, t long, event_id long").withColumn("op", F.lit("x"))
    starts = spark.createDataFrame([(i,) for i in range(14)], "node long")
    got = features.decayed_walks(table, starts, 5, 4, half_life, forward=forward)
    assert sorted((x.node, x.walk, list(x.path)) for x in got.collect()) == walk_by_loops(edges, range(14), 5, 4, half_life, forward)


def test_draws_follow_the_decay(spark):
    edges = spark.createDataFrame([(0, i + 1, i * 100, i) for i in range(6)], "src long, dst long, t long, event_id long").withColumn("op", F.lit("x"))
    start = spark.createDataFrame([(0,)], "node long")
    n = 4000
    counts = {r.d: r.n for r in features.decayed_walks(edges, start, 2, n, 150.0).groupBy(F.element_at("path", 2).alias("d")).agg(F.count("*").alias("n")).collect()}
    w = np.exp(-np.arange(6) * 100 / 150)
    expected = n * w / w.sum()
    assert ((np.array([counts.get(i + 1, 0) for i in range(6)]) - expected) ** 2 / expected).sum() < 20  # chi square, 5 degrees


def test_a_hub_of_many_edges(spark):
    hub = spark.range(300_000).select(F.lit(0).cast("long").alias("src"), (F.col("id") % 1000 + 1).alias("dst"), (F.col("id") * 10**7).alias("t"), F.col("id").alias("event_id"), F.lit("x").alias("op"))
    got = features.decayed_walks(hub, spark.createDataFrame([(0,)], "node long"), 3, 50, 1e12).collect()
    assert len(got) == 50 and all(len(r.path) == 2 for r in got) and len({r.path[1] for r in got}) > 20


def memory_by_loops(events, w, how, unit):
    size = w["u"].shape[1]
    held, last, out = {}, {}, []
    for batch in sorted({e[0] for e in events}):
        sent = {}
        for _, i, t, s, d, msg in (e for e in events if e[0] == batch):
            for node, other, side in ((s, d, 1), (d, s, 0)):
                sent.setdefault(node, []).append((t, i, side, other, msg))
        new = {}
        for node, messages in sent.items():
            zero = np.zeros(size)
            x = [np.concatenate([held.get(node, zero), held.get(other, zero), msg, np.cos((t - last.get(node, 0)) / unit * w["rate"] + w["phase"])]) for t, i, side, other, msg in sorted(messages)]
            x = x[-1] if how == "last" else np.mean(x, 0)
            new[node] = (learn.gru_step(x[None], held.get(node, zero)[None], w)[0], max(m[0] for m in messages))
        for node, (h, t) in new.items():
            held[node], last[node] = h, t
            out.append((batch, node, h, t))
    return out


@pytest.mark.parametrize("how", ["last", "mean"])
def test_memory_equals_loops(spark, how):
    r = random.Random(2)
    events = [(k // 9, k, 1000 * (k // 2), r.randrange(7), r.randrange(7), [r.random(), r.random()]) for k in range(100)]  # ties in time, events of one node, more batches than are folded
    w = memory.memory_weights(4, 2, 3, 1)
    w["rate"] = w["rate"] / 7
    table = spark.createDataFrame(events, "batch long, event_id long, t long, src long, dst long, msg array<double>").repartition(5)
    got = {(x.batch, x.node): x for x in memory.node_memory(table, w, how, unit=100).collect()}
    want = memory_by_loops(events, w, how, 100)
    assert len(got) == len(want)
    for batch, node, h, t in want:
        assert np.allclose(got[batch, node].memory, h) and got[batch, node].last_t == t


def test_memory_of_nothing(spark):
    none = spark.createDataFrame([], "batch long, event_id long, t long, src long, dst long, msg array<double>")
    assert memory.node_memory(none, memory.memory_weights(2, 1, 1, 0)).collect() == []


def test_recurrent_unit_over_sequences_of_any_length(spark):
    r = np.random.default_rng(1)
    w = {"w": r.normal(size=(9, 2)), "u": r.normal(size=(9, 3)), "b": r.normal(size=9), "c": r.normal(size=9)}
    rows = [(i, r.normal(size=(n, 2)).tolist()) for i, n in enumerate((3, 0, 7, 1, 7, 2))]
    got = {x.id: x.h for x in learn.gru(spark.createDataFrame(rows, "id long, s array<array<double>>"), "s", w, "h").collect()}
    for i, s in rows:
        h = np.zeros((1, 3))
        for x in s:
            h = learn.gru_step(np.array([x]), h, w)
        assert np.allclose(got[i], h[0])


def test_last_messages_are_taken_once_for_all_batches(spark, monkeypatch):
    names, keep = [], memory.stored

    def noted(df, name):
        names.append(name)
        return keep(df, name)

    monkeypatch.setattr(memory, "stored", noted)
    edges = spark.createDataFrame([(b, 10 * b + i, 10 * b + i, i % 2, 2 + i, [0.5]) for b in range(2) for i in range(3)], "batch long, event_id long, t long, src long, dst long, msg array<double>")
    got = memory.node_memory(edges, memory.memory_weights(2, 1, 1, 0)).collect()
    assert {(r.batch, r.node) for r in got} == {(b, n) for b in range(2) for n in range(5)}
    assert names.count("memory-last") == 1 and names.count("memory-changes") == 2
