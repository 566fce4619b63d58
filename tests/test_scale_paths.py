"""Plans for large tables, held against plain loops: chains of windows, queues, ranges of precision, neighbours."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import chains, ordinal
from tracewell.operators import detect, neighbours, queues, windows

EVENTS = "event_id long, t long, src long, dst long, op string, day string"


def folded(rows, size, chunk):
    """Windows of one day's events, one event after the other."""
    times = sorted(r[1] for r in rows)
    out, tw, start, members = [], 0, times[0], []
    for i in range(0, len(times), chunk):
        part = times[i : i + chunk]
        members += part
        if part[-1] > start + size or i + chunk >= len(times):
            out += [(t, tw, start, part[-1]) for t in members]
            tw, start, members = tw + 1, part[-1], []
    return out


@pytest.mark.parametrize(("size", "chunk", "spread"), [(10, 2, 5), (0, 1, 2), (50, 3, 1), (10**6, 4, 9), (3, 7, 0)])
def test_adaptive_windows_equal_the_fold(spark, size, chunk, spread):
    random.seed(size)
    rows, t = [], 0
    for k in range(300):
        t += random.randrange(spread + 1) * (20 if k % 37 == 0 else 1)
        rows.append((k, t, 1, 2, "x", "d"))
    got = windows.adaptive(spark.createDataFrame(rows, EVENTS), size, chunk).select("t", "tw", "tw_start", "tw_end")
    assert sorted(map(tuple, got.collect())) == sorted(folded(rows, size, chunk))


def test_many_chunks_in_one_day(spark):
    events = spark.range(80_000).select(F.col("id").alias("event_id"), (F.col("id") * 10**9).alias("t"), F.lit(1).alias("src"), F.lit(2).alias("dst"), F.lit("x").alias("op"), F.lit("d").alias("day"))
    began = time.perf_counter()
    got = windows.adaptive(events, 5 * 10**9, 1).groupBy("tw").count().agg(F.count("*"), F.max("count")).first()
    assert tuple(got) == (13_334, 7) and time.perf_counter() - began < 60


def test_places_that_chains_visit(spark):
    jumps = spark.createDataFrame([("a", i, i + 1 + i % 3) for i in range(0, 200)] + [("b", 5, 7), ("b", 6, 7)], "g string, at long, next long")
    roots = spark.createDataFrame([("a", 0), ("b", 5), ("c", 1)], "g string, at long")
    want, at = {("b", 5), ("b", 7), ("c", 1)}, 0
    while at < 200:
        want.add(("a", at))
        at += 1 + at % 3
    want.add(("a", at))
    got = [tuple(r) for r in chains.reached(jumps, roots, ["g"]).collect()]
    assert sorted(got) == sorted(want)


def fold_queues(windows_, links, everywhere):
    made, out = [], []
    for w in sorted(windows_):
        near = {a for a, b in links if b == w}
        hits = [i for i, q in enumerate(made) if q & near]
        if not hits:
            made.append(set())
            hits = [len(made) - 1]
        for i in hits if everywhere else hits[:1]:
            made[i].add(w)
            out.append((w, i))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("everywhere", [False, True])
def test_queues_equal_the_fold(spark, seed, everywhere):
    r = random.Random(seed)
    n = 60
    rare = [(r.randrange(n) * 3, node) for node in range(25) for _ in range(r.randrange(1, 5))]
    table = spark.createDataFrame([(i * 3, 1.0) for i in range(n) if i % 11], "tw long, mean_loss double")
    kept = {x[0] for x in table.collect()}
    members = spark.createDataFrame([x for x in rare if x[0] in kept], "tw long, node long")
    links = {(a, b) for a, x in rare for b, y in rare if a < b and x == y and a in kept and b in kept}
    want = fold_queues(kept, links, everywhere)
    for related in (queues.related_windows(members), queues.linked_windows(members)):
        assert sorted(map(tuple, queues.build_queues(table, related, everywhere).collect())) == want


def test_a_long_chain_of_windows_is_one_queue(spark):
    n = 3000
    table = spark.range(n).select(F.col("id").alias("tw"))
    related = spark.range(1, n).select((F.col("id") - 1).alias("tw_a"), F.col("id").alias("tw_b"))
    got = queues.build_queues(table, related).groupBy("queue").count().collect()
    assert [tuple(x) for x in got] == [(0, n)]


@pytest.mark.parametrize("slices", [1, 5, 40])
def test_area_in_ranges(spark, slices):
    r = random.Random(4)
    points = [(r.choice([0.1, 0.2, r.random()]), r.random() * 100) for _ in range(500)]
    best = {}
    for p, q in points:
        best[p] = max(q, best.get(p, 0))
    x = sorted(best.items())
    want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(x, x[1:])) / 100
    got = detect.area_over_precision(spark.createDataFrame(points, "precision double, percent double"), slices).first()[0]
    assert got == pytest.approx(want, abs=1e-6)
    plan = detect.area_over_precision(spark.createDataFrame(points, "precision double, percent double"), slices)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # stored before; what is left is one row a range


def test_running_sums_in_ranges(spark):
    r = random.Random(5)
    rows = [(i, float(r.randrange(20)), r.randrange(2)) for i in range(400)]
    d = spark.createDataFrame(rows, "node long, score double, y long")
    got = {x.node: (x.up, x.rank) for x in detect.running(d, ["node"], {"up": "y"}, "rank", slices=9).collect()}
    up = 0
    for rank, (node, _, y) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        up += y
        assert got[node] == (up, rank)
    assert ordinal.sliced(d, ["score", "node"], 7).select("_slice").distinct().count() == 7


def brute_factors(v, k):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    density = 1 / np.maximum(np.maximum(dist, dist[:, -1][near]).mean(1), 1e-10)
    return near, density[near].mean(1) / density


@pytest.mark.parametrize(("n", "dims", "block"), [(3000, 6, 512), (700, 2, 32), (40, 3, 512)])
def test_neighbours_and_outlier_factors(spark, monkeypatch, n, dims, block):
    """Clusters, points far out, and points that repeat."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    r = np.random.default_rng(n)
    v = r.normal(size=(8, dims))[r.integers(0, 8, n)] * 10 + r.normal(size=(n, dims)) * r.choice([0.1, 1.0], (n, 1))
    v[: n // 20] = v[0]
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(7)
    near, lof = brute_factors(v, 9)
    found = neighbours.nearest(points, 9).collect()
    assert sorted((x.id, x["rank"], x.neighbour) for x in found) == [(i, j + 1, int(near[i, j])) for i in range(n) for j in range(9)]
    got = {x.id: x.lof for x in neighbours.outlier_factors(points, 9).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(lof.tolist())


def test_few_points(spark):
    schema = "id long, v array<double>"
    assert neighbours.outlier_factors(spark.createDataFrame([], schema), 3).collect() == []
    assert [tuple(x) for x in neighbours.outlier_factors(spark.createDataFrame([(4, [1.0])], schema), 3).collect()] == [(4, 1.0)]
    two = {x.id: x.lof for x in neighbours.outlier_factors(spark.createDataFrame([(4, [1.0]), (5, [3.0])], schema), 3).collect()}
    assert two == {4: 1.0, 5: 1.0}


def test_nearest_distances_in_blocks(spark, monkeypatch):
    """Many blocks of both sides in a batch, vectors with nulls, batches with too few rows."""
    from tracewell.operators import score

    monkeypatch.setattr(score, "BLOCK", 8)
    r = np.random.default_rng(3)
    rows = [(i, i % 3 if i < 400 else 3, r.normal(size=3).tolist()) for i in range(402)] + [(500, 0, None), (501, 1, [1.0, None, 2.0]), (502, 3, None), (503, None, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "id long, label long, v array<double>")
    got = {x.id: x.distance for x in score.knn_distance(v, v, 4, ["label"], None).collect()}
    whole = lambda x: x is not None and None not in x
    for i, label, x in rows:
        if label is None:
            assert i not in got
            continue
        near = sorted(float(np.linalg.norm(np.subtract(x, y))) for _, g, y in rows if g == label and whole(x) and whole(y))[:4]
        if len(near) < min(4, sum(g == label for _, g, _ in rows)):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.mean(near), abs=1e-12)
    some = {x.id: x.score for x in score.knn_score(v.filter("id < 50"), v, 3).collect()}
    assert len(some) == len(rows) and some[500] is None
    for i, _, x in rows[:400]:
        assert some[i] == pytest.approx(np.mean(sorted(np.linalg.norm(np.subtract(x, y)) for _, _, y in rows[:50])[:3]), abs=1e-12)


def test_scores_against_a_whole_batch(spark, tmp_path):
    """The query's SQL has no sample: rows past 5000 of a label count."""
    from tracewell.plans import scalars

    x = np.random.default_rng(5).normal(size=(5300, 2)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.score for r in scalars.magic_scores(spark, str(tmp_path)).collect()}
    z = (x.astype(float) - x.astype(float).mean(0)) / x.astype(float).std(0)
    d = np.array([np.sort(np.sqrt(((a - z) ** 2).sum(1)))[:5].mean() for a in z])
    assert len(got) == 5300 and all(abs(got[i] - d[i] / d.mean()) < 1e-4 for i in range(5300))


def test_only_what_may_be_near_leaves_a_block(spark):
    """A meeting of two blocks gives rows within the limits, ties included, not k rows for every point."""
    r = np.random.default_rng(8)
    a, b = np.round(r.normal(size=(200, 4)), 1), np.round(r.normal(size=(400, 4)), 1)
    b[:90] = a[0]
    mine, theirs = np.arange(200), r.permutation(np.arange(150, 550))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    d[mine[:, None] == theirs] = np.inf
    limit = np.sort(d, axis=1)[:, 4]
    rows, found, ids = neighbours._within(mine, a, theirs, b, 5, limit)
    inside = found <= limit[rows]
    assert sorted(zip(rows[inside].tolist(), ids[inside].tolist())) == sorted((int(i), int(theirs[j])) for i, j in zip(*np.nonzero(d <= limit[:, None])))
    assert neighbours._within(mine, a, theirs, b, 5, np.full(200, 1e-3))[0].size < 200


def test_softmax_takes_sums_once_a_row(spark):
    """Work follows the length of a vector, not its cube: 20 vectors of 2000 took 20 * 2000 ** 3 steps."""
    from tracewell.operators import score

    x = np.random.default_rng(2).normal(size=(20, 2000))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, None)]
    began = time.time()
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id long, v array<double>").select("id", score.softmax(F.col("v")).alias("p")).collect()}
    assert time.time() - began < 60 and got[20] is None
    e = np.exp(x - x.max(1)[:, None])
    assert all(np.allclose(got[i], e[i] / e[i].sum(), atol=1e-15) for i in range(20))
