"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalar, taxonomy
from tracewell.operators import batches, detect, features, neighbours, queues, score, trace, transform, windows
from tracewell.plans import runner


def edges(spark, rows, day="d"):
    return spark.createDataFrame([(day, i, t, s, d, o) for i, (s, d, t, o) in enumerate(rows)], "day string, event_id long, t long, src string, dst string, op string")


def test_runs_are_fused(spark):
    e = edges(spark, [("s", "d", 1, "A"), ("s", "d", 2, "A"), ("s", "d", 3, "B"), ("s", "d", 4, "A")])
    assert sorted((r.t, r.op) for r in windows.fuse_runs(e, ["day"]).collect()) == [(1, "A"), (3, "B"), (4, "A")]


def test_adaptive_windows(spark):
    e = edges(spark, [("s", "d", t, "A") for t in (0, 1, 5, 12, 13, 14, 20, 30, 31)])
    got = {r.t: (r.tw, r.tw_start) for r in windows.adaptive(e, 10, 2).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 5: (0, 0), 12: (0, 0), 13: (1, 12), 14: (1, 12), 20: (1, 12), 30: (1, 12), 31: (2, 30)}


def test_adaptive_windows_of_no_events(spark):
    assert windows.adaptive(edges(spark, []), 10, 2).count() == 0


def test_undirected_adds_missing_reverses(spark):
    e = edges(spark, [("a", "b", 1, "x"), ("b", "a", 2, "x"), ("a", "c", 3, "x")])
    assert sorted((r.src, r.dst) for r in transform.undirected(e, ["day"]).collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]


def test_roots(spark):
    e = edges(spark, [("a", "b", 1, "x"), ("b", "c", 2, "x"), ("c", "a", 3, "x")])
    assert [r.node for r in transform.roots(e, ["day"]).collect()] == ["a"]


def test_versions(spark):
    e = edges(spark, [("a", "b", 1, "x"), ("b", "a", 2, "x"), ("a", "b", 3, "x")])
    got = [(r.src_version, r.dst_version, r.bumped) for r in transform.versioned(e, ["day"]).orderBy("t").collect()]
    assert got == [(0, 0, False), (0, 1, True), (1, 1, True)]


def test_acyclic_has_no_cycle(spark):
    e = edges(spark, [("a", "b", 1, "x"), ("b", "c", 2, "x"), ("c", "a", 3, "x"), ("c", "d", 4, "x"), ("d", "d", 5, "x")])
    assert [(r.src, r.dst) for r in transform.acyclic(e, ["day"]).collect()] == [("c", "d")]


def test_word_weights(spark):
    w = spark.range(1).select(scalar.word_weights(F.lit(2)).alias("w")).first()["w"]
    assert w == pytest.approx([0.575, 0.425])


def test_prefixes(spark):
    assert spark.range(1).select(scalar.prefixes(F.lit("a/b/c")).alias("p")).first()["p"] == ["a", "a/b", "a/b/c"]


def test_unique_pairs(spark):
    e = edges(spark, [("a", "b", 1, "x"), ("a", "c", 2, "x"), ("a", "b", 3, "x"), ("a", "b", 4, "x")])
    assert [r.batch for r in batches.by_unique_pairs(e, ["day"]).orderBy("t").collect()] == [0, 0, 1, 2]


def test_class_weights(spark):
    labels = spark.createDataFrame([(0,), (0,), (0,), (1,)], "class int")
    kinds = spark.createDataFrame([(0,), (1,), (2,)], "class int")
    got = {r["class"]: r.weight for r in scalar.class_weights(labels, kinds).collect()}
    assert got == pytest.approx({0: 4 / 9, 1: 4 / 3, 2: 0})


def test_idf(spark):
    w = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "b")], "tw int, node string")
    got = {r.node: r.idf for r in queues.idf(w, spark.createDataFrame([(4,)], "n int")).collect()}
    assert got == pytest.approx({"a": math.log(2), "b": 0})


def test_queue_score_and_members(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0)], "tw long, mean_loss double")
    related = spark.createDataFrame([(1, 2, 1)], "tw_a long, tw_b long, n_shared long")
    q = queues.build_queues(w, related)
    assert sorted((r.tw, r.queue) for r in q.collect()) == [(1, 0), (2, 0), (3, 1)]
    assert {r.queue: r.score for r in queues.queue_scores(q, w).collect()} == pytest.approx({0: 6, 1: 6})


def test_first_queue_only_or_all(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "tw long, mean_loss double")
    related = spark.createDataFrame([(1, 3, 1), (2, 3, 1)], "tw_a long, tw_b long, n_shared long")
    assert sorted((r.tw, r.queue) for r in queues.build_queues(w, related).collect()) == [(1, 0), (2, 1), (3, 0)]
    assert sorted((r.tw, r.queue) for r in queues.build_queues(w, related, True).collect()) == [(1, 0), (2, 1), (3, 0), (3, 1)]


@pytest.fixture(scope="module")
def ranking(spark):
    r = spark.createDataFrame([(1, 4.0, 1), (2, 3.0, 0), (3, 2.0, 1), (4, 1.0, 0)], "node long, score double, y_true long")
    return r, spark.createDataFrame([(0, 1), (1, 3)], "attack_id int, node long")


def test_adp(ranking):
    assert detect.adp(*ranking).first()["area"] == pytest.approx(0.6667, abs=1e-4)


def test_until_all_attacks(ranking):
    assert tuple(detect.until_all_attacks(*ranking).first()) == (1, 1)


def test_before_first_false_positive(ranking):
    assert [tuple(r) for r in detect.tps_before_first_fp(*ranking).collect()] == [(0, 1)]


def test_window_labels_are_strict(spark):
    w = spark.createDataFrame([(7, 10, 20)], "tw int, start_t long, end_t long")
    m = spark.createDataFrame([("n", 10), ("n", 15), ("n", 20)], "node string, t long")
    assert [tuple(r) for r in detect.window_labels(w, m, 100).collect()] == [(7, "n", 1)]
    assert [tuple(r) for r in detect.window_labels(w, m, 100, strict=False).collect()] == [(7, "n", 3)]


def test_two_means(spark):
    r = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 1.1, 9.0, 9.5, 0.1])], "node long, score double")
    assert sorted(x.node for x in detect.relabel_by_two_means(r, 4).filter("y_hat = 1").collect()) == [2, 3]


def test_confusion_without_positives(spark):
    r = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "node long, y_true long, y_hat long")
    c = detect.confusion(r).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.precision) == (0, 1, 1, 0, 0)


def test_times(spark):
    row = spark.range(1).select(scalar.text_to_ns(F.lit("2018-04-06 00:00:00")).alias("a"), scalar.ns_to_text(F.lit(1522987200 * 10**9 + 5)).alias("b")).first()
    assert row.a == 1522987200 * 10**9 and row.b == "2018-04-06 00:00:00.000000005"


def test_eastern_day_is_half_open(spark):
    e = spark.createDataFrame([(1522987200 * 10**9 - 1,), (1522987200 * 10**9,)], "t long")
    assert [str(r.day) for r in windows.daily(e).orderBy("t").collect()] == ["2018-04-05", "2018-04-06"]


def test_orientation(spark):
    row = spark.range(1).select(taxonomy.oriented(F.lit(1), F.lit(2), F.lit("EVENT_READ")).alias("r"), taxonomy.oriented(F.lit(1), F.lit(2), F.lit("EVENT_WRITE")).alias("w")).first()
    assert tuple(row.r) == (2, 1) and tuple(row.w) == (1, 2)


def test_triplets(spark):
    possible = [("subject", "EVENT_WRITE", "file"), ("file", "EVENT_READ", "subject")]
    row = spark.range(1).select(taxonomy.triplet(F.lit("file"), F.lit("EVENT_READ"), F.lit("subject"), possible).alias("a"), taxonomy.triplet(F.lit("x"), F.lit("y"), F.lit("z"), possible).alias("b")).first()
    assert tuple(row) == (1, 0)


def test_walks_keep_time_order(spark):
    e = edges(spark, [("a", "b", 5, "x"), ("b", "c", 3, "x"), ("b", "d", 7, "x")])
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r.path) for r in features.temporal_walks(e, start, 3, 4).collect()} == {("a", "b", "d")}


def test_entries_and_best(spark):
    e = edges(spark, [("r", "m", 1, "x"), ("m", "p", 2, "x"), ("q", "p", 3, "x"), ("m", "z", 4, "x")])
    poi = spark.createDataFrame([("d", "p")], "day string, poi string")
    c = trace.entry_components(e, ["day"], poi)
    assert sorted((r.entry, r.node) for r in c.collect()) == [("q", "p"), ("q", "q"), ("r", "m"), ("r", "p"), ("r", "r")]
    s = spark.createDataFrame([("d", n, v) for n, v in (("p", 1.0), ("q", 0.0), ("r", 3.0), ("m", 2.0))], "day string, node string, score double")
    assert [r.entry for r in trace.best_entries(c, s, ["day"]).collect()] == ["r"]


def test_losses(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    row = spark.range(1).select(score.sce(a, b).alias("sce"), score.mse(a, b).alias("mse"), score.mae(a, b).alias("mae"), score.cross_entropy(a, F.lit(0)).alias("ce"), score.two_best_ratio(a).alias("r")).first()
    assert row.sce == 1 and row.mse == 1 and row.mae == 1
    assert row.ce == pytest.approx(math.log(1 + math.exp(-1))) and row.r == pytest.approx(math.log(1e5))


def test_outliers(spark):
    p = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 2, 3, 50])], "id long, v array<double>")
    lof = {r.id: r.lof for r in neighbours.outlier_factors(p, 2).collect()}
    assert max(lof, key=lof.get) == 4 and lof[1] < 1.5


def test_runner_reuses_and_restarts(spark, tmp_path):
    calls = []

    def first(s, inputs, settings):
        calls.append("first")
        return s.range(settings["n"])

    def second(s, inputs, settings):
        calls.append("second")
        return inputs["first"].selectExpr("id * 2 AS id")

    stages = [runner.Stage("first", first, {"n": 3}), runner.Stage("second", second, {}, ("first",))]
    assert runner.run_stages(spark, stages, str(tmp_path))["second"].count() == 3
    runner.run_stages(spark, stages, str(tmp_path))
    assert calls == ["first", "second"]
    runner.run_stages(spark, stages, str(tmp_path), frozenset({"first"}))
    assert calls == ["first", "second", "first", "second"]
    changed = [runner.Stage("first", first, {"n": 4}), stages[1]]
    assert runner.run_stages(spark, changed, str(tmp_path))["second"].count() == 4


def test_settings():
    assert runner.with_dotted({"a": {"b": 1}}, {"a.b": 2}) == {"a": {"b": 2}}
    with pytest.raises(ValueError):
        runner.with_dotted({"a": {"b": 1}}, {"a.c": 2})
    with pytest.raises(ValueError):
        runner.check_combination({"objective": "predict_edge_type", "decoder": "node_mlp"})
    assert runner.grid({"x": [1, 2], "y": [3]}) == [{"x": 1, "y": 3}, {"x": 2, "y": 3}]


def test_layers(spark):
    import numpy as np

    from tracewell.operators import learn

    layers = learn.parse_layers("linear(3) | relu | dropout | linear(2)")
    w = learn.initial_weights(layers, 2, 0)
    d = spark.createDataFrame([([1.0, -2.0],), ([0.5, 0.5],)], "x array<double>")
    got = [r.y for r in learn.forward(d, "x", layers, w, "y").collect()]
    x = np.array([[1.0, -2.0], [0.5, 0.5]])
    assert np.allclose(got, np.maximum(x @ w[0][0], 0) @ w[1][0])
    with pytest.raises(ValueError):
        learn.parse_layers("linear | what(3)")


def test_own_vector_in_aggregation(spark):
    from tracewell.operators import encoders

    e = spark.createDataFrame([("g", "a", "b")], "g string, src string, dst string")
    x = spark.createDataFrame([("g", "a", [1.0, 2.0]), ("g", "b", [10.0, 20.0])], "g string, node string, x array<double>")
    got = {r.node: r.x for r in encoders.aggregate(e, x, ["g"], "sum", 0.5).collect()}
    assert got == {"a": [1.5, 3.0], "b": [16.0, 32.0]}


def test_imitations_begin_at_events_of_their_actor(spark):
    e = spark.createDataFrame([("r", "p", 10**9, 0), ("p", "f", 2 * 10**9, 1)], "src string, dst string, t long, event_id long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    rows = transform.imitations(e, node("r", "p"), node("r", "p"), node("f", "g"), 0, 100 * 10**9, 60).orderBy("run", "step").collect()
    assert len(rows) >= 60 and all(r.y == 1 for r in rows) and len({r.event_id for r in rows}) == len(rows)
    actors = {r.run: (r.dst if r.op == "EVENT_READ" else r.src) for r in rows}
    assert set(actors.values()) == {"r", "p"}
    begins = {"r": (10**9,), "p": (10**9, 2 * 10**9)}
    for r in rows:
        if r.step == 0:
            assert any(0 <= r.t - b <= 3 * 10**9 for b in begins[actors[r.run]])
    runs = {k: tuple(r.op for r in rows if r.run == k) for k in actors}
    assert set(runs.values()) <= set(transform.TEMPLATES)
