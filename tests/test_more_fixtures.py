"""Small cases of sources, sinks, settings and rules that no query covers."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import ordinal, taxonomy
from tracewell.operators import batches, detect, features, learn, queues, trace, transform, windows
from tracewell.plans import runner
from tracewell.sources import labels, records, sinks


def edges(spark, rows, day="d"):
    return spark.createDataFrame([(day, i, t, s, d, o) for i, (s, d, t, o) in enumerate(rows)], "day string, event_id long, t long, src long, dst long, op string")


def test_running_values_across_slices(spark):
    d = spark.createDataFrame([("a", t, v) for t, v in ((1, 5), (2, 7), (11, 1), (12, None), (31, 9))] + [("b", 3, 4)], "g string, t long, v long")
    got = ordinal.with_running(d, ["g"], ["t"], 10, {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")}).orderBy("g", "t").collect()
    assert [(r.s, r.m, r.l) for r in got] == [(5, 5, 5), (12, 7, 5), (13, 7, 1), (13, 7, 1), (22, 9, 1), (4, 4, 4)]
    got = ordinal.with_running(d, ["g"], ["t"], 10, {"m": ("max", "v")}, before=True).orderBy("g", "t").collect()
    assert [r.m for r in got] == [None, 5, 7, 7, 7, None]
    got = ordinal.with_previous(d, ["g"], ["t"], 10, "v", "p").orderBy("g", "t").collect()
    assert [r.p for r in got] == [None, 5, 7, 1, None, None]


def test_unique_pairs_over_many_slices(spark):
    import random

    random.seed(3)
    rows = [(random.randrange(3), random.randrange(3), t * 10**12, "x") for t in range(200)]
    want, held, batch = [], set(), 0
    for s, d, _, _ in rows:
        if (s, d) in held:
            batch, held = batch + 1, set()
        held.add((s, d))
        want.append(batch)
    assert [r.batch for r in batches.by_unique_pairs(edges(spark, rows), ["day"]).orderBy("t").collect()] == want


def test_strong_components_equal_reachability(spark):
    import random

    random.seed(4)
    for n, m in ((12, 20), (30, 45), (5, 20)):
        pairs = [(random.randrange(n), random.randrange(n)) for _ in range(m)]
        reach = {(a, b) for a, b in pairs}
        while True:
            more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
            if not more:
                break
            reach |= more
        got = transform.acyclic(edges(spark, [(a, b, 0, "x") for a, b in pairs]), ["day"])
        assert {(r.src, r.dst) for r in got.collect()} == {(a, b) for a, b in pairs if a != b and (b, a) not in reach}


def test_walks_that_prefer_near_times(spark):
    e = edges(spark, [(9, 1, 50, "x"), (1, 2, 100, "x"), (1, 3, 10_000, "x"), (1, 4, 5, "x")])
    start = spark.createDataFrame([(9,)], "node long")
    got = [r.path[2] for r in features.decayed_walks(e, start, 3, 300, 100.0).collect()]
    assert got.count(2) > 290 and 4 not in got
    even = [r.path[2] for r in features.decayed_walks(e, start, 3, 300, 1e12).collect()]
    assert 100 < even.count(2) < 200 and even.count(2) + even.count(3) == 300


def test_walks_go_back_where_no_edge_goes_out(spark):
    e = edges(spark, [(1, 2, 10, "x"), (2, 3, 20, "x")])
    starts = spark.createDataFrame([(1,), (3,)], "node long")
    got = {r.node: r.path for r in features.walks_either_way(e, starts, 4, 1).collect()}
    assert got == {1: [1, 2, 3], 3: [3, 2, 1]}


def test_tracing_forward(spark):
    e = edges(spark, [(1, 2, 1, "x"), (2, 3, 2, "x"), (4, 3, 3, "x")])
    poi = spark.createDataFrame([("d", 1)], "day string, poi long")
    assert sorted(r.node for r in trace.descendants(e, ["day"], poi).collect()) == [2, 3]
    assert sorted((r.exit, r.node) for r in trace.exit_components(e, ["day"], poi).collect()) == [(3, 1), (3, 2), (3, 3)]


def test_long_paths_are_found(spark):
    e = edges(spark, [(i, i + 1, i, "x") for i in range(32)])
    start = spark.createDataFrame([("d", 0)], "day string, node long")
    assert max(r.hops for r in trace.shortest_paths(e, ["day"], start).collect()) == 32


def test_templates():
    assert len(transform.TEMPLATES) == 14 and all(t[0] == "EVENT_OPEN" and set(t) <= {"EVENT_OPEN", "EVENT_READ", "EVENT_WRITE"} for t in transform.TEMPLATES)


def test_imitations_act_for_the_attack(spark):
    rows = [(1, 101, 5, "x"), (1, 2, 10, "x"), (2, 3, 20, "x"), (9, 1, 30, "x"), (7, 102, 40, "x")]
    e = edges(spark, rows)
    bad = spark.createDataFrame([(1,), (2,)], "node long")
    subjects = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 9)], "node long")
    assert sorted(r.node for r in transform.imitation_actors(e, bad, subjects).collect()) == [1, 2, 3]
    files = spark.createDataFrame([(101,), (102,)], "node long")
    got = transform.imitations(e, bad, subjects, files, 0, 100, 12).orderBy("run", "step").collect()
    assert len(got) >= 12 and len({r.run for r in got}) < 7
    for r in got:
        actor, file = (r.dst, r.src) if r.op == "EVENT_READ" else (r.src, r.dst)
        assert actor in (1, 2, 3) and file in (101, 102)
    times = [r.t for r in got if r.run == 0]
    assert times == sorted(times) and times[-1] - times[0] <= 3 * 10**9 * len(times)
    assert transform.imitations(e, bad.limit(0), subjects, files, 0, 100, 12).count() == 0


def test_outlying_members(spark):
    members = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "tw long, node long")
    lof = spark.createDataFrame([(5, 2.0), (6, 0.9), (7, 3.0)], "id long, lof double")
    seen = spark.createDataFrame([(7,)], "node long")
    assert [tuple(r) for r in queues.outlying_members(members, lof, seen).collect()] == [(1, 5)]


def test_learned_parts(spark):
    e = edges(spark, [(1, 2, 1, "a"), (2, 1, 2, "b"), (1, 9, 3, "b")])
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0])], "node long, vec array<double>")
    g = learn.gathered(e, v)
    assert g.count() == 2
    layers = learn.parse_layers("linear(3) | relu | linear(1)")
    out = learn.edge_mlp(g, "linear(3) | relu | linear(1)", learn.initial_weights(layers, 4, 0), "score")
    assert [len(r.score) for r in out.collect()] == [1, 1]
    with pytest.raises(ValueError):
        learn.losses(g, [("nothing", {})])
    n = spark.range(400).select(F.col("id").alias("node"), F.array(F.lit(1.0)).alias("x"))
    assert 80 < learn.masked(n, 0.3).filter("mask and x_in[0] = 0").count() < 160
    assert {(r.op, r.n) for r in learn.few_shot(e, "op", 1).groupBy("op").agg(F.count("*").alias("n")).collect()} == {("a", 1), ("b", 1)}
    assert learn.without_attacks(e.withColumn("y", F.when(F.col("src") == 2, 1))).count() == 2
    days = spark.createDataFrame([("d",), ("e",), ("f",)], "day string")
    assert learn.bagged_days(e, days, 1).count() % 3 == 0
    assert len(learn.document_vectors(spark.createDataFrame([(1, ["a", "b"])], "node long, tokens array<string>"), 4).first().vec) == 4


def test_a_model_is_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    d = spark.createDataFrame([(0.0, Vectors.dense(0.0)), (1.0, Vectors.dense(1.0))], ["label", "features"])
    model = LogisticRegression(maxIter=2).fit(d)
    learn.save_model(model, f"{tmp_path}/m")
    assert learn.load_model(f"{tmp_path}/m").coefficients == model.coefficients


def test_edge_labels_and_counts():
    assert taxonomy.n_edge_types("agent", taxonomy.AGENT_OPS, True) == 33 and taxonomy.n_edge_types("ten", taxonomy.TEN_OPS, False) == 10
    assert taxonomy.ops_by_id("ten", taxonomy.TEN_OPS, True)[10] == "EVENT_WRITE" and taxonomy.ops_by_id("ten", taxonomy.TEN_OPS, False)[10] == "EVENT_CLONE"
    assert set(taxonomy.AGENT_OPS) == {op for _, op, _ in taxonomy.triplets("agent")}


def test_snapshots_and_losses(spark, tmp_path):
    e = edges(spark, [(1, 2, 5, "a"), (1, 2, 3, "b")]).withColumn("tw", F.col("t") % 2)
    e = e.unionByName(e.withColumn("tw", F.lit(10).cast("long")))
    sinks.write_windows(e, f"{tmp_path}/w")
    assert sinks.read_windows(spark, f"{tmp_path}/w", ["d"]).count() == 4 and sinks.read_windows(spark, f"{tmp_path}/w", ["x"]).count() == 0
    assert [r.tw for r in sinks.windows_of(spark, f"{tmp_path}/w").collect()] == [1, 10]
    edge = spark.createDataFrame([(0.5, 1, 2, 7, 3, "test", 1, 4)], "loss double, srcnode long, dstnode long, time long, edge_type int, split string, epoch int, tw long")
    sinks.write_losses(edge, f"{tmp_path}/e")
    assert sinks.read_losses(spark, f"{tmp_path}/e").select(*edge.columns).collect() == edge.collect()
    node = spark.createDataFrame([(1, 0.5, 2.5, True, "val", 1, 4)], "node long, loss double, threatrace_score double, correct_pred boolean, split string, epoch int, tw long")
    sinks.write_node_losses(node, f"{tmp_path}/n")
    back = sinks.read_losses(spark, f"{tmp_path}/n")
    assert set(back.columns) == set(node.columns) and back.select(*node.columns).collect() == node.collect()
    sinks.write_metrics(spark.createDataFrame([(1.0,)], "adp double"), f"{tmp_path}/m", "a")
    sinks.write_metrics(spark.createDataFrame([(2.0,)], "adp double"), f"{tmp_path}/m", "b")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2


def test_adjacency_names_and_truth(spark, tmp_path):
    e = edges(spark, [(1, 2, 5, "a")])
    nodes = spark.createDataFrame([(1, "p", "subject"), (2, "f", "file")], "node long, label string, node_type string")
    sinks.write_adjacency(e, nodes, f"{tmp_path}/a")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/a").collect()] == [("1", "2", "p", "f", "a", "subject", "file")]
    sinks.write_names(nodes, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j/names").count() == spark.read.json(f"{tmp_path}/j/types").count() == 2
    known = spark.createDataFrame([(1, "u1", "x"), (2, "u2", "y"), (3, "u3", "z")], "index_id long, uuid string, label string")
    sinks.write_truth(known, e, f"{tmp_path}/t")
    assert {r.uuid for r in labels.ground_truth(spark, f"{tmp_path}/t").collect()} == {"u1", "u2"}


def test_where_tables_come_from(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/few/event_table")
    spark.range(5).write.parquet(f"{tmp_path}/all/event_table")
    settings = {"root": f"{tmp_path}/few", "all_root": f"{tmp_path}/all"}
    assert sinks.source(spark, settings, "event_table").count() == 3
    assert sinks.source(spark, settings | {"use_all_files": True}, "event_table").count() == 5
    for name in ("a/x.json", "a/b/y.json", "a/b/z.txt"):
        f = tmp_path / "nested" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}\n")
    assert sinks.read_nested(spark, f"{tmp_path}/nested", "*.json").count() == 2
    assert sinks.manifest("/r", "e5", "theia") == "/r/ta1-theia*-e5-official*.json*"
    splits = spark.createDataFrame([("d", "train"), ("e", "test")], "day string, split string")
    assert sinks.split_of(edges(spark, [(1, 2, 3, "x")]), splits, "train").count() == 1 and sinks.split_of(edges(spark, [(1, 2, 3, "x")]), splits, "test").count() == 0


def test_relational_tables(spark):
    sinks.create_tables(spark, "tracewell_test")
    try:
        assert {r.tableName for r in spark.sql("SHOW TABLES IN tracewell_test").collect()} == set(sinks.TABLES)
        assert "event_date" in spark.table("tracewell_test.event_table").columns
    finally:
        spark.sql("DROP DATABASE tracewell_test CASCADE")


def test_ids_both_ways_and_ranges(spark):
    nodes = spark.createDataFrame([("u", 1, "file"), ("v", 2, "subject")], "uuid string, index_id long, kind string")
    assert {tuple(r) for r in records.ids_by_uuid(nodes).collect()} == {("u", 1), ("v", 2)}
    assert {tuple(r) for r in records.uuids_by_id(nodes).collect()} == {(1, "u", "file"), (2, "v", "subject")}
    e = edges(spark, [(1, 2, 5, "x"), (2, 3, 6, "x"), (1, 2, 9, "x")])
    assert records.events_between(e, 5, 6).count() == 2 and records.events_between(e, 5, 9, nodes).count() == 2
    rows = spark.createDataFrame([("u", "attack", 1), ("v", "benign", 2)], "uuid string, label string, index_id long")
    assert [r.uuid for r in labels.attack_rows(rows).collect()] == ["u"]


KNOWN = {"train": {"lr": runner.Setting(float), "epochs": runner.Setting(int), "encoder": runner.Setting(str, ("gat", "sage"))}, "trial": runner.Setting(bool)}


def test_settings_files(tmp_path):
    (tmp_path / "base.yml").write_text("train:\n  lr: 0.1\n  epochs: 3\n")
    (tmp_path / "own.yml").write_text("include: base.yml\ntrain:\n  epochs: 5\n  encoder: gat, sage\n")
    got = runner.load(f"{tmp_path}/own.yml", KNOWN)
    assert got == {"train": {"lr": 0.1, "epochs": 5, "encoder": "gat, sage"}}
    assert runner.from_command_line(got, KNOWN, ["--train.lr", "0.5", "--trial", "true"]) == {"train": {"lr": 0.5, "epochs": 5, "encoder": "gat, sage"}, "trial": True}
    for bad, error in (({"train": {"lr": "x"}}, TypeError), ({"train": {"encoder": "gin"}}, ValueError), ({"train": {}}, ValueError), ({"other": 1}, ValueError), ({"train": {"lr": None}}, ValueError)):
        with pytest.raises(error):
            runner.check_types(bad, KNOWN)


def test_combinations_that_cannot_work():
    runner.check_combination({"objective": "predict_edge_type", "decoder": "edge_mlp", "tgn": True, "last_neighbours": True})
    for bad in (
        {"objective": "predict_edge_type", "decoder": "node_mlp"}, {"objective": "predict_node_type", "decoder": "edge_mlp"}, {"tgn": True, "batching": "inter_graph"},
        {"tgn": True, "last_neighbours": False}, {"last_neighbours": True, "tgn": True, "transform": "pseudo_graph"}, {"transform": "pseudo_graph", "objective": "predict_edge_type"},
        {"features": "fasttext", "pretrained": True, "size": 128}, {"objective": "reconstruct_masked", "threshold": "max_val_loss"}, {"few_shot": True}, {"multi_dataset": True, "features": "flash"}, {"evaluation": "edge", "level": "node"},
    ):
        with pytest.raises(ValueError):
            runner.check_combination(bad)


def test_experiments(spark):
    assert [s["lr"] for s in runner.varied({"lr": 1.0}, "lr", 0.1, 3)] == pytest.approx([0.9, 1.0, 1.1]) and [s["n"] for s in runner.varied({"n": 10}, "n", 0.2, 3)] == [8, 10, 12]
    assert [s["seed"] for s in runner.ensemble({"seed": 5}, 3)] == [5, 6, 7]
    assert runner.resolved({"node_hid_dim": 64, "node_out_dim": -2, "tgn_time_dim": -1}) == {"node_hid_dim": 64, "node_out_dim": 32, "tgn_time_dim": 64}
    assert runner.resolved({"node_hid_dim": 64, "node_out_dim": -1})["node_out_dim"] == 64
    runs = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0), ("c", 3.0, 1.5)], "run string, adp double, discrim double")
    assert runner.best_run(runs).first().run == "c"
    assert {(r.which, r.run) for r in runner.extremes(runs, "discrim").collect()} == {("least", "b"), ("greatest", "a")}


def test_stage_times(spark, tmp_path):
    took = {}
    runner.run_stages(spark, [runner.Stage("one", lambda s, i, c: s.range(3))], str(tmp_path), took=took)
    assert set(took) == {"one"} and took["one"] >= 0


def test_batching_settings(spark):
    e = edges(spark, [(1, 2, t, "x") for t in range(6)]).withColumn("tw", F.lit(7).cast("long"))
    assert batches.batched(e, {"global": "none"}).columns == e.columns
    assert [r.batch for r in batches.batched(e, {"by": ["tw"], "global": "unique_pairs"}).orderBy("t").collect()] == list(range(6))
    assert [r.inner for r in batches.batched(e, {"by": ["tw"], "inside": 4}).orderBy("t").collect()] == [0, 0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        batches.batched(e, {"global": "other"})
    assert batches.union_windows([e, e.withColumn("y", F.lit(1))]).filter("y is null").count() == 6
    assert [d.count() for d in batches.iterate(batches.by_edges(e, [], 4))] == [4, 2]


def test_shared_folder_is_asked_for_off_one_machine(spark, monkeypatch):
    from types import SimpleNamespace

    from tracewell.functions.tables import shared_root

    asked = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_root(asked)


def test_window_label(spark):
    got = spark.range(1).select(windows.window_label(F.lit(1522764061123456789), F.lit(1522764962000000000))).first()[0]
    assert got == "2018-04-03 10:01:01.123456789~2018-04-03 10:16:02.000000000"


def test_node_level_scores_need_right_predictions(spark):
    rows = [(1, 7, 0.5, 2.0, False), (2, 7, 0.1, 1.6, True), (3, 7, 0.2, 1.9, True), (1, 8, 0.3, 5.0, False)]
    losses = spark.createDataFrame(rows, "tw long, node long, loss double, threatrace_score double, correct_pred boolean")
    w = spark.createDataFrame([(i, i * 10, i * 10 + 5) for i in (1, 2, 3)], "tw long, start_t long, end_t long")
    got = {r.node: r for r in detect.node_level_scores(losses, detect.thresholds(losses), "threatrace", w).collect()}
    assert (got[7].score, got[7].y_hat, got[7].detected_tw, got[7].start_t, got[7].tw_with_max_loss) == (2.0, 1, 3, 30, 1)
    assert (got[8].score, got[8].y_hat, got[8].detected_tw) == (5.0, 0, 1)


def test_recurrent_unit(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    w = {"w": rng.normal(size=(6, 3)), "u": rng.normal(size=(6, 2)), "b": rng.normal(size=6), "c": rng.normal(size=6)}
    xs = rng.normal(size=(4, 3))
    d = spark.createDataFrame([(xs.tolist(),), ([],)], "x array<array<double>>")
    got = learn.gru(d, "x", w, "h").collect()
    h = np.zeros(2)
    for x in xs:
        gate = lambda k: 1 / (1 + np.exp(-(w["w"][k] @ x + w["b"][k] + w["u"][k] @ h + w["c"][k])))  # noqa: E731, B023
        r, z = gate(slice(0, 2)), gate(slice(2, 4))
        new = np.tanh(w["w"][4:] @ x + w["b"][4:] + r * (w["u"][4:] @ h + w["c"][4:]))
        h = (1 - z) * new + z * h
    assert np.allclose(got[0].h, h) and list(got[1].h) == [0.0, 0.0]


def test_tables_through_jdbc(spark):
    rows = spark.createDataFrame([(i, i * 10) for i in range(20)], "event_id long, timestamp_rec long")
    url = "jdbc:derby:memory:tracewell;create=true"
    sinks.write_jdbc(rows, url, "event_table", batch=7)
    back = sinks.read_jdbc(spark, url, "event_table", 0, 200, 4)
    assert back.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in back.collect()) == [(i, i * 10) for i in range(20)]
    assert sinks.source(spark, {"url": url}, "event_table").count() == 20


def test_chosen_edge_features(spark):
    d = spark.createDataFrame([([1.0], [2.0, 3.0], None)], "a array<double>, b array<double>, c array<double>")
    assert d.select(batches.edge_features(["b", "c", "a"]).alias("x")).first().x == [2.0, 3.0, 1.0]


def test_edge_labels_survive_in_graphs(spark):
    e = edges(spark, [(1, 2, 1, "x"), (2, 1, 2, "x")]).withColumn("y", F.when(F.col("t") == 2, 1))
    nodes = spark.createDataFrame([(1, "subject"), (2, "file")], "node long, node_type string")
    assert sorted((r.src_type, r.dst_type, r.y) for r in windows.multigraph(e, nodes).collect()) == [("file", "subject", 1), ("subject", "file", 0)]
