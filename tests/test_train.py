"""Training against the same steps in one process, and slopes against differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import learn, train

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("objective", sorted(train.OBJECTIVES))
@pytest.mark.parametrize("layers", ["linear(3)", "linear(4) | tanh | linear(3)", "linear(4) | elu | linear(5) | leaky_relu | linear(3) | sigmoid", "linear(6) | relu | dropout | linear(3)"])
def test_slopes_are_those_of_the_loss(objective, layers):
    if objective == "link":
        layers = layers.replace("linear(3)", "linear(1)").removesuffix(" | sigmoid")
    x, weight = RNG.normal(size=(7, 4)), RNG.uniform(0.5, 2, 7)
    target = {"classes": RNG.integers(0, 3, (7, 1)), "link": RNG.integers(0, 2, (7, 1))}.get(objective, RNG.normal(size=(7, 3))).astype(float)
    plan = learn.parse_layers(layers)
    weights = [(a, b + RNG.normal(size=b.shape) * 0.1) for a, b in learn.initial_weights(plan, 4, 1)]
    _, slopes = train.gradients(x, target, weight, plan, weights, objective)
    flat = [v for pair in weights for v in pair]
    for k, v in enumerate(flat):
        for at in list(np.ndindex(v.shape))[:6]:
            both = []
            for d in (1e-6, -1e-6):
                moved = [u.copy() for u in flat]
                moved[k][at] += d
                both.append(train.gradients(x, target, weight, plan, list(zip(moved[::2], moved[1::2])), objective)[0])
            assert slopes[k][at] == pytest.approx((both[0] - both[1]) / 2e-6, rel=1e-4, abs=1e-6)


def twin(x, target, part, layers, objective, epochs, rate, decay, steps, seed):
    """The steps of train() over arrays."""
    plan = learn.parse_layers(layers)
    weights, adam, history = learn.initial_weights(plan, x.shape[1], seed), train.Adam(rate, decay), []
    for _ in range(epochs):
        total = 0.0
        for s in range(steps):
            own = part == s
            if own.any():
                loss, slopes = train.gradients(x[own], target[own], np.ones(own.sum()), plan, weights, objective)
                flat = adam.step([v for p in weights for v in p], [g / own.sum() for g in slopes])
                weights, total = list(zip(flat[::2], flat[1::2])), total + loss
        history.append(total / len(x))
    return weights, history


@pytest.mark.parametrize(("objective", "steps"), [("classes", 1), ("mse", 3)])
def test_training_takes_the_same_steps(spark, objective, steps):
    n = 200
    x = RNG.normal(size=(n, 4))
    target = (x[:, :1] > 0).astype(float) + (x[:, 1:2] > 0) if objective == "classes" else np.tanh(x @ RNG.normal(size=(4, 3)))
    rows = spark.createDataFrame([(i, v.tolist(), int(t[0]) if objective == "classes" else t.tolist()) for i, (v, t) in enumerate(zip(x, target))], f"id long, x array<double>, target {'int' if objective == 'classes' else 'array<double>'}").repartition(5)
    part = np.array([r[0] for r in spark.range(n).orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(steps))).collect()])
    model = train.train(rows, "linear(6) | tanh | linear(3)", objective, 6, 0.05, 0.01, steps, "id", seed=4)
    weights, history = twin(x, target, part, "linear(6) | tanh | linear(3)", objective, 6, 0.05, 0.01, steps, 4)
    assert [h["loss"] for h in model.history] == pytest.approx(history)
    for (a, b), (c, d) in zip(model.weights, weights):
        assert np.allclose(a, c) and np.allclose(b, d)
    assert history[-1] < history[0]
    out = train.run_forward(x, learn.parse_layers(model.layers), weights)[-1]
    want = train.OBJECTIVES[objective](out, target)[0]
    scored = {r.id: r for r in train.with_losses(rows, model).collect()}
    assert [scored[i].loss for i in range(n)] == pytest.approx(want.tolist())
    if objective == "classes":
        assert [scored[i].predicted for i in range(n)] == out.argmax(1).tolist()
        assert [scored[i].correct for i in range(n)] == (out.argmax(1) == target[:, 0]).tolist()


def blobs(spark, n=120, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, (r.normal(size=3) + 3 * (i % 3)).tolist(), i % 3) for i in range(n)], "id long, x array<double>, target int")


def test_patience_keeps_the_best_weights(spark):
    rows = blobs(spark)
    wrong = rows.withColumn("target", (F.col("target") + 1) % 3)  # fitting makes this worse and worse
    model = train.train(rows, "linear(3)", "classes", 20, 0.1, val=wrong, patience=2)
    vals = [h["val"] for h in model.history]
    assert len(vals) < 20 and vals[-3:] == sorted(vals[-3:])
    assert train.mean_loss(model, wrong) == pytest.approx(min(vals))


def test_fine_tuning_and_weights(spark):
    rows = blobs(spark)
    model = train.train(rows, "linear(8) | tanh | linear(3)", "classes", 15, 0.05)
    assert train.with_losses(rows, model).filter("correct").count() > 100
    few = learn.few_shot(rows.withColumnRenamed("id", "event_id"), "target", 5)
    tuned = train.train(few, model.layers, "classes", 5, 0.01, start=model.weights)
    assert train.mean_loss(tuned, few) < train.mean_loss(model, few)
    uneven = rows.filter("target = 0 or id < 30")
    weighted = train.class_weights(uneven, 3)
    sums = {r.target: r.s for r in weighted.groupBy("target").agg(F.sum("weight").alias("s")).collect()}
    assert sums == pytest.approx({t: uneven.count() / 3 for t in range(3)})
    assert len(train.train(weighted, "linear(3)", "classes", 2).history) == 2


def test_links_and_edges(spark):
    """True and drawn links told apart by a network over both ends."""
    e = spark.createDataFrame([(i, i % 10, 10 + (i * 3) % 10) for i in range(60)], "id long, src long, dst long")
    v = spark.createDataFrame([(i, [float(i < 10), i / 20, 1.0]) for i in range(20)], "node long, vec array<double>")
    pairs = learn.gathered(e, v).select(F.concat("src_vec", "dst_vec").alias("x"), F.lit(1).alias("target")).unionByName(learn.gathered(e.select("id", F.col("dst").alias("src"), F.col("src").alias("dst")), v).select(F.concat("src_vec", "dst_vec").alias("x"), F.lit(0).alias("target")))
    model = train.train(pairs, "linear(4) | relu | linear(1)", "link", 25, 0.1, seed=2)
    assert model.history[-1]["loss"] < 0.3 < model.history[0]["loss"]


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, [1.0, 2.0], None), (3, [1.0, 2.0], 1), (4, [2.0, 1.0], 0)], "id long, x array<double>, target int")
    model = train.train(rows, "linear(2)", "classes", 2)
    got = {r.id: r.loss for r in train.with_losses(rows, model).collect()}
    assert got[1] is None and got[2] is None and got[3] > 0
    assert train.train(rows.filter("id > 9"), "linear(2)", "classes", 3).history == []
    with pytest.raises(ValueError):
        train.train(rows, "linear(2)", "what", 1)


def test_slopes_of_the_variational_loss():
    x, noise = RNG.normal(size=(6, 5)), RNG.normal(size=(6, 2))
    first = lambda layers, n, k: learn.initial_weights(learn.parse_layers(layers), n, k)
    model = train.Variational("linear(4) | tanh", "linear(3) | tanh | linear(5)", first("linear(4)", 5, 1), first("linear(2)", 4, 2)[0], first("linear(2)", 4, 3)[0], first("linear(3) | linear(5)", 2, 4), 0.3)
    flat = [v.copy() for v in model.flat()]
    slopes = train.variational_step(x, noise, model)[2]
    assert len(slopes) == len(flat)
    for k, v in enumerate(flat):
        for at in list(np.ndindex(v.shape))[:5]:
            both = []
            for d in (1e-6, -1e-6):
                moved = [u.copy() for u in flat]
                moved[k][at] += d
                model.set(moved)
                both.append(train.variational_step(x, noise, model)[0].sum())
            assert slopes[k][at] == pytest.approx((both[0] - both[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_variational_training_takes_the_same_steps(spark):
    n = 80
    x = RNG.normal(size=(n, 2)) @ RNG.normal(size=(2, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (99, None)], "id long, x array<double>").repartition(5)
    model = train.train_variational(rows, "id", "linear(4) | relu", 2, "linear(4) | relu | linear(6)", 30, 0.02, 1e-3, seed=2)
    other = train.train_variational(rows.filter("id is null"), "id", "linear(4) | relu", 2, "linear(4) | relu | linear(6)", 1, seed=2)
    assert other.history == []
    first = lambda layers, m, k: learn.initial_weights(learn.parse_layers(layers), m, k)
    mine = train.Variational("linear(4) | relu", "linear(4) | relu | linear(6)", first("linear(4)", 6, 2), first("linear(2)", 4, 3)[0], first("linear(2)", 4, 4)[0], first("linear(4) | linear(6)", 2, 5), 1e-3)
    adam, history = train.Adam(0.02), []
    for epoch in range(30):
        loss, _, slopes = train.variational_step(x, train.normal(np.arange(n), 2 * 7919 + epoch, 2), mine)
        history.append(loss.mean())
        mine.set(adam.step(mine.flat(), [g / n for g in slopes]))
    assert [h["loss"] for h in model.history] == pytest.approx(history) and history[-1] < 0.7 * history[0]
    got = {r.id: (r.out, r.loss) for r in train.reconstructed(rows, model).collect()}
    want = train.variational_step(x, np.zeros((n, 2)), mine)[1]
    for i in range(n):
        assert np.allclose(got[i][0], want[i]) and got[i][1] == pytest.approx(((want[i] - x[i]) ** 2).mean())
    assert got[99] == (None, None)


def test_draws_are_normal():
    z = train.normal(np.arange(20_000), 5, 3)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T)[0, 1]) < 0.02
