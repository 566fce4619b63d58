"""Layers against plain numpy over small graphs."""

import numpy as np
import pytest

from tracewell.functions import joins, vectors
from tracewell.operators import encoders, learn

RNG = np.random.default_rng(3)
N, WIDE = 9, 5
X = {g: RNG.normal(size=(N, WIDE)) for g in "ab"}
EDGES = [(g, int(RNG.integers(N - 1)), 0 if k % 3 == 0 else int(RNG.integers(N - 1)), RNG.normal(size=3).tolist()) for g in "ab" for k in range(40)]  # node 8 alone, node 0 a hub


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame(EDGES, "g string, src long, dst long, e array<double>")
    x = spark.createDataFrame([(g, i, X[g][i].tolist()) for g in X for i in range(N)], "g string, node long, x array<double>")
    return e, x


def rows(df):
    return {(r.g, r.node): np.array(r.x) for r in df.collect()}


def close(df, want):
    got = rows(df)
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k]), k


def softmax(l):
    e = np.exp(l - l.max(0))
    return e / e.sum(0)


def attention(x, edges, w, heads, concat):
    """x by node; edges (src, dst, attributes)."""
    p = {k: x @ w[k][0] + w[k][1] for k in ("query", "key", "value", "skip")}
    size = w["query"][0].shape[1] // heads
    out = p["skip"].copy()
    for i in range(len(x)):
        own = [(s, a) for s, d, a in edges if d == i]
        if not own:
            continue
        ev = np.array([np.array(a) @ w["edge"][0] if "edge" in w else 0 * p["key"][0] for _, a in own])
        k, v = (p[n][[s for s, _ in own]] + ev for n in ("key", "value"))
        parts = []
        for h in range(heads):
            c = slice(h * size, (h + 1) * size)
            parts.append(softmax((k[:, c] @ p["query"][i, c]) / np.sqrt(size)) @ v[:, c])
        out[i] += np.concatenate(parts) if concat or heads == 1 else np.mean(parts, 0)
    return out


def of(g):
    return [(s, d, a) for q, s, d, a in EDGES if q == g]


@pytest.mark.parametrize("hot", [1000, 4])
@pytest.mark.parametrize(("heads", "concat", "edge"), [(1, False, 0), (3, False, 3), (2, True, 3)])
def test_attention_layer(graph, monkeypatch, heads, concat, edge, hot):
    monkeypatch.setattr(joins, "HOT", hot)  # the hub by broadcast, or not
    e, x = graph
    w = encoders.attention_weights(WIDE, 4, heads, 1, edge, concat)
    close(encoders.attention_layer(e, x, ["g"], w, heads, concat, "e" if edge else None), {(g, i): v for g in X for i, v in enumerate(attention(X[g], of(g), w, heads, concat))})


def gat(x, edges, w, heads, concat, loops, edge):
    p, size = x @ w["linear"], w["linear"].shape[1] // heads
    edges = [e for e in edges if e[0] != e[1]] + [(i, i, None) for i in range(len(x))] if loops else edges
    out = np.zeros((len(x), heads * size if concat else size))
    for i in range(len(x)):
        own = [(s, a) for s, d, a in edges if d == i]
        if not own:
            continue
        parts = []
        for h in range(heads):
            c = slice(h * size, (h + 1) * size)
            l = np.array([p[s, c] @ w["source"][h] + p[i, c] @ w["target"][h] + (np.array(a) @ w["edge"][:, c] @ w["edge_target"][h] if edge else 0) for s, a in own])
            parts.append(softmax(np.where(l > 0, l, 0.2 * l)) @ p[[s for s, _ in own]][:, c])
        out[i] = np.concatenate(parts) if concat else np.mean(parts, 0)
    return out


@pytest.mark.parametrize(("heads", "concat", "loops", "edge"), [(1, True, False, 0), (2, True, True, 0), (3, False, False, 3)])
def test_gat_layer(graph, heads, concat, loops, edge):
    e, x = graph
    w = encoders.gat_weights(WIDE, 4, heads, 2, edge)
    close(encoders.gat_layer(e, x, ["g"], w, heads, concat, "e" if edge else None, loops), {(g, i): v for g in X for i, v in enumerate(gat(X[g], of(g), w, heads, concat, loops, edge))})


def test_stacks_of_layers(graph):
    e, x = graph
    relu = lambda v: np.maximum(v, 0)
    stack = [encoders.attention_weights(WIDE, 3, 2, 1), encoders.attention_weights(3, 2, 1, 2)]
    close(encoders.attention_encoder(e, x, ["g"], stack, 2), {(g, i): v for g in X for i, v in enumerate(attention(relu(attention(X[g], of(g), stack[0], 2, False)), of(g), stack[1], 1, False))})

    three = [encoders.gat_weights(WIDE, 3, 2, 1), encoders.gat_weights(6, 3, 2, 2), encoders.gat_weights(6, 4, 1, 3)]
    mlp = [(RNG.normal(size=(10, 8)), RNG.normal(size=8)), (RNG.normal(size=(8, 4)), RNG.normal(size=4))]
    want = {}
    for g in X:
        b = relu(gat(relu(gat(X[g], of(g), three[0], 2, True, True, 0)), of(g), three[1], 2, True, True, 0))
        both = np.hstack([b, gat(b, of(g), three[2], 1, False, True, 0)])
        want |= {(g, i): v for i, v in enumerate(relu(both @ mlp[0][0] + mlp[0][1]) @ mlp[1][0] + mlp[1][1])}
    close(encoders.rcaid_encoder(e, x, ["g"], three, 2, mlp), want)

    two, out, last = [encoders.gat_weights(WIDE, 3, 2, 1, 3), encoders.gat_weights(6, 4, 2, 2, 3)], (RNG.normal(size=(14, 4)), RNG.normal(size=4)), (RNG.normal(size=(6, 8)), np.zeros(8))
    want, decoded = {}, {}
    for g in X:
        a = np.tanh(gat(X[g], of(g), two[0], 2, True, False, 3))
        b = np.tanh(gat(a, of(g), two[1], 2, True, False, 3) + a @ last[0])
        decoded |= {(g, i): v for i, v in enumerate(b)}
        want |= {(g, i): v for i, v in enumerate(np.hstack([a, b]) @ out[0] + out[1])}
    close(encoders.masked_gat_encoder(e, x, ["g"], two, 2, out, "e", "tanh", last), want)
    close(encoders.masked_gat_encoder(e, x, ["g"], two, 2, None, "e", "tanh", last), decoded)


def test_sums_with_edge_attributes(graph, spark):
    e, x = graph
    same = spark.createDataFrame([(g, s, d, [*a, 0.5, -0.5]) for g, s, d, a in EDGES], "g string, src long, dst long, e array<double>")
    weights = [(RNG.normal(size=(WIDE, 2)), RNG.normal(size=2))]
    want = {}
    for g in X:
        for i in range(N):
            total = 1.25 * X[g][i] + sum((np.maximum(X[g][s] + [*a, 0.5, -0.5], 0) for s, d, a in of(g) if d == i), np.zeros(WIDE))
            want[g, i] = np.tanh(total @ weights[0][0] + weights[0][1])
    close(encoders.gin_layer(same, x, ["g"], "linear(2) | tanh", weights, 0.25, "e"), want)


def test_no_row_an_element(graph):
    e, x = graph
    for df in (encoders.aggregate(e, x, ["g"], "mean"), encoders.aggregate(e, x, ["g"], "sum", 0.5)):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], 2.0), (1, [3.0, 4.0], 0.5), (2, None, 1.0)], "k long, v array<double>, w double")
    assert vectors.width(d, "v") == 2 and vectors.width(d.filter("k = 3"), "v") == 0
    assert {r.k: r.v for r in vectors.combined(d, ["k"], "v", 2, weight="w").collect()} == {1: [3.5, 6.0], 2: [None, None]}
    assert {r.k: r.v for r in vectors.combined(d, ["k"], "v", 2, "mean").collect()} == {1: [2.0, 3.0], 2: [None, None]}
    got = [r.y for r in d.withColumn("y", vectors.times_matrix("v", np.array([[1.0], [10.0]]), np.array([0.5]))).collect()]
    assert got == [[21.5], [43.5], None]
    assert learn.parse_layers("tanh") == [("tanh", None)]
