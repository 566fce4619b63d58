"""Message passing over edge and node tables: sums, attention from vectors, and layers of them.

features hold (by, node, x), one row a node of a graph; edges hold (by, src, dst) and may hold
a vector of attributes. Vectors are projected batch by batch in numpy; logits, weights
and messages are expressions of one row an edge; sums by destination are taken
element by element in tasks before the shuffle. A node that a share of all edges
meets goes to every task. Repeated edges count each; an edge at a node without features
sends nothing. Dropout is off: layers run forward.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.joins import join_hot
from tracewell.functions.tables import stored
from tracewell.functions.vectors import combined, plus, times_matrix, width

from . import learn

Pair = tuple[np.ndarray, np.ndarray | None]


def aggregate(edges: DataFrame, features: DataFrame, by: list[str], how: str = "mean", self_weight: float | None = None, edge: str | None = None) -> DataFrame:
    """(by, node, x): mean, sum or weighted sum (edge column weight) of in-neighbours' vectors.

    With edge, a column of vectors of the same length, a message is max(x + edge, 0). With self_weight,
    (1 + self_weight) times a node's own vector is added; nodes without in-neighbours then keep theirs alone.
    """
    size = width(features, "x")
    kept = edges.select(*by, "src", F.col("dst").alias("_to"), *(["weight"] if how == "weighted" else []), *([F.col(edge).alias("_e")] if edge else []))
    sent = join_hot(kept, features.select(*by, F.col("node").alias("src"), "x"), [*by, "src"])
    if edge:
        sent = sent.withColumn("x", F.transform(plus(F.col("x"), F.col("_e")), lambda v: F.greatest(v, F.lit(0.0))))
    sent = sent.withColumnRenamed("_to", "node")
    got = combined(sent, [*by, "node"], "x", size, "mean" if how == "mean" else "sum", "weight" if how == "weighted" else None)
    if self_weight is None:
        return got
    own = features.select(*by, "node", F.transform("x", lambda v: v.cast("double") * (1 + self_weight)).alias("x"))
    return combined(got.unionByName(own), [*by, "node"], "x", size)


def _heads(v: str | Column, heads: int, size: int) -> list[Column]:
    v = F.col(v) if isinstance(v, str) else v
    return [F.slice(v, 1 + h * size, size) for h in range(heads)]


def _times(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def softmax_sum(scored: DataFrame, by: list[str], heads: int, size: int) -> DataFrame:
    """(by, node, x): per head the messages into a node weighted by the softmax of their logits, heads side by side.

    scored(by, dst, logits of heads, message of heads * size).
    """
    scored = stored(scored.select(*by, "dst", "logits", "message"), "scored-edges")
    most = scored.groupBy(*by, "dst").agg(*[F.max(F.col("logits")[h]).alias(f"_m{h}") for h in range(heads)])
    weight = [F.exp(F.col("logits")[h] - F.col(f"_m{h}")) for h in range(heads)]
    parts = [_times(m, w) for m, w in zip(_heads("message", heads, size), weight)]
    joined = join_hot(scored, most, [*by, "dst"]).select(*by, F.col("dst").alias("node"), F.concat(*parts, F.array(*weight)).alias("x"))
    sums = combined(joined, [*by, "node"], "x", heads * (size + 1))
    scaled = [_times(part, 1 / F.col("x")[heads * size + h]) for h, part in enumerate(_heads("x", heads, size))]
    return sums.select(*by, "node", F.concat(*scaled).alias("x"))


def _merged(x: Column, heads: int, size: int, concat: bool) -> Column:
    """Heads side by side, or their mean."""
    if concat or heads == 1:
        return x
    total = _heads(x, heads, size)[0]
    for part in _heads(x, heads, size)[1:]:
        total = plus(total, part)
    return F.transform(total, lambda v: v / heads)


def attention_weights(inputs: int, size: int, heads: int, seed: int, edge: int = 0, concat: bool = False) -> dict[str, Pair]:
    """Uniform starting weights for attention_layer."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.uniform(-1, 1, (a, b)) / math.sqrt(a)
    out: dict[str, Pair] = {k: (draw(inputs, heads * size), rng.uniform(-1, 1, heads * size) / math.sqrt(inputs)) for k in ("query", "key", "value")}
    width_ = heads * size if concat else size
    out["skip"] = (draw(inputs, width_), np.zeros(width_))
    if edge:
        out["edge"] = (draw(edge, heads * size), None)
    return out


def attention_layer(edges: DataFrame, features: DataFrame, by: list[str], weights: dict[str, Pair], heads: int = 1, concat: bool = False, edge: str | None = None) -> DataFrame:
    """(by, node, x) for every node: attention by scaled products of queries and keys.

    An edge's logit in a head is the destination's query times the source's key, over the root of the head's
    size; messages are the source's values. Projected edge attributes are added to keys and values. A node
    gets its weighted messages, heads side by side or averaged, plus the projection `skip` of its own vector.
    """
    total = weights["query"][0].shape[1]
    size = total // heads
    names = ("query", "key", "value", "skip")
    matrix = np.hstack([weights[n][0] for n in names])
    bias = np.concatenate([np.zeros(weights[n][0].shape[1]) if weights[n][1] is None else weights[n][1] for n in names])
    ends = np.cumsum([0, *[weights[n][0].shape[1] for n in names]])
    projected = features.select(*by, "node", times_matrix("x", matrix, bias).alias("_p"))
    parts = stored(projected.select(*by, "node", *[F.slice("_p", int(a) + 1, int(b - a)).alias(n) for n, a, b in zip(names, ends, ends[1:])]), "projected")
    kept = edges.select(*by, "src", "dst", *([times_matrix(edge, weights["edge"][0]).alias("_e")] if edge else []))
    sent = join_hot(kept, parts.select(*by, F.col("node").alias("src"), "key", "value"), [*by, "src"])
    met = join_hot(sent, parts.select(*by, F.col("node").alias("dst"), "query"), [*by, "dst"])
    key, value = (plus(F.col(c), F.col("_e")) if edge else F.col(c) for c in ("key", "value"))
    logits = [F.aggregate(F.zip_with(q, k, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / math.sqrt(size) for q, k in zip(_heads("query", heads, size), _heads(key, heads, size))]
    got = softmax_sum(met.select(*by, "dst", F.array(*logits).alias("logits"), value.alias("message")), by, heads, size).withColumnRenamed("x", "_got")
    x = F.when(F.col("_got").isNull(), F.col("skip")).otherwise(plus(_merged(F.col("_got"), heads, size, concat), F.col("skip")))
    return parts.select(*by, "node", "skip").join(got, [*by, "node"], "left").select(*by, "node", x.alias("x"))


def gat_weights(inputs: int, size: int, heads: int, seed: int, edge: int = 0) -> dict[str, np.ndarray]:
    """Uniform starting weights for gat_layer."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.uniform(-1, 1, s) / math.sqrt(s[-1])
    out = {"linear": rng.uniform(-1, 1, (inputs, heads * size)) / math.sqrt(inputs), "source": draw(heads, size), "target": draw(heads, size)}
    if edge:
        out |= {"edge": rng.uniform(-1, 1, (edge, heads * size)) / math.sqrt(edge), "edge_target": draw(heads, size)}
    return out


def gat_layer(edges: DataFrame, features: DataFrame, by: list[str], weights: dict[str, np.ndarray], heads: int = 1, concat: bool = True, edge: str | None = None, self_loops: bool = False, slope: float = 0.2, bias: np.ndarray | None = None) -> DataFrame:
    """(by, node, x) for every node: attention by a vector over both ends' projections.

    A logit is the leaky rectifier of source, target and edge terms, each the product of a projection with a
    head's vector. With self_loops each node has exactly one edge to itself. A node without edges gets the bias.
    """
    linear = weights["linear"]
    size = linear.shape[1] // heads
    per_head = lambda m, a: np.stack([m[:, h * size : (h + 1) * size] @ a[h] for h in range(heads)], axis=1)
    matrix = np.hstack([linear, per_head(linear, weights["source"]), per_head(linear, weights["target"])])
    projected = features.select(*by, "node", times_matrix("x", matrix).alias("_p"))
    n = heads * size
    parts = stored(projected.select(*by, "node", F.slice("_p", 1, n).alias("message"), F.slice("_p", n + 1, heads).alias("_s"), F.slice("_p", n + heads + 1, heads).alias("_t")), "projected")
    kept = edges.select(*by, "src", "dst", *([times_matrix(edge, per_head(weights["edge"], weights["edge_target"])).alias("_e")] if edge else []))
    if self_loops:
        kept = kept.filter("src != dst").unionByName(parts.select(*by, F.col("node").alias("src"), F.col("node").alias("dst")), allowMissingColumns=True)
    sent = join_hot(kept, parts.select(*by, F.col("node").alias("src"), "message", "_s"), [*by, "src"])
    met = join_hot(sent, parts.select(*by, F.col("node").alias("dst"), "_t"), [*by, "dst"])
    raw = [F.col("_s")[h] + F.col("_t")[h] + (F.coalesce(F.col("_e")[h], F.lit(0.0)) if edge else F.lit(0.0)) for h in range(heads)]
    logits = F.array(*[F.when(r > 0, r).otherwise(r * slope) for r in raw])
    got = softmax_sum(met.select(*by, "dst", logits.alias("logits"), "message"), by, heads, size).withColumnRenamed("x", "_got")
    width_ = n if concat else size
    b = F.array(*[F.lit(float(v)) for v in (np.zeros(width_) if bias is None else bias)])
    x = F.when(F.col("_got").isNull(), b).otherwise(plus(_merged(F.col("_got"), heads, size, concat), b))
    return parts.select(*by, "node").join(got, [*by, "node"], "left").select(*by, "node", x.alias("x"))


def gin_layer(edges: DataFrame, features: DataFrame, by: list[str], layers: str, weights: list[Pair], eps: float = 0.0, edge: str | None = None) -> DataFrame:
    """(by, node, x): a network over (1 + eps) times a node's vector plus the sum of its messages."""
    got = aggregate(edges, features, by, "sum", self_weight=eps, edge=edge)
    return learn.forward(got, "x", learn.parse_layers(layers), weights, "x")


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b.withColumnRenamed("x", "_b"), [*by, "node"]).select(*by, "node", F.concat("x", "_b").alias("x"))


def _relu(df: DataFrame) -> DataFrame:
    return df.withColumn("x", learn.activation("relu", F.col("x")))


def attention_encoder(edges: DataFrame, features: DataFrame, by: list[str], stack: list[dict[str, Pair]], heads: int, concat: bool = False, edge: str | None = None, activation: str = "relu") -> DataFrame:
    """Attention layers one after the other, an activation between them; the last has one head."""
    x = features
    for weights in stack[:-1]:
        x = stored(attention_layer(edges, x, by, weights, heads, concat, edge).withColumn("x", learn.activation(activation, F.col("x"))), "layer")
    return attention_layer(edges, x, by, stack[-1], 1, False, edge)


def rcaid_encoder(edges: DataFrame, features: DataFrame, by: list[str], stack: list[dict[str, np.ndarray]], heads: int, mlp: list[Pair]) -> DataFrame:
    """Three attention layers with self loops; the second's and the third's outputs side by side go through a network."""
    first = stored(_relu(gat_layer(edges, features, by, stack[0], heads, self_loops=True)), "layer")
    second = stored(_relu(gat_layer(edges, first, by, stack[1], heads, self_loops=True)), "layer")
    third = gat_layer(edges, second, by, stack[2], 1, concat=False, self_loops=True)
    sizes = " | relu | ".join(f"linear({w.shape[1]})" for w, _ in mlp)
    return learn.forward(_beside(second, third, by), "x", learn.parse_layers(sizes), mlp, "x")


def masked_gat_encoder(edges: DataFrame, features: DataFrame, by: list[str], stack: list[dict[str, np.ndarray]], heads: int, out: Pair | None, edge: str | None = None, activation: str | None = None, residual: Pair | None = None) -> DataFrame:
    """Attention layers side by side, then projected; without `out` (a decoder) the last layer alone.

    residual adds a layer's input to its output from the second on, projected by it at the last.
    """
    x, kept = features, None
    for i, weights in enumerate(stack):
        got = gat_layer(edges, x, by, weights, heads, edge=edge)
        if residual is not None and i:
            before = x.select(*by, "node", (times_matrix("x", *residual) if i == len(stack) - 1 else F.col("x")).alias("_b"))
            got = got.join(before, [*by, "node"]).select(*by, "node", plus(F.col("x"), F.col("_b")).alias("x"))
        if activation:
            got = got.withColumn("x", learn.activation(activation, F.col("x")))
        x = stored(got, "layer")
        kept = x if kept is None else _beside(kept, x, by)
    return x if out is None else kept.select(*by, "node", times_matrix("x", *out).alias("x"))
