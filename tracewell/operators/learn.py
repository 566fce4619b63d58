"""The relational core of learned scorers: message passing, small networks, trained classifiers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewell.functions.ordinal import with_ordinal

from .score import cross_entropy, dot, mae, mse, sce, softplus


def time_encoding(gap: Column, size: int) -> Column:
    """cos of a time gap at geometrically falling frequencies."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.cos(gap / F.pow(F.lit(10.0), i * (9.0 / max(size - 1, 1)))))


def parse_layers(text: str) -> list[tuple[str, float | None]]:
    """`linear(8) | relu | dropout` to [(name, number)]; unknown parts are an error."""
    out = []
    for part in text.split("|"):
        m = re.fullmatch(r"\s*(linear|relu|tanh|sigmoid|elu|leaky_relu|dropout|identity)\s*(?:\(\s*([\d.]+)\s*\))?\s*", part)
        if m is None or (m[1] == "linear") != (m[2] is not None) and m[1] != "dropout":
            raise ValueError(f"cannot read layer {part!r}")
        out.append((m[1], float(m[2]) if m[2] else None))
    return out


ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0),
    "tanh": np.tanh,
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
    "dropout": lambda x: x,
    "identity": lambda x: x,
}


def initial_weights(layers: list[tuple[str, float | None]], size: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = np.random.default_rng(seed), []
    for name, n in layers:
        if name == "linear":
            bound = 1 / math.sqrt(size)
            out.append((rng.uniform(-bound, bound, (size, int(n))), np.zeros(int(n))))
            size = int(n)
    return out


def forward(df: DataFrame, column: str, layers: list[tuple[str, float | None]], weights: list[tuple[np.ndarray, np.ndarray]], out: str) -> DataFrame:
    """Adds the network's output for a vector column, batch by batch in numpy; dropout is off."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            x, k = (np.stack(s.to_numpy()).astype(float) if len(s) else np.zeros((0, 1))), 0
            for name, _ in layers:
                if name == "linear" and len(s):
                    x, k = x @ weights[k][0] + weights[k][1], k + 1
                elif name != "linear":
                    x = ACTIVATIONS[name](x)
            yield pd.Series(list(x))

    return df.withColumn(out, pandas_udf("array<double>")(run)(column))


def gru_step(x: np.ndarray, h: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """New states of a gated unit for rows of inputs and states.

    weights: w (3 * hidden, inputs), u (3 * hidden, hidden), and b, c (3 * hidden), gates in order reset,
    update, candidate.
    """
    n, sigmoid = h.shape[1], ACTIVATIONS["sigmoid"]
    i, k = x @ weights["w"].T + weights["b"], h @ weights["u"].T + weights["c"]
    r, z = sigmoid(i[:, :n] + k[:, :n]), sigmoid(i[:, n : 2 * n] + k[:, n : 2 * n])
    return (1 - z) * np.tanh(i[:, 2 * n :] + r * k[:, 2 * n :]) + z * h


def gru(df: DataFrame, column: str, weights: dict[str, np.ndarray], out: str) -> DataFrame:
    """Adds the last state of a gated recurrent unit run over an array of vectors.

    A batch's sequences go one step at a time together, the longest first, so that those still running are
    the first rows. An empty sequence leaves the state at zero.
    """
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            length = s.map(len).to_numpy(dtype=int)
            order = np.argsort(-length, kind="stable")
            h = np.zeros((len(s), weights["u"].shape[1]))
            values = s.to_numpy()[order]
            for t in range(length.max(initial=0)):
                on = int((length > t).sum())
                h[:on] = gru_step(np.stack([np.asarray(v[t], float) for v in values[:on]]), h[:on], weights)
            states = np.empty_like(h)
            states[order] = h
            yield pd.Series(list(states))

    return df.withColumn(out, pandas_udf("array<double>")(run)(column))


def activation(name: str, v: Column) -> Column:
    """An activation over a vector column, as an expression."""
    one = {
        "relu": lambda x: F.greatest(x, F.lit(0.0)),
        "leaky_relu": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
        "tanh": lambda x: F.tanh(x),
        "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
        "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
        "identity": lambda x: x,
        "dropout": lambda x: x,
    }
    if name not in one:
        raise ValueError(f"no activation {name!r}")
    return F.transform(v, one[name])


def activated(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(column, activation(name, F.col(column)))


def gathered(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges with src_vec and dst_vec from vectors(node, vec); edges at a node without a vector go."""
    v = vectors.select("node", "vec")
    return edges.join(v.withColumnsRenamed({"node": "src", "vec": "src_vec"}), "src").join(v.withColumnsRenamed({"node": "dst", "vec": "dst_vec"}), "dst")


def inner_product(edges: DataFrame, out: str) -> DataFrame:
    """The inner-product decoder: a link's logit from the vectors of its ends."""
    return edges.withColumn(out, dot(F.col("src_vec"), F.col("dst_vec")))


def edge_mlp(edges: DataFrame, layers: str, weights: list, out: str) -> DataFrame:
    """The edge decoder: a network over both ends' vectors side by side."""
    return forward(edges.withColumn("_both", F.concat("src_vec", "dst_vec")), "_both", parse_layers(layers), weights, out).drop("_both")


LOSSES = {"mse": mse, "mae": mae, "sce": sce}

# Objectives by name: a column with an edge's or node's loss from its parts.
OBJECTIVES = {
    "predict_type": lambda o: cross_entropy(F.col(o["logits"]), F.col(o["target"])),
    "reconstruct": lambda o: LOSSES[o.get("loss", "mse")](F.col(o["x"]), F.col(o["y"])),
    "link": lambda o: softplus(-F.col(o["logit"])),
    "no_link": lambda o: softplus(F.col(o["logit"])),
    "reconstruct_masked": lambda o: F.when(F.col(o["mask"]), LOSSES[o.get("loss", "sce")](F.col(o["x"]), F.col(o["y"]))).otherwise(F.lit(0.0)),
}


def losses(df: DataFrame, objectives: list[tuple[str, dict]], weights: list[float] | None = None) -> DataFrame:
    """Adds loss: the weighted sum of the objectives' losses."""
    total = F.lit(0.0)
    for (name, o), w in zip(objectives, weights or [1.0] * len(objectives)):
        if name not in OBJECTIVES:
            raise ValueError(f"no objective {name!r}")
        total = total + w * OBJECTIVES[name](o)
    return df.withColumn("loss", total)


def masked(nodes: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """nodes(node, x) with mask, true for a share of them by a hash, and x_in, zeros where it is true."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "node")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return nodes.withColumn("mask", draw < share).withColumn("x_in", F.when(F.col("mask"), F.transform("x", lambda _: F.lit(0.0))).otherwise(F.col("x")))


def few_shot(train: DataFrame, column: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each class by a hash of event_id, for a last round of training."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "event_id")), 1, 15), 16, 10).cast("long")
    return with_ordinal(train.withColumn("_h", h), [column], ["_h", "event_id"], 1 << 50, "_r").filter(F.col("_r") < k).drop("_r", "_h")


def without_attacks(edges: DataFrame) -> DataFrame:
    """Edges that no label marks as an attack, for training."""
    return edges.filter(F.coalesce("y", F.lit(0)) != 1)


def edge_type_scorer(train: DataFrame, edges: DataFrame, columns: list[str], target: str, rounds: int = 30) -> DataFrame:
    """Adds loss: cross-entropy of a multinomial logistic regression for the edge's type.

    train and edges hold numeric columns and the zero-based target.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    to_vector = VectorAssembler(inputCols=columns, outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol=target, maxIter=rounds, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r").fit(to_vector.transform(train))
    p = F.element_at(vector_to_array("_p"), F.col(target).cast("int") + 1)
    return model.transform(to_vector.transform(edges)).withColumn("loss", -F.ln(F.greatest(p, F.lit(1e-12)))).drop("_x", "_p", "_y", "_r")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """A saved model of any of the library's kinds."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active().sparkContext)


def document_vectors(tokens: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(node, vec): mean word vectors of each document, by the library's Word2Vec."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="tokens", outputCol="_v").fit(tokens)
    return model.transform(tokens).select("node", vector_to_array("_v").alias("vec"))


def bagged_days(edges: DataFrame, days: DataFrame, run: int) -> DataFrame:
    """Training edges of a bootstrap of days: a day counts as often as a seeded hash draws it."""
    n = days.agg(F.count("*").alias("_n"))
    ranked = days.crossJoin(F.broadcast(n)).withColumn("_d", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(run), "day")), 1, 7), 16, 10).cast("long"), F.col("_n")))
    order = F.row_number().over(W.orderBy("day")) - 1
    drawn = ranked.select("_d").join(days.withColumn("_d", order.cast("long")), "_d").select("day")
    return edges.join(F.broadcast(drawn), "day")
