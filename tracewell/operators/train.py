"""Training small networks over tables: gradients summed where rows lie, steps taken on the driver.

A model is a network over a row's vector x and an objective that compares its output with the
row's target. A step sends the weights to every task (the model's size, nothing of the data's);
a task sums the gradients of its rows and gives one row; these are added up in groups, and
the driver adds up the groups. Adam's state lives on the driver. Epochs, steps an epoch (rows are dealt by a hash, once, into a stored
table), patience on validation rows, weight decay and later rounds of fine tuning are
parameters. Losses of any table come back as its rows with columns added.

Rows whose x is null take no part and get a null loss; an empty table trains nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewell.functions import sums
from tracewell.functions.tables import stored

from .learn import ACTIVATIONS, initial_weights, parse_layers

Layers = list[tuple[str, float | None]]
Weights = list[tuple[np.ndarray, np.ndarray]]

_SLOPES = {
    "relu": lambda x, y: (x > 0).astype(float),
    "tanh": lambda x, y: 1 - y * y,
    "sigmoid": lambda x, y: y * (1 - y),
    "elu": lambda x, y: np.where(x > 0, 1.0, y + 1),
    "leaky_relu": lambda x, y: np.where(x > 0, 1.0, 0.01),
    "dropout": lambda x, y: np.ones_like(x),
    "identity": lambda x, y: np.ones_like(x),
}


def _classes(out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of the zero-based class target[:, 0]."""
    e = np.exp(out - out.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    own = target[:, 0].astype(int)
    at = np.arange(len(out))
    slope = p.copy()
    slope[at, own] -= 1
    return -np.log(np.maximum(p[at, own], 1e-300)), slope


def _links(out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary cross-entropy of one logit against 0 or 1."""
    x, y = out[:, 0], target[:, 0]
    return np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))), (1 / (1 + np.exp(-x)) - y)[:, None]


def _squares(out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = out - target
    return (d * d).mean(1), 2 * d / d.shape[1]


def _sizes(out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = out - target
    return np.abs(d).mean(1), np.sign(d) / d.shape[1]


def _angles(out: np.ndarray, target: np.ndarray, power: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(1 - cosine) to a power; a zero vector has cosine 0."""
    a, b = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (out, target))
    u, t = out / a, target / b
    cos = (u * t).sum(1, keepdims=True)
    return (1 - cos[:, 0]) ** power, -power * (1 - cos) ** (power - 1) * (t - cos * u) / a


OBJECTIVES = {"classes": _classes, "link": _links, "mse": _squares, "mae": _sizes, "sce": _angles}


def run_forward(x: np.ndarray, layers: Layers, weights: Weights) -> list[np.ndarray]:
    """The input and every layer's output."""
    states, k = [x], 0
    for name, _ in layers:
        if name == "linear":
            x, k = x @ weights[k][0] + weights[k][1], k + 1
        else:
            x = ACTIVATIONS[name](x)
        states.append(x)
    return states


def backward(states: list[np.ndarray], slope: np.ndarray, layers: Layers, weights: Weights) -> tuple[list[np.ndarray], np.ndarray]:
    """Slopes at every weight in order (matrix, bias, ...) and at the input, from the slope at the output."""
    out: list[np.ndarray] = []
    k = len(weights)
    for i in range(len(layers) - 1, -1, -1):
        if layers[i][0] == "linear":
            k -= 1
            out = [states[i].T @ slope, slope.sum(0), *out]
            slope = slope @ weights[k][0].T
        else:
            slope = slope * _SLOPES[layers[i][0]](states[i], states[i + 1])
    return out, slope


def gradients(x: np.ndarray, target: np.ndarray, row_weight: np.ndarray, layers: Layers, weights: Weights, objective: str) -> tuple[float, list[np.ndarray]]:
    """Sums over rows: the weighted loss, and its slope at every weight in order (matrix, bias, ...)."""
    states = run_forward(x, layers, weights)
    loss, slope = OBJECTIVES[objective](states[-1], target)
    return float((loss * row_weight).sum()), backward(states, slope * row_weight[:, None], layers, weights)[0]


def uniform(keys: np.ndarray, salt: int, n: int) -> np.ndarray:
    """n numbers below 1 for each whole number, the same wherever its row lies."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 1_000_003 % (1 << 64)) + np.arange(n, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)) / float(1 << 53)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed_gradients(rows: DataFrame, layers: Layers, weights: Weights, objective: str) -> tuple[float, float, list[np.ndarray]]:
    """Loss, weight of rows, and gradients over rows(x, target, weight)."""
    def of_task(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
        out = None
        for b in batches:
            w = b.column("weight").to_numpy(zero_copy_only=False)
            loss, slopes = gradients(_matrix(b.column("x")), _matrix(b.column("target")), w, layers, weights, objective)
            one = [np.array([loss, w.sum()]), *slopes]
            out = one if out is None else sums.added([out, one])
        return out

    found = sums.summed(rows.select("x", "target", "weight"), of_task)
    return (*found[0].tolist(), found[1:]) if found else (0.0, 0.0, [])


class Adam:
    """The usual running moments, with decoupled weight decay if one is set."""

    def __init__(self, rate: float = 1e-3, decay: float = 0.0, beta: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.rate, self.decay, self.beta, self.eps, self.t = rate, decay, beta, eps, 0
        self.m: list[np.ndarray] = []
        self.v: list[np.ndarray] = []

    def step(self, values: list[np.ndarray], slopes: list[np.ndarray]) -> list[np.ndarray]:
        self.t += 1
        self.m = self.m or [np.zeros_like(x) for x in values]
        self.v = self.v or [np.zeros_like(x) for x in values]
        a, b = self.beta
        self.m = [a * m + (1 - a) * g for m, g in zip(self.m, slopes)]
        self.v = [b * v + (1 - b) * g * g for v, g in zip(self.v, slopes)]
        scale = lambda m, v: (m / (1 - a**self.t)) / (np.sqrt(v / (1 - b**self.t)) + self.eps)
        return [x - self.rate * (scale(m, v) + self.decay * x) for x, m, v in zip(values, self.m, self.v)]


@dataclass
class Model:
    """A trained network with the objective it was trained on, and its losses by epoch."""

    layers: str
    objective: str
    weights: Weights
    history: list[dict] = field(default_factory=list)


def mean_loss(model: Model, rows: DataFrame) -> float:
    """Weighted mean of the objective over rows; infinite where there are none."""
    scored = with_losses(prepared(rows), model).agg(F.sum(F.col("loss") * F.col("weight")), F.sum("weight")).first()
    return scored[0] / scored[1] if scored[1] else math.inf


def prepared(rows: DataFrame) -> DataFrame:
    """rows with weight (1 unless there), target as a vector, and without null inputs."""
    target = F.col("target") if rows.schema["target"].dataType.typeName() == "array" else F.array(F.col("target").cast("double"))
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) if "weight" in rows.columns else F.lit(1.0)
    return rows.filter("x is not null and target is not null").withColumns({"x": F.col("x").cast("array<double>"), "target": target.cast("array<double>"), "weight": weight})


def train(rows: DataFrame, layers: str, objective: str, epochs: int, rate: float = 1e-3, decay: float = 0.0, steps: int = 1, key: str | None = None, val: DataFrame | None = None, patience: int | None = None, seed: int = 0, start: Weights | None = None) -> Model:
    """Fit a network to rows(x, target[, weight]).

    target is a zero-based class or 0 or 1 (`classes`, `link`), or a vector (`mse`, `mae`, `sce`). Each epoch
    takes `steps` Adam steps, each on the mean gradient of the rows whose `key` column hashes to it. With val the
    weights of least validation loss are kept, and training ends after `patience` epochs without a better one.
    start continues from given weights, as a round of fine tuning on few labelled rows does.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"no objective {objective!r}")
    kept = prepared(rows).select("x", "target", "weight", *([key] if key and steps > 1 else []))
    part = F.pmod(F.xxhash64(key or "x"), F.lit(steps)).cast("int") if steps > 1 else F.lit(0)
    dealt = stored(kept.select("x", "target", "weight", part.alias("step")), "training")
    first = dealt.select(F.size("x")).head(1)
    plan = parse_layers(layers)
    weights = start or initial_weights(plan, first[0][0] if first else 1, seed)
    model, adam, best, waited = Model(layers, objective, weights), Adam(rate, decay), None, 0
    for epoch in range(epochs if first else 0):
        total = count = 0.0
        for step in range(steps):
            loss, n, slopes = summed_gradients(dealt.filter(F.col("step") == step) if steps > 1 else dealt, plan, model.weights, objective)
            if n:
                flat = adam.step([x for pair in model.weights for x in pair], [g / n for g in slopes])
                model.weights = list(zip(flat[::2], flat[1::2]))
                total, count = total + loss, count + n
        row = {"epoch": epoch, "loss": total / count if count else math.inf}
        if val is not None:
            row["val"] = mean_loss(model, val)
            if best is None or row["val"] < best[0]:
                best, waited = (row["val"], model.weights), 0
            else:
                waited += 1
        model.history.append(row)
        if patience is not None and waited > patience:
            break
    if best is not None:
        model.weights = best[1]
    return model


def outputs(df: DataFrame, model: Model, x: str | Column = "x") -> Column:
    """The network's output for a vector column, batch by batch; null for null."""
    plan, weights = parse_layers(model.layers), model.weights

    def run(s: pd.Series) -> pd.Series:
        out, there = pd.Series([None] * len(s), index=s.index, dtype=object), s.notna()
        if there.any():
            out[there] = pd.Series(list(run_forward(np.stack(s[there].to_numpy()).astype(float), plan, weights)[-1]), index=s.index[there])
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf("array<double>")(run)(x)


def with_losses(rows: DataFrame, model: Model) -> DataFrame:
    """rows(x, target) with loss, and for classes predicted and correct: what evaluation reads."""
    d = rows.withColumn("_out", outputs(rows, model))
    objective = OBJECTIVES[model.objective]
    target = F.col("target") if rows.schema["target"].dataType.typeName() == "array" else F.array(F.col("target").cast("double"))

    def run(out: pd.Series, wanted: pd.Series) -> pd.Series:
        loss, there = pd.Series([None] * len(out), index=out.index, dtype=float), out.notna() & wanted.map(lambda t: t is not None and not np.isnan(np.asarray(t, float)).any())
        if there.any():
            loss[there] = objective(np.stack(out[there].to_numpy()).astype(float), np.stack(wanted[there].to_numpy()).astype(float))[0]
        return loss

    run.__annotations__ = {"out": pd.Series, "wanted": pd.Series, "return": pd.Series}
    scored = d.withColumn("loss", pandas_udf("double")(run)("_out", target))
    if model.objective == "classes":
        best = F.array_position("_out", F.array_max("_out")).cast("int") - 1
        scored = scored.withColumn("predicted", best).withColumn("correct", F.col("predicted") == target[0].cast("int"))
    return scored.drop("_out")


def uncertain_losses(rows: DataFrame, model: Model, passes: int, key: str, seed: int = 0) -> DataFrame:
    """rows with loss_mean and loss_deviation over `passes` runs with dropout on.

    A unit of a dropout layer is off by a hash of the row's key (a whole number), the run and the unit, so results
    do not depend on how rows lie in tasks; what is left is scaled up by the share that stays.
    """
    plan, weights, objective = parse_layers(model.layers), model.weights, OBJECTIVES[model.objective]
    target = F.col("target") if rows.schema["target"].dataType.typeName() == "array" else F.array(F.col("target").cast("double"))

    def one_run(x: np.ndarray, keys: np.ndarray, run: int) -> np.ndarray:
        k = 0
        for i, (name, share) in enumerate(plan):
            if name == "linear":
                x, k = x @ weights[k][0] + weights[k][1], k + 1
            elif name == "dropout":
                off = share if share is not None else 0.5
                x = np.where(uniform(keys, (seed * 1009 + run) * 31 + i, x.shape[1]) < off, 0.0, x / max(1 - off, 1e-12))
            else:
                x = ACTIVATIONS[name](x)
        return x

    def run(x: pd.Series, wanted: pd.Series, keys: pd.Series) -> pd.Series:
        out, there = pd.Series([None] * len(x), index=x.index, dtype=object), x.notna() & wanted.map(lambda t: t is not None and not np.isnan(np.asarray(t, float)).any()) & keys.notna()
        if there.any():
            matrix, y, ids = np.stack(x[there].to_numpy()).astype(float), np.stack(wanted[there].to_numpy()).astype(float), keys[there].to_numpy().astype(np.int64)
            losses = np.stack([objective(one_run(matrix, ids, r), y)[0] for r in range(passes)])
            out[there] = pd.Series(list(np.column_stack([losses.mean(0), losses.std(0)])), index=x.index[there])
        return out

    run.__annotations__ = {"x": pd.Series, "wanted": pd.Series, "keys": pd.Series, "return": pd.Series}
    scored = rows.withColumn("_l", pandas_udf("array<double>")(run)("x", F.when(F.col("target").isNotNull(), target), F.col(key).cast("long")))
    return scored.withColumns({"loss_mean": F.col("_l")[0], "loss_deviation": F.col("_l")[1]}).drop("_l")


@dataclass
class Variational:
    """An encoder, two linear maps to the mean and the logarithm of the deviation of a latent vector, and a decoder."""

    encoder: str
    decoder: str
    encoding: Weights
    mean: tuple[np.ndarray, np.ndarray]
    deviation: tuple[np.ndarray, np.ndarray]
    decoding: Weights
    divergence: float
    history: list[dict] = field(default_factory=list)

    def flat(self) -> list[np.ndarray]:
        return [v for pair in (*self.encoding, self.mean, self.deviation, *self.decoding) for v in pair]

    def set(self, flat: list[np.ndarray]) -> None:
        pairs, n = list(zip(flat[::2], flat[1::2])), len(self.encoding)
        self.encoding, self.mean, self.deviation, self.decoding = pairs[:n], pairs[n], pairs[n + 1], pairs[n + 2 :]


def variational_step(x: np.ndarray, noise: np.ndarray, model: Variational) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(losses, outputs, summed slopes): squared reconstruction plus `divergence` times s^2 + m^2 - ln s - 1/2 over the latent vector."""
    enc, dec = parse_layers(model.encoder), parse_layers(model.decoder)
    first = run_forward(x, enc, model.encoding)
    e = first[-1]
    m, log_s = e @ model.mean[0] + model.mean[1], e @ model.deviation[0] + model.deviation[1]
    s = np.exp(np.clip(log_s, -30, 30))
    second = run_forward(m + s * noise, dec, model.decoding)
    square, slope = _squares(second[-1], x)
    loss = square + model.divergence * (s * s + m * m - log_s - 0.5).sum(1)
    decoding, z = backward(second, slope, dec, model.decoding)
    to_m, to_s = z + model.divergence * 2 * m, z * s * noise + model.divergence * (2 * s * s - 1)
    encoding, _ = backward(first, to_m @ model.mean[0].T + to_s @ model.deviation[0].T, enc, model.encoding)
    return loss, second[-1], [*encoding, e.T @ to_m, to_m.sum(0), e.T @ to_s, to_s.sum(0), *decoding]


def normal(keys: np.ndarray, salt: int, n: int) -> np.ndarray:
    """Normal draws for each key."""
    return np.sqrt(-2 * np.log(1 - uniform(keys, 2 * salt, n))) * np.cos(2 * np.pi * uniform(keys, 2 * salt + 1, n))


def train_variational(rows: DataFrame, key: str, encoder: str, latent: int, decoder: str, epochs: int, rate: float = 1e-3, divergence: float = 1e-3, seed: int = 0) -> Variational:
    """Fit a variational decoder to rows(key, x); draws come from a row's key (a whole number) and the epoch. Null rows take no part."""
    kept = stored(rows.filter(F.col("x").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col("x").cast("array<double>").alias("x")), "variational")
    first = kept.select(F.size("x")).head(1)
    width = first[0][0] if first else 1
    enc, dec = parse_layers(encoder), parse_layers(decoder)
    encoding = initial_weights(enc, width, seed)
    inner = encoding[-1][0].shape[1] if encoding else width
    heads = [initial_weights([("linear", latent)], inner, seed + k)[0] for k in (1, 2)]
    model = Variational(encoder, decoder, encoding, *heads, initial_weights(dec, latent, seed + 3), divergence)
    adam = Adam(rate)
    for epoch in range(epochs if first else 0):
        def of_task(batches: Iterator[pa.RecordBatch], now: Variational = model, epoch: int = epoch) -> list[np.ndarray] | None:
            out = None
            for b in batches:
                loss, _, slopes = variational_step(_matrix(b.column("x")), normal(b.column("key").to_numpy(), seed * 7919 + epoch, latent), now)
                one = [np.array([loss.sum(), len(loss)]), *slopes]
                out = one if out is None else sums.added([out, one])
            return out

        found = sums.summed(kept, of_task)
        loss, n = found[0].tolist()
        model.history.append({"epoch": epoch, "loss": loss / n})
        model.set(adam.step(model.flat(), [g / n for g in found[1:]]))
    return model


def reconstructed(rows: DataFrame, model: Variational) -> DataFrame:
    """rows(x) with out, decoded from the latent mean, and loss, its mean squared distance from x; null for null."""
    def run(s: pd.Series) -> pd.Series:
        out, there = pd.Series([None] * len(s), index=s.index, dtype=object), s.notna()
        if there.any():
            x = np.stack(s[there].to_numpy()).astype(float)
            out[there] = pd.Series(list(variational_step(x, np.zeros((len(x), model.mean[0].shape[1])), model)[1]), index=s.index[there])
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    d = rows.withColumn("out", pandas_udf("array<double>")(run)("x"))
    gaps = F.zip_with("out", "x", lambda a, b: (a - b) * (a - b))
    return d.withColumn("loss", F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v) / F.size("x"))


def class_weights(rows: DataFrame, k: int) -> DataFrame:
    """rows(target) with weight: n / (k * rows of the class), so that classes weigh alike."""
    counts = rows.groupBy("target").agg(F.count("*").alias("_c"))
    n = counts.agg(F.sum("_c").alias("_n"))
    each = counts.crossJoin(F.broadcast(n)).select("target", (F.col("_n") / (k * F.col("_c"))).alias("weight"))
    return rows.join(F.broadcast(each), "target")  # k rows at most
