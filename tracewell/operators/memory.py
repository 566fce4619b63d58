"""A memory of each node, carried batch by batch and updated by a gated unit from the batch's messages.

A message to a node from an event is its own memory, the other end's memory, the event's vector and
an encoding of the time since the node's last event. A batch reads memories as they stood before it;
each of its nodes then takes one update from its last message or the mean of its messages. Only nodes of
the batch are read and written: what changed is a stored table a batch, and every few batches these
are folded into one table of the latest memories. Time is linear in batches, as the method is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewell.functions.joins import join_hot
from tracewell.functions.tables import stored
from tracewell.functions.vectors import combined

from .learn import gru_step

FOLD = 8  # batches after which changes are folded into one table
_STATE = "node long, memory array<double>, last_t long, batch long"


def memory_weights(size: int, message: int, time: int, seed: int) -> dict[str, np.ndarray]:
    """Uniform starting weights: gates over messages (w, b) and memory (u, c), and the time encoding's rates and phases."""
    rng = np.random.default_rng(seed)
    inputs, bound = 2 * size + message + time, 1 / np.sqrt(size)
    draw = lambda *s: rng.uniform(-bound, bound, s)
    return {"w": draw(3 * size, inputs), "u": draw(3 * size, size), "b": draw(3 * size), "c": draw(3 * size), "rate": 10.0 ** -np.linspace(0, 9, time), "phase": np.zeros(time)}


def _cell(weights: dict[str, np.ndarray]):
    def run(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(list(gru_step(np.stack(x.to_numpy()).astype(float), np.stack(h.to_numpy()).astype(float), weights))) if len(x) else pd.Series([], dtype=object)

    run.__annotations__ = {"x": pd.Series, "h": pd.Series, "return": pd.Series}
    return pandas_udf("array<double>")(run)


def _latest(tables: list[DataFrame], nodes: DataFrame | None = None) -> DataFrame:
    """(node, memory, last_t, batch): the latest state of each node (of those asked for)."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    if nodes is not None:
        every = every.join(nodes, "node", "left_semi")
    return every.groupBy("node").agg(F.max_by(F.struct("memory", "last_t", "batch"), "batch").alias("s")).select("node", "s.*")


def node_memory(edges: DataFrame, weights: dict[str, np.ndarray], how: str = "last", unit: int = 1_000_000_000) -> DataFrame:
    """(batch, node, memory, last_t) after each batch that holds the node, from edges(batch, event_id, t, src, dst, msg).

    how is last (ties in t by event_id, then the source's message) or mean. Memories begin at zero, last times at 0. Gaps are
    encoded in `unit`s of t. An event between a node and itself gives it two messages.
    """
    if how not in ("last", "mean"):
        raise ValueError(f"no aggregator {how!r}")
    size = weights["u"].shape[1]
    rate, phase = weights["rate"].tolist(), weights["phase"].tolist()
    spark = edges.sparkSession
    zero = F.array_repeat(F.lit(0.0), size)
    ordered = stored(edges.select(F.col("batch").cast("long").alias("batch"), "event_id", "t", "src", "dst", F.col("msg").cast("array<double>").alias("msg")).repartitionByRange("batch", "event_id").sortWithinPartitions("batch"), "memory-events")
    cell = _cell(weights)

    def ends(rows: DataFrame, *columns: str) -> DataFrame:
        """A message to each end of every event."""
        one = lambda node, other, side: rows.select(*columns, F.col(node).alias("node"), F.col(other).alias("other"), "t", "event_id", F.lit(side).alias("side"), "msg")
        return one("src", "dst", 1).unionByName(one("dst", "src", 0))

    if how == "last":
        # which message of a batch is a node's last does not depend on memories: taken once, for all batches
        last = ends(ordered, "batch").groupBy("batch", "node").agg(F.max_by(F.struct("other", "t", "msg"), F.struct("t", "event_id", "side")).alias("m"), F.max("t").alias("most"))
        lasts = stored(last.select("batch", "node", "m.*", "most").repartitionByRange("batch", "node").sortWithinPartitions("batch"), "memory-last")
    state, changes, out = spark.createDataFrame([], _STATE), [], []
    for (batch,) in ordered.select("batch").distinct().orderBy("batch").collect():  # one number a batch
        if how == "last":
            last = lasts.filter(F.col("batch") == batch).drop("batch")
            nodes = last.select("node")
        else:
            sent = ends(ordered.filter(F.col("batch") == batch))
            nodes = sent.select("node").distinct()
        known = nodes.join(_latest([state, *changes], nodes), "node", "left").select("node", F.coalesce("memory", zero).alias("memory"), F.coalesce("last_t", F.lit(0).cast("long")).alias("last_t"))
        known = stored(known, "memory-known")
        time = lambda t, since: [F.cos((t - since).cast("double") / unit * r + p) for r, p in zip(rate, phase)]
        theirs = known.select(F.col("node").alias("other"), F.col("memory").alias("_theirs"))
        if how == "last":
            met = join_hot(last, theirs, ["other"]).join(known, "node")
            x = F.concat("memory", "_theirs", "msg", F.array(*time(F.col("t"), F.col("last_t"))))
            ready = met.select("node", x.alias("x"), "memory", "most")
        else:
            met = join_hot(join_hot(sent, theirs, ["other"]), known.select("node", "last_t"), ["node"])
            parts = met.select("node", F.concat("_theirs", "msg", F.array(*time(F.col("t"), F.col("last_t")))).alias("x"))
            mean = combined(parts, ["node"], "x", weights["w"].shape[1] - size, "mean")
            ready = mean.join(known, "node").join(sent.groupBy("node").agg(F.max("t").alias("most")), "node").select("node", F.concat("memory", "x").alias("x"), "memory", "most")
        changed = stored(ready.select("node", cell("x", "memory").alias("memory"), F.col("most").alias("last_t"), F.lit(batch).cast("long").alias("batch")), "memory-changes")
        changes.append(changed)
        out.append(changed)
        if len(changes) == FOLD:
            state, changes = stored(_latest([state, *changes]), "memory-state"), []
    whole = spark.createDataFrame([], _STATE)
    for t in out:
        whole = whole.unionByName(t)
    return whole.select("batch", "node", "memory", "last_t")
