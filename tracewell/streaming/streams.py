"""Structured Streaming twins of the windowed operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and loss per UTC day and operation, for events at most `late` behind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "op").agg(F.count("*").alias("n"), F.sum("loss").alias("loss")).select(F.to_date("w.start").alias("day"), "op", "n", "loss")


def window_statistics(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Mean, deviation and count of losses per time window, from which anomalous edges follow."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std")).select(F.col("w.start").alias("start"), "n", "mean", "std")


def last_neighbours(events: DataFrame, k: int) -> DataFrame:
    """(node, neighbour, event_id, age): the k most recent neighbours of a node as each event arrives.

    A node's state is its last k neighbours; rows of a node within one trigger
    are taken in time order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for event, near in zip(rows["event_id"].tolist(), rows["neighbour"].tolist()):
            out += [(key[0], n, event, age) for age, (n, _) in enumerate(reversed(held), 1)]
            held = (held + [(near, event)])[-k:]
        state.update(tuple(list(x) for x in zip(*held)))
        yield pd.DataFrame(out, columns=["node", "neighbour", "event_id", "age"])

    ends = events.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "t", "event_id").unionByName(events.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "t", "event_id"))
    return ends.groupBy("node").applyInPandasWithState(run, "node long, neighbour long, event_id long, age int", "neighbours array<long>, events array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through the stream, into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
