"""Time windows over event streams, and the graphs in them as edge and node tables.

Events are rows (event_id, t, src, dst, op, ...) with t in nanoseconds. Ties in t
are ordered by event_id everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.chains import reached
from tracewell.functions.integers import floor_div
from tracewell.functions.ordinal import HOUR, with_ordinal, with_previous, with_running
from tracewell.functions.scalar import ns_to_text
from tracewell.functions.tables import stored


def day_of(t: Column, zone: str = "America/New_York") -> Column:
    """Calendar day of a nanosecond time in a zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(floor_div(t, 1000)), zone))


def daily(events: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Adds day; days are half-open, so an event at midnight belongs to the day it begins."""
    return events.withColumn("day", day_of(F.col("t"), zone))


def adaptive(events: DataFrame, size: int, chunk: int = 1024) -> DataFrame:
    """Adds tw, tw_start and tw_end per day.

    A day's events are cut into chunks; after a chunk the window closes if the
    chunk's last time is more than size after the window's start, or at the day's
    end. The next window starts at that last time.

    A window that starts at some chunk's last time can only close at the first chunk
    whose last time is more than size later: each chunk points to that one, and the
    chunks that do close are those the pointers visit from the day's start, found by
    doubling. No task holds a day's chunks.
    """
    placed = with_ordinal(events, ["day"], ["t", "event_id"], HOUR).withColumn("chunk", F.floor(F.col("ordinal") / chunk)).drop("ordinal")
    ends = stored(placed.groupBy("day", "chunk").agg(F.min("t").alias("first"), F.max("t").alias("last")), "chunks")
    begin = ends.filter("chunk = 0").select("day", F.lit(-1).cast("long").alias("at"), F.col("first").alias("last"))
    asks = ends.select("day", F.col("chunk").alias("at"), "last").unionByName(begin)
    # from the latest time down: an ask sees the chunks that end more than size after its start
    asked = asks.select("day", (-(F.col("last") + size)).alias("back"), F.lit(0).alias("kind"), "at", F.lit(None).cast("long").alias("chunk"))
    given = ends.select("day", (-F.col("last")).alias("back"), F.lit(1).alias("kind"), F.col("chunk").alias("at"), "chunk")
    jumps = with_running(asked.unionByName(given), ["day"], ["back", "kind", "at"], HOUR, {"next": ("min", "chunk")}).filter("kind = 0").select("day", "at", "next")
    closing = reached(jumps, begin.select("day", "at"), ["day"]).filter("at >= 0").select("day", F.col("at").alias("chunk"), F.lit(1).cast("long").alias("closes"))
    marked = ends.join(closing, ["day", "chunk"], "left").withColumn("closes", F.coalesce("closes", F.lit(0).cast("long")))
    numbered = stored(with_running(marked, ["day"], ["chunk"], 1 << 16, {"tw": ("sum", "closes")}, before=True).fillna(0, ["tw"]), "numbered")
    starts = begin.select("day", F.lit(0).cast("long").alias("tw"), F.col("last").alias("tw_start")).unionByName(numbered.filter("closes = 1").select("day", (F.col("tw") + 1).alias("tw"), F.col("last").alias("tw_start")))
    spans = numbered.groupBy("day", "tw").agg(F.max("last").alias("tw_end")).join(starts, ["day", "tw"])
    windows = numbered.select("day", "chunk", "tw").join(spans, ["day", "tw"]).select("day", "chunk", "tw", "tw_start", "tw_end")
    return placed.join(windows, ["day", "chunk"]).drop("chunk")


def fuse_runs(edges: DataFrame, by: list[str]) -> DataFrame:
    """Keeps the first event of each run of equal operations between the same two nodes."""
    return with_previous(edges, [*by, "src", "dst"], ["t", "event_id"], HOUR, "op", "_before").filter(F.col("_before").isNull() | (F.col("_before") != F.col("op"))).drop("_before")


def window_label(start: Column, end: Column, zone: str = "America/New_York") -> Column:
    """`start~end` of a window in wall-clock time."""
    return F.concat(ns_to_text(start, zone), F.lit("~"), ns_to_text(end, zone))


def first_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """The simple graph: the earliest event of each pair of nodes."""
    least = F.min_by(F.struct("t", "event_id", "op"), F.struct("t", "event_id"))
    return edges.groupBy(*by, "src", "dst").agg(least.alias("e")).select(*by, "src", "dst", "e.t", "e.event_id", "e.op")


def window_nodes(edges: DataFrame, by: list[str], nodes: DataFrame) -> DataFrame:
    """Nodes that occur in each window, with their attributes."""
    ends = edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node"))).distinct()
    return ends.join(nodes, "node")


def multigraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types of their ends, nodes(node, node_type), and y, 0 where an edge has none yet."""
    typed = lambda e: nodes.select(F.col("node").alias(e), F.col("node_type").alias(f"{e}_type"))
    y = F.coalesce("y", F.lit(0)) if "y" in edges.columns else F.lit(0)
    return edges.join(typed("src"), "src").join(typed("dst"), "dst").withColumn("y", y)


def split_nodes(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, node) for nodes met on the days of each split."""
    e = edges.join(splits, "day")
    return e.select("split", F.col("src").alias("node")).unionByName(e.select("split", F.col("dst").alias("node"))).distinct()


def used_nodes(nodes: DataFrame, members: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Nodes that occur in any of the splits."""
    return nodes.join(members.filter(F.col("split").isin(*splits)), "node", "left_semi")


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """Out- and in-degree and number of distinct operations per window and node."""
    out = edges.select(*by, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "op")
    into = edges.select(*by, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "op")
    return out.unionByName(into).groupBy(*by, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.countDistinct("op").alias("n_ops"))


def capped(edges: DataFrame, by: list[str], n: int = 2001) -> DataFrame:
    """The first n events of each group, for trial runs."""
    return with_ordinal(edges, by, ["t", "event_id"], HOUR, "_r").filter(F.col("_r") < n).drop("_r")


def stack_sources(sources: list[DataFrame]) -> DataFrame:
    """Node tables of several datasets with ids moved past those of the datasets before."""
    out = ends = None
    for k, nodes in enumerate(sources):
        most = nodes.agg(F.coalesce(F.max("node") + 1, F.lit(0)).alias("_next"))
        part = nodes.withColumn("dataset", F.lit(k))
        if out is None:
            out, ends = part, most
        else:
            out = out.unionByName(part.crossJoin(F.broadcast(ends)).withColumn("node", F.col("node") + F.col("_next")).drop("_next"))
            ends = ends.crossJoin(F.broadcast(most.withColumnRenamed("_next", "_m"))).select((F.col("_next") + F.col("_m")).alias("_next"))
    return out


def inject(events: DataFrame, generated: DataFrame, attacks: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Adds generated events of attacks that lie wholly within one day; times decide their place."""
    whole = attacks.filter(day_of(F.col("start_ns"), zone) == day_of(F.col("end_ns"), zone)).select("attack_id")
    own = generated.join(F.broadcast(whole), "attack_id", "left_semi").drop("attack_id")
    return events.unionByName(own, allowMissingColumns=True)
