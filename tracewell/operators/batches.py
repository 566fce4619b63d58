"""Batching of temporal edges and the state that batches see."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.chains import reached
from tracewell.functions.integers import floor_div
from tracewell.functions.ordinal import HOUR, with_ordinal, with_previous, with_running
from tracewell.functions.tables import stored


def by_edges(edges: DataFrame, group: list[str], n: int, width: int = HOUR) -> DataFrame:
    """Adds batch: n neighbouring events each."""
    return with_ordinal(edges, group, ["t", "event_id"], width).withColumn("batch", F.floor(F.col("ordinal") / n)).drop("ordinal")


def by_time(edges: DataFrame, hop: int, length: int, start: int) -> DataFrame:
    """Adds batch: windows of the given length every hop from start; events between windows go."""
    at = F.col("t") - start
    return edges.withColumn("batch", floor_div(at, hop)).filter((at >= 0) & (F.pmod(at, F.lit(hop)) < length))


def by_unique_pairs(edges: DataFrame, group: list[str]) -> DataFrame:
    """Adds batch: a batch ends before a (src, dst) that it already holds.

    A batch that starts at place i ends at the first place whose pair was last met at
    i or later. Places point to the start that would follow them; those that are reached from
    the first place are found by doubling the pointers, as many rounds as the
    number of batches has binary digits, so no task walks through a group.
    """
    placed = with_ordinal(edges, group, ["t", "event_id"], HOUR)
    met = with_previous(placed, [*group, "src", "dst"], ["t", "event_id"], HOUR, "ordinal", "before")
    placed = stored(met, "unique-pairs")
    first = placed.filter("before is not null").groupBy(*group, F.col("before").alias("at")).agg(F.min("ordinal").alias("to"))
    ahead = placed.select(*group, F.col("ordinal").alias("at")).join(first, [*group, "at"], "left").withColumn("_back", -F.col("at"))
    jump = with_running(ahead, group, ["_back"], 1 << 16, {"next": ("min", "to")})
    starts = reached(jump, placed.select(*group, F.col("ordinal").alias("at")).filter("at = 0"), group)
    marked = placed.join(starts.select(*group, F.col("at").alias("ordinal"), F.lit(1).alias("_start")), [*group, "ordinal"], "left")
    counted = with_running(marked, group, ["ordinal"], 1 << 16, {"batch": ("sum", F.coalesce("_start", F.lit(0)).cast("long"))})
    return counted.withColumn("batch", F.col("batch") - 1).drop("ordinal", "before", "_start")


def last_neighbours(edges: DataFrame, k: int, directed: bool = False, include_current: bool = False) -> DataFrame:
    """(batch, node, neighbour, e_id, age): the k most recent neighbours from earlier batches.

    directed counts an edge at its destination only; include_current inserts a batch's own
    edges before it is asked. Events of a node are numbered; what a batch may see
    of a node is how many came before it (up to its end), so the last k are a band of numbers
    and the join is on node and number, k rows for each pair of batch and node.
    """
    ends = edges.select("batch", "event_id", "t", F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit(1).alias("side"))
    asks = ends.select("batch", "node").unionByName(edges.select("batch", F.col("src").alias("node"))).distinct()
    if not directed:
        ends = ends.unionByName(edges.select("batch", "event_id", "t", F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit(0).alias("side")))
    numbered = with_ordinal(ends, ["node"], ["t", "event_id", "side"], HOUR, "no")
    sizes = ends.groupBy("node", "batch").agg(F.count("*").cast("long").alias("_n"))
    asked = asks.join(sizes, ["node", "batch"], "left").fillna(0, ["_n"])
    asked = with_running(asked, ["node"], ["batch"], 1 << 12, {"seen": ("sum", "_n")}, before=not include_current).fillna(0, ["seen"])
    wanted = asked.select("batch", "node", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("age"), "seen").withColumn("no", F.col("seen") - F.col("age")).filter("no >= 0")
    return wanted.join(numbered.select("node", "no", "neighbour", F.col("event_id").alias("e_id")), ["node", "no"]).select("batch", "node", "neighbour", "e_id", "age")


def _newest(lists: list[Column], k: int) -> Column:
    """The first k of lists that follow one another, newest first; null lists are empty."""
    return F.slice(F.concat(*[F.coalesce(x, F.array().cast("array<long>")) for x in lists]), 1, k)


def last_neighbours_hops(edges: DataFrame, k: int, hops: int, width: int = 1 << 16) -> DataFrame:
    """(batch, node, neighbour, hop): nodes met by following last neighbours hop by hop, each batch with what it may see.

    A neighbour that a batch does not hold itself is asked for what came before that batch as well. What may be seen of
    a node changes only in batches that hold it: each such row keeps the k last neighbours, and those of the rows before
    it come from the k rows before. Rows of a node are cut into slices of width batches; only the first ones of a slice
    look into the slices before, of which a row each is kept.
    """
    ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit(1).alias("side")))
    ends = edges.select("batch", "t", "event_id", F.explode(ways).alias("_e")).select("batch", "t", "event_id", "_e.*").filter("node is not null and batch is not null")
    late = W.partitionBy("node", "batch").orderBy(F.desc("t"), F.desc("event_id"), F.desc("side"))
    last = ends.withColumn("_no", F.row_number().over(late)).filter(F.col("_no") <= k).groupBy("node", "batch").agg(F.array_sort(F.collect_list(F.struct("_no", F.col("neighbour").cast("long").alias("to")))).alias("_l"))
    kept = last.select("node", "batch", floor_div(F.col("batch"), width).alias("_slice"), F.col("_l.to").alias("own"))
    above = W.partitionBy("node", "_slice").orderBy("batch")
    kept = stored(kept.withColumn("near", _newest([F.lag("own", i).over(above) for i in range(1, k + 1)], k)), "last")
    ends_of = kept.groupBy("node", "_slice").agg(F.max_by(_newest([F.col("own"), F.col("near")], k), "batch").alias("after"))
    slices = W.partitionBy("node").orderBy("_slice")
    ends_of = stored(ends_of.withColumn("start", _newest([F.lag("after", i).over(slices) for i in range(1, k + 1)], k)), "slices")
    begun = ends_of.filter(F.size("start") > 0).select("node", "_slice", "start")
    few = F.size("near") < k
    states = kept.filter(~few).unionByName(kept.filter(few).join(begun, ["node", "_slice"], "left").withColumn("near", _newest([F.col("near"), F.col("start")], k)).drop("start"))
    out = None
    for hop in range(1, hops + 1):
        if hop == 1:
            front = states.select("batch", "node", F.array_distinct("near").alias("at"))
        else:
            near = _seen(front.select("batch", F.explode("at").alias("node")).filter("node is not null").distinct(), states, ends_of, k, width)
            asks = front.select("batch", F.col("node").alias("asker"), F.explode("at").alias("node"))
            front = asks.join(near, ["batch", "node"]).groupBy("batch", F.col("asker").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("at"))
        if hop < hops:
            front = stored(front.filter(F.size("at") > 0), "hops")
        found = front.select("batch", "node", F.explode("at").alias("neighbour"), F.lit(hop).alias("hop"))
        out = found if out is None else out.unionByName(found)
    return out


def _seen(asks: DataFrame, states: DataFrame, ends_of: DataFrame, k: int, width: int) -> DataFrame:
    """(batch, node, near): the k last neighbours that each of asks(batch, node) may see of a node; none for a node not met before."""
    none = F.lit(None).cast("array<long>")
    rows = states.select("node", "batch", "_slice", F.lit(1).alias("held"), _newest([F.col("own"), F.col("near")], k).alias("after"))
    both = rows.unionByName(asks.select("node", "batch", floor_div(F.col("batch"), width).alias("_slice"), F.lit(0).alias("held"), none.alias("after")))
    above = W.partitionBy("node", "_slice").orderBy("batch", "held").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = stored(both.withColumn("near", F.last("after", ignorenulls=True).over(above)).filter("held = 0").select("batch", "node", "_slice", "near"), "seen")
    early = found.filter("near is null").select("batch", "node", "_slice")
    cut = ends_of.select("node", "_slice", F.lit(1).alias("held"), _newest([F.col("after"), F.col("start")], k).alias("after"))
    cuts = cut.unionByName(early.select("node", "_slice").distinct().select("node", "_slice", F.lit(0).alias("held"), none.alias("after")))
    before = W.partitionBy("node").orderBy("_slice", "held").rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = cuts.withColumn("near", F.last("after", ignorenulls=True).over(before)).filter("held = 0 and near is not null").select("node", "_slice", "near")
    return found.filter("near is not null").select("batch", "node", "near").unionByName(early.join(cuts, ["node", "_slice"]).select("batch", "node", "near"))


def last_update(edges: DataFrame) -> DataFrame:
    """(batch, node, last_t): the last time a node was met before each batch that holds it."""
    ends = edges.select("batch", "t", F.col("src").alias("node")).unionByName(edges.select("batch", "t", F.col("dst").alias("node")))
    per = ends.groupBy("batch", "node").agg(F.max("t").alias("most"))
    return with_running(per, ["node"], ["batch"], 1 << 12, {"last_t": ("max", "most")}, before=True).select("batch", "node", "last_t")


def stacked(sizes: DataFrame, m: int) -> DataFrame:
    """(tw, stack, offset): m graphs a stack, node ids moved past those of the graphs before."""
    s = sizes.withColumn("stack", F.floor(F.col("tw") / m))
    before = F.sum("n_nodes").over(W.partitionBy("stack").orderBy("tw").rowsBetween(W.unboundedPreceding, -1))
    return s.select("tw", "stack", F.coalesce(before, F.lit(0)).alias("offset"))


def reindexed(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, index): nodes of each graph numbered from 0 in order of id."""
    ends = edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node"))).distinct()
    return ends.withColumn("index", F.row_number().over(W.partitionBy(*by).orderBy("node")) - 1)


def node_means_overwritten(edges: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of an edge value over edges into a node; over edges out of it where none goes in (an earlier rule)."""
    ends = edges.select(*by, F.col("src").alias("node"), F.col(value).alias("_o"), F.lit(None).cast("double").alias("_i")).unionByName(edges.select(*by, F.col("dst").alias("node"), F.lit(None).cast("double").alias("_o"), F.col(value).alias("_i")))
    return ends.groupBy(*by, "node").agg(F.coalesce(F.avg("_i"), F.avg("_o")).alias(f"mean_{value}"))


def node_means(edges: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of an edge value over all edges at a node."""
    ends = edges.select(*by, F.col("src").alias("node"), value).unionByName(edges.select(*by, F.col("dst").alias("node"), value))
    return ends.groupBy(*by, "node").agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n_edges"))


def op_distribution(edges: DataFrame, by: list[str], ops: tuple[str, ...]) -> DataFrame:
    """Counts of each operation out of and into a node, over the graph's largest count."""
    out = edges.select(*by, F.col("src").alias("node"), F.concat(F.lit("out_"), "op").alias("k"))
    into = edges.select(*by, F.col("dst").alias("node"), F.concat(F.lit("in_"), "op").alias("k"))
    names = [f"{d}_{o}" for d in ("out", "in") for o in ops]
    counts = out.unionByName(into).groupBy(*by, "node").pivot("k", names).count().fillna(0, names)
    most = counts.groupBy(*by).agg(F.max(F.greatest(*names)).alias("_most"))
    return counts.join(most, by).select(*by, "node", *[(F.col(n) / F.col("_most")).alias(n) for n in names])


def dataset_stats(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split: number of graphs, and mean, least and most edges and nodes of a graph."""
    e = edges.join(splits, "day")
    n_edges = e.groupBy("split", "day", "tw").agg(F.count("*").alias("n_edges"))
    ends = e.select("split", "day", "tw", F.col("src").alias("node")).unionByName(e.select("split", "day", "tw", F.col("dst").alias("node")))
    n_nodes = ends.groupBy("split", "day", "tw").agg(F.countDistinct("node").alias("n_nodes"))
    both = n_edges.join(n_nodes, ["split", "day", "tw"])
    stats = [f(c).alias(f"{n}_{c}") for c in ("n_edges", "n_nodes") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return both.groupBy("split").agg(F.count("*").alias("n_graphs"), *stats)


def edge_features(parts: list[str]):
    """Concatenated feature arrays in the given order."""
    return F.concat(*[F.coalesce(F.col(p), F.array().cast("array<double>")) for p in parts])


def union_windows(windows: list[DataFrame]) -> DataFrame:
    out = windows[0]
    for w in windows[1:]:
        out = out.unionByName(w, allowMissingColumns=True)
    return out


def batched(edges: DataFrame, settings: dict) -> DataFrame:
    """The batching stage by its settings: a global batch (edges, minutes, unique_pairs), then one inside graphs.

    global: none, edges, minutes or unique_pairs, with size; by: columns of a graph's key; inside: edges a batch in
    a graph, numbered after the global ones; stack: graphs a stack. Adds batch and, where asked for, inner and stack.
    """
    by, kind = settings.get("by", []), settings.get("global", "none")
    if kind == "edges":
        edges = by_edges(edges, [], settings["size"])
    elif kind == "minutes":
        edges = by_time(edges, settings["size"] * 60_000_000_000, settings.get("length", settings["size"]) * 60_000_000_000, settings["start"])
    elif kind == "unique_pairs":
        edges = by_unique_pairs(edges, by)
    elif kind != "none":
        raise ValueError(f"no batching {kind!r}")
    if "inside" in settings:
        had = "batch" in edges.columns
        named = edges.withColumnRenamed("batch", "_outer") if had else edges
        named = by_edges(named, [*by, *(["_outer"] if had else [])], settings["inside"]).withColumnRenamed("batch", "inner")
        edges = named.withColumnRenamed("_outer", "batch") if had else named
    if "stack" in settings:
        edges = edges.withColumn("stack", F.floor(F.col(by[-1]) / settings["stack"]))
    return edges


def iterate(edges: DataFrame, column: str = "batch") -> Iterator[DataFrame]:
    """One DataFrame a batch, for training loops; batch numbers are few."""
    for row in edges.select(column).distinct().orderBy(column).toLocalIterator():
        yield edges.filter(F.col(column) == row[0])
