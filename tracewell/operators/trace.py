"""Tracing from points of interest through graphs in edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalar import min_max
from tracewell.functions.tables import stored

from .transform import closure, doubled, ways_from


def points_of_interest(results: DataFrame) -> DataFrame:
    """(tw, pois) of flagged nodes per window."""
    return results.filter("y_hat = 1").groupBy("tw").agg(F.array_sort(F.collect_set("node")).alias("pois"))


def n_hop(edges: DataFrame, by: list[str], start: DataFrame, n: int) -> DataFrame:
    """(by, poi, node, hops): nodes within n undirected hops of each poi, with the least number of hops."""
    e = edges.select(*by, "src", "dst").unionByName(edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = front = stored(start.select(*by, "poi", F.col("poi").alias("node")).withColumn("hops", F.lit(0)), "hops")
    for k in range(1, n + 1):
        more = front.join(e.withColumnRenamed("src", "node"), [*by, "node"]).select(*by, "poi", F.col("dst").alias("node")).distinct()
        front = stored(more.join(found, [*by, "poi", "node"], "left_anti").withColumn("hops", F.lit(k)), "hops")
        found = found.unionByName(front)
    return found


def ancestors(edges: DataFrame, by: list[str], pois: DataFrame) -> DataFrame:
    """(by, poi, node) for all nodes from which a poi is reached."""
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, by, pois.withColumnRenamed("poi", "node")).select(*by, F.col("src").alias("poi"), F.col("dst").alias("node"))


def descendants(edges: DataFrame, by: list[str], pois: DataFrame) -> DataFrame:
    return closure(edges, by, pois.withColumnRenamed("poi", "node")).select(*by, F.col("src").alias("poi"), F.col("dst").alias("node"))


def entry_components(edges: DataFrame, by: list[str], pois: DataFrame) -> DataFrame:
    """(by, poi, entry, node): per entry (an ancestor without incoming edges) the nodes on ways from it to the poi."""
    step, m, whole = doubled(edges, by)
    if whole:  # both directions are in one table
        up = stored(step.select(*by, F.col("dst").alias("poi"), F.col("src").alias("node")).join(pois.select(*by, "poi").distinct(), [*by, "poi"], "left_semi"), "up")
    else:
        up = stored(ancestors(edges, by, pois), "up")
    into = step.select(*by, F.col("dst").alias("node")).distinct()
    entries = stored(up.join(into, [*by, "node"], "left_anti").withColumnRenamed("node", "entry"), "entries")
    down = ways_from(entries.select(*by, F.col("entry").alias("node")), step, m, whole, by).select(*by, F.col("src").alias("entry"), F.col("dst").alias("node"))
    on_way = entries.join(down, [*by, "entry"]).join(up, [*by, "poi", "node"], "left_semi").select(*by, "poi", "entry", "node")
    ends = entries.select(*by, "poi", "entry", F.col("entry").alias("node")).unionByName(entries.select(*by, "poi", "entry", F.col("poi").alias("node")))
    return on_way.unionByName(ends).distinct()


def exit_components(edges: DataFrame, by: list[str], pois: DataFrame) -> DataFrame:
    """(by, poi, exit, node): per exit (a descendant without outgoing edges) the nodes on ways from the poi to it."""
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return entry_components(back, by, pois).withColumnRenamed("entry", "exit")


def attack_subgraph(edges: DataFrame, by: list[str], marked: DataFrame, labels: DataFrame, hops: int) -> DataFrame:
    """Nodes around marked(by, node) within hops, those of equal path and type as one.

    labels(by, node, path, node_type, y_true) describe nodes. Gives (by, path, node_type, y_true, score, first_t,
    last_t, n_nodes) of the induced edges' ends: greatest label and loss, first and last time.
    """
    near = n_hop(edges, by, marked.withColumnRenamed("node", "poi"), hops).select(*by, "node")
    own = induced(edges, near, by)
    ends = own.select(*by, F.col("src").alias("node"), "t", "loss").unionByName(own.select(*by, F.col("dst").alias("node"), "t", "loss"))
    per = ends.groupBy(*by, "node").agg(F.max("loss").alias("score"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return fused_nodes(per.join(labels, [*by, "node"]), by)


def shortest_paths(edges: DataFrame, by: list[str], sources: DataFrame) -> DataFrame:
    """(by, src, dst, hops, path): one shortest path from each source, the least by node ids, of any length."""
    step, m, whole = doubled(edges.filter("src != dst"), by, paths=True)
    start = sources.select(*by, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hops"), F.array("node").alias("path"))
    return start.unionByName(ways_from(sources, step, m, whole, by, paths=True))


def time_respecting(edges: DataFrame, by: list[str], start: DataFrame, forward: bool) -> DataFrame:
    """(by, poi, node, t): nodes reached along edges of increasing (backward: decreasing) time; t is the best time of arrival."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    best = F.min if forward else F.max
    found = front = stored(start.select(*by, "poi", F.col("poi").alias("node"), "t"), "times")
    e = edges.select(*by, F.col(a).alias("node"), F.col(b).alias("next"), F.col("t").alias("et"))
    while True:
        later = F.col("et") > F.col("t") if forward else F.col("et") < F.col("t")
        more = front.join(e, [*by, "node"]).filter(later).groupBy(*by, "poi", F.col("next").alias("node")).agg(best("et").alias("t"))
        old = found.groupBy(*by, "poi", "node").agg(best("t").alias("_t"))
        better = F.col("_t").isNull() | ((F.col("t") < F.col("_t")) if forward else (F.col("t") > F.col("_t")))
        front = stored(more.join(old, [*by, "poi", "node"], "left").filter(better).drop("_t"), "times")
        if not front.head(1):
            break
        found = found.unionByName(front)
    return found.groupBy(*by, "poi", "node").agg(best("t").alias("t"))


def degree_ratio(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, ratio): out-degree over in-degree, 0 without incoming edges."""
    d = edges.select(*by, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(*by, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return d.groupBy(*by, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).select(*by, "node", F.when(F.col("i") > 0, F.col("o") / F.col("i")).otherwise(F.lit(0.0)).alias("ratio"))


def combined_scores(ratios: DataFrame, losses: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, score): scaled degree ratio plus scaled loss; a node without loss has 0."""
    d = ratios.join(losses.select(*by, "node", "loss"), [*by, "node"], "left").fillna(0.0, ["loss"])
    return min_max(min_max(d, "ratio", by, "_r"), "loss", by, "_l").select(*by, "node", (F.col("_r") + F.col("_l")).alias("score"))


def best_entries(components: DataFrame, scores: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """(by, poi, entry, score): entries of greatest mean node score, ties all kept."""
    means = components.join(scores, [*by, "node"]).groupBy(*by, "poi", "entry").agg(F.round(F.avg("score"), digits).alias("score"))
    most = means.groupBy(*by, "poi").agg(F.max("score").alias("score"))
    return means.join(most, [*by, "poi", "score"]).select(*by, "poi", "entry", "score")


def induced(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Edges with both ends among nodes(by, node)."""
    n = nodes.select(*by, "node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), [*by, "src"], "left_semi").join(n.withColumnRenamed("node", "dst"), [*by, "dst"], "left_semi")


def fused_nodes(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nodes of equal path and type as one: greatest label and score, first and last time."""
    return nodes.groupBy(*(by or []), "path", "node_type").agg(F.max("y_true").alias("y_true"), F.max("score").alias("score"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.count("*").alias("n_nodes"))
