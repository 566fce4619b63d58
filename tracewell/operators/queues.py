"""Anomalous windows chained into queues by the rare nodes they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ordinal import with_ordinal, with_previous
from tracewell.functions.tables import stored


def idf(window_nodes: DataFrame, n_windows: DataFrame) -> DataFrame:
    """(node, idf): ln(N / (df + 1)); window_nodes(tw, node), n_windows(n)."""
    df = window_nodes.groupBy("node").agg(F.countDistinct("tw").alias("df"))
    return df.crossJoin(F.broadcast(n_windows)).select("node", "df", F.ln(F.col("n") / (F.col("df") + 1)).alias("idf"))


def anomalous_edges(losses: DataFrame, sigmas: float = 1.5) -> DataFrame:
    """Edges whose loss is over their window's mean plus sigmas population deviations."""
    s = losses.groupBy("tw").agg((F.avg("loss") + sigmas * F.stddev_pop("loss")).alias("_t"))
    return losses.join(s, "tw").filter("loss > _t").drop("_t")


def over_validation(losses: DataFrame, val: DataFrame) -> DataFrame:
    """Edges whose loss is over the greatest validation loss."""
    return losses.crossJoin(F.broadcast(val.agg(F.max("loss").alias("_t")))).filter("loss > _t").drop("_t")


def summarise(edges: DataFrame) -> DataFrame:
    """(tw, n, mean_loss, n_nodes) of a window's anomalous edges."""
    ends = edges.select("tw", F.col("src").alias("node")).unionByName(edges.select("tw", F.col("dst").alias("node"))).groupBy("tw").agg(F.countDistinct("node").alias("n_nodes"))
    return edges.groupBy("tw").agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss")).join(ends, "tw")


def rare_members(members: DataFrame, test_idf: DataFrame, train_idf: DataFrame, n_test: DataFrame, n_train: DataFrame, least: float = 5.0, benign: DataFrame | None = None) -> DataFrame:
    """members(tw, node) whose idf over test and training windows exceeds least; a node not met has ln(N)."""
    m = members if benign is None else members.join(benign, "node", "left_anti")
    d = m.join(test_idf.select("node", F.col("idf").alias("_a")), "node", "left").join(train_idf.select("node", F.col("idf").alias("_b")), "node", "left")
    d = d.crossJoin(F.broadcast(n_test.select(F.ln("n").alias("_na")))).crossJoin(F.broadcast(n_train.select(F.ln("n").alias("_nb"))))
    return d.filter(F.coalesce("_a", "_na") + F.coalesce("_b", "_nb") > least).select("tw", "node")


def rare_members_earlier(members: DataFrame, node_idf: DataFrame, n: DataFrame, share: float = 0.9) -> DataFrame:
    """members(tw, node) by the earlier rule: idf over ln(share * N); a node not met has ln(N)."""
    d = members.join(node_idf.select("node", "idf"), "node", "left").crossJoin(F.broadcast(n.select(F.col("n").alias("_n"))))
    return d.filter(F.coalesce("idf", F.ln("_n")) > F.ln(F.col("_n") * share)).select("tw", "node")


def outlying_members(members: DataFrame, lof: DataFrame, seen: DataFrame, least: float = 1.0) -> DataFrame:
    """members(tw, node) that training has not seen and whose outlier factor, lof(id, lof), exceeds least."""
    new = members.join(seen.select("node").distinct(), "node", "left_anti")
    return new.join(lof.filter(F.col("lof") > least).select(F.col("id").alias("node")), "node", "left_semi").select("tw", "node")


def related_windows(rare: DataFrame) -> DataFrame:
    """(tw_a, tw_b, n_shared) with tw_a < tw_b; rare nodes are in few windows by construction."""
    a, b = rare.select(F.col("tw").alias("tw_a"), "node"), rare.select(F.col("tw").alias("tw_b"), "node")
    return a.join(b, "node").filter("tw_a < tw_b").groupBy("tw_a", "tw_b").agg(F.count("*").alias("n_shared"))


def linked_windows(rare: DataFrame) -> DataFrame:
    """(tw_a, tw_b): each window of a node with the node's window before it, a row at most for each row of rare(tw, node).

    Whatever related windows reach from a window backwards, these reach too, so they build the same queues.
    """
    before = with_previous(rare.select("node", F.col("tw").cast("long").alias("tw")).distinct(), ["node"], ["tw"], 1 << 16, "tw", "before")
    return before.filter("before is not null").select(F.col("before").alias("tw_a"), F.col("tw").alias("tw_b")).distinct()


def build_queues(windows: DataFrame, related: DataFrame, everywhere: bool = False) -> DataFrame:
    """(tw, queue): each window in order joins the first queue with a related window, else opens one.

    With everywhere it joins all such queues. A window's queue was opened by the least window that links
    reach from it backwards: least windows pass along links and along each other, round by round in stored
    tables, so long chains take a few rounds and no task folds over the windows. Queues are numbered in
    order of their openers. related(tw_a, tw_b) with tw_a < tw_b, between windows.
    """
    nodes = windows.select(F.col("tw").cast("long").alias("tw")).distinct()
    ends = related.select(F.col("tw_a").cast("long").alias("a"), F.col("tw_b").cast("long").alias("b")).distinct()
    links = stored(ends.join(nodes.select(F.col("tw").alias("a")), "a", "left_semi").join(nodes.select(F.col("tw").alias("b")), "b", "left_semi").filter("a < b"), "window-links")
    opened = nodes.join(links.select(F.col("b").alias("tw")), "tw", "left_anti")
    numbers = with_ordinal(opened, [], ["tw"], 1 << 16, "queue").select(F.col("tw").alias("opener"), "queue")
    found = _every_opener(opened, links) if everywhere else _least_opener(nodes, links)
    return found.join(numbers, "opener").select("tw", "queue")


def _least_opener(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(tw, opener): the least window that links reach backwards; itself if there is none."""
    labels = stored(nodes.select("tw", F.col("tw").alias("opener")), "openers")
    while True:
        near = links.join(labels.withColumnsRenamed({"tw": "a"}), "a").groupBy(F.col("b").alias("tw")).agg(F.min("opener").alias("near"))
        stepped = labels.join(near, "tw", "left").select("tw", F.col("opener").alias("old"), F.least("opener", "near").alias("opener"))
        further = labels.select(F.col("tw").alias("opener"), F.col("opener").alias("further"))  # what the opener itself reaches
        moved = stored(stepped.join(further, "opener").select("tw", "old", F.least("opener", "further").alias("opener")), "openers")
        if not moved.filter("old != opener").head(1):
            return moved.select("tw", "opener")
        labels = moved.select("tw", "opener")


def _every_opener(opened: DataFrame, links: DataFrame) -> DataFrame:
    """(tw, opener): all openers that links reach backwards; a round takes new pairs one link on."""
    new = out = stored(opened.select("tw", F.col("tw").alias("opener")), "openers")
    while new.head(1):
        ahead = new.join(links, new["tw"] == links["a"]).select(F.col("b").alias("tw"), "opener").distinct()
        new = stored(ahead.join(out, ["tw", "opener"], "left_anti"), "openers")
        out = out.unionByName(new)
    return out


def queue_scores(queues: DataFrame, windows: DataFrame) -> DataFrame:
    """(queue, n_windows, score): the product of mean_loss + 1 over a queue's windows."""
    return queues.join(windows, "tw").groupBy("queue").agg(F.count("*").alias("n_windows"), F.exp(F.sum(F.ln(F.col("mean_loss") + 1))).alias("score"))


def flag_windows(queues: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(tw, y_hat): windows of a queue whose score exceeds the threshold."""
    return queues.join(scores, "queue").groupBy("tw").agg(F.max((F.col("score") > threshold).cast("int")).alias("y_hat"))
