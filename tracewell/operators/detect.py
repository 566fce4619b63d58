"""Thresholds, predictions and detection metrics over loss tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.integers import floor_div
from tracewell.functions.ordinal import carried, sliced

EPS = 1e-12


def thresholds(val: DataFrame) -> DataFrame:
    """One row: threshold by method from validation losses (magic: from magic_score, where there is one), and the constant ones."""
    magic = [F.avg("magic_score").alias("magic")] if "magic_score" in val.columns else []
    return val.agg(F.max("loss").alias("max_val_loss"), F.avg("loss").alias("mean_val_loss"), F.percentile("loss", F.lit(0.9)).alias("nodlink"), F.lit(1.5).alias("threatrace"), F.lit(0.53).alias("flash"), *magic)


def reduce_loss(method: str) -> Column:
    return F.avg("loss") if method == "mean_val_loss" else F.max("loss")


def node_scores(losses: DataFrame, threshold: DataFrame, method: str, use_dst: bool = True) -> DataFrame:
    """(node, score, y_hat, tw_with_max_loss) from edge losses (tw, src, dst, loss).

    The window is the first of the strictly largest positive loss, -1 if none is positive.
    """
    ends = losses.select("tw", F.col("src").alias("node"), "loss")
    if use_dst:
        ends = ends.unionByName(losses.select("tw", F.col("dst").alias("node"), "loss"))
    per = ends.groupBy("node").agg(reduce_loss(method).alias("score"), F.max_by("tw", F.struct("loss", -F.col("tw"))).alias("_tw"), F.max("loss").alias("_m"))
    t = threshold.select(F.col(method).alias("_t"))
    return per.crossJoin(F.broadcast(t)).select("node", "score", (F.col("score") > F.col("_t")).cast("int").alias("y_hat"), F.when(F.col("_m") > 0, F.col("_tw")).otherwise(F.lit(-1)).cast("long").alias("tw_with_max_loss"))


def with_seen(scores: DataFrame, train: DataFrame) -> DataFrame:
    """Adds is_seen: whether the node is an end of a training edge."""
    seen = train.select(F.col("src").alias("node")).unionByName(train.select(F.col("dst").alias("node"))).distinct().withColumn("_seen", F.lit(1))
    return scores.join(seen, "node", "left").withColumn("is_seen", F.coalesce("_seen", F.lit(0))).drop("_seen")


def node_level_scores(losses: DataFrame, threshold: DataFrame, method: str, windows: DataFrame) -> DataFrame:
    """(node, score, y_hat, tw_with_max_loss, detected_tw, start_t, end_t) from node losses (tw, node, loss, ...).

    threatrace and flash read their score and correct_pred, magic its score: a node's score is the
    greatest, and it is flagged if one over the threshold has a right prediction (magic: any). The window of the
    greatest such score, else of the greatest positive loss, gives the time range from windows(tw, start_t, end_t).
    Ties take the first window.
    """
    own = {"threatrace": "threatrace_score", "flash": "flash_score", "magic": "magic_score"}.get(method)
    t = threshold.select(F.col(method).alias("_t"))
    d = losses.crossJoin(F.broadcast(t))
    value = F.col(own or "loss")
    hit = value > F.col("_t")
    if method in ("threatrace", "flash"):
        hit = hit & F.coalesce(F.col("correct_pred").cast("boolean"), F.lit(False))
    best = F.max_by(F.when(hit, F.col("tw")), F.when(hit, F.struct(value.alias("v"), (-F.col("tw")).alias("w")))) if own else F.lit(None).cast("long")
    per = d.groupBy("node").agg(
        (F.max(own) if own else reduce_loss(method)).alias("score"), F.max(hit.cast("int")).alias("_hit"), F.max("_t").alias("_t"), best.alias("_best"),
        F.max_by("tw", F.struct("loss", -F.col("tw"))).alias("_tw"), F.max("loss").alias("_m"),
    )
    flagged = F.col("_hit") if method in ("threatrace", "flash") else (F.col("score") > F.col("_t")).cast("int")
    loudest = F.when(F.col("_m") > 0, F.col("_tw"))
    out = per.select("node", "score", flagged.alias("y_hat"), F.coalesce(loudest, F.lit(-1)).cast("long").alias("tw_with_max_loss"), F.coalesce("_best", loudest).cast("long").alias("detected_tw"))
    return out.join(windows.select(F.col("tw").alias("detected_tw"), "start_t", "end_t"), "detected_tw", "left")


def traced_results(results: DataFrame, traced: DataFrame) -> DataFrame:
    """results(tw, node, score, y_true) with y_hat by whether tracing kept the node in that window, traced(tw, node)."""
    kept = traced.select("tw", "node").distinct().withColumn("_k", F.lit(1))
    return results.drop("y_hat").join(kept, ["tw", "node"], "left").withColumn("y_hat", F.coalesce("_k", F.lit(0))).drop("_k")


def traced_nodes(results: DataFrame) -> DataFrame:
    """traced_results as one row a node: what its last window says."""
    last = F.max_by(F.struct("score", "y_true", "y_hat"), F.col("tw"))
    return results.groupBy("node").agg(last.alias("r")).select("node", "r.*")


def results_by_window(results: DataFrame, window_nodes: DataFrame) -> DataFrame:
    """Node results spread over the windows that hold the nodes, window_nodes(tw, node)."""
    return window_nodes.select("tw", "node").distinct().join(results.select("node", "score", "y_true", "y_hat"), "node")


def tracing_counts(traced: DataFrame, bad: DataFrame) -> DataFrame:
    """(tw, poi, is_tp, tps, fps): of the nodes traced from each poi, traced(tw, poi, node), how many are bad(node)."""
    b = bad.select("node").distinct().withColumn("_b", F.lit(1))
    d = traced.select("tw", "poi", "node").distinct().join(b, "node", "left")
    per = d.groupBy("tw", "poi").agg(F.count("_b").alias("tps"), (F.count("*") - F.count("_b")).alias("fps"))
    return per.join(b.select(F.col("node").alias("poi"), "_b"), "poi", "left").select("tw", "poi", F.coalesce("_b", F.lit(0)).alias("is_tp"), "tps", "fps")


def window_scores(losses: DataFrame, threshold: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """(keys, score, y_hat) reduced per window, or per window and node."""
    t = threshold.select(F.col(method).alias("_t"))
    return losses.groupBy(*keys).agg(reduce_loss(method).alias("score")).crossJoin(F.broadcast(t)).select(*keys, "score", (F.col("score") > F.col("_t")).cast("int").alias("y_hat"))


def edge_predictions(losses: DataFrame, truth: DataFrame, threshold: DataFrame, method: str) -> DataFrame:
    """Adds y_true by (src, dst, t, op) and y_hat."""
    t = threshold.select(F.col(method).alias("_t"))
    own = truth.select("src", "dst", "t", "op").distinct().withColumn("_y", F.lit(1))
    return losses.join(own, ["src", "dst", "t", "op"], "left").crossJoin(F.broadcast(t)).withColumn("y_true", F.coalesce("_y", F.lit(0))).withColumn("y_hat", (F.col("loss") > F.col("_t")).cast("int")).drop("_y", "_t")


def malicious_edges(edges: DataFrame, bad: DataFrame, mode: str) -> DataFrame:
    """Edges by which of their ends are in bad(node): src_node, dst_node, both_nodes or either_node."""
    src, dst = bad.select(F.col("node").alias("src")).distinct().withColumn("_s", F.lit(True)), bad.select(F.col("node").alias("dst")).distinct().withColumn("_d", F.lit(True))
    e = edges.join(src, "src", "left").join(dst, "dst", "left")
    s, d = F.col("_s").isNotNull(), F.col("_d").isNotNull()
    keep = {"src_node": s, "dst_node": d, "both_nodes": s & d, "either_node": s | d}[mode]
    return e.filter(keep).drop("_s", "_d")


def window_labels(windows: DataFrame, touched: DataFrame, slot: int, strict: bool = True) -> DataFrame:
    """(tw, node, n): how often each malicious node is met inside a window.

    windows(tw, start_t, end_t) and touched(node, t) meet in time slots, so the
    range test runs inside an equality join.
    """
    w = windows.withColumn("_slot", F.explode(F.sequence(floor_div(F.col("start_t"), slot), floor_div(F.col("end_t"), slot))))
    m = touched.withColumn("_slot", floor_div(F.col("t"), slot))
    inside = (F.col("t") > F.col("start_t")) & (F.col("t") < F.col("end_t")) if strict else F.col("t").between(F.col("start_t"), F.col("end_t"))
    return w.join(m, "_slot").filter(inside).groupBy("tw", "node").agg(F.count("*").alias("n"))


def touched_nodes(events: DataFrame, attacks: DataFrame, bad: DataFrame) -> DataFrame:
    """(attack_id, node, t): times in an attack's closed range at which its nodes are an end."""
    ends = events.select("t", F.col("src").alias("node")).unionByName(events.select("t", F.col("dst").alias("node")))
    a = bad.join(F.broadcast(attacks), "attack_id")
    return ends.join(a, "node").filter(F.col("t").between(F.col("start_ns"), F.col("end_ns"))).select("attack_id", "node", "t")


def confusion(results: DataFrame) -> DataFrame:
    """tp, fp, tn, fn and the metrics derived from them; zeros without positives."""
    y, p = F.col("y_true") == 1, F.col("y_hat") == 1
    c = results.agg(*[F.coalesce(F.sum(cond.cast("long")), F.lit(0)).alias(n) for n, cond in (("tp", y & p), ("fp", ~y & p), ("tn", ~y & ~p), ("fn", y & ~p))])
    tp, fp, tn, fn = (F.col(n).cast("double") for n in ("tp", "fp", "tn", "fn"))
    precision, recall, fpr = tp / (tp + fp + EPS), tp / (tp + fn + EPS), fp / (fp + tn + EPS)
    mcc = (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + EPS)
    return c.select("tp", "fp", "tn", "fn", *[F.round(v, 5).alias(n) for n, v in (
        ("precision", precision), ("recall", recall), ("fpr", fpr), ("fscore", 2 * precision * recall / (precision + recall + EPS)),
        ("accuracy", (tp + tn) / (tp + tn + fp + fn + EPS)), ("balanced_acc", (recall + tn / (tn + fp + EPS)) / 2), ("lr_plus", recall / (fpr + EPS)), ("dor", tp * tn / (fp * fn + EPS)), ("mcc", mcc))])


def running(df: DataFrame, ties: list[str], sums: dict[str, str], rank: str | None = None, slices: int | None = None) -> DataFrame:
    """Adds running sums from the highest score down (ties in order of `ties`), and the rank.

    Rows are cut into ranges of (score, ties); sums run inside a slice, on top of
    the totals of the slices above, one row each.
    """
    names = {**sums, **({rank: "_one"} if rank else {})}
    d = sliced(df.withColumn("_one", F.lit(1).cast("long")), [F.desc("score"), *ties], slices)
    totals = d.groupBy("_slice").agg(*[F.sum(c).alias(f"_{n}") for n, c in names.items()])
    above = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_slice", *[F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_start_{n}") for n in names])
    own = W.partitionBy("_slice").orderBy(F.desc("score"), *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = d.select("*", *[F.sum(c).over(own).alias(f"_in_{n}") for n, c in names.items()]).join(F.broadcast(starts), "_slice")
    return out.select(*df.columns, *[(F.col(f"_start_{n}") + F.col(f"_in_{n}")).alias(n) for n in names])


def ranking_counts(results: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives at it, and from the highest down to it."""
    per = results.groupBy("score").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    return running(per, [], {"tp": "pos", "fp": "neg"})


def auc_ap(results: DataFrame) -> DataFrame:
    """Area under ROC (ties count half) and average precision."""
    r = ranking_counts(results)
    total = results.agg(F.sum("y_true").alias("_p"), F.sum(1 - F.col("y_true")).alias("_n"))
    d = r.crossJoin(F.broadcast(total))
    return d.agg(
        F.round(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.max(F.col("_p") * F.col("_n")), 6).alias("auc"),
        F.round(F.sum(F.col("pos") / F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("ap"),
    )


def pr_curve(results: DataFrame) -> DataFrame:
    """(score, precision, recall) at each distinct score."""
    total = results.agg(F.sum("y_true").alias("_p"))
    return ranking_counts(results).crossJoin(F.broadcast(total)).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("_p")).alias("recall"))


def ranked(results: DataFrame) -> DataFrame:
    """Rows by score, highest first, ties by node, with rank and running true and false positives."""
    d = running(results.withColumn("_neg", 1 - F.col("y_true")), ["node"], {"tps": "y_true", "fps": "_neg"}, "rank")
    return d.drop("_neg")


def with_attacks_found(results: DataFrame, attacks: DataFrame) -> DataFrame:
    """Adds found: how many attacks have a node at or above the row, and n_attacks."""
    r = ranked(results)
    first = r.join(attacks.select("node", "attack_id").distinct(), "node").groupBy("attack_id").agg(F.min("rank").alias("rank"))
    at = first.agg(F.coalesce(F.collect_list("rank"), F.array().cast("array<long>")).alias("_at"))  # one number an attack
    n = attacks.agg(F.countDistinct("attack_id").alias("n_attacks"))
    found = F.size(F.filter("_at", lambda x: x <= F.col("rank"))).cast("long")
    return r.crossJoin(F.broadcast(at)).withColumn("found", found).drop("_at").crossJoin(F.broadcast(n))


def area_over_precision(points: DataFrame, slices: int | None = None) -> DataFrame:
    """Trapezoid area, over precision, of the largest percentage at each precision; points(precision, percent).

    Precisions are cut into ranges; a range's first point meets the last one of the ranges before.
    """
    best = sliced(points.groupBy("precision").agg(F.max("percent").alias("percent")), ["precision"], slices)
    point = F.struct("precision", "percent")
    before = F.lag(F.struct(point.alias("v"))).over(W.partitionBy("_slice").orderBy("precision"))
    slabs = best.withColumn("_b", before).join(F.broadcast(carried(best, point, F.col("precision"))), "_slice").withColumn("_b", F.coalesce("_b", "_carried")["v"])
    area = F.sum((F.col("precision") - F.col("_b.precision")) * (F.col("percent") + F.col("_b.percent")) / 2)
    return slabs.agg(F.round(F.coalesce(area, F.lit(0.0)) / 100, 6).alias("area"))


def adp(results: DataFrame, attacks: DataFrame) -> DataFrame:
    """Area of detected attacks over precision, from (0, 0) on."""
    r = with_attacks_found(results, attacks)
    points = r.select((F.col("tps") / F.col("rank")).alias("precision"), (F.col("found") / F.col("n_attacks") * 100).alias("percent"))
    origin = points.sparkSession.range(1).select(F.lit(0.0).alias("precision"), F.lit(0.0).alias("percent"))
    return area_over_precision(points.unionByName(origin))


def recall_over_precision(results: DataFrame) -> DataFrame:
    """The same area for the percentage of positives found."""
    n = results.agg(F.sum("y_true").alias("_n"))
    points = ranked(results).crossJoin(F.broadcast(n)).select((F.col("tps") / F.col("rank")).alias("precision"), (F.col("tps") / F.col("_n") * 100).alias("percent"))
    origin = points.sparkSession.range(1).select(F.lit(0.0).alias("precision"), F.lit(0.0).alias("percent"))
    return area_over_precision(points.unionByName(origin))


def discrimination(results: DataFrame, attacks: DataFrame, k: int = 10) -> DataFrame:
    """Mean over attacks of its best scaled score less the mean of the k best benign ones, and how many nodes beat that mean."""
    top = results.agg((F.max("score") + 1e-6).alias("_m"))
    d = results.crossJoin(F.broadcast(top)).withColumn("s", F.col("score") / F.col("_m"))
    benign = d.filter("y_true = 0").orderBy(F.desc("s"), "node").limit(k).agg(F.avg("s").alias("_b"))
    own = d.join(attacks.select("node", "attack_id").distinct(), "node").crossJoin(F.broadcast(benign))
    per = own.groupBy("attack_id").agg((F.max("s") - F.max("_b")).alias("gap"))
    beat = own.filter("s > _b").agg(F.countDistinct("node").alias("discrim_tp"))
    return per.agg(F.round(F.avg("gap"), 6).alias("discrim_score")).crossJoin(beat)


def discrimination_area(results: DataFrame, k: int) -> DataFrame:
    """Mean trapezoid area between the k best positives and the k best benign nodes, by rank, over the greatest score."""
    w = W.partitionBy("y_true").orderBy(F.desc("score"), "node")
    best = results.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    pos, neg = best.filter("y_true = 1").select("r", F.col("score").alias("p")), best.filter("y_true = 0").select("r", F.col("score").alias("n"))
    gaps = pos.join(neg, "r").withColumn("gap", F.col("p") - F.col("n"))
    before = F.lag("gap").over(W.orderBy("r"))
    most = results.agg(F.max("score").alias("_m"))
    area = gaps.withColumn("slab", (F.col("gap") + before) / 2).agg(F.sum("slab").alias("a"), F.count("*").alias("c"))
    return area.crossJoin(most).select(F.round(F.coalesce(F.col("a"), F.lit(0.0)) / F.greatest(F.col("c") - 1, F.lit(1)) / (F.col("_m") + 1e-6), 6).alias("area"))


def tps_before_first_fp(results: DataFrame, attacks: DataFrame) -> DataFrame:
    """(attack_id, n_nodes): nodes of each attack ranked above the first false positive."""
    clean = ranked(results).filter("fps = 0 and y_true = 1")
    return clean.join(attacks.select("node", "attack_id").distinct(), "node").groupBy("attack_id").agg(F.count("*").alias("n_nodes"))


def until_all_attacks(results: DataFrame, attacks: DataFrame) -> DataFrame:
    """fps and tps above the row that completes the set of attacks."""
    r = with_attacks_found(results, attacks).filter("found < n_attacks")
    return r.agg(F.coalesce(F.sum(1 - F.col("y_true")), F.lit(0)).alias("fps"), F.coalesce(F.sum("y_true"), F.lit(0)).alias("tps"))


def relabel_by_two_means(results: DataFrame, k: int) -> DataFrame:
    """(node, score, y_hat): the k best scores are cut in two by the best one-dimensional 2-means; the upper part is 1."""
    top = results.select("node", "score").orderBy(F.desc("score"), "node").limit(k)
    order = W.orderBy("score", F.desc("node"))
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    d = top.withColumn("i", F.row_number().over(order)).withColumn("s1", F.sum("score").over(run)).withColumn("n", F.count("*").over(whole)).withColumn("s", F.sum("score").over(whole))
    rest = F.col("n") - F.col("i")
    gain = F.col("s1") * F.col("s1") / F.col("i") + F.when(rest > 0, (F.col("s") - F.col("s1")) * (F.col("s") - F.col("s1")) / rest)
    cut = d.withColumn("gain", F.round(gain, 9)).filter(rest > 0).orderBy(F.desc("gain"), "i").limit(1).select(F.col("i").alias("cut"))
    up = d.crossJoin(F.broadcast(cut)).filter("i > cut").select("node", F.lit(1).alias("y"))
    return results.select("node", "score").join(up, "node", "left").select("node", "score", F.coalesce("y", F.lit(0)).alias("y_hat"))


def relabel_windows_by_two_means(scores: DataFrame, threshold: DataFrame, k: int) -> DataFrame:
    """(tw, node, score, y_hat): in windows with a score over the threshold, the upper part of the k best scores; 0 elsewhere.

    scores(tw, node, score), threshold one value. Each such window's k best are cut in two by the best one-dimensional
    2-means; a window with one node has no upper part. Only k rows of a window meet in a task.
    """
    t = threshold.select(F.col(threshold.columns[0]).alias("_t"))
    loud = scores.crossJoin(F.broadcast(t)).filter("score > _t").select("tw").distinct()
    best = W.partitionBy("tw").orderBy(F.desc("score"), "node")
    top = scores.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).join(loud, "tw", "left_semi")
    run = W.partitionBy("tw").orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("tw")
    d = top.select("tw", "node", "r", F.count("*").over(run).alias("i"), F.sum("score").over(run).alias("s1"), F.count("*").over(whole).alias("n"), F.sum("score").over(whole).alias("s"))
    rest = F.col("n") - F.col("i")
    gain = F.round(F.col("s1") * F.col("s1") / F.col("i") + (F.col("s") - F.col("s1")) * (F.col("s") - F.col("s1")) / rest, 9)
    cut = d.filter(rest > 0).groupBy("tw").agg(F.max_by("i", F.struct(gain.alias("g"), (-F.col("i")).alias("i"))).alias("cut"))
    up = d.join(cut, "tw").filter("i > cut").select("tw", "node", F.lit(1).alias("y"))
    return scores.select("tw", "node", "score").join(up, ["tw", "node"], "left").select("tw", "node", "score", F.coalesce("y", F.lit(0)).alias("y_hat"))


def fp_in_malicious_windows(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of false positives whose window of greatest loss holds a malicious node."""
    bad = labels.select(F.col("tw").alias("tw_with_max_loss")).distinct().withColumn("_bad", F.lit(1))
    fp = results.filter("y_true = 0 and y_hat = 1").join(bad, "tw_with_max_loss", "left")
    return fp.agg(F.count("*").alias("n_fp"), F.round(F.coalesce(F.avg(F.coalesce("_bad", F.lit(0))), F.lit(0.0)), 6).alias("share"))


def attacks_detected(results: DataFrame, attacks: DataFrame) -> DataFrame:
    """(attack_id, tps): flagged nodes of each attack, 0 where none is."""
    hit = results.filter("y_hat = 1").select("node").withColumn("_h", F.lit(1))
    return attacks.select("attack_id", "node").distinct().join(hit, "node", "left").groupBy("attack_id").agg(F.coalesce(F.sum("_h"), F.lit(0)).alias("tps"))


def dor_sweep(results: DataFrame, steps: int = 300) -> DataFrame:
    """(threshold, recall, dor) at evenly spaced thresholds between the least and the greatest score.

    Counts per step are differences of one histogram, so each row is read once.
    """
    span = results.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / (steps - 1)
    at = F.when(width > 0, F.least(F.lit(steps - 1), F.ceil(F.round((F.col("score") - F.col("_lo")) / width, 9)) - 1)).otherwise(F.lit(-1))
    bins = results.crossJoin(F.broadcast(span)).groupBy(at.cast("long").alias("bin")).agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))
    grid = results.sparkSession.range(-1, steps).withColumnRenamed("id", "bin").join(bins, "bin", "left").fillna(0)
    above = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = grid.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above))
    total = results.agg(F.sum("y_true").alias("_p"), F.sum(1 - F.col("y_true")).alias("_n"))
    d = run.filter("bin >= 0").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(span))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("_p") - F.col("tp"), F.col("_n") - F.col("fp")
    return d.select("bin", F.round(F.col("_lo") + F.col("bin") * width, 6).alias("threshold"), F.round(tp / F.col("_p"), 6).alias("recall"), F.round(tp * tn / (fp * fn + EPS), 6).alias("dor"))


def best_by(stats: DataFrame, *metrics: str) -> DataFrame:
    """The row of greatest metrics, in their order; ties take the least epoch."""
    return stats.groupBy().agg(F.max_by(F.struct(*stats.columns), F.struct(*metrics, -F.col("epoch"))).alias("b")).select("b.*")


def attacks_of_nodes(attacks: DataFrame) -> DataFrame:
    """(node, attacks): the attacks of each node, from (attack_id, node) rows."""
    return attacks.groupBy("node").agg(F.array_sort(F.collect_set("attack_id")).alias("attacks"))


def best_epoch(stats: DataFrame) -> DataFrame:
    """The epoch of greatest adp, then discrimination, then least number."""
    return stats.groupBy().agg(F.max_by(F.struct(*stats.columns), F.struct("adp", "discrim", -F.col("epoch"))).alias("b")).select("b.*")
