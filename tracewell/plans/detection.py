"""Queries on thresholds, predictions, detection metrics, queues, tracing and experiments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions.tables import shared_root
from tracewell.operators import detect, queues, trace
from tracewell.session import table
from tracewell.streaming import streams

from . import model as m
from . import runner


def _val(s, d):
    return m.events(s, d).filter("day > '2024-01-15' and day <= '2024-01-20'")


def _test(s, d):
    return m.slotted(s, d).filter("day > '2024-01-20'")


def thresholds(s, d):
    out = detect.thresholds(_val(s, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def node_scores(s, d):
    out = detect.node_scores(_test(s, d), detect.thresholds(_val(s, d)), "mean_val_loss")
    return out.select("node", F.round("score", 6).alias("score"), "y_hat", "tw_with_max_loss")


def node_scores_seen(s, d):
    out = detect.node_scores(_test(s, d), detect.thresholds(_val(s, d)), "max_val_loss", use_dst=False)
    return detect.with_seen(out, m.events(s, d).filter("day <= '2024-01-15'")).select("node", "score", "is_seen")


def _node_losses(s, d, e):
    """Node losses with scores of three kinds, derived from the event."""
    return e.select("tw", F.col("src").alias("node"), "loss", (F.col("loss") / 60).alias("threatrace_score"), (F.col("loss") / 200).alias("flash_score"), (F.col("loss") * F.col("loss") / 1000).alias("magic_score"), (F.col("event_id") % 3 != 0).alias("correct_pred"))


def _node_level(s, d, method):
    e = _test(s, d)
    w = e.groupBy("tw").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    val = _node_losses(s, d, m.slotted(s, d).filter("day > '2024-01-15' and day <= '2024-01-20'"))
    out = detect.node_level_scores(_node_losses(s, d, e), detect.thresholds(val), method, w)
    return out.select("node", F.round("score", 6).alias("score"), "y_hat", "tw_with_max_loss", "detected_tw", "start_t", "end_t")


def node_level_threatrace(s, d):
    return _node_level(s, d, "threatrace")


def node_level_flash(s, d):
    return _node_level(s, d, "flash")


def node_level_magic(s, d):
    return _node_level(s, d, "magic")


def node_level_loss(s, d):
    return _node_level(s, d, "mean_val_loss")


def results_by_window(s, d):
    e = _test(s, d)
    return detect.results_by_window(m.results(s, d), e.select("tw", F.col("src").alias("node")))


def attacks_of_nodes(s, d):
    return detect.attacks_of_nodes(m.bad_nodes(s, d)).select("node", F.array_join("attacks", ",").alias("attacks"))


def tw_scores(s, d):
    return detect.window_scores(_test(s, d), detect.thresholds(_val(s, d)), "max_val_loss", ["tw"])


def node_tw_scores(s, d):
    e = _test(s, d)
    ends = e.select("tw", F.col("src").alias("node"), "loss").unionByName(e.select("tw", F.col("dst").alias("node"), "loss"))
    out = detect.window_scores(ends, detect.thresholds(_val(s, d)), "nodlink", ["tw", "node"])
    return out.select("tw", "node", F.round("score", 6).alias("score"), "y_hat")


def edge_predictions(s, d):
    e = m.events(s, d)
    truth = e.filter("op = 'error' and loss > 40 and day > '2024-01-20'")
    out = detect.edge_predictions(_test(s, d), truth, detect.thresholds(_val(s, d)), "mean_val_loss")
    return out.select("event_id", "y_true", "y_hat")


def edge_labels_4modes(s, d):
    e = m.meshed(s, d).select("src", "dst", "event_id")
    bad = m.bad_nodes(s, d).select("node")
    out = None
    for mode in ("src_node", "dst_node", "both_nodes", "either_node"):
        part = detect.malicious_edges(e, bad, mode).groupBy().agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.lit(mode).alias("mode"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


def malicious_times(s, d):
    return detect.touched_nodes(m.events(s, d), m.attacks(s), m.bad_nodes(s, d)).groupBy("attack_id", "node").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


def tw_labels_rangejoin(s, d):
    w = m.adaptive(s, d).select((F.datediff(F.col("day").cast("date"), F.lit("2024-01-01").cast("date")) * 1000 + F.col("tw")).alias("tw"), F.col("tw_start").alias("start_t"), F.col("tw_end").alias("end_t")).distinct()
    return detect.window_labels(w, detect.touched_nodes(m.events(s, d), m.attacks(s), m.bad_nodes(s, d)).select("node", "t"), m.SLOT)


def confusion_metrics(s, d):
    return detect.confusion(m.results(s, d))


def auc_ap(s, d):
    return detect.auc_ap(m.results(s, d))


def pr_curve(s, d):
    return detect.pr_curve(m.results(s, d)).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def adp(s, d):
    return detect.adp(m.results(s, d), m.bad_nodes(s, d))


def recall_over_precision(s, d):
    return detect.recall_over_precision(m.results(s, d))


def discrimination(s, d):
    return detect.discrimination(m.results(s, d), m.bad_nodes(s, d))


def discrimination_area(s, d):
    return detect.discrimination_area(m.results(s, d), 10)


def tps_before_first_fp(s, d):
    r = m.results(s, d).withColumn("score", F.when(F.col("node") == 38, 1e6).otherwise(F.col("score")))
    return detect.tps_before_first_fp(r, m.bad_nodes(s, d))


def fps_until_all_attacks(s, d):
    return detect.until_all_attacks(m.results(s, d), m.bad_nodes(s, d))


def attacks_detected(s, d):
    return detect.attacks_detected(m.results(s, d), m.bad_nodes(s, d))


def kmeans_topk(s, d):
    return detect.relabel_by_two_means(m.results(s, d), 30)


def kmeans_windows(s, d):
    """Mean losses of nodes a window; windows with one over the threshold keep the upper part of their ten best."""
    e = _test(s, d)
    scores = e.groupBy("tw", F.col("src").alias("node")).agg(F.avg("loss").alias("score"))
    t = _val(s, d).agg((F.max("loss") * 0.8).alias("t"))
    return detect.relabel_windows_by_two_means(scores, t, 10).select("tw", "node", F.round("score", 6).alias("score"), "y_hat")


def fp_in_malicious_windows(s, d):
    scores = detect.node_scores(_test(s, d).filter("src < 1000000"), detect.thresholds(_val(s, d)), "mean_val_loss", use_dst=False)
    bad = m.bad_nodes(s, d).select("node").distinct().withColumn("y", F.lit(1))
    r = scores.join(bad, "node", "left").withColumn("y_true", F.coalesce("y", F.lit(0)))
    labels = _test(s, d).join(bad.withColumnRenamed("node", "src"), "src").filter("op = 'purchase' and loss > 60").select("tw").distinct()
    return detect.fp_in_malicious_windows(r, labels)


def dor_recall_sweep(s, d):
    return detect.dor_sweep(m.results(s, d), 50)


def node_idf(s, d):
    e = m.slotted(s, d)
    ends = e.select("tw", F.col("src").alias("node")).unionByName(e.select("tw", F.col("dst").alias("node")))
    return queues.idf(ends, e.agg(F.countDistinct("tw").alias("n"))).select("node", "df", F.round("idf", 9).alias("idf"))


def anomalous_edges_sigma(s, d):
    return queues.anomalous_edges(m.slotted(s, d)).select("tw", "event_id")


def anomalous_windows(s, d):
    out = queues.summarise(queues.anomalous_edges(m.slotted(s, d), 3.0))
    return out.select("tw", "n", F.round("mean_loss", 6).alias("mean_loss"), "n_nodes")


def over_validation(s, d):
    return queues.over_validation(_test(s, d), _val(s, d)).select("event_id")


def _rare(s, d):
    e = m.slotted(s, d)

    def ends(x):
        return x.select("tw", F.col("src").alias("node")).unionByName(x.select("tw", F.col("dst").alias("node"))).distinct()

    test, train = e.filter("day > '2024-01-20'"), e.filter("day <= '2024-01-15'")
    n_test, n_train = test.agg(F.countDistinct("tw").alias("n")), train.agg(F.countDistinct("tw").alias("n"))
    odd = ends(queues.anomalous_edges(test, 2.0))
    return queues.rare_members(odd, queues.idf(ends(test), n_test), queues.idf(ends(train), n_train), n_test, n_train, 2.0)


def window_relatedness(s, d):
    return queues.related_windows(_rare(s, d))


def window_relatedness_earlier(s, d):
    e = m.slotted(s, d)
    ends = lambda x: x.select("tw", F.col("src").alias("node")).unionByName(x.select("tw", F.col("dst").alias("node"))).distinct()
    n = e.agg(F.countDistinct("tw").alias("n"))
    return queues.related_windows(queues.rare_members_earlier(ends(queues.anomalous_edges(e, 2.0)), queues.idf(ends(e), n), n, 0.06))


def _queues(s, d):
    rare = _rare(s, d)
    w = queues.summarise(queues.anomalous_edges(_test(s, d), 2.0))
    return w, queues.build_queues(w, queues.linked_windows(rare))


def queue_members(s, d):
    return _queues(s, d)[1]


def queue_score(s, d):
    w, q = _queues(s, d)
    return queues.queue_scores(q, w).select("queue", "n_windows", F.round(F.log(10.0, "score"), 6).alias("log_score"))


def queue_windows(s, d):
    w, q = _queues(s, d)
    return queues.flag_windows(q, queues.queue_scores(q, w), 1e6)


def _edges(s, d):
    """All events as graphs of four hours, users and objects in one id space."""
    return m.folded(s, d, m.slotted(s, d)).select("tw", "src", "dst", "t", "event_id", "loss")


TW = ["tw"]
MESH = m.SL + f", sp AS (SELECT tw, src, {m.FOLD} AS dst, t, event_id, loss FROM sl)"


def _pois(s, d):
    """Destinations of events with a loss over 150."""
    return _edges(s, d).filter("loss > 150").select("tw", F.col("dst").alias("poi")).distinct()


def _loud(s, d):
    """Sources of events with a loss over 150."""
    return _edges(s, d).filter("loss > 150").select("tw", F.col("src").alias("node")).distinct()


def points_of_interest(s, d):
    r = m.results(s, d).withColumn("tw", F.col("node") % 5)
    return trace.points_of_interest(r).select("tw", F.array_join("pois", ",").alias("pois"))


def n_hop(s, d):
    return trace.n_hop(_edges(s, d), TW, _pois(s, d), 2)


def ancestors(s, d):
    return trace.ancestors(_edges(s, d), TW, _pois(s, d))


def descendants(s, d):
    return trace.descendants(_edges(s, d), TW, _pois(s, d))


def entry_components(s, d):
    return trace.entry_components(_edges(s, d), TW, _pois(s, d)).groupBy("tw", "poi", "entry").agg(F.count("*").alias("n_nodes"))


def exit_components(s, d):
    return trace.exit_components(_edges(s, d), TW, _loud(s, d).withColumnRenamed("node", "poi")).groupBy("tw", "poi", "exit").agg(F.count("*").alias("n_nodes"))


def shortest_paths(s, d):
    return trace.shortest_paths(_edges(s, d), TW, _loud(s, d)).select("tw", "src", "dst", "hops", F.array_join("path", ">").alias("path"))


def time_respecting(s, d):
    start = _edges(s, d).filter("loss > 150").groupBy("tw", F.col("src").alias("poi")).agg((F.min("t") - 1).alias("t"))
    return trace.time_respecting(_edges(s, d), TW, start, True)


def time_respecting_back(s, d):
    start = _edges(s, d).filter("loss > 150").groupBy("tw", F.col("dst").alias("poi")).agg((F.max("t") + 1).alias("t"))
    return trace.time_respecting(_edges(s, d), TW, start, False)


def degree_ratio(s, d):
    return trace.degree_ratio(_edges(s, d), TW).select("tw", "node", F.round("ratio", 6).alias("ratio"))


def best_entry(s, d):
    e = _edges(s, d)
    losses = e.groupBy("tw", F.col("src").alias("node")).agg(F.max("loss").alias("loss"))
    scores = trace.combined_scores(trace.degree_ratio(e, TW), losses, TW)
    return trace.best_entries(trace.entry_components(e, TW, _pois(s, d)), scores, TW, 6)


def induced_subgraph(s, d):
    return trace.induced(_edges(s, d), trace.n_hop(_edges(s, d), TW, _pois(s, d), 1).select("tw", "node"), TW).select("tw", "event_id")


def attack_subgraph(s, d):
    e = _edges(s, d).withColumn("op", F.lit("x"))
    labels = e.select("tw", F.col("src").alias("node")).unionByName(e.select("tw", F.col("dst").alias("node"))).distinct().select("tw", "node", (F.col("node") % 11).cast("string").alias("path"), F.lit("subject").alias("node_type"), (F.col("node") % 37 == 1).cast("long").alias("y_true"))
    return trace.attack_subgraph(e, TW, _pois(s, d).withColumnRenamed("poi", "node"), labels, 1)


def poi_stats(s, d):
    up = trace.ancestors(_edges(s, d), TW, _pois(s, d))
    return detect.tracing_counts(up, m.bad_nodes(s, d).select("node"))


def _traced(s, d):
    e = _test(s, d)
    r = detect.window_scores(e.select("tw", F.col("src").alias("node"), "loss"), detect.thresholds(_val(s, d)), "max_val_loss", ["tw", "node"])
    bad = m.bad_nodes(s, d).select("node").distinct().withColumn("y_true", F.lit(1))
    r = r.join(bad, "node", "left").fillna(0, ["y_true"])
    kept = trace.n_hop(_edges(s, d), TW, _pois(s, d), 1).select("tw", "node")
    return detect.traced_results(r, kept)


def triage_confusion(s, d):
    return detect.confusion(_traced(s, d))


def triage_nodes(s, d):
    return detect.traced_nodes(_traced(s, d)).select("node", F.round("score", 6).alias("score"), "y_true", "y_hat")


def best_epoch_mcc(s, d):
    stats = m.events(s, d).withColumn("epoch", F.dayofmonth(F.col("day").cast("date"))).groupBy("epoch").agg(F.round(F.count("*") / 10).alias("mcc"))
    return detect.best_by(stats, "mcc")


def fused_nodes(s, d):
    r = m.results(s, d).select((F.col("node") % 11).cast("string").alias("path"), F.lit("subject").alias("node_type"), "y_true", "score", F.col("node").alias("first_t"), F.col("node").alias("last_t"))
    return trace.fused_nodes(r)


def run_mean_std(s, d):
    runs = m.events(s, d).groupBy("day").agg(F.avg("loss").alias("adp"), F.count("*").alias("discrim"))
    out = runner.run_statistics(runs, ["adp", "discrim"])
    return out.select("metric", *[F.round(c, 4).alias(c) for c in ("mean", "std", "rel_std", "least", "greatest")])


def best_epoch(s, d):
    stats = m.events(s, d).withColumn("epoch", F.dayofmonth(F.col("day").cast("date"))).groupBy("epoch").agg(F.round(F.count("*") / 10).alias("adp"), F.max("loss").alias("discrim"))
    return detect.best_epoch(stats)


def stream_daily(s, d):
    """The streaming twin of daily windows, run to the end of its input."""
    schema = table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    e = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), F.col("value").alias("loss"))
    name = f"stream_daily_{uuid.uuid4().hex}"
    return streams.run_once(streams.daily_counts(e), name, f"{shared_root(s)}/{name}", "complete").select(F.col("day").cast("string").alias("day"), "op", "n", F.round("loss", 4).alias("loss"))


_TE = m.SL + ", va AS (SELECT * FROM ev WHERE day > '2024-01-15' AND day <= '2024-01-20'), te AS (SELECT * FROM sl WHERE day > '2024-01-20'), en AS (SELECT tw, src AS node, loss FROM te UNION ALL SELECT tw, dst, loss FROM te)"
_TOUCH = "to_ AS (SELECT attack_id, node, t FROM (SELECT t, src AS node FROM ev UNION ALL SELECT t, dst FROM ev) e JOIN bad USING (node) JOIN atk USING (attack_id) WHERE t BETWEEN start_ns AND end_ns)"
_AREA = ", b AS (SELECT precision, max(percent) AS percent FROM pts GROUP BY precision), l AS (SELECT *, lag(precision) OVER (ORDER BY precision) AS p0, lag(percent) OVER (ORDER BY precision) AS q0 FROM b) SELECT round(coalesce(sum((precision - p0) * (percent + q0) / 2), 0.0) / 100, 6) AS area FROM l"
_DIS = ", sc AS (SELECT res.*, score / ((SELECT max(score) FROM res) + 1e-6) AS s FROM res), be AS (SELECT avg(s) AS b FROM (SELECT s FROM sc WHERE y_true = 0 ORDER BY s DESC, node LIMIT 10))"
_RARE = m.SL + """, al AS (SELECT DISTINCT day, tw, node FROM (SELECT day, tw, src AS node FROM sl UNION ALL SELECT day, tw, dst FROM sl)),
te AS (SELECT * FROM sl WHERE day > '2024-01-20'), od AS (SELECT te.* FROM te JOIN (SELECT tw, avg(loss) + 2 * stddev_pop(loss) AS th FROM te GROUP BY tw) x USING (tw) WHERE loss > th),
me AS (SELECT tw, src AS node FROM od UNION SELECT tw, dst FROM od), nt AS (SELECT count(DISTINCT tw) AS n FROM te), nr AS (SELECT count(DISTINCT tw) AS n FROM sl WHERE day <= '2024-01-15'),
it AS (SELECT node, ln((SELECT n FROM nt) / (count(DISTINCT tw) + 1.0)) AS idf FROM al WHERE day > '2024-01-20' GROUP BY node), ir AS (SELECT node, ln((SELECT n FROM nr) / (count(DISTINCT tw) + 1.0)) AS idf FROM al WHERE day <= '2024-01-15' GROUP BY node),
ra AS (SELECT tw, node FROM me LEFT JOIN it USING (node) LEFT JOIN ir USING (node) WHERE coalesce(it.idf, ln((SELECT n FROM nt))) + coalesce(ir.idf, ln((SELECT n FROM nr))) > 2),
rl AS (SELECT a.tw AS tw_a, b.tw AS tw_b, count(*) AS n_shared FROM ra a JOIN ra b ON a.node = b.node AND a.tw < b.tw GROUP BY ALL)"""
_QUEUE = _RARE + """, wl AS (SELECT tw, row_number() OVER (ORDER BY tw) AS i FROM (SELECT DISTINCT tw FROM od)), er AS (SELECT i, wl.tw, coalesce((SELECT list(tw_a) FROM rl WHERE tw_b = wl.tw), []) AS earlier FROM wl),
qf AS (SELECT 0 AS i, CAST([] AS STRUCT(tw BIGINT, queue BIGINT)[]) AS held, CAST(0 AS BIGINT) AS n UNION ALL
  SELECT i, list_append(held, {'tw': tw, 'queue': coalesce(q, n)}), n + CAST(q IS NULL AS BIGINT) FROM (SELECT er.i, er.tw, held, n, list_min(list_transform(list_filter(held, lambda x: list_contains(earlier, x.tw)), lambda x: x.queue)) AS q FROM qf JOIN er ON er.i = qf.i + 1)),
qm AS (SELECT h.tw, h.queue FROM (SELECT unnest(held) AS h FROM qf WHERE i = (SELECT max(i) FROM qf)))"""
_PO = ", po AS (SELECT DISTINCT tw, dst AS poi FROM sp WHERE loss > 150), lo AS (SELECT DISTINCT tw, src AS node FROM sp WHERE loss > 150)"
_REV = _PO + ", rv AS (SELECT DISTINCT tw, dst AS src, src AS dst FROM sp), up AS (SELECT po.tw, poi, rv.dst AS node FROM po JOIN rv ON rv.tw = po.tw AND rv.src = poi UNION SELECT up.tw, up.poi, rv.dst FROM up JOIN rv ON rv.tw = up.tw AND rv.src = up.node)"
_FWD = _PO + ", fw AS (SELECT DISTINCT tw, src, dst FROM sp), dn AS (SELECT lo.tw, lo.node AS poi, fw.dst AS node FROM lo JOIN fw ON fw.tw = lo.tw AND fw.src = lo.node UNION SELECT dn.tw, dn.poi, fw.dst FROM dn JOIN fw ON fw.tw = dn.tw AND fw.src = dn.node)"
_HOP = _PO + ", un AS (SELECT tw, src, dst FROM sp UNION SELECT tw, dst, src FROM sp), h1 AS (SELECT tw, poi AS node FROM po UNION SELECT po.tw, dst FROM po JOIN un ON un.tw = po.tw AND un.src = poi)"
_NL = _TE + ", nl AS (SELECT tw, src AS node, loss, loss / 60 AS threatrace, loss / 200 AS flash, loss * loss / 1000 AS magic, event_id % 3 <> 0 AS ok FROM te), wi AS (SELECT tw, min(t) AS start_t, max(t) AS end_t FROM te GROUP BY tw)"


def _level(score: str, threshold: str, ok: str) -> str:
    return f"""WITH {_NL}, h AS (SELECT node, max({score}) AS score, arg_max(tw, ({score}, -tw)) FILTER ({score} > {threshold} AND {ok}) AS best, CAST(count(*) FILTER ({score} > {threshold} AND {ok}) > 0 AS INT) AS y_hat, arg_max(tw, (loss, -tw)) AS w, max(loss) AS m FROM nl GROUP BY node)
SELECT node, round(score, 6) AS score, y_hat, CASE WHEN m > 0 THEN w ELSE -1 END AS tw_with_max_loss, tw AS detected_tw, start_t, end_t FROM (SELECT *, coalesce(best, CASE WHEN m > 0 THEN w END) AS tw FROM h) LEFT JOIN wi USING (tw)"""


_TR = _TE + f", sp AS (SELECT tw, src, {m.FOLD} AS dst, t, event_id, loss FROM sl)" + _HOP + f", {m.AT}, {m.BAD}, r AS (SELECT tw, src AS node, max(loss) AS score FROM te GROUP BY ALL), tr AS (SELECT r.*, CAST(r.node IN (SELECT node FROM bad) AS INT) AS y_true, CAST(EXISTS (SELECT 1 FROM h1 WHERE h1.tw = r.tw AND h1.node = r.node) AS INT) AS y_hat FROM r)"
_ENT = _REV + """, et AS (SELECT tw, poi, node AS entry FROM up WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.tw = up.tw AND sp.dst = up.node)),
dn AS (SELECT DISTINCT et.tw, entry, sp.dst AS node FROM et JOIN sp ON sp.tw = et.tw AND sp.src = entry UNION SELECT dn.tw, dn.entry, sp.dst FROM dn JOIN sp ON sp.tw = dn.tw AND sp.src = dn.node),
cm AS (SELECT et.tw, et.poi, et.entry, dn.node FROM et JOIN dn USING (tw, entry) JOIN up ON up.tw = et.tw AND up.poi = et.poi AND up.node = dn.node UNION SELECT tw, poi, entry, entry FROM et UNION SELECT tw, poi, entry, poi FROM et)"""
_EXT = _FWD + """, ex AS (SELECT tw, poi, node AS exit FROM dn WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.tw = dn.tw AND sp.src = dn.node)),
bk AS (SELECT DISTINCT ex.tw, exit, sp.src AS node FROM ex JOIN sp ON sp.tw = ex.tw AND sp.dst = exit UNION SELECT bk.tw, bk.exit, sp.src FROM bk JOIN sp ON sp.tw = bk.tw AND sp.dst = bk.node),
cm AS (SELECT ex.tw, ex.poi, ex.exit, bk.node FROM ex JOIN bk USING (tw, exit) JOIN dn ON dn.tw = ex.tw AND dn.poi = ex.poi AND dn.node = bk.node UNION SELECT tw, poi, exit, exit FROM ex UNION SELECT tw, poi, exit, poi FROM ex)"""
_DEG = ", dg AS (SELECT tw, node, CASE WHEN sum(i) > 0 THEN CAST(sum(o) AS DOUBLE) / sum(i) ELSE 0.0 END AS ratio FROM (SELECT tw, src AS node, 1 AS o, 0 AS i FROM sp UNION ALL SELECT tw, dst, 0, 1 FROM sp) GROUP BY ALL)"

_CONF = """k AS (SELECT *, tp / (tp + fp + 1e-12) AS p, tp / (tp + fn + 1e-12) AS r, fp / (fp + tn + 1e-12) AS f FROM c)
SELECT tp, fp, tn, fn, round(p, 5) AS precision, round(r, 5) AS recall, round(f, 5) AS fpr, round(2 * p * r / (p + r + 1e-12), 5) AS fscore, round((tp + tn) / (tp + tn + fp + fn + 1e-12), 5) AS accuracy, round((r + tn / (tn + fp + 1e-12)) / 2, 5) AS balanced_acc,
round(r / (f + 1e-12), 5) AS lr_plus, round(tp * tn / (fp * fn + 1e-12), 5) AS dor, round((tp * tn - fp * fn) / (sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-12), 5) AS mcc FROM k"""

ORACLES = {
    "thresholds": f"WITH {_TE} SELECT max(loss) AS max_val_loss, round(avg(loss), 6) AS mean_val_loss, round(quantile_cont(loss, 0.9), 6) AS nodlink, 1.5::DOUBLE AS threatrace, 0.53::DOUBLE AS flash FROM va",
    "node_scores": f"WITH {_TE} SELECT node, round(avg(loss), 6) AS score, CAST(avg(loss) > (SELECT avg(loss) FROM va) AS INT) AS y_hat, CASE WHEN max(loss) > 0 THEN arg_max(tw, (loss, -tw)) ELSE -1 END AS tw_with_max_loss FROM en GROUP BY node",
    "tw_scores": f"WITH {_TE} SELECT tw, max(loss) AS score, CAST(max(loss) > (SELECT max(loss) FROM va) AS INT) AS y_hat FROM te GROUP BY tw",
    "node_tw_scores": f"WITH {_TE} SELECT tw, node, round(max(loss), 6) AS score, CAST(max(loss) > (SELECT quantile_cont(loss, 0.9) FROM va) AS INT) AS y_hat FROM en GROUP BY ALL",
    "edge_predictions": f"WITH {_TE} SELECT event_id, CAST(op = 'error' AND loss > 40 AS INT) AS y_true, CAST(loss > (SELECT avg(loss) FROM va) AS INT) AS y_hat FROM te",
    "edge_labels_4modes": f"WITH {m.EV}, {m.AT}, {m.BAD}, x AS (SELECT event_id, src IN (SELECT node FROM bad) AS a, {m.FOLD} IN (SELECT node FROM bad) AS b FROM ev) " + " UNION ALL ".join(f"SELECT '{n}' AS mode, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM x WHERE {c}" for n, c in (("src_node", "a"), ("dst_node", "b"), ("both_nodes", "a AND b"), ("either_node", "a OR b"))),
    "malicious_times": f"WITH {m.EV}, {m.AT}, {m.BAD}, {_TOUCH} SELECT attack_id, node, count(*) AS n, min(t) AS first_t FROM to_ GROUP BY ALL",
    "tw_labels_rangejoin": f"WITH RECURSIVE {m.AD}, {m.AT}, {m.BAD}, {_TOUCH}, w AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) * 1000 + tw AS tw, tw_start, tw_end FROM ad) SELECT CAST(tw AS BIGINT) AS tw, node, count(*) AS n FROM w JOIN to_ ON t > tw_start AND t < tw_end GROUP BY ALL",
    "confusion_metrics": f"""WITH {m.RES}, c AS (SELECT count(*) FILTER (y_true = 1 AND y_hat = 1) AS tp, count(*) FILTER (y_true = 0 AND y_hat = 1) AS fp, count(*) FILTER (y_true = 0 AND y_hat = 0) AS tn, count(*) FILTER (y_true = 1 AND y_hat = 0) AS fn FROM res),
{_CONF}""",
    "auc_ap": f"WITH {m.RES}, g AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM res GROUP BY score), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)), z AS (SELECT sum(y_true) AS p, sum(1 - y_true) AS n FROM res) SELECT round(CAST(sum(neg * (tp - pos / 2)) AS DOUBLE) / any_value(p * n), 6) AS auc, round(sum(pos / p * tp / (tp + fp)), 6) AS ap FROM r, z",
    "pr_curve": f"WITH {m.RES}, g AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM res GROUP BY score), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / (SELECT sum(y_true) FROM res), 6) AS recall FROM r",
    "adp": f"WITH {m.RES}, pts AS (SELECT tps / rank AS precision, found / n_attacks * 100 AS percent FROM fd UNION ALL SELECT 0.0, 0.0){_AREA}",
    "recall_over_precision": f"WITH {m.RES}, pts AS (SELECT tps / rank AS precision, tps / (SELECT sum(y_true) FROM res) * 100 AS percent FROM rk UNION ALL SELECT 0.0, 0.0){_AREA}",
    "discrimination": f"WITH {m.RES}{_DIS} SELECT round(avg(g), 6) AS discrim_score, (SELECT count(DISTINCT node) FROM sc JOIN bad USING (node), be WHERE s > b) AS discrim_tp FROM (SELECT attack_id, max(s) - any_value(b) AS g FROM sc JOIN bad USING (node), be GROUP BY attack_id)",
    "discrimination_area": f"WITH {m.RES}, k AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY score DESC, node) AS r FROM res), g AS (SELECT a.r, a.score - b.score AS gap FROM k a JOIN k b ON a.r = b.r WHERE a.y_true = 1 AND b.y_true = 0 AND a.r <= 10), s AS (SELECT (gap + lag(gap) OVER (ORDER BY r)) / 2 AS slab FROM g) SELECT round(coalesce(sum(slab), 0.0) / greatest(count(*) - 1, 1) / ((SELECT max(score) FROM res) + 1e-6), 6) AS area FROM s",
    "tps_before_first_fp": f"WITH {m.RES}, x AS (SELECT node, y_true, sum(1 - y_true) OVER (ORDER BY CASE WHEN node = 38 THEN 1e6 ELSE score END DESC, node ROWS UNBOUNDED PRECEDING) AS fps FROM res) SELECT attack_id, count(*) AS n_nodes FROM x JOIN bad USING (node) WHERE fps = 0 AND y_true = 1 GROUP BY attack_id",
    "fps_until_all_attacks": f"WITH {m.RES} SELECT CAST(coalesce(sum(1 - y_true), 0) AS BIGINT) AS fps, CAST(coalesce(sum(y_true), 0) AS BIGINT) AS tps FROM fd WHERE found < n_attacks",
    "attacks_detected": f"WITH {m.RES} SELECT attack_id, CAST(coalesce(sum(y_hat), 0) AS BIGINT) AS tps FROM bad LEFT JOIN res USING (node) GROUP BY attack_id",
    "kmeans_topk": f"WITH {m.RES}, t AS (SELECT node, score FROM res ORDER BY score DESC, node LIMIT 30), o AS (SELECT *, row_number() OVER w AS i, sum(score) OVER w AS s1, sum(score) OVER () AS s, count(*) OVER () AS n FROM t WINDOW w AS (ORDER BY score, node DESC ROWS UNBOUNDED PRECEDING)), c AS (SELECT i FROM o WHERE i < n ORDER BY round(s1 * s1 / i + (s - s1) * (s - s1) / (n - i), 9) DESC, i LIMIT 1) SELECT res.node, res.score, CAST(coalesce(o.i > (SELECT i FROM c), false) AS INT) AS y_hat FROM res LEFT JOIN o USING (node)",
    "fp_in_malicious_windows": f"WITH {_TE}, {m.AT}, {m.BAD}, ns AS (SELECT src AS node, CAST(avg(loss) > (SELECT avg(loss) FROM va) AS INT) AS y_hat, arg_max(tw, (loss, -tw)) AS w FROM te GROUP BY src), la AS (SELECT DISTINCT tw FROM te WHERE src IN (SELECT node FROM bad) AND op = 'purchase' AND loss > 60) SELECT count(*) AS n_fp, round(coalesce(avg(CASE WHEN w IN (SELECT tw FROM la) THEN 1.0 ELSE 0.0 END), 0.0), 6) AS share FROM ns WHERE y_hat = 1 AND node NOT IN (SELECT node FROM bad)",
    "dor_recall_sweep": f"""WITH {m.RES}, sp AS (SELECT min(score) AS lo, max(score) AS hi FROM res), b AS (SELECT y_true, least(49, ceil(round((score - lo) / ((hi - lo) / 49), 9)) - 1) AS bin FROM res, sp), g AS (SELECT unnest(range(50)) AS bin),
k AS (SELECT g.bin, count(*) FILTER (y_true = 1 AND b.bin >= g.bin) AS tp, count(*) FILTER (y_true = 0 AND b.bin >= g.bin) AS fp, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM g, b GROUP BY g.bin)
SELECT bin, round(lo + bin * ((hi - lo) / 49), 6) AS threshold, round(tp / p, 6) AS recall, round(tp * (n - fp) / (fp * (p - tp) + 1e-12), 6) AS dor FROM k, sp""",
    "node_idf": f"WITH {m.SL}, e AS (SELECT DISTINCT tw, node FROM (SELECT tw, src AS node FROM sl UNION ALL SELECT tw, dst FROM sl)) SELECT node, count(*) AS df, round(ln((SELECT count(DISTINCT tw) FROM sl) / (count(*) + 1.0)), 9) AS idf FROM e GROUP BY node",
    "anomalous_edges_sigma": f"WITH {m.SL} SELECT tw, event_id FROM sl JOIN (SELECT tw, avg(loss) + 1.5 * stddev_pop(loss) AS th FROM sl GROUP BY tw) USING (tw) WHERE loss > th",
    "anomalous_windows": f"WITH {m.SL}, o AS (SELECT sl.* FROM sl JOIN (SELECT tw, avg(loss) + 3.0 * stddev_pop(loss) AS th FROM sl GROUP BY tw) USING (tw) WHERE loss > th), n AS (SELECT tw, count(*) AS n_nodes FROM (SELECT tw, src AS x FROM o UNION SELECT tw, dst FROM o) GROUP BY tw) SELECT tw, count(*) AS n, round(avg(loss), 6) AS mean_loss, any_value(n_nodes) AS n_nodes FROM o JOIN n USING (tw) GROUP BY tw",
    "over_validation": f"WITH {_TE} SELECT event_id FROM te WHERE loss > (SELECT max(loss) FROM va)",
    "window_relatedness": f"WITH {_RARE} SELECT * FROM rl",
    "queue_members": f"WITH RECURSIVE {_QUEUE} SELECT tw, queue FROM qm",
    "queue_score": f"WITH RECURSIVE {_QUEUE}, ws AS (SELECT tw, avg(loss) AS mean_loss FROM od GROUP BY tw) SELECT queue, count(*) AS n_windows, round(log10(exp(sum(ln(mean_loss + 1)))), 6) AS log_score FROM qm JOIN ws USING (tw) GROUP BY queue",
    "queue_windows": f"WITH RECURSIVE {_QUEUE}, ws AS (SELECT tw, avg(loss) AS mean_loss FROM od GROUP BY tw), sc AS (SELECT queue, exp(sum(ln(mean_loss + 1))) AS score FROM qm JOIN ws USING (tw) GROUP BY queue) SELECT tw, CAST(score > 1e6 AS INT) AS y_hat FROM qm JOIN sc USING (queue)",
    "points_of_interest": f"WITH {m.RES} SELECT node % 5 AS tw, string_agg(node, ',' ORDER BY node) AS pois FROM res WHERE y_hat = 1 GROUP BY 1",
    "n_hop": f"WITH {MESH}{_PO}, un AS (SELECT tw, src, dst FROM sp UNION SELECT tw, dst, src FROM sp), h AS (SELECT tw, poi, poi AS node, 0 AS hops FROM po UNION ALL SELECT po.tw, poi, dst, 1 FROM po JOIN un ON un.tw = po.tw AND un.src = poi UNION ALL SELECT po.tw, poi, b.dst, 2 FROM po JOIN un a ON a.tw = po.tw AND a.src = poi JOIN un b ON b.tw = a.tw AND b.src = a.dst) SELECT tw, poi, node, min(hops) AS hops FROM h GROUP BY tw, poi, node",
    "ancestors": f"WITH RECURSIVE {MESH}{_REV} SELECT * FROM up",
    "descendants": f"WITH RECURSIVE {MESH}{_PO}, dn AS (SELECT po.tw, poi, sp.dst AS node FROM po JOIN sp ON sp.tw = po.tw AND sp.src = poi UNION SELECT dn.tw, dn.poi, sp.dst FROM dn JOIN sp ON sp.tw = dn.tw AND sp.src = dn.node) SELECT * FROM dn",
    "entry_components": f"WITH RECURSIVE {MESH}{_ENT} SELECT tw, poi, entry, count(*) AS n_nodes FROM cm GROUP BY ALL",
    "exit_components": f"WITH RECURSIVE {MESH}{_EXT} SELECT tw, poi, exit, count(*) AS n_nodes FROM cm GROUP BY ALL",
    "kmeans_windows": f"""WITH {_TE}, sc AS (SELECT tw, src AS node, avg(loss) AS score FROM te GROUP BY ALL), th AS (SELECT max(loss) * 0.8 AS t FROM ev WHERE day > '2024-01-15' AND day <= '2024-01-20'),
tp AS (SELECT *, row_number() OVER (PARTITION BY tw ORDER BY score DESC, node) AS r FROM sc WHERE tw IN (SELECT tw FROM sc, th WHERE score > t) QUALIFY r <= 10),
ru AS (SELECT tw, node, count(*) OVER w AS i, sum(score) OVER w AS s1, count(*) OVER (PARTITION BY tw) AS n, sum(score) OVER (PARTITION BY tw) AS s FROM tp WINDOW w AS (PARTITION BY tw ORDER BY r DESC ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT tw, i AS cut FROM ru WHERE n > i QUALIFY row_number() OVER (PARTITION BY tw ORDER BY round(s1 * s1 / i + (s - s1) * (s - s1) / (n - i), 9) DESC, i) = 1)
SELECT tw, node, round(score, 6) AS score, CAST(EXISTS (SELECT 1 FROM ru JOIN cu ON cu.tw = ru.tw WHERE ru.tw = sc.tw AND ru.node = sc.node AND i > cut) AS INT) AS y_hat FROM sc""",
    "shortest_paths": f"WITH RECURSIVE {MESH}{_PO}, e AS (SELECT DISTINCT tw, src, dst FROM sp WHERE src <> dst), b AS (SELECT tw, node AS src, node AS dst, 0 AS hops, [node] AS path FROM lo UNION ALL SELECT b.tw, b.src, e.dst, hops + 1, list_append(path, e.dst) FROM b JOIN e ON e.tw = b.tw AND e.src = b.dst WHERE NOT list_contains(path, e.dst)), r AS (SELECT *, row_number() OVER (PARTITION BY tw, src, dst ORDER BY hops, path) AS k FROM b) SELECT tw, src, dst, hops, array_to_string(path, '>') AS path FROM r WHERE k = 1",
    "time_respecting": f"WITH RECURSIVE {MESH}, b AS (SELECT tw, src AS poi, src AS node, min(t) - 1 AS t FROM sp WHERE loss > 150 GROUP BY tw, src UNION SELECT b.tw, poi, sp.dst, sp.t FROM b JOIN sp ON sp.tw = b.tw AND sp.src = b.node AND sp.t > b.t) SELECT tw, poi, node, min(t) AS t FROM b GROUP BY ALL",
    "time_respecting_back": f"WITH RECURSIVE {MESH}, b AS (SELECT tw, dst AS poi, dst AS node, max(t) + 1 AS t FROM sp WHERE loss > 150 GROUP BY tw, dst UNION SELECT b.tw, poi, sp.src, sp.t FROM b JOIN sp ON sp.tw = b.tw AND sp.dst = b.node AND sp.t < b.t) SELECT tw, poi, node, max(t) AS t FROM b GROUP BY ALL",
    "degree_ratio": f"WITH {MESH}{_DEG} SELECT tw, node, round(ratio, 6) AS ratio FROM dg",
    "best_entry": f"""WITH RECURSIVE {MESH}{_ENT}{_DEG}, ls AS (SELECT tw, src AS node, max(loss) AS loss FROM sp GROUP BY ALL), j AS (SELECT tw, node, ratio, coalesce(loss, 0.0) AS loss FROM dg LEFT JOIN ls USING (tw, node)),
sc AS (SELECT tw, node, CASE WHEN max(ratio) OVER w > min(ratio) OVER w THEN (ratio - min(ratio) OVER w) / (max(ratio) OVER w - min(ratio) OVER w) ELSE 0 END + CASE WHEN max(loss) OVER w > min(loss) OVER w THEN (loss - min(loss) OVER w) / (max(loss) OVER w - min(loss) OVER w) ELSE 0 END AS score FROM j WINDOW w AS (PARTITION BY tw)),
av AS (SELECT tw, poi, entry, round(avg(score), 6) AS score FROM cm JOIN sc USING (tw, node) GROUP BY ALL) SELECT tw, poi, entry, score FROM (SELECT *, rank() OVER (PARTITION BY tw, poi ORDER BY score DESC) AS r FROM av) WHERE r = 1""",
    "induced_subgraph": f"WITH {MESH}{_HOP} SELECT tw, event_id FROM sp WHERE EXISTS (SELECT 1 FROM h1 WHERE h1.tw = sp.tw AND h1.node = sp.src) AND EXISTS (SELECT 1 FROM h1 WHERE h1.tw = sp.tw AND h1.node = sp.dst)",
    "attack_subgraph": f"""WITH {MESH}{_HOP}, i AS (SELECT sp.* FROM sp WHERE EXISTS (SELECT 1 FROM h1 WHERE h1.tw = sp.tw AND h1.node = sp.src) AND EXISTS (SELECT 1 FROM h1 WHERE h1.tw = sp.tw AND h1.node = sp.dst)),
en AS (SELECT tw, src AS node, t, loss FROM i UNION ALL SELECT tw, dst, t, loss FROM i) SELECT tw, CAST(node % 11 AS VARCHAR) AS path, 'subject' AS node_type, CAST(max(CAST(node % 37 = 1 AS INT)) AS BIGINT) AS y_true, max(loss) AS score, min(t) AS first_t, max(t) AS last_t, count(DISTINCT node) AS n_nodes FROM en GROUP BY ALL""",
    "poi_stats": f"WITH RECURSIVE {MESH}, {m.AT}, {m.BAD}{_REV} SELECT tw, poi, CAST(poi IN (SELECT node FROM bad) AS INT) AS is_tp, count(*) FILTER (node IN (SELECT node FROM bad)) AS tps, count(*) FILTER (node NOT IN (SELECT node FROM bad)) AS fps FROM up GROUP BY tw, poi",
    "triage_confusion": f"""WITH {_TR}, c AS (SELECT count(*) FILTER (y_true = 1 AND y_hat = 1) AS tp, count(*) FILTER (y_true = 0 AND y_hat = 1) AS fp, count(*) FILTER (y_true = 0 AND y_hat = 0) AS tn, count(*) FILTER (y_true = 1 AND y_hat = 0) AS fn FROM tr), {_CONF}""",
    "triage_nodes": f"WITH {_TR} SELECT node, round(arg_max(score, tw), 6) AS score, arg_max(y_true, tw) AS y_true, arg_max(y_hat, tw) AS y_hat FROM tr GROUP BY node",
    "best_epoch_mcc": f"WITH {m.EV}, r AS (SELECT CAST(day[9:10] AS INT) AS epoch, round(count(*) / 10) AS mcc FROM ev GROUP BY 1) SELECT * FROM r ORDER BY mcc DESC, epoch LIMIT 1",
    "node_scores_seen": f"WITH {_TE} SELECT src AS node, max(loss) AS score, CAST(src IN (SELECT src FROM ev WHERE day <= '2024-01-15' UNION SELECT dst FROM ev WHERE day <= '2024-01-15') AS INT) AS is_seen FROM te GROUP BY src",
    "node_level_threatrace": _level("threatrace", "1.5", "ok"),
    "node_level_flash": _level("flash", "0.53", "ok"),
    "node_level_magic": _level("magic", "(SELECT avg(loss * loss / 1000) FROM va)", "true"),
    "node_level_loss": f"WITH {_NL}, h AS (SELECT node, avg(loss) AS score, CASE WHEN max(loss) > 0 THEN arg_max(tw, (loss, -tw)) END AS tw FROM nl GROUP BY node) SELECT node, round(score, 6) AS score, CAST(score > (SELECT avg(loss) FROM va) AS INT) AS y_hat, coalesce(tw, -1) AS tw_with_max_loss, tw AS detected_tw, start_t, end_t FROM h LEFT JOIN wi USING (tw)",
    "results_by_window": f"WITH {m.RES}, w AS (SELECT DISTINCT t // 14400000000000 AS tw, src AS node FROM ev WHERE day > '2024-01-20') SELECT tw, node, score, CAST(y_true AS BIGINT) AS y_true, CAST(y_hat AS BIGINT) AS y_hat FROM w JOIN res USING (node)",
    "attacks_of_nodes": f"WITH {m.EV}, {m.AT}, {m.BAD} SELECT node, string_agg(attack_id, ',' ORDER BY attack_id) AS attacks FROM bad GROUP BY node",
    "window_relatedness_earlier": f"""WITH {m.SL}, al AS (SELECT DISTINCT tw, node FROM (SELECT tw, src AS node FROM sl UNION ALL SELECT tw, dst FROM sl)), n AS (SELECT count(DISTINCT tw) AS n FROM sl), df AS (SELECT node, ln((SELECT n FROM n) / (count(*) + 1.0)) AS idf FROM al GROUP BY node),
od AS (SELECT sl.* FROM sl JOIN (SELECT tw, avg(loss) + 2 * stddev_pop(loss) AS th FROM sl GROUP BY tw) x USING (tw) WHERE loss > th), me AS (SELECT tw, src AS node FROM od UNION SELECT tw, dst FROM od), ra AS (SELECT tw, node FROM me JOIN df USING (node) WHERE idf > ln((SELECT n FROM n) * 0.06))
SELECT a.tw AS tw_a, b.tw AS tw_b, count(*) AS n_shared FROM ra a JOIN ra b ON a.node = b.node AND a.tw < b.tw GROUP BY ALL""",
    "fused_nodes": f"WITH {m.RES} SELECT CAST(node % 11 AS VARCHAR) AS path, 'subject' AS node_type, CAST(max(y_true) AS BIGINT) AS y_true, max(score) AS score, min(node) AS first_t, max(node) AS last_t, count(*) AS n_nodes FROM res GROUP BY 1",
    "run_mean_std": f"WITH {m.EV}, r AS (SELECT avg(loss) AS adp, CAST(count(*) AS DOUBLE) AS discrim FROM ev GROUP BY day), l AS (SELECT 'adp' AS metric, adp AS v FROM r UNION ALL SELECT 'discrim', discrim FROM r) SELECT metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(stddev_pop(v) / avg(v) * 100, 4) AS rel_std, round(min(v), 4) AS least, round(max(v), 4) AS greatest FROM l GROUP BY metric",
    "best_epoch": f"WITH {m.EV}, r AS (SELECT CAST(day[9:10] AS INT) AS epoch, round(count(*) / 10) AS adp, max(loss) AS discrim FROM ev GROUP BY 1) SELECT * FROM r ORDER BY adp DESC, discrim DESC, epoch LIMIT 1",
    "stream_daily": f"WITH {m.EV} SELECT day, op, count(*) AS n, round(sum(loss), 4) AS loss FROM ev GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in ORACLES}
