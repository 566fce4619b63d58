"""Queries on windows, graphs, batches and transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import batches, transform, windows

from . import model as m

DAY = ["day"]
TW = ["day", "tw"]


def tw_daily(s, d):
    return m.events(s, d).groupBy("day").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def tw_daily_eastern(s, d):
    return windows.daily(m.events(s, d).drop("day")).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


def tw_adaptive(s, d):
    return m.adaptive(s, d).groupBy("day", "tw", "tw_start", "tw_end").agg(F.count("*").alias("n"))


def edge_fusion(s, d):
    return windows.fuse_runs(m.adaptive(s, d), TW).select("day", "tw", "src", "dst", "op", "t", "event_id")


def window_multigraph(s, d):
    e = m.slotted(s, d)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("node_type", m.node_type(F.col("node")))
    return windows.multigraph(e, nodes).groupBy("tw", "src_type", "op", "dst_type", "y").agg(F.count("*").alias("n"))


def transform_chain(s, d):
    """Undirected, then without cycles of more than two nodes' pairs: each step takes what the one before gives."""
    out = transform.chain(_mesh(s, d), [lambda e: transform.undirected(e, SLOT), lambda e: e.filter("src < dst"), lambda e: transform.acyclic(e, SLOT)])
    return out.groupBy("tw").agg(F.count("*").alias("n"), F.sum("src").alias("sum_src"))


def tw_nodes(s, d):
    e = m.slotted(s, d)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("node_type", m.node_type(F.col("node")))
    return windows.window_nodes(e, ["tw"], nodes).groupBy("tw", "node_type").agg(F.count("*").alias("n_nodes"))


def first_edge_graph(s, d):
    return windows.first_edges(m.slotted(s, d), ["tw"])


def split_nodes(s, d):
    return windows.split_nodes(m.events(s, d), m.days(s, d)).groupBy("split").agg(F.count("*").alias("n_nodes"), F.sum("node").alias("sum_nodes"))


def used_nodes(s, d):
    customers = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("node"), "c_name")
    return windows.used_nodes(customers, windows.split_nodes(m.events(s, d), m.days(s, d)), ("train", "val"))


def window_node_degrees(s, d):
    e = windows.fuse_runs(m.adaptive(s, d), TW)
    return windows.degrees(e, TW).withColumn("node_type", m.node_type(F.col("node")))


def node_id_offsets(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("node"))
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"))
    u = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("node"))
    return windows.stack_sources([c, p, u])


def trial_cap(s, d):
    return windows.capped(m.events(s, d), DAY, 50).select("day", "event_id")


def range_scan(s, d):
    return m.events(s, d).filter((F.col("t") > 1704672000 * 10**9) & (F.col("t") < 1704758400 * 10**9)).select("t", "event_id", "src", "dst", "op")


def undirected(s, d):
    return transform.undirected(m.folded(s, d, m.slotted(s, d)).select("tw", "src", "dst", "op", "t"), ["tw"]).groupBy("tw", "src", "dst").agg(F.count("*").alias("n"))


SLOT = ["tw"]


def _mesh(s, d):
    """Users and objects in one id space, so that ways longer than one edge occur."""
    return m.folded(s, d, m.slotted(s, d)).select("day", "tw", "src", "dst", "t", "event_id", "op", "loss")


MESH = m.SL + f", me AS (SELECT day, tw, src, {m.FOLD} AS dst, t, event_id, op, loss FROM sl)"
REACH = ", re AS (SELECT DISTINCT tw, src, dst FROM me UNION SELECT re.tw, re.src, me.dst FROM re JOIN me ON me.tw = re.tw AND me.src = re.dst)"
ROOTS = ", ro AS (SELECT o.tw, o.node FROM (SELECT tw, src AS node, min(t) AS a FROM me GROUP BY ALL) o LEFT JOIN (SELECT tw, dst AS node, min(t) AS b FROM me GROUP BY ALL) i USING (tw, node) WHERE b IS NULL OR a < b)"
PSEUDO = ", ps AS (SELECT re.tw, re.src, re.dst FROM re JOIN ro ON ro.tw = re.tw AND ro.node = re.src WHERE re.src <> re.dst)"


def root_nodes(s, d):
    return transform.roots(_mesh(s, d), SLOT)


def pseudo_graph(s, d):
    return transform.pseudo_edges(_mesh(s, d), SLOT)


def prune_roots(s, d):
    e = _mesh(s, d)
    return transform.prune_roots(transform.pseudo_edges(e, SLOT), e, SLOT, 0.1)


def pseudo_merged(s, d):
    e = _mesh(s, d)
    return transform.merged_pseudo(e, transform.pseudo_edges(e, SLOT), SLOT)


def acyclic(s, d):
    return transform.acyclic(_mesh(s, d), SLOT)


def strong_components(s, d):
    c = transform.strong_components(_mesh(s, d), SLOT)
    own = c.groupBy("tw", "component").agg(F.count("*").alias("n_nodes"), F.min("node").alias("least"))
    return c.join(own.filter("n_nodes > 1"), ["tw", "component"]).select("tw", "node", "least", "n_nodes")


def versioned_dag(s, d):
    return transform.versioned(_mesh(s, d), DAY).select("day", "event_id", "src", "src_version", "dst", "dst_version", "bumped")


def version_edges(s, d):
    return transform.version_edges(transform.versioned(_mesh(s, d), DAY), DAY)


def latest_versions(s, d):
    return transform.latest_versions(transform.versioned(_mesh(s, d), DAY, self_loops=True), DAY)


def random_times(s, d):
    e = _mesh(s, d)
    span = e.groupBy("tw").agg(F.min("t").alias("low"), (F.max("t") + 1).alias("high"))
    return transform.random_times(transform.acyclic(e, SLOT), SLOT, span)


def _actors(e):
    """Users with purchases in training and in validation."""
    buys = e.filter("op = 'purchase'")
    return buys.filter("day <= '2024-01-15'").select(F.col("src").alias("actor")).intersect(buys.filter("day between '2024-01-16' and '2024-01-20'").select(F.col("src").alias("actor")))


def synthetic_attack(s, d):
    e = m.events(s, d)
    pairs = transform.unauthorised_pairs(e, _actors(e), e.select(F.col("dst").alias("target")).distinct(), 3)
    return transform.attack_events(pairs, 1705881600 * 10**9, 60 * 10**9)


def window_attacks(s, d):
    """Attacks of purchasing users in every graph of four hours; keys of half the files go, so that some are new to them."""
    e = m.slotted(s, d).filter("(dst + src) % 3 > 0 or dst % 2 = 1")
    ends = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    return transform.window_attacks(e, SLOT, ends.withColumn("node_type", m.node_type(F.col("node"))), _actors(e), 2)


def injected(s, d):
    e = m.events(s, d)
    made = synthetic_attack(s, d).withColumn("attack_id", (F.col("src") % 3).cast("int")).withColumn("day", F.lit("2024-01-22")).withColumn("loss", F.lit(0.0)).withColumn("event_id", -F.col("src") * 1000 - F.col("dst") % 1000)
    whole = m.attacks(s).withColumn("end_ns", F.col("end_ns") - 1)
    return windows.inject(e.withColumn("y", F.lit(0)), made, whole, "UTC").groupBy("day", "y").agg(F.count("*").alias("n"))


def mean_time_delta(s, d):
    return transform.time_gaps(m.slotted(s, d), ["tw"]).select("tw", F.round("mean_gap", 6).alias("mean_gap"), "first_t", "last_t")


def unauthorized_pairs(s, d):
    e = m.events(s, d)
    return transform.unauthorised_pairs(e, _actors(e), e.select(F.col("dst").alias("target")).distinct(), 3)


def batch_edges(s, d):
    return batches.by_edges(m.events(s, d), [], 256).groupBy("batch").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def batch_edges_in_graph(s, d):
    return batches.by_edges(m.events(s, d), DAY, 64).groupBy("day", "batch").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def batch_minutes(s, d):
    return batches.by_time(m.events(s, d), 30 * 60 * 10**9, 20 * 60 * 10**9, 1704067200 * 10**9).groupBy("batch").agg(F.count("*").alias("n"))


def batch_unique_pairs(s, d):
    return batches.by_unique_pairs(m.events(s, d), DAY).select("day", "event_id", "batch")


def last_k_neighbors(s, d):
    return batches.last_neighbours(batches.by_edges(m.events(s, d), [], 256), 5)


def last_k_current(s, d):
    return batches.last_neighbours(batches.by_edges(m.events(s, d), [], 256), 5, include_current=True)


def last_k_directed(s, d):
    return batches.last_neighbours(batches.by_edges(m.events(s, d), [], 256), 5, directed=True)


def last_k_two_hops(s, d):
    return batches.last_neighbours_hops(batches.by_edges(m.events(s, d), [], 256), 2, 2).groupBy("batch", "node", "hop").agg(F.count("neighbour").alias("n"), F.sum("neighbour").alias("sum"))


def batching_stage(s, d):
    e = batches.batched(m.slotted(s, d), {"by": ["tw"], "global": "edges", "size": 256, "inside": 32, "stack": 6})
    return e.groupBy("stack", "tw", "batch", "inner").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def node_means_overwritten(s, d):
    return batches.node_means_overwritten(m.slotted(s, d), ["tw"], "loss").select("tw", "node", F.round("mean_loss", 6).alias("mean_loss"))


def tw_labels_text(s, d):
    w = m.adaptive(s, d).select("day", "tw", "tw_start", "tw_end").distinct()
    return w.select("day", "tw", windows.window_label(F.col("tw_start"), F.col("tw_end"), "UTC").alias("label"))


def last_update(s, d):
    return batches.last_update(batches.by_edges(m.events(s, d), [], 256)).fillna(0, ["last_t"])


def inter_graph_offsets(s, d):
    e = m.slotted(s, d)
    ends = e.select("tw", F.col("src").alias("node")).unionByName(e.select("tw", F.col("dst").alias("node")))
    return batches.stacked(ends.groupBy("tw").agg(F.countDistinct("node").alias("n_nodes")), 6)


def reindex_nodes(s, d):
    return batches.reindexed(m.slotted(s, d), ["tw"])


def node_feature_means(s, d):
    return batches.node_means(m.slotted(s, d), ["tw"], "loss").select("tw", "node", F.round("mean_loss", 6).alias("mean_loss"), "n_edges")


def edges_distribution(s, d):
    from tracewell.functions.taxonomy import STREAM_OPS

    out = batches.op_distribution(m.slotted(s, d), ["tw"], STREAM_OPS)
    return out.select("tw", "node", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("tw", "node")])


def dataset_stats(s, d):
    out = batches.dataset_stats(m.slotted(s, d), m.days(s, d))
    return out.select("split", "n_graphs", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns if c not in ("split", "n_graphs")])


_ACY = MESH + ", en AS (SELECT DISTINCT tw, src, dst FROM me WHERE src <> dst), rr AS (SELECT * FROM en UNION SELECT rr.tw, rr.src, en.dst FROM rr JOIN en ON en.tw = rr.tw AND en.src = rr.dst), ac AS (SELECT * FROM en WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.tw = en.tw AND rr.src = en.dst AND rr.dst = en.src))"
_VE = MESH
_VX = """, x AS (SELECT day, t, event_id, src AS node, 0 AS role FROM e UNION ALL SELECT day, t, event_id, dst, 1 FROM e),
v AS (SELECT *, sum(role) OVER w - first_value(role) OVER w AS version, row_number() OVER w AS k FROM x WINDOW w AS (PARTITION BY day, node ORDER BY t, event_id, role))"""
_UN = m.EV + """, acs AS (SELECT src AS actor FROM ev WHERE op = 'purchase' AND day <= '2024-01-15' INTERSECT SELECT src FROM ev WHERE op = 'purchase' AND day BETWEEN '2024-01-16' AND '2024-01-20'),
ta AS (SELECT target, row_number() OVER (ORDER BY CAST('0x' || md5('0|' || target)[1:15] AS BIGINT), target) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT dst AS target FROM ev)),
fr AS (SELECT actor, target, (place - CAST('0x' || md5('0|' || actor)[1:8] AS BIGINT) % n + n) % n AS step FROM acs, ta WHERE NOT EXISTS (SELECT 1 FROM ev WHERE src = actor AND dst = target)),
un AS (SELECT * FROM (SELECT actor, target, row_number() OVER (PARTITION BY actor ORDER BY step) AS r FROM fr) WHERE r <= 3)"""
_NO = "row_number() OVER (ORDER BY t, event_id) - 1"
_BA = m.EV + f", ba AS (SELECT *, ({_NO}) // 256 AS batch FROM ev)"

def _window_attacks() -> str:
    """The same rings and draws by md5."""
    x = lambda *parts, n=8: "CAST('0x' || md5(" + " || '|' || ".join(("'0'", *parts)) + f")[1:{n}] AS BIGINT)"
    return f"""WITH {m.SL}, e AS (SELECT * FROM sl WHERE (dst + src) % 3 > 0 OR dst % 2 = 1),
ac AS (SELECT DISTINCT src AS actor FROM e WHERE op = 'purchase' AND day <= '2024-01-15' INTERSECT SELECT src FROM e WHERE op = 'purchase' AND day BETWEEN '2024-01-16' AND '2024-01-20'),
met AS (SELECT tw, src AS node FROM e UNION SELECT tw, dst FROM e), sp AS (SELECT tw, min(t) AS low, max(t) AS high, CAST(floor(coalesce((max(t) - min(t)) / 1e9 / nullif(count(*) - 1, 0), 0) * 1e9) AS BIGINT) AS gap FROM e GROUP BY tw),
fi AS (SELECT tw, node AS target, row_number() OVER (PARTITION BY tw ORDER BY {x("'file'", "tw", "node", n=15)}, node) - 1 AS place, count(*) OVER (PARTITION BY tw) AS n FROM met WHERE node >= 1000000 AND node % 2 = 0),
nf AS (SELECT tw, node AS target, row_number() OVER (PARTITION BY tw ORDER BY {x("'netflow'", "tw", "node", n=15)}, node) - 1 AS place, count(*) OVER (PARTITION BY tw) AS n FROM met WHERE node >= 1000000 AND node % 2 = 1),
tr AS (SELECT met.tw, actor, target, (place - {x("met.tw", "actor")} % n + n) % n AS step FROM met JOIN ac ON actor = node JOIN fi ON fi.tw = met.tw WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = actor AND e.dst = target)),
tk AS (SELECT *, row_number() OVER (PARTITION BY tw, actor ORDER BY step) - 1 AS r FROM tr QUALIFY r < 2),
bg AS (SELECT tk.*, low + {x("'begin'", "tk.tw", "actor")} % (high - low + 1) AS begin, gap FROM tk JOIN sp ON sp.tw = tk.tw)
SELECT tw, actor AS src, target AS dst, ['EVENT_OPEN', 'EVENT_READ', 'EVENT_WRITE'][k + 1] AS op, begin + (2 * r + k) * gap AS t, 1 AS y FROM bg, (SELECT unnest([0, 1, 2]) AS k)
UNION ALL SELECT g.tw, actor, nf.target, 'EVENT_CONNECT', begin + (2 * c + 1) * gap, 1 FROM (SELECT tw, actor, any_value(begin) AS begin, any_value(gap) AS gap, count(*) AS c FROM bg GROUP BY tw, actor) g JOIN nf ON nf.tw = g.tw AND nf.place = {x("'netflow'", "g.tw", "actor")} % nf.n"""


ORACLES = {
    "tw_daily": f"WITH {m.EV} SELECT day, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY day",
    "tw_daily_eastern": f"WITH {m.EV} SELECT CAST(CAST(make_timestamp(t // 1000) - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ev GROUP BY 1",
    "tw_adaptive": f"WITH RECURSIVE {m.AD} SELECT day, CAST(tw AS BIGINT) AS tw, tw_start, tw_end, count(*) AS n FROM ad GROUP BY ALL",
    "edge_fusion": f"WITH RECURSIVE {m.AD} SELECT day, CAST(tw AS BIGINT) AS tw, src, dst, op, t, event_id FROM (SELECT *, lag(op) OVER (PARTITION BY day, tw, src, dst ORDER BY t, event_id) AS b FROM ad) WHERE b IS NULL OR b <> op",
    "window_multigraph": f"WITH {m.SL} SELECT tw, {m.type_sql('src')} AS src_type, op, {m.type_sql('dst')} AS dst_type, 0 AS y, count(*) AS n FROM sl GROUP BY ALL",
    "transform_chain": f"WITH {MESH}, b AS (SELECT tw, src, dst FROM me UNION SELECT tw, dst, src FROM me) SELECT tw, count(*) AS n, CAST(sum(src) AS BIGINT) AS sum_src FROM b WHERE src < dst GROUP BY tw",
    "tw_nodes": f"WITH {m.SL}, en AS (SELECT tw, src AS node FROM sl UNION SELECT tw, dst FROM sl) SELECT tw, {m.type_sql('node')} AS node_type, count(*) AS n_nodes FROM en GROUP BY ALL",
    "first_edge_graph": f"WITH {m.SL} SELECT tw, src, dst, t, event_id, op FROM (SELECT *, row_number() OVER (PARTITION BY tw, src, dst ORDER BY t, event_id) AS r FROM sl) WHERE r = 1",
    "split_nodes": f"WITH {m.EV}, sn AS (SELECT {m.SPLIT} AS split, src AS node FROM ev UNION SELECT {m.SPLIT}, dst FROM ev) SELECT split, count(*) AS n_nodes, CAST(sum(node) AS BIGINT) AS sum_nodes FROM sn GROUP BY split",
    "used_nodes": f"WITH {m.EV} SELECT c_custkey AS node, c_name FROM customer WHERE c_custkey IN (SELECT src FROM ev WHERE day <= '2024-01-20' UNION SELECT dst FROM ev WHERE day <= '2024-01-20')",
    "window_node_degrees": f"""WITH RECURSIVE {m.AD}, fu AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY day, tw, src, dst ORDER BY t, event_id) AS b FROM ad) WHERE b IS NULL OR b <> op),
en AS (SELECT day, tw, src AS node, 1 AS o, 0 AS i, op FROM fu UNION ALL SELECT day, tw, dst, 0, 1, op FROM fu)
SELECT day, CAST(tw AS BIGINT) AS tw, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(DISTINCT op) AS n_ops, {m.type_sql('node')} AS node_type FROM en GROUP BY day, tw, node""",
    "node_id_offsets": """WITH c AS (SELECT max(c_custkey) + 1 AS n FROM customer), p AS (SELECT max(p_partkey) + 1 AS n FROM part)
SELECT c_custkey AS node, 0 AS dataset FROM customer UNION ALL SELECT p_partkey + (SELECT n FROM c), 1 FROM part UNION ALL SELECT s_suppkey + (SELECT n FROM c) + (SELECT n FROM p), 2 FROM supplier""",
    "trial_cap": f"WITH {m.EV} SELECT day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t, event_id) AS r FROM ev) WHERE r <= 50",
    "range_scan": f"WITH {m.EV} SELECT t, event_id, src, dst, op FROM ev WHERE t > 1704672000000000000 AND t < 1704758400000000000",
    "undirected": f"WITH {m.SL}, e AS (SELECT tw, src, {m.FOLD} AS dst FROM sl), b AS (SELECT tw, src, dst FROM e UNION ALL SELECT tw, dst, src FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.tw = e.tw AND x.src = e.dst AND x.dst = e.src)) SELECT tw, src, dst, count(*) AS n FROM b GROUP BY ALL",
    "root_nodes": f"WITH {MESH}{ROOTS} SELECT * FROM ro",
    "pseudo_graph": f"WITH RECURSIVE {MESH}{REACH}{ROOTS}{PSEUDO} SELECT * FROM ps",
    "pseudo_merged": f"WITH RECURSIVE {MESH}{REACH}{ROOTS}{PSEUDO} SELECT * FROM ps UNION SELECT tw, src, dst FROM me",
    "prune_roots": f"WITH RECURSIVE {MESH}{REACH}{ROOTS}{PSEUDO}, sz AS (SELECT tw, count(*) AS n FROM (SELECT tw, src AS x FROM me UNION SELECT tw, dst FROM me) GROUP BY tw), wd AS (SELECT ps.tw, src FROM ps JOIN sz ON sz.tw = ps.tw GROUP BY ps.tw, src, n HAVING count(*) > n * 0.1) SELECT ps.* FROM ps WHERE NOT EXISTS (SELECT 1 FROM wd WHERE wd.tw = ps.tw AND wd.src = ps.src)",
    "acyclic": f"WITH RECURSIVE {_ACY} SELECT * FROM ac",
    "strong_components": f"WITH RECURSIVE {_ACY}, c AS (SELECT a.tw, a.src AS node, a.dst AS other FROM rr a JOIN rr b ON b.tw = a.tw AND b.src = a.dst AND b.dst = a.src) SELECT tw, node, min(other) AS least, count(*) AS n_nodes FROM c GROUP BY tw, node HAVING count(*) > 1",
    "versioned_dag": f"""WITH {_VE}, e AS (SELECT * FROM me WHERE src <> dst){_VX}
SELECT e.day, e.event_id, e.src, CAST(a.version AS BIGINT) AS src_version, e.dst, CAST(b.version AS BIGINT) AS dst_version, b.k > 1 AS bumped FROM e JOIN v a ON a.event_id = e.event_id AND a.day = e.day AND a.role = 0 JOIN v b ON b.event_id = e.event_id AND b.day = e.day AND b.role = 1""",
    "mean_time_delta": f"WITH {m.SL}, g AS (SELECT *, lead(t) OVER (PARTITION BY tw ORDER BY t, event_id) - t AS gap FROM sl) SELECT tw, round(CAST(sum(gap) AS DOUBLE) / 1e9 / count(gap), 6) AS mean_gap, min(t) AS first_t, max(t) AS last_t FROM g GROUP BY tw",
    "unauthorized_pairs": f"WITH {_UN} SELECT actor, target, CAST(r AS INT) AS r FROM un",
    "window_attacks": _window_attacks(),
    "synthetic_attack": f"WITH {_UN}, st AS (SELECT actor, target, (r - 1) * 3 + k AS n, ['EVENT_OPEN', 'EVENT_READ', 'EVENT_WRITE'][k] AS op FROM un, (SELECT unnest([1, 2, 3]) AS k)) SELECT actor AS src, target AS dst, op, 1705881600000000000 + n * 60000000000 AS t, 1 AS y FROM st",
    "injected": f"WITH {_UN} SELECT day, 0 AS y, count(*) AS n FROM ev GROUP BY day UNION ALL SELECT '2024-01-22', 1, count(*) * 3 FROM un WHERE actor % 3 <> 1 HAVING count(*) > 0",
    "version_edges": f"WITH {_VE}, e AS (SELECT * FROM me WHERE src <> dst){_VX} SELECT day, node, CAST(version - 1 AS BIGINT) AS from_version, CAST(version AS BIGINT) AS to_version, t FROM v WHERE role = 1 AND k > 1",
    "latest_versions": f"WITH {_VE}, e AS (SELECT * FROM me){_VX} SELECT day, node, CAST(max(version) AS BIGINT) AS version FROM v GROUP BY ALL",
    "random_times": f"WITH RECURSIVE {_ACY}, sn AS (SELECT tw, min(t) AS lo, max(t) + 1 AS hi FROM me GROUP BY tw) SELECT tw, src, dst, lo + CAST('0x' || md5('0|' || tw || '|' || src || '|' || dst)[1:8] AS BIGINT) % (hi - lo) AS t FROM ac JOIN sn USING (tw)",
    "last_k_current": f"""WITH {_BA}, en AS (SELECT batch, event_id, t, src AS node, dst AS neighbour, 0 AS side FROM ba UNION ALL SELECT batch, event_id, t, dst, src, 1 FROM ba), q AS (SELECT DISTINCT batch, node FROM en)
SELECT batch, node, neighbour, e_id, CAST(age AS INT) AS age FROM (SELECT q.batch, q.node, e.neighbour, e.event_id AS e_id, row_number() OVER (PARTITION BY q.batch, q.node ORDER BY e.t DESC, e.event_id DESC, e.side DESC) AS age FROM q JOIN en e ON e.node = q.node AND e.batch <= q.batch) WHERE age <= 5""",
    "last_k_directed": f"""WITH {_BA}, en AS (SELECT batch, event_id, t, dst AS node, src AS neighbour FROM ba), q AS (SELECT batch, src AS node FROM ba UNION SELECT batch, dst FROM ba)
SELECT batch, node, neighbour, e_id, CAST(age AS INT) AS age FROM (SELECT q.batch, q.node, e.neighbour, e.event_id AS e_id, row_number() OVER (PARTITION BY q.batch, q.node ORDER BY e.t DESC, e.event_id DESC) AS age FROM q JOIN en e ON e.node = q.node AND e.batch < q.batch) WHERE age <= 5""",
    "last_k_two_hops": f"""WITH {_BA}, en AS (SELECT batch, event_id, t, src AS node, dst AS neighbour, 0 AS side FROM ba UNION ALL SELECT batch, event_id, t, dst, src, 1 FROM ba), bs AS (SELECT DISTINCT batch FROM ba), q AS (SELECT DISTINCT batch, node FROM en),
nb AS (SELECT DISTINCT batch, node, neighbour FROM (SELECT bs.batch, e.node, e.neighbour, row_number() OVER (PARTITION BY bs.batch, e.node ORDER BY e.t DESC, e.event_id DESC, e.side DESC) AS age FROM bs JOIN en e ON e.batch < bs.batch) WHERE age <= 2),
h1 AS (SELECT q.batch, q.node, nb.neighbour FROM q JOIN nb USING (batch, node)), h2 AS (SELECT DISTINCT h1.batch, h1.node, nb.neighbour FROM h1 JOIN nb ON nb.batch = h1.batch AND nb.node = h1.neighbour)
SELECT batch, node, 1 AS hop, count(DISTINCT neighbour) AS n, CAST(sum(neighbour) AS BIGINT) AS sum FROM h1 GROUP BY ALL UNION ALL SELECT batch, node, 2, count(DISTINCT neighbour), CAST(sum(neighbour) AS BIGINT) FROM h2 GROUP BY ALL""",
    "batching_stage": f"WITH {m.SL}, a AS (SELECT *, ({_NO}) // 256 AS batch FROM sl), b AS (SELECT *, (row_number() OVER (PARTITION BY tw, batch ORDER BY t, event_id) - 1) // 32 AS inner_ FROM a) SELECT tw // 6 AS stack, tw, batch, inner_ AS \"inner\", count(*) AS n, min(event_id) AS first_event FROM b GROUP BY ALL",
    "node_means_overwritten": f"WITH {m.SL}, o AS (SELECT tw, src AS node, avg(loss) AS a FROM sl GROUP BY ALL), i AS (SELECT tw, dst AS node, avg(loss) AS b FROM sl GROUP BY ALL) SELECT tw, node, round(coalesce(b, a), 6) AS mean_loss FROM o FULL JOIN i USING (tw, node)",
    "tw_labels_text": f"WITH RECURSIVE {m.AD}, w AS (SELECT DISTINCT day, tw, tw_start, tw_end FROM ad) SELECT day, CAST(tw AS BIGINT) AS tw, " + " || '~' || ".join(f"strftime(make_timestamp({c} // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST({c} % 1000000000 AS VARCHAR), 9, '0')" for c in ("tw_start", "tw_end")) + " AS label FROM w",
    "batch_edges": f"WITH {_BA} SELECT batch, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM ba GROUP BY batch",
    "batch_edges_in_graph": f"WITH {m.EV}, b AS (SELECT *, (row_number() OVER (PARTITION BY day ORDER BY t, event_id) - 1) // 64 AS batch FROM ev) SELECT day, batch, count(*) AS n, max(event_id) AS last_event FROM b GROUP BY ALL",
    "batch_minutes": f"WITH {m.EV}, b AS (SELECT t - 1704067200000000000 AS a FROM ev) SELECT a // 1800000000000 AS batch, count(*) AS n FROM b WHERE a % 1800000000000 < 1200000000000 GROUP BY 1",
    "batch_unique_pairs": f"""WITH RECURSIVE {m.EV}, nu AS (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY t, event_id) AS i, src, dst, t FROM ev),
pr AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY day, src, dst ORDER BY i), 0) AS p FROM nu),
f AS (SELECT day, event_id, i, 0 AS batch, 1 AS start FROM pr WHERE i = 1 UNION ALL SELECT n.day, n.event_id, n.i, f.batch + CAST(n.p >= f.start AS INT), CASE WHEN n.p >= f.start THEN n.i ELSE f.start END FROM f JOIN pr n ON n.day = f.day AND n.i = f.i + 1)
SELECT day, event_id, CAST(batch AS BIGINT) AS batch FROM f""",
    "last_k_neighbors": f"""WITH {_BA}, en AS (SELECT batch, event_id, t, src AS node, dst AS neighbour, 0 AS side FROM ba UNION ALL SELECT batch, event_id, t, dst, src, 1 FROM ba), q AS (SELECT DISTINCT batch, node FROM en)
SELECT batch, node, neighbour, e_id, CAST(age AS INT) AS age FROM (SELECT q.batch, q.node, e.neighbour, e.event_id AS e_id, row_number() OVER (PARTITION BY q.batch, q.node ORDER BY e.t DESC, e.event_id DESC, e.side DESC) AS age FROM q JOIN en e ON e.node = q.node AND e.batch < q.batch) WHERE age <= 5""",
    "last_update": f"WITH {_BA}, en AS (SELECT batch, t, src AS node FROM ba UNION ALL SELECT batch, t, dst FROM ba), q AS (SELECT DISTINCT batch, node FROM en) SELECT q.batch, q.node, coalesce(max(e.t), 0) AS last_t FROM q LEFT JOIN en e ON e.node = q.node AND e.batch < q.batch GROUP BY q.batch, q.node",
    "inter_graph_offsets": f"WITH {m.SL}, z AS (SELECT tw, count(*) AS n FROM (SELECT tw, src AS x FROM sl UNION SELECT tw, dst FROM sl) GROUP BY tw) SELECT a.tw, a.tw // 6 AS stack, CAST(coalesce((SELECT sum(n) FROM z b WHERE b.tw // 6 = a.tw // 6 AND b.tw < a.tw), 0) AS BIGINT) AS \"offset\" FROM z a",
    "reindex_nodes": f"WITH {m.SL}, en AS (SELECT tw, src AS node FROM sl UNION SELECT tw, dst FROM sl) SELECT tw, node, CAST(dense_rank() OVER (PARTITION BY tw ORDER BY node) - 1 AS INT) AS index FROM en",
    "node_feature_means": f"WITH {m.SL}, en AS (SELECT tw, src AS node, loss FROM sl UNION ALL SELECT tw, dst, loss FROM sl) SELECT tw, node, round(avg(loss), 6) AS mean_loss, count(*) AS n_edges FROM en GROUP BY ALL",
    "edges_distribution": "WITH " + m.SL + ", en AS (SELECT tw, src AS node, 'out_' || op AS k FROM sl UNION ALL SELECT tw, dst, 'in_' || op FROM sl), c AS (SELECT tw, node, " + ", ".join(f"count(*) FILTER (k = '{d}_{o}') AS {d}_{o}" for d in ("out", "in") for o in ("click", "error", "purchase", "signup", "view")) + " FROM en GROUP BY ALL), mx AS (SELECT tw, max(greatest(" + ", ".join(f"{d}_{o}" for d in ("out", "in") for o in ("click", "error", "purchase", "signup", "view")) + ")) AS mx FROM c GROUP BY tw) SELECT c.tw, node, " + ", ".join(f"round({d}_{o} / mx, 6) AS {d}_{o}" for d in ("out", "in") for o in ("click", "error", "purchase", "signup", "view")) + " FROM c JOIN mx ON mx.tw = c.tw",
    "dataset_stats": f"WITH {m.SL}, e AS (SELECT {m.SPLIT} AS split, day, tw, src, dst FROM sl), a AS (SELECT split, day, tw, count(*) AS n_edges FROM e GROUP BY ALL), b AS (SELECT split, day, tw, count(*) AS n_nodes FROM (SELECT split, day, tw, src AS x FROM e UNION SELECT split, day, tw, dst FROM e) GROUP BY ALL) SELECT split, count(*) AS n_graphs, " + ", ".join(f"round(CAST({f}({c}) AS DOUBLE), 6) AS {n}_{c}" for c in ("n_edges", "n_nodes") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM a JOIN b USING (split, day, tw) GROUP BY split",
}
QUERIES = {name: globals()[name] for name in ORACLES}
