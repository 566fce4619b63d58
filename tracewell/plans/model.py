"""The driver's tables as a provenance data model, in Spark and as SQL text.

Users are subjects and the keys in props are objects: files if even, netflows if
odd. Days are UTC here. Split days: train to the 15th, val to the 20th, then test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.integers import floor_div
from tracewell.operators import windows
from tracewell.session import table

HOUR = 3_600_000_000_000
SLOT = 4 * HOUR
CHUNK = 32


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", (F.unix_micros(ts) * 1000).alias("t"), F.col("user_id").alias("src"), (F.get_json_object("props", "$.k").cast("long") + 1_000_000).alias("dst"), F.col("event_type").alias("op"), F.col("value").alias("loss"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


EV = r"""ev AS (SELECT event_id, epoch_us(ts) * 1000 AS t, user_id AS src, 1000000 + CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS dst,
  event_type AS op, value AS loss, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"""


def folded(spark: SparkSession, sf: str, e: DataFrame) -> DataFrame:
    """Events whose objects are users too, so that ways are longer than one edge: nodes and edges both follow the table."""
    most = table(spark, sf, "events").agg((F.max("user_id") + 1).alias("_n"))
    return e.crossJoin(F.broadcast(most)).withColumn("dst", (F.col("event_id") * 7919 + F.col("dst")) % F.col("_n")).drop("_n")


FOLD = "(event_id * 7919 + dst) % (SELECT max(user_id) + 1 FROM events)"


def meshed(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf, events(spark, sf))


ME = EV + f", me AS (SELECT * REPLACE ({FOLD} AS dst) FROM ev)"


def node_type(node: Column) -> Column:
    return F.when(node < 1_000_000, "subject").when(node % 2 == 0, "file").otherwise("netflow")


def type_sql(node: str) -> str:
    return f"CASE WHEN {node} < 1000000 THEN 'subject' WHEN {node} % 2 = 0 THEN 'file' ELSE 'netflow' END"


def slotted(spark: SparkSession, sf: str) -> DataFrame:
    """Events in fixed windows of four hours."""
    return events(spark, sf).withColumn("tw", floor_div(F.col("t"), SLOT))


SL = EV + ", sl AS (SELECT *, t // 14400000000000 AS tw FROM ev)"


def adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return windows.adaptive(events(spark, sf), SLOT, CHUNK)


AD = EV + f""", nu AS (SELECT *, (row_number() OVER (PARTITION BY day ORDER BY t, event_id) - 1) // {CHUNK} AS chunk FROM ev),
ch AS (SELECT day, chunk, min(t) AS first, max(t) AS last FROM nu GROUP BY day, chunk),
fold AS (SELECT day, chunk, first AS start, 0 AS tw, last FROM ch WHERE chunk = 0
  UNION ALL SELECT c.day, c.chunk, CASE WHEN f.last > f.start + {SLOT} THEN f.last ELSE f.start END, f.tw + CAST(f.last > f.start + {SLOT} AS INT), c.last
  FROM fold f JOIN ch c ON c.day = f.day AND c.chunk = f.chunk + 1),
ad AS (SELECT nu.*, f.tw, f.start AS tw_start, max(f.last) OVER (PARTITION BY nu.day, f.tw) AS tw_end FROM nu JOIN fold f ON f.day = nu.day AND f.chunk = nu.chunk)"""


def split_of(day: Column) -> Column:
    return F.when(day <= "2024-01-15", "train").when(day <= "2024-01-20", "val").otherwise("test")


SPLIT = "CASE WHEN day <= '2024-01-15' THEN 'train' WHEN day <= '2024-01-20' THEN 'val' ELSE 'test' END"


def days(spark: SparkSession, sf: str) -> DataFrame:
    d = events(spark, sf).select("day").distinct()
    return d.withColumn("split", split_of(F.col("day")))


def attacks(spark: SparkSession) -> DataFrame:
    """Three attacks on test days; their nodes are users by remainder."""
    return spark.createDataFrame([(0, 1705881600 * 10**9, 1705968000 * 10**9), (1, 1706140800 * 10**9, 1706313600 * 10**9), (2, 1706486400 * 10**9, 1706572800 * 10**9)], "attack_id int, start_ns long, end_ns long")


AT = "atk AS (SELECT * FROM (VALUES (0, 1705881600000000000, 1705968000000000000), (1, 1706140800000000000, 1706313600000000000), (2, 1706486400000000000, 1706572800000000000)) v(attack_id, start_ns, end_ns))"


def bad_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(attack_id, node): users whose id leaves 3 * attack + 1 modulo 37."""
    u = events(spark, sf).select(F.col("src").alias("node")).distinct()
    return u.join(F.broadcast(attacks(spark).select("attack_id")), (F.col("node") % 37) == (F.col("attack_id") * 3 + 1)).select("attack_id", "node")


BAD = "bad AS (SELECT attack_id, node FROM (SELECT DISTINCT src AS node FROM ev) u JOIN atk ON node % 37 = attack_id * 3 + 1)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """(node, score, y_true, y_hat): users of test days by greatest loss; flagged above 150."""
    e = events(spark, sf).filter("day > '2024-01-20'")
    r = e.groupBy(F.col("src").alias("node")).agg(F.max("loss").alias("score"))
    bad = bad_nodes(spark, sf).select("node").distinct().withColumn("y", F.lit(1))
    return r.join(bad, "node", "left").select("node", "score", F.coalesce("y", F.lit(0)).cast("long").alias("y_true"), (F.col("score") > 150).cast("long").alias("y_hat"))


RES = EV + ", " + AT + ", " + BAD + """, res AS (SELECT r.node, score, CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.node = r.node) THEN 1 ELSE 0 END AS y_true, CASE WHEN score > 150 THEN 1 ELSE 0 END AS y_hat
  FROM (SELECT src AS node, max(loss) AS score FROM ev WHERE day > '2024-01-20' GROUP BY src) r),
rk AS (SELECT *, row_number() OVER w AS rank, sum(y_true) OVER w AS tps, sum(1 - y_true) OVER w AS fps FROM res WINDOW w AS (ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING)),
fd AS (SELECT rk.*, (SELECT count(*) FROM (SELECT attack_id, min(rank) AS r FROM rk JOIN bad USING (node) GROUP BY attack_id) f WHERE f.r <= rk.rank) AS found,
  (SELECT count(DISTINCT attack_id) FROM bad) AS n_attacks FROM rk)"""
