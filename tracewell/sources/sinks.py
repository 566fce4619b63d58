"""Where tables go: partitioned Parquet, CSV, JSON, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_windows(edges: DataFrame, path: str) -> None:
    """Graph snapshots by day and window."""
    edges.repartition("day", "tw").sortWithinPartitions("t", "event_id").write.mode("overwrite").partitionBy("day", "tw").parquet(path)


def read_windows(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """Snapshots of some days; other days' folders are not read."""
    d = spark.read.parquet(path)
    return d if days is None else d.filter(F.col("day").isin(*days))


def write_losses(losses: DataFrame, path: str, keys: tuple[str, ...] = ("split", "epoch", "tw")) -> None:
    losses.write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)


# The columns of loss files; a file holds those of its kind.
LOSS_COLUMNS = {"loss": "double", "srcnode": "long", "dstnode": "long", "time": "long", "edge_type": "int", "node": "long", "threatrace_score": "double", "flash_score": "double", "magic_score": "double", "correct_pred": "boolean", "split": "string", "epoch": "int", "tw": "long"}


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """Edge or node losses; scores and predictions are columns where the files have them."""
    d = spark.read.option("header", True).csv(path)
    return d.select(*[F.col(c).cast(LOSS_COLUMNS.get(c, "string")).alias(c) for c in d.columns])


def write_node_losses(losses: DataFrame, path: str, keys: tuple[str, ...] = ("split", "epoch", "tw")) -> None:
    """Node losses (node, loss and the scores there are) per window, as CSV with a header."""
    own = ["node", "loss", *[c for c in ("threatrace_score", "flash_score", "magic_score", "correct_pred") if c in losses.columns]]
    write_losses(losses.select(*own, *keys), path, keys)


def write_truth(nodes: DataFrame, generated: DataFrame, path: str) -> None:
    """(uuid, label, id) of the nodes of generated events, as a truth file without header."""
    ends = generated.select(F.col("src").alias("index_id")).unionByName(generated.select(F.col("dst").alias("index_id"))).distinct()
    nodes.join(ends, "index_id", "left_semi").select("uuid", "label", "index_id").write.mode("overwrite").csv(path)


def write_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Metrics of a run, added to those of other runs."""
    metrics.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def write_adjacency(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """(u, v, label_u, label_v, op, type_u, type_v)."""
    u = nodes.select(F.col("node").alias("src"), F.col("label").alias("label_u"), F.col("node_type").alias("type_u"))
    v = nodes.select(F.col("node").alias("dst"), F.col("label").alias("label_v"), F.col("node_type").alias("type_v"))
    edges.join(u, "src").join(v, "dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "label_u", "label_v", "op", "type_u", "type_v").write.mode("overwrite").csv(path)


def write_names(nodes: DataFrame, path: str) -> None:
    nodes.select("node", "label").write.mode("overwrite").json(f"{path}/names")
    nodes.select("node", "node_type").write.mode("overwrite").json(f"{path}/types")


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int) -> DataFrame:
    """The event table in parallel ranges of time."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", "timestamp_rec").option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


# The tables of the relational form.
TABLES = {
    "event_table": "src_node string, src_index_id string, operation string, dst_node string, dst_index_id string, event_uuid string, timestamp_rec bigint, _id int",
    "file_node_table": "node_uuid string, hash_id string, path string, index_id bigint",
    "netflow_node_table": "node_uuid string, hash_id string, src_addr string, src_port string, dst_addr string, dst_port string, index_id bigint",
    "subject_node_table": "node_uuid string, hash_id string, path string, cmd string, index_id bigint",
}


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        days = "PARTITIONED BY (event_date date)" if name == "event_table" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.{name} ({columns}) USING parquet {days}")


def source(spark: SparkSession, settings: dict, name: str) -> DataFrame:
    """A table of the model from where the settings say: a Parquet root (root, or all_root with use_all_files), or JDBC."""
    if "url" in settings:
        return spark.read.format("jdbc").option("url", settings["all_url"] if settings.get("use_all_files") else settings["url"]).option("dbtable", name).load()
    root = settings["all_root"] if settings.get("use_all_files") else settings["root"]
    return spark.read.parquet(f"{root}/{name}")


def read_nested(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Lines of all files below a path, at any depth, whose names match."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)


def windows_of(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """(day, tw) of stored snapshots in order of time, from partition values alone."""
    return read_windows(spark, path, days).select("day", "tw").distinct().orderBy("day", "tw")


def manifest(root: str, edition: str, name: str) -> str:
    """A glob for the record files of a dataset under a root, by the published names of its parts."""
    return f"{root}/ta1-{name}*-{edition}-official*.json*"


def split_of(edges: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """The edges of a split's days, splits(day, split)."""
    return edges.join(splits.filter(F.col("split") == name).select("day"), "day", "left_semi")
