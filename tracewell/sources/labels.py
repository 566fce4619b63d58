"""Ground truth and attack windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scalar import text_to_ns


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, label) of a file without header; ids in it are not trusted."""
    return spark.read.schema("uuid string, label string, old_id string").csv(path, quote='"', escape='"').select("uuid", "label")


def with_node_ids(truth: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Adds index_id by uuid; with strict, unknown uuids are an error."""
    if strict and (missing := truth.join(nodes, "uuid", "left_anti").head(1)):
        raise ValueError(f"no node has uuid {missing[0]['uuid']}")
    return truth.join(nodes.select("uuid", "index_id"), "uuid")


def attack_windows(spark: SparkSession, attacks: list[tuple[str, str, str]]) -> DataFrame:
    """(attack_id, name, start_ns, end_ns) from wall-clock bounds in US Eastern time."""
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(attacks)], "attack_id int, name string, a string, z string")
    return rows.select("attack_id", "name", text_to_ns(F.col("a")).alias("start_ns"), text_to_ns(F.col("z")).alias("end_ns"))


def attack_rows(rows: DataFrame) -> DataFrame:
    """Of a label corpus (uuid, label, index_id), the rows labelled as attack."""
    return rows.filter("label = 'attack'")
