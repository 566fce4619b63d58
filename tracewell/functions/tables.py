"""Tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _paths:
        atexit.register(_clear)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about so many rows, for work that a small file's few tasks would be slow at; as it is if one holds all."""
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


def delete(spark_context: SparkContext, paths: list[str]) -> None:
    for path in paths:
        p = spark_context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark_context._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    if SparkContext._active_spark_context is not None:
        delete(SparkContext._active_spark_context, _paths)
