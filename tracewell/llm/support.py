"""What the operators of this package share: scratch tables, shipping code to executors, row sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.functions.tables import delete, shared_root

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
_tables: list[str] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where they do not start in the repository."""
    root, app = os.path.dirname(_PACKAGE), spark.sparkContext.applicationId
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or root in on_path:
        return
    out = os.path.join(tempfile.mkdtemp(), "tracewell.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the folder of spark.checkpoint.dir and read it back."""
    path = scratch(f"{shared_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(path: str) -> str:
    """Note a path that goes when the application ends or the caller releases it."""
    if not _tables:
        atexit.register(_clear)
    _tables.append(path)
    return path


def _clear() -> None:
    if SparkContext._active_spark_context is not None:
        delete(SparkContext._active_spark_context, _tables)


def tables() -> list[str]:
    """Scratch tables of this process that were not released."""
    return list(_tables)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch tables whose readers are done (all of this process's by default)."""
    gone = list(_tables if paths is None else paths)
    delete(spark.sparkContext, gone)
    for path in gone:
        if path in _tables:
            _tables.remove(path)


HOT_KEYS = 1000  # a key with more than one in so many rows is joined in every task


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join with one(keys, n, ...), a row a key that says in n how many of the total rows have it.

    Keys that hold more than one in HOT_KEYS of all rows, fewer than HOT_KEYS of
    them, go to every task; the others go through the shuffle. So no task gathers
    a key that holds a share of the rows. Both sides are parted by the hot keys' hashes.
    """
    h = F.xxhash64(*keys)
    hot = [r[0] for r in one.filter(F.col(n) * HOT_KEYS > total).select(h).collect()]  # fewer than HOT_KEYS numbers
    if not hot:
        return rows.join(one, keys)
    apart = h.isin(hot)
    return rows.filter(apart).join(F.broadcast(one.filter(apart)), keys).unionByName(rows.filter(~apart).join(one.filter(~apart), keys))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch and further columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def extended(fields: StructType | list, ddl: str) -> StructType:
    """A schema with further fields at its end."""
    return StructType([*fields, *StructType.fromDDL(ddl)])


SLICE_BYTES = 4 << 20  # of a slice of rows; a larger row alone


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects at a time, however long they are."""

    def halved(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows > 1 and b.nbytes > SLICE_BYTES:
            half = b.num_rows // 2
            yield from halved(b.slice(0, half))
            yield from halved(b.slice(half))
        else:
            yield b

    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield from halved(b.slice(a, rows))
    settle()


def settle() -> None:
    """Give memory that a task no longer needs back to the system: its worker lives on for the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
