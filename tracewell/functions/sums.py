"""Sums of numpy arrays over the tasks of a table, in two levels."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GROUPS = 64  # sums that reach the driver
_SCHEMA = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])
DDL = "slot int, sums binary"


def added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [sum(p) for p in zip(*parts)]


def row_of(arrays: list[np.ndarray]) -> dict:
    """A task's arrays as one row; tasks are dealt to GROUPS slots."""
    from pyspark import TaskContext

    return {"slot": TaskContext.get().partitionId() % GROUPS, "sums": pickle.dumps(arrays)}


def total(rows: DataFrame) -> list[np.ndarray]:
    """The sum of all rows(slot, sums): added up by slot, then on the driver; empty without a row."""
    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"slot": table["slot"][0].as_py(), "sums": pickle.dumps(added([pickle.loads(s) for s in table["sums"].to_pylist()]))}], _SCHEMA)

    return added([pickle.loads(r["sums"]) for r in rows.groupBy("slot").applyInArrow(add, DDL).orderBy("slot").collect()])


def summed(df: DataFrame, of_task: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray] | None]) -> list[np.ndarray]:
    """The sum over tasks of the arrays that each makes of its batches; a task may make none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = of_task(b for b in batches if b.num_rows)
        if arrays is not None:
            yield pa.RecordBatch.from_pylist([row_of(arrays)], _SCHEMA)

    return total(df.mapInArrow(run, DDL))
