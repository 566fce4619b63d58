"""Exact nearest neighbours and local outlier factors over points of any number.

Points lie in blocks near one pivot. Each block keeps its range of distances to every
pivot, and how far its points' k-th neighbours can be at most, from the block's own
points. By the triangle inequality two blocks are at least as far apart as their ranges
to any pivot are; only blocks that may hold a neighbour of one another are joined,
under that condition, and compared exactly, a block against a block. A task keeps the best
of a block over all blocks that it meets in a row, so rows follow points, not pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.tables import stored

BLOCK = 2048  # points of a block
PIVOTS = 12
SAMPLE = 1000  # points that pivots are chosen from; they decide cost, never results
_BLOCK = "block long, ids array<long>, v binary, lo array<double>, hi array<double>, reach double"


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Points far from one another, one after the other."""
    chosen, near = [sample[0]], np.full(len(sample), np.inf)
    while len(chosen) < PIVOTS:
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(sample[near.argmax()])
    return np.array(chosen)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From differences, so that equal points are 0 apart."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        d = a[i : i + 64, None, :] - b[None]
        out[i : i + 64] = np.sqrt((d * d).sum(-1))
    return out


def _least(mine: np.ndarray, a: np.ndarray, theirs: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest rows of b to each row of a, ties by id; rows of equal id and missing ones are at infinity.

    Products choose rows, with all that may tie with the k-th; their distances are then taken from differences.
    """
    def exact(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
        d, ids = np.take_along_axis(d, order, 1), np.take_along_axis(np.broadcast_to(ids, d.shape), order, 1)
        more = max(0, k - d.shape[1])
        return np.pad(d, ((0, 0), (0, more)), constant_values=np.inf), np.pad(ids, ((0, 0), (0, more)))

    def whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(a[rows], b)
        d[mine[rows][:, None] == theirs] = np.inf
        return exact(d, theirs)

    most = k + 64
    if len(b) <= 2 * most or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return whole(np.arange(len(a)))
    size, sizes = np.einsum("nd,nd->n", b, b), np.einsum("nd,nd->n", a, a)
    rough = size - 2 * (a @ b.T)
    if np.isin(mine, theirs, kind="sort").any():
        rough[mine[:, None] == theirs] = np.inf
    chosen = np.argpartition(rough, most - 1, axis=1)[:, :most]
    near = np.sort(np.take_along_axis(rough, chosen, 1), axis=1)
    d = a[:, None] - b[chosen]
    d = np.sqrt((d * d).sum(-1))
    d[mine[:, None] == theirs[chosen]] = np.inf
    kept, ids = exact(d, theirs[chosen])
    unsure = np.flatnonzero(~(near[:, -1] > near[:, k - 1] + 1e-10 * (sizes + size.max())))  # others may tie with the k-th
    if len(unsure):
        kept[unsure], ids[unsure] = whole(unsure)
    return kept, ids


def _within(mine: np.ndarray, a: np.ndarray, theirs: np.ndarray, b: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance, id) of rows of b no further from a row of a than its limit, or of its k nearest where that is less work."""
    if np.isfinite(a).all() and np.isfinite(b).all() and np.isfinite(limit).all():
        size, sizes = np.einsum("nd,nd->n", b, b), np.einsum("nd,nd->n", a, a)
        rough = size - 2 * (a @ b.T)
        rows, others = np.nonzero(rough <= (limit * limit - sizes + 1e-10 * (sizes + size.max()))[:, None])
        if len(rows) <= 32 * len(a):
            apart = mine[rows] != theirs[others]
            rows, others = rows[apart], others[apart]
            d = a[rows] - b[others]
            return rows, np.sqrt((d * d).sum(-1)), theirs[others]
    d, ids = _least(mine, a, theirs, b, k)
    rows, others = np.nonzero(np.isfinite(d))
    return rows, d[rows, others], ids[rows, others]


def _blocks(points: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Points in order of nearest pivot and distance to it, a row a block."""
    from pyspark import TaskContext

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1), pivots)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "v", "cell", "own"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, count = np.zeros((0, pivots.shape[1])), np.zeros(0, np.int64), 0

        def block() -> pa.RecordBatch:
            nonlocal held, ids, count
            own, own_ids = held[:BLOCK], ids[:BLOCK]
            held, ids, count = held[BLOCK:], ids[BLOCK:], count + 1
            d = _distances(own, pivots)
            reach = _least(own_ids, own, own_ids, own, k)[0].max() if len(own) > k else np.inf
            number = (TaskContext.get().partitionId() << 32) + count
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own_ids.tolist()], pa.list_(pa.int64())), pa.array([own.tobytes()], pa.binary()), pa.array([d.min(0).tolist()]), pa.array([d.max(0).tolist()]), pa.array([float(reach)])], ["block", "ids", "v", "lo", "hi", "reach"])

        for b in batches:
            if b.num_rows:
                held = np.vstack([held, np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1)])
                ids = np.concatenate([ids, b.column("id").to_numpy()])
            while len(ids) >= BLOCK:
                yield block()
        if len(ids):
            yield block()

    placed = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(place, "id long, v array<double>, cell int, own double")
    order = ["cell", "own", "id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK)


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, rank, distance): the k nearest other points of each of points(id, v), ties by id.

    Vectors have one length; ids tell points apart. With fewer than k others all of them are neighbours.
    """
    out = "id long, neighbour long, distance double"
    sample = points.orderBy(F.xxhash64("id"), "id").select(F.col("v").cast("array<double>").alias("v")).limit(SAMPLE).collect()
    if not sample:
        return points.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(0))
    pivots = _pivots(np.array([r["v"] for r in sample], float).reshape(len(sample), -1))
    slack = 1e-9 * (1 + float(np.abs(pivots).max()))
    blocks = stored(_blocks(points, pivots, k), "point-blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None

        def found() -> pa.RecordBatch:
            rows, d, ids = best
            return pa.RecordBatch.from_arrays([pa.array(mine[rows]), pa.array(ids), pa.array(d)], ["id", "neighbour", "distance"])

        for b in batches:
            for r in range(b.num_rows):
                own, ids, v, reach, theirs, o_v = (b.column(c)[r] for c in ("block", "ids", "v", "reach", "o_ids", "o_v"))
                if own.as_py() != block:
                    if best is not None:
                        yield found()
                    block, mine = own.as_py(), ids.values.to_numpy()
                    points = np.frombuffer(v.as_buffer()).reshape(len(mine), -1)
                    limit = np.minimum(_least(mine, points, mine, points, k)[0][:, -1], reach.as_py() + slack)
                    best = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
                theirs = theirs.values.to_numpy()
                new = _within(mine, points, theirs, np.frombuffer(o_v.as_buffer()).reshape(len(theirs), -1), k, limit)
                rows, d, near = (np.concatenate(x) for x in zip(best, new))
                order = np.lexsort((near, d, rows))
                rows, d, near = rows[order], d[order], near[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                last = rank == k - 1
                limit[rows[last]] = np.minimum(limit[rows[last]], d[last])
                best = rows[rank < k], d[rank < k], near[rank < k]
        if best is not None:
            yield found()

    apart = F.greatest(F.lit(0.0), *[F.greatest(F.col("o_lo")[j] - F.col("hi")[j], F.col("lo")[j] - F.col("o_hi")[j]) for j in range(len(pivots))])
    other = blocks.select(*[F.col(c).alias(f"o_{c}") for c in ("ids", "v", "lo", "hi")])
    met = blocks.join(other, apart <= F.col("reach") + slack).select("block", "ids", "v", "reach", "o_ids", "o_v")
    w = W.partitionBy("id").orderBy("distance", "neighbour")
    return met.mapInArrow(compare, out).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def outlier_factors(points: DataFrame, k: int) -> DataFrame:
    """(id, lof) over points(id, v): how much sparser a point lies than its k nearest neighbours.

    A distance to a neighbour counts as the neighbour's own k-th distance at least; density is one over
    the mean of these (1e-10 at least), lof the neighbours' mean density over the point's. A point alone has 1.
    """
    kind = points.schema["id"].dataType
    near = stored(nearest(points, k), "nearest")
    kth = near.groupBy("id").agg(F.max("distance").alias("kth"))
    reach = near.join(kth.withColumnsRenamed({"id": "neighbour"}), "neighbour").withColumn("reach", F.greatest("distance", "kth"))
    density = stored(reach.groupBy("id").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-10))).alias("density")), "density")
    around = near.join(density.withColumnsRenamed({"id": "neighbour"}), "neighbour").groupBy("id").agg(F.avg("density").alias("around"))
    found = around.join(density, "id").select("id", (F.col("around") / F.col("density")).alias("lof"))
    return points.select(F.col("id").cast("long").alias("id")).join(found, "id", "left").select(F.col("id").cast(kind).alias("id"), F.coalesce("lof", F.lit(1.0)).alias("lof"))
