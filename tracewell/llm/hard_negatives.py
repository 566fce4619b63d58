"""Hard negatives of vectors under the inner product, by a pivot table.

Rows (vec_id, embedding, label) take part if id, label and vector are there, every
component is finite and the squared length below is under 2^53, so that scores are
exact in doubles. Each component x becomes floor(256 * x); a row's score with an
anchor is their integer inner product. Ids that divide by `shifted` first move to
the next label, of LABELS. Anchors are rows whose id divides by `anchors_every`: a
stated query set, compared with all rows in blocks.

Augmenting every row to the common length M with one more component, and every
anchor with a zero, makes the inner product a Euclidean distance:
d^2 = M^2 + |q|^2 - 2 score. The distances of every row to a few pivots are stored;
the triangle inequality over them brackets each distance from both sides, hence each
score. Rows lie in blocks of one label, near one pivot; a block's ranges bracket all
its rows, so that block pairs that cannot matter are never joined. In a pair of
blocks each row is bracketed, and survivors are scored exactly.

1. Seed: an anchor's best rows of its label near its own pivot give a score that its
   positives reach at least.
2. Positives: the first `positives` other rows of the label from that score on.
3. Negatives: per positive, the first rows of other labels inside the band
   50 * positive <= 100 * negative <= 95 * positive.

Higher scores come first, ties by smaller id. A task raises its limits by what it has
found already. Pivots are chosen on a bounded sample (SAMPLE rows of least hash); they
decide cost, never results. Rows that repeat count each; an anchor that repeats with
equal label and vector answers once; rows with an anchor's own id are never its
positives or negatives. Shorter vectors count as padded with zeros. Anchors without
positives, and positives without a row in their band, give no row. Other columns pass
by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.integers import floor_div

from .support import shuffle_parts, stored

LABELS = 10
SCALE = 256
SAMPLE = 512  # rows that pivots are chosen from
PIVOTS = 8
BANDS = 5  # positives of an anchor at most
ROWS, ANCHORS = 1024, 256  # of a block
BROADCAST = 64 << 20  # bytes of anchor blocks that go to every task; larger ones meet the rows' blocks partition by partition
HELD = 256  # blocks of anchors whose best rows a task holds before it sends them on
MOST = float(1 << 53)

_PLACED = "vec_id long, label long, cell int, own double, q array<double>, d array<double>"
_ROWS = "label long, cell int, ids binary, q binary, d binary, d_lo array<double>, d_hi array<double>"
_ANCHORS = "a_label long, a_cell int, a_block long, a binary, a_ids binary, a_q binary, a_d binary, a_norm binary, a_lo binary, a_hi binary, bands int, a_d_lo array<double>, a_d_hi array<double>, norm_lo double, norm_hi double, lo double, hi double"
_FOUND = "a long, anchor_id long, band int, id long, score double"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _one_row(ddl: str, row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], pa.schema([(n, _TYPES[t]) for n, t in map(str.split, ddl.split(", "))]))


def taking_part(rows: DataFrame, shifted: int = 7) -> DataFrame:
    """(vec_id, label, q, norm): scaled rows that take part, labels moved where the id says so."""
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % shifted == 0, (label + 1) % LABELS).otherwise(label)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    kept = rows.filter(sound).filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), q.alias("q"))
    return kept.withColumn("norm", F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).filter(F.col("norm") < MOST)


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as a matrix, short ones padded with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    if len(at) > 1 and (np.diff(at) == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before; fewer if the rest repeat them."""
    if not len(x):
        return x
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < n:
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


class Pivots:
    """The common length, pivots in the augmented space, and distances to them."""

    def __init__(self, sample: np.ndarray, norm: float):
        self.norm, self.dims = norm, sample.shape[1]
        self.at = farthest(self.augmented(sample), PIVOTS)
        self.slack = 1e-5 * (norm**0.5 + 1)  # far above what rounding does to a distance

    def augmented(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.sqrt(np.maximum(self.norm - (q * q).sum(1), 0))[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of augmented rows to each pivot."""
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.at * self.at).sum(1) - 2 * x @ self.at.T, 0))


def placed(rows: DataFrame, pivots: Pivots, as_anchors: bool = False) -> DataFrame:
    """Each row with its distances to the pivots, its nearest pivot and the distance to that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _padded(b.column("q"), pivots.dims)
            d = pivots.distances(np.hstack([q, np.zeros((len(q), 1))]) if as_anchors else pivots.augmented(q))
            cell = d.argmin(1).astype(np.int32)
            lists = lambda m: pa.array(list(m), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(cell), pa.array(d[np.arange(len(d)), cell]), lists(q), lists(d)], ["vec_id", "label", "cell", "own", "q", "d"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, _PLACED)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut where label or cell changes, and after `most` rows of them."""
    held: list[pa.RecordBatch] = []
    n, key = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        label, cell = b.column("label").to_numpy(), b.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(label) != 0) | (np.diff(cell) != 0)) + 1), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            now = (label[lo], cell[lo])
            while lo < hi:
                if held and (now != key or n >= most):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
                take = min(hi - lo, most - n)
                held.append(b.slice(lo, take))
                n, lo, key = n + take, lo + take, now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def row_blocks(table: DataFrame, pivots: Pivots) -> DataFrame:
    """Placed rows in blocks of one label near one pivot, each with its range of distances to every pivot."""
    n, dims = len(pivots.at), pivots.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, ROWS):
            order = np.argsort(b.column("vec_id").to_numpy(), kind="stable")  # ties go by id
            ids, q, d = b.column("vec_id").to_numpy()[order], _padded(b.column("q"), dims)[order], _padded(b.column("d"), n)[order]
            yield _one_row(_ROWS, {"label": b.column("label")[0].as_py(), "cell": b.column("cell")[0].as_py(), "ids": ids.tobytes(), "q": q.tobytes(), "d": d.tobytes(), "d_lo": d.min(0).tolist(), "d_hi": d.max(0).tolist()})

    order = ["label", "cell", "own", "vec_id"]  # the id deals equal vectors out too
    return table.repartitionByRange(shuffle_parts(table.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, _ROWS)


def anchor_blocks(anchors: DataFrame, pivots: Pivots, tasks: int) -> DataFrame:
    """Anchors (a, vec_id, label, cell, own, q, d, lo, hi; lists of bands) in blocks like those of rows."""
    n, dims = len(pivots.at), pivots.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, ANCHORS):
            q, d = _padded(b.column("q"), dims), _padded(b.column("d"), n)
            lo, hi = (np.array(b.column(c).to_pylist(), float) for c in ("lo", "hi"))
            norm, a = (q * q).sum(1), b.column("a").to_numpy()
            yield _one_row(_ANCHORS, {"a_label": b.column("label")[0].as_py(), "a_cell": b.column("cell")[0].as_py(), "a_block": int(a[0]), "a": a.tobytes(), "a_ids": b.column("vec_id").to_numpy().tobytes(), "a_q": q.tobytes(), "a_d": d.tobytes(), "a_norm": norm.tobytes(), "a_lo": lo.tobytes(), "a_hi": hi.tobytes(), "bands": lo.shape[1], "a_d_lo": d.min(0).tolist(), "a_d_hi": d.max(0).tolist(), "norm_lo": norm.min(), "norm_hi": norm.max(), "lo": lo.min(), "hi": hi.max()})

    order = ["label", "cell", "own", "a"]
    return anchors.repartitionByRange(tasks, *order).coalesce(tasks).sortWithinPartitions(*order).mapInArrow(run, _ANCHORS)


def can_matter(pivots: Pivots) -> Column:
    """Whether some row of a block can have a score from lo to hi with some anchor of the other block."""
    of = lambda c, j: F.col(c)[j]
    apart = F.greatest(F.lit(0.0), *[F.greatest(of("a_d_lo", j) - of("d_hi", j), of("d_lo", j) - of("a_d_hi", j)) - pivots.slack for j in range(len(pivots.at))])
    within = F.least(F.lit(float("inf")), *[of("a_d_hi", j) + of("d_hi", j) + pivots.slack for j in range(len(pivots.at))])
    most = (pivots.norm + F.col("norm_hi") - apart * apart) / 2 + 1
    least = (pivots.norm + F.col("norm_lo") - within * within) / 2 - 1
    return (most >= F.col("lo")) & (least <= F.col("hi"))


def survivors(d_rows: np.ndarray, d_anchors: np.ndarray, norms: np.ndarray, lo: np.ndarray, hi: np.ndarray, pivots_norm: float, slack: float) -> np.ndarray:
    """Pairs (anchor, row) whose bracket of the score meets [lo, hi] of the anchor."""
    apart = np.zeros((len(d_anchors), len(d_rows)))
    within = np.full(apart.shape, np.inf)
    for j in range(d_rows.shape[1]):
        np.maximum(apart, np.abs(d_anchors[:, j, None] - d_rows[None, :, j]), out=apart)
        np.minimum(within, d_anchors[:, j, None] + d_rows[None, :, j], out=within)
    top, roof = (pivots_norm + norms)[:, None], np.maximum(apart - slack, 0)
    return ((top - roof * roof) / 2 + 1 >= lo[:, None]) & ((top - (within + slack) ** 2) / 2 - 1 <= hi[:, None])


def _scored(keep: np.ndarray, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs kept; a product of the blocks where most pairs are."""
    a, r = np.nonzero(keep)
    if len(a) * 8 > keep.size:
        return a, r, (q @ rows.T)[a, r]
    return a, r, np.einsum("ij,ij->i", q[a], rows[r])


class _Best:
    """The k best rows so far of each anchor and band of one block of anchors."""

    def __init__(self, r: dict, k: int):
        self.k, self.a, self.a_ids = k, np.frombuffer(r["a"], np.int64), np.frombuffer(r["a_ids"], np.int64)
        n, b = len(self.a), r["bands"]
        self.lo, self.hi = (np.frombuffer(r[c]).reshape(n, b).copy() for c in ("a_lo", "a_hi"))
        self.q, self.d, self.norm = np.frombuffer(r["a_q"]).reshape(n, -1), np.frombuffer(r["a_d"]).reshape(n, -1), np.frombuffer(r["a_norm"])
        self.score, self.id = np.full((n, b, k), -np.inf), np.zeros((n, b, k), np.int64)

    def meet(self, ids: np.ndarray, q: np.ndarray, d: np.ndarray, norm: float, slack: float) -> None:
        keep = survivors(d, self.d, self.norm, self.lo.min(1), self.hi.max(1), norm, slack)
        keep &= ids[None, :] != self.a_ids[:, None]
        a, r, s = _scored(keep, self.q, q)
        ok = (s >= self.lo.min(1)[a]) & (s <= self.hi.max(1)[a])
        a, r, s = a[ok], r[ok], s[ok]
        order = np.lexsort((r, -s, a))
        a, r, s = a[order], r[order], s[order]
        ends = np.searchsorted(a, np.arange(len(self.a) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            own, at = s[ends[i] : ends[i + 1]], r[ends[i] : ends[i + 1]]
            first = np.searchsorted(-own, -self.hi[i])  # the best score a band allows
            last = np.minimum(np.searchsorted(-own, -self.lo[i], side="right"), first + self.k)
            for j in np.flatnonzero(last > first):
                score = np.concatenate([self.score[i, j], own[first[j] : last[j]]])
                found = np.concatenate([self.id[i, j], ids[at[first[j] : last[j]]]])
                best = np.lexsort((found, -score))[: self.k]
                self.score[i, j], self.id[i, j] = score[best], found[best]
                self.lo[i, j] = max(self.lo[i, j], self.score[i, j, -1])

    def rows(self) -> pa.RecordBatch:
        i, j, k = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.a[i], self.a_ids[i], j.astype(np.int32), self.id[i, j, k], self.score[i, j, k])], ["a", "anchor_id", "band", "id", "score"])


def first_rows(blocks: DataFrame, anchors: DataFrame, on: Column, k: int, pivots: Pivots, broadcast: bool) -> DataFrame:
    """(a, anchor_id, band, id, score, rank): each anchor's k first rows in each of its bands, over the joined blocks."""
    norm, slack = pivots.norm, pivots.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["a_block"] not in held:
                    if len(held) >= HELD:
                        yield held.pop(next(iter(held))).rows()
                    held[r["a_block"]] = _Best(r, k)
                ids = np.frombuffer(r["ids"], np.int64)
                held[r["a_block"]].meet(ids, np.frombuffer(r["q"]).reshape(len(ids), -1), np.frombuffer(r["d"]).reshape(len(ids), -1), norm, slack)
        for best in held.values():
            yield best.rows()

    met = blocks.join(F.broadcast(anchors) if broadcast else anchors, on & can_matter(pivots)).select("ids", "q", "d", *[f.split()[0] for f in _ANCHORS.split(", ")[2:11]])
    w = W.partitionBy("a", "band").orderBy(F.desc("score"), "id")
    return met.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors_every: int = 50, shifted: int = 7, positives: int = BANDS, negatives: int = 3, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the module says.

    A negative's score lies from band[0] to band[1] hundredths of the positive's.
    """
    if not 1 <= positives <= BANDS:
        raise ValueError(f"1 to {BANDS} positives")
    part = taking_part(rows, shifted)
    norm, dims = part.agg(F.max("norm"), F.max(F.size("q"))).first()
    sample = part.orderBy(F.xxhash64("vec_id", "q"), "vec_id").select("q").limit(SAMPLE).toArrow().to_batches() if dims else []
    sample = np.vstack([_padded(b.column("q"), dims) for b in sample]) if sample else np.zeros((1, 1))
    pivots = Pivots(sample, norm or 0.0)
    blocks = stored(row_blocks(placed(part, pivots), pivots), "negatives-rows")

    own = part.filter(F.col("vec_id") % anchors_every == 0).select("vec_id", "label", "q").distinct()
    own = stored(placed(own, pivots, as_anchors=True).withColumn("a", F.monotonically_increasing_id()), "negatives-anchors")
    n = own.count()
    tasks, broadcast = max(1, n // (16 * ANCHORS)), n * 8 * (pivots.dims + len(pivots.at) + 2 * BANDS + 4) <= BROADCAST
    any_score = (F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf"))))
    same, near = F.col("label") == F.col("a_label"), F.col("cell") == F.col("a_cell")

    seeds = stored(anchor_blocks(own.withColumn("lo", any_score[0]).withColumn("hi", any_score[1]), pivots, tasks), "negatives-seeds")
    least = first_rows(blocks, seeds, same & near, positives, pivots, broadcast).filter(F.col("rank") == positives).select("a", F.col("score").alias("least"))
    known = own.join(least, "a", "left").withColumn("lo", F.array(F.coalesce("least", F.lit(float("-inf"))))).withColumn("hi", any_score[1]).drop("least")
    wanted = stored(anchor_blocks(known, pivots, tasks), "negatives-wanted")
    best = stored(first_rows(blocks, wanted, same, positives, pivots, broadcast), "negatives-positives")

    bands = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("best"))  # `positives` rows at most
    # a negative positive_score leaves no band: its lower end lies above its upper one
    lower = F.transform("best", lambda p: -floor_div(p["score"].cast("long") * -band[0], 100).cast("double"))
    upper = F.transform("best", lambda p: floor_div(p["score"].cast("long") * band[1], 100).cast("double"))
    missing = lambda end: F.array_repeat(F.lit(float(end)), F.lit(BANDS) - F.size("best"))
    limits = bands.select("a", F.concat(lower, missing("inf")).alias("lo"), F.concat(upper, missing("-inf")).alias("hi"))
    searched = stored(anchor_blocks(own.join(limits, "a"), pivots, tasks), "negatives-searched")
    found = first_rows(blocks, searched, ~same, negatives, pivots, broadcast)
    p = best.select("a", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(p, ["a", "band"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))
