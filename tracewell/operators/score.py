"""Losses and scorers on edge and node vectors, as expressions or aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ordinal import with_ordinal
from tracewell.functions.tables import stored
from tracewell.functions.vectors import width


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sce(a: Column, b: Column, power: int = 3) -> Column:
    return F.pow(1 - cosine(a, b), power)


def mse(a: Column, b: Column, mean: bool = True) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a) if mean else total


def mae(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def bce(p: Column, y: Column) -> Column:
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit."""
    return y * softplus(-x) + (1 - y) * softplus(x)


def contrastive_bce(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """One row, loss: half the sum of the mean losses of true edges' logits as 1 and of false edges' as 0, both in `logit`."""
    p = positive.agg(F.avg(softplus(-F.col("logit"))).alias("_p"))
    return p.crossJoin(negative.agg(F.avg(softplus(F.col("logit"))).alias("_n"))).select(((F.col("_p") + F.col("_n")) * 0.5).alias("loss"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax at the zero-based target."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most))
    return F.ln(total) + most - F.element_at(logits, target + 1)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value taken once a row; written out, a lambda takes it anew for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(v: Column) -> Column:
    def of(v: Column) -> Column:
        powers = once(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most)))
        return once(powers, lambda p: once(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(p, lambda x: x / total)))

    return once(v, of)


def two_best_ratio(p: Column) -> Column:
    """max(ln(p1 / p2 + 1e-12), 0) of the two largest probabilities; p2 = 0 counts as 1e-5."""
    s = F.sort_array(p, asc=False)
    p1, p2 = F.element_at(s, 1), F.element_at(s, 2)
    return F.greatest(F.ln(p1 / F.when(p2 == 0, F.lit(1e-5)).otherwise(p2) + 1e-12), F.lit(0.0))


def confidence(df: DataFrame, scores: str, by: list[str], out: str = "confidence") -> DataFrame:
    """(s1 - s2) / (s1 + eps), shifted by the group's least and divided by its greatest."""
    lead = once(F.sort_array(F.col(scores), asc=False), lambda s: (F.element_at(s, 1) - F.element_at(s, 2)) / (F.element_at(s, 1) + 1e-6))
    d = df.withColumn("_c", lead)
    bounds = d.groupBy(*by).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    return d.join(bounds, by).withColumn(out, F.when(width > 0, (F.col("_c") - F.col("_lo")) / width).otherwise(F.lit(0.0))).drop("_c", "_lo", "_hi")


def _sampled(vectors: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most `most` rows a batch, by a hash of the id."""
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long")
    return with_ordinal(vectors.withColumn("_h", h), by, ["_h", "id"], 1 << 50, "_r").filter(F.col("_r") < most).drop("_r", "_h")


def z_scored(vectors: DataFrame, sample: DataFrame, by: list[str]) -> DataFrame:
    """vectors(by, id, v) less the batch's sample mean, over its population deviation (1 where it is 0)."""
    n = width(sample, "v")
    stats = sample.groupBy(*by).agg(*[f(F.col("v")[i]).alias(f"_{c}{i}") for i in range(n) for c, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = stats.select(*by, F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.col(f"_s{i}").alias("s")) for i in range(n)]).alias("_z"))
    joined = vectors.join(one, by) if by else vectors.crossJoin(F.broadcast(one))
    z = F.zip_with("v", "_z", lambda x, p: (x.cast("double") - p["m"]) / F.when(p["s"] > 0, p["s"]).otherwise(1.0))
    return joined.select(*by, "id", z.alias("v"))


BLOCK = 1024  # vectors of a block, about
TOGETHER = 8  # blocks of test vectors that meet a block of training vectors in one task, at most


def _packed(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, block, blocks, rows): vectors(by, id, v) in blocks by a hash of the id; blocks is the batch's number of them."""
    sizes = vectors.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = vectors.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy(*by, "block", "blocks").agg(F.collect_list(F.struct("id", F.col("v").cast("array<double>").alias("v"))).alias("rows"))


def _matrices(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the whole vectors of each length."""
    sizes = [-1 if v is None or None in v else len(v) for v in lists.to_pylist()] if lists.null_count or lists.flatten().null_count else np.diff(lists.offsets.to_numpy())
    sizes = np.asarray(sizes)
    return {int(n): (at, np.array(lists.take(pa.array(at)).flatten(), float).reshape(len(at), -1)) for n in np.unique(sizes[sizes >= 0]) for at in [np.flatnonzero(sizes == n)]}


def _least(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k least distances of each row of a to rows of b, in order; not a number comes last.

    Products choose k + 8 rows; their distances are then taken from differences, so that equal vectors are 0 apart.
    """
    n = min(k + 8, len(b))
    rough = np.einsum("nd,nd->n", b, b) - 2 * (a @ b.T)
    chosen = np.argpartition(rough, n - 1, axis=1)[:, :n]
    d = a[:, None] - b[chosen]
    return np.sort(np.sqrt(np.einsum("nkd,nkd->nk", d, d)), axis=1)[:, :k]


def knn_distance(train: DataFrame, test: DataFrame, k: int, by: list[str] | None = None, most_train: int | None = 5000) -> DataFrame:
    """(by, id, distance): mean distance to the k nearest of the batch's training vectors.

    Each batch's train is cut to most_train rows by a hash of the id, the method's own sample; with None every row
    counts. Every test row is scored. Vectors lie in blocks of one row each, a block of one side meets all
    blocks of the other in its batch, and of such a meeting only the k least distances of a test vector remain.
    """
    keys = by or ["_whole"]
    train, test = (d if by else d.withColumn("_whole", F.lit(0)) for d in (train, test))
    train = train.select(*keys, "id", "v")
    own = stored(_packed(_sampled(train, keys, most_train) if most_train else train, keys), "train-blocks")
    asked = stored(_packed(test.select(*keys, "id", "v"), keys), "test-blocks")
    n = own.groupBy(*keys).agg(F.sum(F.size("rows")).alias("_n"))
    pieces = asked.groupBy(*keys).agg(F.max(F.floor(F.col("block") / TOGETHER)).alias("_last"))
    dealt = own.join(pieces, keys).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("piece"), F.col("rows.v").alias("all"))
    met = asked.select(*keys, "block", F.floor(F.col("block") / TOGETHER).alias("piece"), F.col("rows.v").alias("v")).hint("merge").join(dealt, [*keys, "piece"]).select(*keys, "block", "v", "all")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                mine, theirs = (_matrices(b.column(c)[i].values) for c in ("v", "all"))
                out = b.slice(i, 1).select([*keys, "block"])
                for size, (at, a) in mine.items():
                    if size in theirs:
                        near = _least(a, theirs[size][1], k)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                        yield pa.RecordBatch.from_arrays([*out.take(pa.array(np.zeros(len(at), int))).columns, pa.array(at.astype(np.int32)), lists], [*keys, "block", "place", "near"])

    schema = ", ".join([*(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in keys), "block int, place int, near array<double>"])
    near = met.mapInArrow(compare, schema).groupBy(*keys, "block", "place").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    rows = asked.select(*keys, "block", F.posexplode("rows").alias("place", "row")).join(n, keys)
    mean = F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")
    whole = F.size("near") == F.least(F.lit(k), F.col("_n"))  # a vector with a null is at no distance from others
    return rows.join(near, [*keys, "block", "place"], "left").select(*(by or []), F.col("row.id").alias("id"), F.when(whole, mean).alias("distance"))


def knn_score(train: DataFrame, test: DataFrame, k: int, most_train: int | None = 5000) -> DataFrame:
    """(id, score): mean distance to the k nearest training vectors."""
    return knn_distance(train, test, k, None, most_train).select("id", F.col("distance").alias("score"))


def magic_scores(train: DataFrame, test: DataFrame, by: list[str], k: int = 10, most: int | None = 5000) -> DataFrame:
    """(by, id, score): mean distance to the k nearest of the batch's sample over the mean such distance in training.

    Vectors are z-scored by their batch's sample of at most `most` rows (all with None). In training a row is its own nearest
    neighbour; the batches' means are averaged (1e-9 if that is 0).
    """
    def distances(x: DataFrame, every: bool) -> DataFrame:
        sample = _sampled(x, by, most) if most else x
        z = stored(z_scored(sample, sample, by), "z-scored")
        return knn_distance(z, z_scored(x, sample, by) if every and most else z, k, by, most)

    found = stored(distances(test, True), "distances")
    trained = found if train is test and not most else distances(train, False)
    per = trained.groupBy(*by).agg(F.avg("distance").alias("_d")).agg(F.avg("_d").alias("_mean"))
    mean = F.when(F.coalesce(F.col("_mean"), F.lit(0.0)) > 0, F.col("_mean")).otherwise(1e-9)
    return found.crossJoin(F.broadcast(per)).select(*by, "id", (F.col("distance") / mean).alias("score"))


def frequency_loss(train: DataFrame, edges: DataFrame, n_ops: int, alpha: float = 1.0) -> DataFrame:
    """Adds loss: -ln of the smoothed share of the operation among edges of the same end types."""
    keys = ["src_type", "dst_type"]
    ops = train.groupBy(*keys, "op").agg(F.count("*").alias("_n"))
    all_ = train.groupBy(*keys).agg(F.count("*").alias("_all"))
    d = edges.join(ops, [*keys, "op"], "left").join(all_, keys, "left")
    share = (F.coalesce("_n", F.lit(0)) + alpha) / (F.coalesce("_all", F.lit(0)) + alpha * n_ops)
    return d.withColumn("loss", -F.ln(share)).drop("_n", "_all")


def neighbour_mean(edges: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """One round of mean aggregation over in-neighbours; features hold (by, node, x array)."""
    from .encoders import aggregate

    return aggregate(edges, features, by, "mean")


def negative_edges(edges: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """(by, event_id, src, dst): each edge with the destination of another of its graph, less self loops and true edges.

    Destinations are permuted within the graph: both sides are numbered in orders of two hashes and
    paired by number, so that every edge gets one and no task orders them all.
    """
    def numbered(column: str, salt: int) -> DataFrame:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + salt), "event_id")), 1, 15), 16, 10).cast("long")
        return with_ordinal(edges.select(*by, "event_id", column).withColumn("_h", h), by, ["_h", "event_id"], 1 << 50, "_r")

    sources, targets = numbered("src", 0).select(*by, "_r", "event_id", "src"), numbered("dst", 1).select(*by, "_r", "dst")
    pairs = sources.join(targets, [*by, "_r"]).filter("src != dst").drop("_r")
    return pairs.join(edges.select(*by, "src", "dst").distinct(), [*by, "src", "dst"], "left_anti").select(*by, "event_id", "src", "dst")


def attention(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edge logits to weights that sum to 1 over the edges into a node."""
    most = edges.groupBy(*by, "dst").agg(F.max("logit").alias("_m"))
    e = edges.join(most, [*by, "dst"]).withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    total = e.groupBy(*by, "dst").agg(F.sum("_e").alias("_t"))
    return e.join(total, [*by, "dst"]).withColumn("weight", F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")
