"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the set of its distinct five-word shingles (lower-cased words; all
words if there are fewer). Each element is a Poisson process whose rate is its
weight, 1 for every shingle; arrivals fall into random registers, and a register
keeps the element that arrived first. An element stops once its next arrival is
later than every register's first. Two texts agree in a register with the
probability Jaccard similarity of their weights, here the Jaccard similarity of
the sets, by which links are decided too.

Texts equal word for word are one node. Nodes that agree in a whole band of
registers meet. Meetings above LIMIT nodes (or as many shingles) are dealt to blocks by
a hash of the node, with two of their nodes in every block, so that a large group of
copies is linked across its blocks; no node is repeated for any other reason. In each
block the maximum spanning forest of estimated similarities proposes pairs, about g for
a group of g. They are verified by exact Jaccard similarity of the shingle sets and
linked from `threshold` on; classes are the connected components.

Then every pair of different classes left in a meeting, of any size, is looked at, but
those whose estimate is below `least` or whose numbers of shingles alone rule the
threshold out: such a pair has a node outside the meeting's largest class, so those
nodes, in slices, meet slices of all nodes. The nodes of such pairs come with their sets,
and the task that holds a block verifies its pairs and gives only links that join
classes, fewer than it has classes. So pairs that fail are never rows.

Texts without a word (null ones too) are classes of their own. A class is named
by its least doc_id. Repeated rows are copies. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import lowered, mix, shingle_hashes, word_hashes
from .support import extended, join_hot, settle, shuffle_parts, stored, with_columns

REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
THRESHOLD = 0.8
SLACK = 0.2  # nearly five standard deviations of an estimate from 96 registers at 0.8
LIMIT = 1024
SHINGLES = 1024  # of a node; a meeting with more on average counts as larger
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketch(h: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """First-arrived element of each register, for elements h with positive weights."""
    first, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, done, most = np.zeros(len(h)), 0, np.inf
    block = 1 + int(6.5 * m / len(h))
    with np.errstate(over="ignore"):
        while len(h):
            i = np.arange(done + 1, done + block + 1, dtype=np.uint64)
            r = mix(h[:, None] + i * _STEP)
            x = at[:, None] + np.cumsum(-np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None], axis=1)
            who, when = np.nonzero(x < most)
            if not len(who):
                break
            t, k = x[who, when], ((r[who, when] & np.uint64(2047)) * np.uint64(m) >> np.uint64(11)).astype(np.int64)
            order = np.argsort(-t, kind="stable")
            new, by = np.full(m, np.inf), np.zeros(m, np.uint64)
            new[k[order]], by[k[order]] = t[order], h[who[order]]
            better = new < first
            first[better], owner[better] = new[better], by[better]
            most, done = first.max(), done + block
            on = x[:, -1] < most
            h, weight, at = h[on], weight[on], x[on, -1]
    return owner


def bands(owner: np.ndarray) -> np.ndarray:
    """Keys of the bands of a sketch's bytes: two texts share a key where their bytes agree."""
    with np.errstate(over="ignore"):
        h = owner.reshape(-1, ROWS)
        out = np.arange(1, len(h) + 1, dtype=np.uint64) * _STEP
        for j in range(ROWS):
            out = mix(out + h[:, j])
    return out.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a in range(0, len(texts), 256):
            node, keys, short, size = [], [], [], []
            for t in texts.slice(a, 256).to_pylist():
                b = lowered(t)
                w = word_hashes(b)
                if not len(w):
                    node.append(None), keys.append(None), short.append(None), size.append(None)
                    continue
                h = np.unique(shingle_hashes(w))
                owner = sketch(h, np.ones(len(h))) & np.uint64(255)
                node.append(xxhash.xxh3_128_digest(b" ".join(b.tobytes().split())))
                keys.append(bands(owner)), short.append(owner.astype(np.uint8).tobytes()), size.append(len(h))
            part = batch.slice(a, 256)
            yield with_columns(part.select([c for c in part.schema.names if c != "text"]), node=pa.array(node, pa.binary()), bands=pa.array(keys, pa.list_(pa.int64())), sketch=pa.array(short, pa.binary()), size=pa.array(size, pa.int32()))
    settle()


def forest(s: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of the maximum spanning forest of estimated similarities from `least` on (Prim)."""
    n, m = s.shape
    best, parent, out = np.full(n, -1), np.zeros(n, np.int64), []
    open_, v = np.ones(n, bool), 0
    for _ in range(n - 1):
        open_[v] = False
        same = (s == s[v]).sum(axis=1)
        nearer = open_ & (same > best)
        best[nearer], parent[nearer] = same[nearer], v
        v = int(np.where(open_, best, -2).argmax())
        if best[v] >= least * m:
            out.append((int(parent[v]), v))
    return out


@dataclass
class Side:
    """Rows of a block as columns: sketches, labels, sizes, and their places in the block."""

    sketch: np.ndarray
    label: np.ndarray
    size: np.ndarray
    at: np.ndarray

    def take(self, which: np.ndarray) -> Side:
        return Side(self.sketch[which], self.label[which], self.size[which], self.at[which])


def crossing(some: Side, every: Side, band: int, least: float, threshold: float) -> Iterator[tuple[np.ndarray, int]]:
    """(places u of `every`, place v of `some`) of pairs of other labels, estimated from `least` on, whose sizes may reach the threshold.

    Rows that agree in several bands meet in each; a pair counts only in the
    meeting of the first band in which its sketches agree.
    """
    m = every.sketch.shape[1]
    for v in range(len(some.at)):
        fit = np.minimum(every.size, some.size[v]) >= np.maximum(every.size, some.size[v]) * threshold - 1e-9
        u = np.flatnonzero((every.label != some.label[v]) & fit)
        agree = every.sketch[u] == some.sketch[v]
        near = agree.sum(axis=1) >= least * m
        u, agree = u[near], agree[near]
        u = u[agree.reshape(len(u), m // ROWS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(u):
            yield every.at[u], int(some.at[v])


def sides(rows: list[tuple]) -> tuple[Side, Side]:
    """(nodes outside the largest class, all nodes) of a block's rows (key, block, band, node, sketch, size, label, side).

    side is 1 for rows outside the meeting's largest class and 0 for all rows, where a meeting
    lies in several blocks; null where a block is a whole meeting.
    """
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    label, count = np.unique([r[6] for r in rows], return_inverse=True, return_counts=True)[1:]
    whole = Side(sketch, label, np.array([r[5] for r in rows]), np.arange(len(rows)))
    if rows[0][7] is None:
        return whole.take(label != count.argmax()), whole
    side = np.array([r[7] for r in rows])
    return whole.take(side == 1), whole.take(side == 0)


def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block, from batches sorted by key and block; lists come as arrays."""
    held = []
    for batch in batches:
        columns = [[x.values.to_numpy() for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
    del held
    settle()


def _pairs(found: Iterator[tuple[bytes, bytes]]) -> pa.RecordBatch:
    z = sorted({tuple(sorted(p)) for p in found})
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in z], pa.binary()), pa.array([p[1] for p in z], pa.binary())], ["a", "b"])


def _propose(least: float):
    """Pairs of the spanning forests of blocks: rows (key, block, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_blocks(batches):
            rows = sorted(set(rows), key=lambda r: r[2])
            sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
            yield _pairs((rows[i][2], rows[j][2]) for i, j in forest(sketch, least))

    return run


def _asks(least: float, threshold: float):
    """The rows of blocks that are in a pair of different classes to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_blocks(batches):
            some, every = sides(rows)
            asked = np.zeros(len(rows), bool)
            for u, v in crossing(some, every, rows[0][2], least, threshold):
                asked[u] = asked[v] = True
            at = np.flatnonzero(asked).tolist()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][k] for i in at], kind) for k, kind in enumerate(kinds)], _BLOCK)

    return run


def _verify(least: float, threshold: float):
    """Links that join classes of a block, by the sets that its rows have at their end."""

    def solve(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        some, every = sides(rows)
        up = list(range(1 + max(some.label.max(initial=0), every.label.max(initial=0))))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        label = dict(zip(some.at.tolist(), some.label.tolist())) | dict(zip(every.at.tolist(), every.label.tolist()))
        for u, v in crossing(some, every, rows[0][2], least, threshold):
            u = [i for i in u.tolist() if top(label[i]) != top(label[v])]
            if not u:
                continue
            sizes = np.array([len(rows[i][8]) for i in u])
            hit = np.isin(np.concatenate([rows[i][8] for i in u]), rows[v][8])
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for i, n, m in zip(u, both.tolist(), sizes.tolist()):
                a, b = top(label[i]), top(label[v])
                if a != b and n >= (m + len(rows[v][8]) - n) * threshold - 1e-9:
                    up[a] = b
                    yield rows[i][3], rows[v][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_blocks(batches):
            yield _pairs(solve(rows))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            found = [np.unique(shingle_hashes(word_hashes(lowered(t)))).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])
    settle()


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n, weight, low, high) for keys under which n > 1 nodes meet, the least and greatest of them low and high."""
    met = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    weight = F.greatest(F.count("*"), F.ceil(F.sum("size") / SHINGLES)).alias("weight")
    one = stored(met.groupBy("key").agg(F.count("*").alias("n"), weight, F.min("node").alias("low"), F.max("node").alias("high")).filter("n > 1"), "keys")
    return join_hot(met.drop("size"), one, ["key"], "n", nodes.count() * BANDS)


_BLOCK_KINDS = ("key long", "block int", "band int", "node binary", "sketch binary", "size int", "label binary", "side int")
_BLOCK = [x.split()[0] for x in _BLOCK_KINDS]


def in_blocks(met: DataFrame, limit: int) -> DataFrame:
    """(key, block, node) of meetings; the blocks of a meeting share its nodes low and high."""
    blocks = F.ceil(F.col("weight") / limit).cast("int")
    shared = (F.col("node") == F.col("low")) | (F.col("node") == F.col("high"))
    own = F.when(shared, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))
    return met.select("key", F.explode(own).alias("block"), "node")


def across_classes(met: DataFrame, limit: int) -> DataFrame:
    """Rows of meetings(+ label, size) of more than one class, in blocks that hold each pair of different classes.

    Meetings above the limit: slices of the nodes outside the largest class (side 1) by slices of all (side 0).
    """
    kinds = met.groupBy("key", "label").agg(F.count("*").alias("_c"), F.sum("size").alias("_s"))
    most = kinds.groupBy("key").agg(F.max(F.struct("_c", "label", "_s")).alias("_m"), F.sum("_c").alias("_n"), F.sum("_s").alias("_all")).filter("_m._c < _n")
    others = F.greatest(F.col("_n") - F.col("_m._c"), F.ceil((F.col("_all") - F.col("_m._s")) / SHINGLES))
    most = stored(most.select("key", F.col("_m.label").alias("major"), others.alias("others"), F.col("_n").alias("n")), "classes")
    rows = join_hot(met.drop("n"), most, ["key"], "n", met.count())
    few = rows.filter(F.col("weight") <= limit).withColumn("block", F.lit(0)).withColumn("side", F.lit(None).cast("int"))
    wide, tall = F.ceil(F.col("weight") / limit).cast("int"), F.ceil(F.col("others") / limit).cast("int")
    large = rows.filter(F.col("weight") > limit).withColumn("_w", wide).withColumn("_t", tall)
    slot = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = large.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda t: t * F.col("_w") + slot("_w")))).withColumn("side", F.lit(0))
    some = large.filter("label != major").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda w: slot("_t") * F.col("_w") + w))).withColumn("side", F.lit(1))
    return few.select(*_BLOCK).unionByName(every.select(*_BLOCK)).unionByName(some.select(*_BLOCK))


def content_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """(doc_id, k1, k2, class_id, class_size) per row of docs; k1 and k2 are a key of the text."""
    spark, least = docs.sparkSession, threshold - SLACK
    parts = shuffle_parts(spark)
    keyed = content_key(docs)
    scan = stored(keyed.mapInArrow(_scan, extended([keyed.schema["doc_id"]], "k1 long, k2 int, node binary, bands array<long>, sketch binary, size int")), "sketches")
    nodes = stored(scan.filter("node is not null").select("node", "doc_id", "k1", "k2", "bands", "sketch", "size").dropDuplicates(["node"]), "nodes")
    met = stored(meetings(nodes), "meetings")
    by_block = lambda rows: rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    ends = "a binary, b binary"

    def sets_of(wanted: DataFrame) -> DataFrame:
        need = nodes.select("node", "doc_id", "k1", "k2").join(wanted, "node")  # one of a node's rows, so that its copies meet nowhere
        same = keyed["doc_id"].eqNullSafe(need["doc_id"]) & (keyed["k1"] == need["k1"]) & (keyed["k2"] == need["k2"])
        texts = keyed.join(need, same).select(need["node"], keyed["text"]).dropDuplicates(["node"])
        return stored(texts.mapInArrow(_sets, "node binary, shingles array<long>"), "sets")

    blocks = in_blocks(met, limit).join(nodes.select("node", "sketch"), "node").select("key", "block", "node", "sketch")
    pairs = stored(by_block(blocks).mapInArrow(_propose(least), ends).distinct(), "pairs")
    links = labels = None
    if pairs.head(1):
        sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        sizes = F.size("sa") + F.size("sb")
        links = stored(pairs.join(a, "a").join(b, "b").filter((F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * threshold - 1e-9) & (both >= (sizes - both) * threshold - 1e-9)).select("a", "b"), "links")
        labels = components(links)
        named = met.join(nodes.select("node", "sketch", "size"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        asks = stored(by_block(across_classes(named, limit)).mapInArrow(_asks(least, threshold), ", ".join(_BLOCK_KINDS)), "asks")
        if asks.head(1):
            sets = sets.unionByName(sets_of(asks.select("node").distinct().join(sets.select("node"), "node", "left_anti")))
            dealt = by_block(asks.join(sets, "node").select(*_BLOCK, "shingles"))
            more = stored(dealt.mapInArrow(_verify(least, threshold), ends), "more-links")
            if more.head(1):
                labels = components(links.unionByName(more).distinct())
    found = scan.select("doc_id", "k1", "k2", "node")
    if labels is not None:
        found = found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        found = found.withColumn("label", F.col("node"))
    with_words = found.filter("label is not null")
    least_id = stored(with_words.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class-ids")
    classes = join_hot(with_words, least_id, ["label"], "class_size", scan.count())
    alone = found.filter("label is null").withColumn("class_id", F.col("doc_id")).withColumn("class_size", F.lit(1).cast("long"))
    out = ["doc_id", "k1", "k2", "label", "class_id", "class_size"]
    return classes.select(*out).unionByName(alone.select(*out))


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: one of each class, of least doc_id (ties: least text key)."""
    classes = near_classes(docs, threshold)
    wins = classes.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("w")).select("w.doc_id", "w.k1", "w.k2")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    on = rows["doc_id"].eqNullSafe(wins["doc_id"]) & (rows["k1"] == wins["k1"]) & (rows["k2"] == wins["k2"])
    kept = rows.join(wins, on).select(rows["own"], rows["doc_id"], rows["k1"], rows["k2"]).dropDuplicates(["doc_id", "k1", "k2"])
    wordless = rows.filter(~F.coalesce(F.col("own.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select("own.*").unionByName(wordless.select("own.*"))
