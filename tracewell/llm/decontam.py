"""Documents that hold a benchmark item, by SimHash of item-sized windows.

Words are lower-cased runs of other than ASCII white space; a text is the bag of
its five-word shingles (items of fewer words: one shingle). For each length of
item, every document window of that many words that shares a shingle with an
item of that length (others have similarity 0) gets a 128-bit SimHash, its bits the
signs of sums over the window's weighted shingles. Fingerprints are cut into 8 blocks
of 16 bits with LIMITS that add up to RADIUS - 7: a pair within RADIUS lies within its
limit in some block, so that a table from each value to the items so near, one for each
block, finds every item within RADIUS. Candidates are verified by exact weighted
Jaccard similarity, shingles weighted by how often they occur, against `threshold`.
A document shorter than an item is one window. RADIUS lies four standard deviations
above the expected distance at similarity 0.8.

Items are a stated query set: they are held in memory in groups of at most
GROUP items, each compared with all documents. Null or wordless items match
nothing; null and empty texts hold no item. Equal items each match. Repeated
rows are judged one by one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shingles import lowered, mix, shingle_hashes, word_hashes
from .support import extended, join_hot, slices, stored, with_columns

K = 5
THRESHOLD = 0.8
BITS, BLOCKS = 128, 8
RADIUS = 36
LIMITS = tuple((RADIUS - BLOCKS + 1 + k) // BLOCKS for k in range(BLOCKS))  # add up to RADIUS - BLOCKS + 1
GROUP = 4096  # items that a task holds; each takes about 30 kB of tables
STRETCH = 4096  # shingles summed at a time


def bit_signs(h: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 per shingle hash."""
    two = np.stack([mix(h), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(two.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(len(a) + len(b) - both, 1)


_NEAR = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_ONES = _NEAR[np.arange(1 << 16) >> 8] + _NEAR[np.arange(1 << 16) & 255]
_FLIPS = {t: np.flatnonzero(_ONES <= t).astype(np.uint16) for t in set(LIMITS)}  # all changes of at most t bits of 16


class Blocks:
    """Fingerprints, and per block a table from each value to the fingerprints whose own value lies within the block's limit.

    The changes are made on the items' side, once, so a window asks each table once.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.halves = np.ascontiguousarray(prints).view(np.uint64)
        values, n = np.ascontiguousarray(prints).view(np.uint16), len(prints)
        self.near, self.start = [], []
        for b in range(BLOCKS):
            keys = (values[:, b, None] ^ _FLIPS[LIMITS[b]][None, :]).ravel()
            owner = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.int64), len(_FLIPS[LIMITS[b]]))
            self.near.append(owner[np.argsort(keys, kind="stable")])
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << 16))]))

    def asked(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, place of a fingerprint) near in some block; a pair comes once for each such block."""
        values, windows, owners = np.ascontiguousarray(prints).view(np.uint16), [], []
        for b in range(BLOCKS):
            lo, hi = self.start[b][values[:, b]], self.start[b][values[:, b].astype(np.int64) + 1]
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            windows.append(np.repeat(np.arange(len(prints)), n))
            owners.append(self.near[b][at].astype(np.int64))
        return np.concatenate(windows), np.concatenate(owners)

    def met(self, prints: np.ndarray) -> np.ndarray:
        """The pairs of `asked`, each once."""
        w, i = self.asked(prints)
        return np.stack(np.divmod(np.unique(w * len(self.prints) + i), len(self.prints)), axis=1)

    def within(self, prints: np.ndarray) -> np.ndarray:
        """Rows (place in prints, place of a fingerprint) within RADIUS."""
        found = [np.zeros((0, 2), np.int64)]
        halves = np.ascontiguousarray(prints).view(np.uint64)
        for a in range(0, len(prints), 512):
            w, i = self.asked(prints[a : a + 512])
            ok = np.bitwise_count(halves[a + w] ^ self.halves[i]).sum(axis=1) <= RADIUS
            pairs = np.unique((w[ok] + a) * len(self.prints) + i[ok])
            found.append(np.stack(np.divmod(pairs, len(self.prints)), axis=1))
        return np.concatenate(found)


class Index:
    """Items by length, the blocks of each length, and the lengths of the items that hold a shingle."""

    def __init__(self, rows: list[tuple], threshold: float):
        self.threshold = threshold
        self.ids: dict[int, list] = {}
        self.bags: dict[int, list[np.ndarray]] = {}
        for item_id, text in rows:
            w = word_hashes(lowered(text))
            if len(w):
                self.ids.setdefault(len(w), []).append(item_id)
                self.bags.setdefault(len(w), []).append(shingle_hashes(w, K))
        self.blocks = {n: Blocks(pack(np.stack([bit_signs(b).sum(axis=0) for b in bags]))) for n, bags in self.bags.items()}
        self.shingles: dict[int, np.ndarray] = {}  # by words in a shingle
        self.lengths: dict[int, list[tuple[int, ...]]] = {}  # of the items that hold each of them
        self.filter: dict[int, np.ndarray] = {}
        for k in {min(K, n) for n in self.bags}:
            own = [(h, n) for n, bags in self.bags.items() if min(K, n) == k for h in np.unique(np.concatenate(bags)).tolist()]
            by: dict[int, list[int]] = {}
            for h, n in own:
                by.setdefault(h, []).append(n)
            self.shingles[k] = np.array(sorted(by), np.uint64)
            self.lengths[k] = [tuple(by[h]) for h in sorted(by)]
            self.filter[k] = np.zeros(1 << 20, bool)
            self.filter[k][(self.shingles[k] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, text: str | None) -> dict:
        """Best similarity by item."""
        w, out = word_hashes(lowered(text)), {}

        def verify(words: int, prints: np.ndarray, windows) -> None:
            for at, i in self.blocks[words].within(prints).tolist():
                sim, item = weighted_jaccard(windows(at), self.bags[words][i]), self.ids[words][i]
                if sim >= self.threshold - 1e-9 and sim > out.get(item, 0):
                    out[item] = sim

        for k, known in self.shingles.items():
            if len(w) < k:
                continue
            g = shingle_hashes(w, k)
            hit = np.flatnonzero(self.filter[k][(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, g[hit]), len(known) - 1)
            hit, place = hit[known[place] == g[hit]], place[known[place] == g[hit]]
            if not len(hit):
                continue
            met = {n for p in set(place.tolist()) for n in self.lengths[k][p]}
            for n in sorted(x for x in met if x - k + 1 > len(g)):  # the document is one window
                verify(n, pack(bit_signs(g).sum(axis=0)[None, :]), lambda _: g)
            own = [n for n in met if n - k + 1 <= len(g)]
            most = max((n - k + 1 for n in own), default=1)
            cut = np.flatnonzero((np.diff(hit) > most) | (np.diff(hit // STRETCH) > 0))
            for a, z in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(hit) - 1).tolist()):
                first, last = int(hit[a]), int(hit[z])
                lo, hi = max(0, first - most + 1), min(len(g), last + most)
                total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bit_signs(g[lo:hi]), axis=0)])
                for words in sorted({n for p in set(place[a : z + 1].tolist()) for n in self.lengths[k][p]} & set(own)):
                    n = words - k + 1  # shingles in a window; windows that hold no hit are left out
                    s, e = max(0, first - n + 1) - lo, min(len(g) - n, last) - lo
                    if e >= s:
                        verify(words, pack(total[s + n : e + n + 1] - total[s : e + 1]), lambda at, x=lo + s, n=n: g[x + at : x + at + n])
        return out


def _group(items: DataFrame, groups: int, k: int) -> list[tuple]:
    part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k) if groups > 1 else items
    return [tuple(r) for r in part.collect()]  # about GROUP rows, whatever the benchmark's size


def _found(index: Index, texts: list[str | None]) -> list[list[dict]]:
    return [[{"item_id": i, "similarity": s} for i, s in sorted(index.find(t).items())] for t in texts]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, and leaks array<struct<item_id,similarity>>, empty for clean documents.

    A benchmark of several groups is compared group after group, so that the driver holds one; what each finds
    is stored by the texts' keys, and documents meet it at the end.
    """
    docs = docs.drop("leaks")
    items = benchmark.select("item_id", "text")
    groups = max(1, -(-items.count() // GROUP))
    kind = f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},similarity:double>>"
    item = to_arrow_type(items.schema["item_id"].dataType)
    arrow = pa.list_(pa.struct([("item_id", item), ("similarity", pa.float64())]))
    if groups == 1:
        rows = _group(items, 1, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(rows, threshold)
            for b in slices(batches):
                yield with_columns(b, leaks=pa.array(_found(index, b.column(b.schema.get_field_index("text")).to_pylist()), arrow))

        return docs.mapInArrow(run, extended(docs.schema, f"leaks {kind}"))
    key = lambda text: (F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"))
    texts = docs.select("text", *key(F.col("text"))).filter("text is not null")
    hits = None
    for k in range(groups):
        hits = _hits_of_group(texts, _group(items, groups, k), threshold, arrow, kind, hits)
    keys = ["_k1", "_k2"]
    leaking = stored(hits.select(*keys, F.explode("leaks").alias("leak")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("leak")).alias("leaks")), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *key(F.col("text")))
    copies = rows.join(leaking.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    one = leaking.join(copies, keys)
    dirty = join_hot(rows, one, keys, "_n", max(docs.count(), 1)).select("own.*", "leaks")
    clean = rows.join(leaking.select(*keys), keys, "left_anti").select("own.*", F.array().cast(kind).alias("leaks"))
    return dirty.unionByName(clean)


def _hits_of_group(texts: DataFrame, rows: list[tuple], threshold: float, arrow: pa.DataType, kind: str, before: DataFrame | None) -> DataFrame:
    """(_k1, _k2, leaks) of texts that hold an item of rows, stored, and those found before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rows, threshold)
        for b in slices(batches):
            found = _found(index, b.column("text").to_pylist())
            at = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([b.column("_k1").take(pa.array(at, pa.int64())), b.column("_k2").take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], arrow)], ["_k1", "_k2", "leaks"])

    hits = stored(texts.mapInArrow(run, f"_k1 long, _k2 int, leaks {kind}"), "leaks-group")
    return hits if before is None else before.unionByName(hits)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id and similarity of each item that a document holds."""
    found = matches(docs.select("doc_id", "text"), benchmark, threshold)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.similarity")
