"""What each of five filters removes under every order of applying them.

A text (null: empty; words are maximal runs of other than ASCII white space) fails
A under 50 words; B with less than 65 distinct words a hundred; C with more than 5
characters `[A-Z]` a hundred code points; D with any of `#$%&*|`; E if a smaller
doc_id has an identical text.

Texts are read from Arrow's buffers, a few MB of whole texts at a time: one table
gives each byte its class, prefix sums over the classes give counts a text, and a
polynomial prefix hash gives every word's hash. A slice's words are sorted by hash
(the text's number mixed in); neighbours of equal hash are compared byte by byte, and
a text with a false match is counted exactly instead, so distinct counts are exact.
Texts over SLICE bytes are counted piece by piece, with a set of their words.

E needs the least doc_id of each text. Rows are summed by digest, part and verdict
before they meet, so a group of copies is a few rows, and hot digests go to every
task. What is left is a count for each part and set of failed filters (32 at most);
all 600 rows of a part follow from these by matrix products.

Null parts are the empty string; every part has all 600 rows, zeros included. A null
doc_id is smaller than none and larger than none: such a row neither fails E nor makes
others fail it, and has no label. Of rows that repeat a doc_id and its text none is
smaller, so the least of a text are all first. Labels that repeat for a document count
once: good, or toxic, if any is. An empty table has no part. Texts are told apart by
SHA-256. Other columns pass by unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import join_hot, stored

FILTERS = "ABCDE"
SLICE = 4 << 20  # bytes of text that are scanned at a time
SPACE, CAPITAL, SYMBOL, GOES_ON = 1, 2, 4, 8
LONG_WORD = 256  # bytes; longer words are compared one by one
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def byte_classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] |= SPACE
    c[ord("A") : ord("Z") + 1] |= CAPITAL
    c[list(b"#$%&*|")] |= SYMBOL
    c[0x80:0xC0] |= GOES_ON  # of a code point that began before
    return c


CLASSES = byte_classes()


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


class Scanner:
    """Counts (words, distinct words, capitals, symbols, code points) for each text of a slice."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each word, from one prefix sum."""
        if len(self.up) < len(data) + 1:
            self.up, self.down = powers(_R, len(data)), powers(_R_INVERSE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """data: the texts' bytes one after the other; at: their offsets, one more than texts."""
        c = CLASSES[data]
        total = lambda on: np.diff(np.concatenate([[0], np.cumsum(on, dtype=np.int64)])[at])
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (c & SPACE) == 0
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = np.flatnonzero(np.diff(at) > 0)
        first[at[full]] |= inside[1:-1][at[full]]  # words end with their text
        last[at[full + 1] - 1] |= inside[1:-1][at[full + 1] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = total(first)
        text = np.repeat(np.arange(len(words)), words)
        return np.stack([words, words - self.repeats(data, starts, ends, text, len(words)), total((c & CAPITAL) != 0), total((c & SYMBOL) != 0), total((c & GOES_ON) == 0)], 1)

    def repeats(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """How many words of each text are equal to another one that counts."""
        h = (self.hashes(data, starts, ends) ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _R
        order = np.argsort(h)
        again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        a, b = order[again], order[again + 1]
        equal = (text[a] == text[b]) & same_bytes(data, starts[a], ends[a], starts[b], ends[b])
        out = np.bincount(text[b[equal]], minlength=n)
        for i in np.unique(np.concatenate([text[a[~equal]], text[b[~equal]]])):  # false matches of hashes
            own = np.flatnonzero(text == i)
            out[i] = len(own) - len({data[starts[w] : ends[w]].tobytes() for w in own})
        return out


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the pieces [a, a_end) and [b, b_end) of data are equal, eight bytes at a time."""
    n = a_end - a
    equal = n == b_end - b
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    left = np.flatnonzero(equal & (n <= LONG_WORD))
    k = 0
    while len(left):
        keep = masks[np.minimum(n[left] - k, 8)]
        x, y = (eight[p[left] + k].view("<u8").ravel() & keep for p in (a, b))
        equal[left[x != y]] = False
        k += 8
        left = left[(x == y) & (n[left] > k)]
    for i in np.flatnonzero(equal & (n > LONG_WORD)):
        equal[i] = data[a[i] : a_end[i]].tobytes() == data[b[i] : b_end[i]].tobytes()
    return equal


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about SLICE bytes that end at white space; one word is never cut."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not CLASSES[data[end]] & SPACE:
            ahead = np.flatnonzero(CLASSES[data[end : end + SLICE]] & SPACE)
            end = min(end + (int(ahead[0]) if len(ahead) else SLICE), len(data))
        yield data[at:end]
        at = end


def long_counts(data: np.ndarray, scanner: Scanner) -> np.ndarray:
    """The counts of one long text."""
    out, seen = np.zeros(5, np.int64), set()
    for piece in _pieces(data):
        out += scanner.count(piece, np.array([0, len(piece)]))[0]
        seen.update(piece.tobytes().split())  # bytes split at the same six characters
    out[1] = len(seen)
    return out


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SLICE bytes together; a longer text alone."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, side="right")) - 1)
        yield lo, hi
        lo = hi


def text_counts(column: pa.StringArray, scanner: Scanner) -> tuple[np.ndarray, list[bytes]]:
    """The five counts and the digest of each text of a column without nulls, from its buffers."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    out = np.zeros((n, 5), np.int64)
    for lo, hi in slices(at):
        part = data[at[lo] : at[hi]]
        out[lo:hi] = long_counts(part, scanner) if len(part) > SLICE else scanner.count(part, at[lo : hi + 1] - at[lo])
    return out, [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:])]


def verdicts(counts: np.ndarray) -> np.ndarray:
    """Bits of the failed filters A to D."""
    words, distinct, capitals, symbols, points = counts.T
    fails = [words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails)).astype(np.int32)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) for each row: one pass over whole texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            if b.num_rows:
                counts, digests = text_counts(b.column("text"), scanner)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(verdicts(counts)), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic; rows without an id are dealt by digest, since they meet no label."""
    own = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    joined = rows.withColumn("_spread", spread).join(own.filter("good or toxic").withColumn("_spread", F.lit(0).cast("long")), ["doc_id", "_spread"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows by part and set of failed filters, E included."""
    by = ["digest", "part", "mask", "good", "toxic"]
    # rows that repeat an id and text are summed first; this needs no shuffle after the join by id
    of_id = labelled(scanned(docs), labels).groupBy("doc_id", "_spread", *by).agg(F.count("*").alias("rows"))
    has_id = F.col("doc_id").isNotNull()
    summed = stored(of_id.groupBy(*by).agg(F.sum("rows").alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("rows"))).alias("without_id"), F.min(F.when(has_id, F.struct("doc_id", "rows"))).alias("least")), "audit-texts")
    first = summed.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("groups"))
    met = join_hot(summed, first, ["digest"], "groups", summed.count())
    free = F.col("without_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.rows")).otherwise(0)
    both = met.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", free.alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - free).alias("n")))).alias("m"))
    return both.filter("m.n > 0").groupBy("part", "m.mask", "good", "toxic").agg(F.sum("m.n").alias("n"))


ORDERS = ["".join(o) for o in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]


def effects() -> dict[str, np.ndarray]:
    """For each of a part's 600 rows and each set of failed filters: whether a text with that set counts (shapley: how often)."""
    masks = np.arange(1 << len(FILTERS))
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order, _ in STEPS])
    step = np.array([s for _, s in STEPS])
    own = bits[np.arange(len(STEPS)), step - 1]
    before = (bits * (np.arange(len(FILTERS)) < step[:, None] - 1)).sum(1)
    fails, gone = (masks & own[:, None]) != 0, (masks & before[:, None]) != 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own[:, None]}
    removed = out["removed"].astype(np.int64)
    by_filter = {b: removed[own == b].sum(0) for b in set(own.tolist())}
    return {k: v.astype(np.int64) for k, v in out.items()} | {"shapley": np.array([by_filter[b] for b in own.tolist()])}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    table = effects()
    orders, steps = pa.array([o for o, _ in STEPS]), pa.array([s for _, s in STEPS], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sets in zip(b.column("part").to_pylist(), b.column("sets").to_pylist()):
                n = np.zeros((3, 1 << len(FILTERS)), np.int64)  # all rows, good ones, toxic ones
                for s in sets:
                    n[[True, s["good"], s["toxic"]], s["mask"]] += s["n"]
                found = {k: v @ n[0] for k, v in table.items()} | {"good_lost": table["removed"] @ n[1], "toxic_lost": table["removed"] @ n[2]}
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(STEPS)), orders, steps, *[pa.array(found[k]) for k in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    sets = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("sets"))  # 128 entries a part at most
    return sets.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
