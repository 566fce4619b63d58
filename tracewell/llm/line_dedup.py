"""Line dedup by winnowing: later repeats of runs of whole lines are deleted.

Units are a document's lines with at least one word (runs of other than ASCII
white space). A run of consecutive units counts from `min_words` words on. For
each unit the shortest such run that begins there, and the shortest that ends
there, is a window; the least line hash of a window is its fingerprint. Only the
places of these minima are kept, so that every run that counts and repeats holds a
fingerprint that repeats (the guarantee).

Places are joined by fingerprint; those whose fingerprint lies at one place only
drop out. From the others the match is extended both ways: the windows around a
place, hashed over their lines, are compared with those around the other places of its
fingerprint. Windows overlap, so the union of equal ones reaches as far as lines
agree. A line goes if a window over it has an equal one earlier, by (doc_id, place);
the first stays. Runs are judged on the input.

Null texts stay null, empty ones empty. Lines without a word stay, unless the
units on both sides go. Rows that repeat in full are one document in several
rows and get the same text. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import join_hot, slices, stored

MIN_WORDS = 50


def line_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each unit."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)), np.fromiter((len(x.split()) for x in lines), np.int32, len(lines))


def spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first unit, end unit) of each window."""
    found, s, e, total = set(), 0, 0, 0
    for s in range(len(words)):  # the shortest run that begins at s
        while e < len(words) and total < min_words:
            total += words[e]
            e += 1
        if total < min_words:
            break
        found.add((s, e))
        total -= words[s]
    s = total = 0
    for e in range(1, len(words) + 1):  # the shortest run that ends before e
        total += words[e - 1]
        while total - words[s] >= min_words:
            total -= words[s]
            s += 1
        if total >= min_words:
            found.add((s, e))
    return sorted(found)


def windows(hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(place of the least hash, first unit, end unit) of each window."""
    h = hashes.tolist()
    return [(h.index(min(h[s:e]), s), s, e) for s, e in spans(words.tolist(), min_words)]


def _scan(min_words: int):
    """Line hashes of each document, and the places of its windows' minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, words, minima = [], [], []
            for t in batch.column(3).to_pylist():
                h, n = line_hashes((t or "").encode())
                hashes.append(h.view(np.int64)), words.append(n)
                minima.append(sorted({w[0] for w in windows(h, n, min_words)}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(minima, pa.list_(pa.int32()))], [*batch.schema.names[:3], "hashes", "words", "minima"])

    return run


def _extend(min_words: int):
    """Windows around the joined places: rows (doc_id, k1, k2, hashes, words, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, at = [], []
            for i, (h, n, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                h, places = np.array(h, np.int64).view(np.uint64), set(places)
                flat = h.tobytes()
                for unit, s, e in windows(h, np.array(n), min_words):
                    if unit in places:
                        rows.append((h[unit], xxhash.xxh3_64_intdigest(flat[8 * s : 8 * e]), s, e))
                        at.append(i)
            keys = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
            columns = [np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1)] + [np.array([r[k] for r in rows], np.int32) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([*keys.columns, *map(pa.array, columns)], [*keys.schema.names, "fp", "content", "s", "e"])

    return run


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, gone = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, before, removed = [], [], []
        for t, runs in zip(texts, gone):
            lines = [] if t is None else t.split("\n")
            unit = [i for i, x in enumerate(lines) if x.encode().strip()]
            drop = np.zeros(len(lines), bool)
            n = 0
            for s, e in sorted((r["s"], r["e"]) for r in runs or ()):
                drop[unit[s] : unit[e - 1] + 1] = True
            if runs:
                n = int(drop[unit].sum())
                out.append("\n".join(x for x, d in zip(lines, drop) if not d))
            else:
                out.append(t)
            before.append(len(unit)), removed.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())], ["own", "text", "n_lines", "n_removed"])


def keyed(docs: DataFrame) -> DataFrame:
    """The row as one column, and (doc_id, k1, k2) that names it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id"), F.xxhash64("doc_id", text).alias("k1"), F.hash(text).alias("k2"), F.col("text"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2) of documents and their later repeated windows, as runs array<struct<s,e>> of units."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {kind}, k1 long, k2 int"
    lines = keyed(docs).select("doc_id", "k1", "k2", "text").mapInArrow(_scan(min_words), f"{key}, hashes array<long>, words array<int>, minima array<int>")
    lines = stored(lines.filter(F.size("minima") > 0), "lines")
    places = stored(lines.select("k1", "k2", F.explode("minima").alias("unit"), "hashes").select("k1", "k2", "unit", F.get("hashes", F.col("unit")).alias("fp")), "places")
    ends = [f(c).alias(f"{n}_{c}") for c in ("k1", "k2", "unit") for n, f in (("low", F.min), ("high", F.max))]
    twice = places.groupBy("fp").agg(F.count("*").alias("n"), *ends).filter("low_k1 != high_k1 or low_k2 != high_k2 or low_unit != high_unit").select("fp", "n")
    joined = join_hot(places, stored(twice, "fingerprints"), ["fp"], "n", places.count()).groupBy("k1", "k2").agg(F.collect_set("unit").alias("places"))
    met = lines.join(joined, ["k1", "k2"]).select("doc_id", "k1", "k2", "hashes", "words", "places")
    met = stored(met.mapInArrow(_extend(min_words), f"{key}, fp long, content long, s int, e int").select("fp", "content", F.struct("doc_id", "k1", "k2", "s").alias("at"), "e"), "met")
    first = met.groupBy("fp", "content").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")
    later = join_hot(met, stored(first, "firsts"), ["fp", "content"], "n", met.count()).filter("first < at")
    return later.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_set(F.struct(F.col("at.s").alias("s"), "e")).alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs with text cut, and n_lines and n_removed (units before, units deleted)."""
    runs = repeated_runs(docs, min_words)
    rows = keyed(docs).select("own", "k1", "k2").join(runs, ["k1", "k2"], "left").select("own.text", "runs", F.struct(*[F.col(f"own.`{c}`") for c in docs.columns if c != "text"]).alias("own"))
    own = rows.schema["own"].dataType.simpleString()
    out = rows.mapInArrow(_delete, f"own {own}, text string, n_lines long, n_removed long")
    columns = [F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, "n_lines", "n_removed")
