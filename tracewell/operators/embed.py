"""Vectors of words and documents, learned from tables of tokens.

Trained matrices have a set number of rows (`buckets`): words and their character n-grams are hashed
into them, so a model's size is a parameter and does not follow the vocabulary. Tasks train copies on the
rows they hold, sentence after sentence; after each epoch a row of a matrix moves by the mean of its
copies' moves, weighted by how often each was trained. Negative samples are drawn by the words' counts over
the whole corpus. Draws are seeded by epoch and task, or by the document's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewell.functions import sums
from tracewell.functions.tables import spread, stored
from tracewell.functions.vectors import combined, times_matrix, width

TEXTS = 20_000  # texts of a task, about
PAIRS = 256  # pairs of words that take one step together
TOGETHER = 8  # steps that a document's vector takes at once from such a group, at most


def bucket(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode()) % buckets


def grams(word: str, buckets: int, low: int = 3, high: int = 6) -> list[int]:
    """Rows of a word: its own, and those of its character n-grams in angle brackets."""
    w = f"<{word}>"
    return sorted({bucket(w, buckets), *(bucket(w[i : i + n], buckets) for n in range(low, high + 1) for i in range(len(w) - n + 1))})


@dataclass
class Vectors:
    """Input and output matrices; n-grams of the sizes low to high, none if high is 0."""

    size: int
    buckets: int
    inputs: np.ndarray
    outputs: np.ndarray
    noise: np.ndarray  # cumulated shares of output rows, from which negative samples are drawn
    low: int = 3
    high: int = 6

    def drawn(self, rng: np.random.Generator, *shape: int) -> np.ndarray:
        return np.searchsorted(self.noise, rng.random(shape), side="right")

    def rows(self, word: str) -> list[int]:
        return grams(word, self.buckets, self.low, self.high)


def new_vectors(tokens: DataFrame, size: int, buckets: int, seed: int, low: int = 3, high: int = 6) -> Vectors:
    """Starting matrices, and the words' counts to the power 0.75 as the shares of negative samples."""
    def of_task(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        counts = np.zeros(buckets)
        for b in batches:
            ids = [bucket(f"<{w}>", buckets) for s in b.column("tokens").to_pylist() for w in s or [] if w is not None]
            counts += np.bincount(np.array(ids, int), minlength=buckets)
        return [counts]

    found = sums.summed(tokens.select("tokens"), of_task)
    shares = found[0] ** 0.75 if found and found[0].any() else np.ones(buckets)
    rng = np.random.default_rng(seed)
    noise = np.minimum(np.cumsum(shares) / shares.sum(), 1)
    noise[np.flatnonzero(shares)[-1] :] = 1  # rounding must not leave a gap at the end
    return Vectors(size, buckets, rng.uniform(-1, 1, (buckets, size)) / size, np.zeros((buckets, size)), noise, low, high)


class _Trainer:
    """One task's copy of the matrices, with how often each row was trained."""

    def __init__(self, model: Vectors, rate: float, negatives: int, rng: np.random.Generator):
        self.model, self.rate, self.negatives, self.rng = model, rate, negatives, rng
        self.inputs, self.outputs = model.inputs.copy(), model.outputs.copy()
        self.seen_in, self.seen_out = np.zeros(model.buckets), np.zeros(model.buckets)
        self.known: dict[str, list[int]] = {}

    def of(self, word: str) -> list[int]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self.model.rows(word)
        return self.known[word]

    def step(self, rows: list[list[int]], wanted: np.ndarray, drawn: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Move towards the wanted output rows and away from the drawn ones; rows are each pair's input rows.

        own: further input vectors, one a pair; their moves are returned.
        """
        n = np.array([len(r) for r in rows])
        flat, at = np.concatenate([np.asarray(r, int) for r in rows]) if n.sum() else np.zeros(0, int), np.repeat(np.arange(len(rows)), n)
        h = np.zeros((len(rows), self.model.size))
        np.add.at(h, at, self.inputs[flat])
        parts = n + (own is not None)
        h = (h + (0 if own is None else own)) / np.maximum(parts, 1)[:, None]
        targets = np.column_stack([wanted, drawn])
        out = self.outputs[targets]
        slope = 1 / (1 + np.exp(-np.clip(np.einsum("nkd,nd->nk", out, h), -30, 30)))
        slope[:, 0] -= 1
        slope[:, 1:][drawn == wanted[:, None]] = 0  # a draw of the wanted word says nothing
        moves = -self.rate * np.einsum("nk,nkd->nd", slope, out) / np.maximum(parts, 1)[:, None]
        np.add.at(self.outputs, targets.ravel(), (-self.rate * slope[:, :, None] * h[:, None]).reshape(-1, self.model.size))
        np.add.at(self.inputs, flat, moves[at])
        np.add.at(self.seen_in, flat, 1)
        np.add.at(self.seen_out, targets.ravel(), 1)
        return moves

    def moved(self) -> list[np.ndarray]:
        return [(self.inputs - self.model.inputs) * self.seen_in[:, None], self.seen_in, (self.outputs - self.model.outputs) * self.seen_out[:, None], self.seen_out]


def _averaged(model: Vectors, moved: list[np.ndarray]) -> Vectors:
    if not moved:
        return model
    mean = lambda x, n: x / np.maximum(n, 1)[:, None]
    return Vectors(model.size, model.buckets, model.inputs + mean(moved[0], moved[1]), model.outputs + mean(moved[2], moved[3]), model.noise, model.low, model.high)


def _seed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def train_subwords(tokens: DataFrame, size: int = 16, buckets: int = 1 << 14, window: int = 5, negatives: int = 5, epochs: int = 5, rate: float = 0.05, seed: int = 0, low: int = 3, high: int = 6) -> Vectors:
    """Skip-gram over tokens(tokens): a word's n-grams, averaged, predict the words up to window places away."""
    kept = stored(spread(tokens.filter(F.size("tokens") > 1).select("tokens"), TEXTS), "sentences")
    model = new_vectors(kept, size, buckets, seed, low, high)

    for epoch in range(epochs):
        now, speed = model, rate * (1 - epoch / epochs)

        def of_task(batches: Iterator[pa.RecordBatch], now: Vectors = now, speed: float = speed, epoch: int = epoch) -> list[np.ndarray] | None:
            from pyspark import TaskContext

            rng = np.random.default_rng(_seed(seed, epoch, TaskContext.get().partitionId()))
            t = _Trainer(now, speed, negatives, rng)
            for b in batches:
                sentences = [[w for w in s if w is not None] for s in b.column("tokens").to_pylist()]
                words = np.array([bucket(f"<{w}>", buckets) for s in sentences for w in s], int)
                rows: list[list[int]] = []
                wanted: list[int] = []
                at = 0

                def go() -> None:
                    t.step(rows, np.array(wanted), now.drawn(rng, len(wanted), negatives))
                    rows.clear(), wanted.clear()

                for s in sentences:
                    for i, w in enumerate(s):
                        for j in range(max(0, i - window), min(len(s), i + window + 1)):
                            if j != i:
                                rows.append(t.of(w))
                                wanted.append(words[at + j])
                        if len(rows) >= PAIRS:
                            go()
                    at += len(s)
                if rows:
                    go()
            return t.moved() if t.seen_in.any() else None

        model = _averaged(model, sums.summed(kept, of_task))
    return model


def word_vectors(model: Vectors, word: str | Column) -> Column:
    """A word's vector, the mean of its rows; words that training has not met have one too. Null for null."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else model.inputs[model.rows(w)].mean(0))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf("array<double>")(run)(word)


def mean_unit_vectors(tokens: DataFrame, model: Vectors) -> DataFrame:
    """(node, vec): the mean of a label's word vectors, each scaled to length 1, from tokens(node, tokens); zeros without a word."""
    zero = np.zeros(model.size)

    def unit(word: str) -> np.ndarray:
        v = model.inputs[model.rows(word)].mean(0)
        return v / max(np.linalg.norm(v), 1e-12)

    def run(s: pd.Series) -> pd.Series:
        known = {w: unit(w) for w in {w for words in s if words is not None for w in words if w is not None}}
        of = lambda words: [known[w] for w in (words if words is not None else []) if w is not None]
        return s.map(lambda words: np.mean(found, axis=0) if (found := of(words)) else zero)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return spread(tokens.select("node", "tokens"), TEXTS).select("node", pandas_udf("array<double>")(run)("tokens").alias("vec"))


def _first_vector(node: object, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(_seed(seed, node)).uniform(-1, 1, size) / size


def _document(t: _Trainer, ids: np.ndarray, vec: np.ndarray, window: int, negatives: int, rng: np.random.Generator) -> np.ndarray:
    """One pass over a document: its vector with the words around a place predicts the word there."""
    for lo in range(0, len(ids), PAIRS):
        places = range(lo, min(lo + PAIRS, len(ids)))
        rows = [[*ids[max(0, i - window) : i], *ids[i + 1 : i + window + 1]] for i in places]
        moves = t.step(rows, ids[places.start : places.stop], t.model.drawn(rng, len(rows), negatives), np.repeat(vec[None], len(rows), 0))
        vec = vec + moves.mean(0) * min(len(rows), TOGETHER)
    return vec


def _moved_alone(model: Vectors, ids: np.ndarray, vec: np.ndarray, window: int, negatives: int, rng: np.random.Generator, rate: float) -> np.ndarray:
    """The same pass with frozen words."""
    cumulated = np.vstack([np.zeros(model.size), np.cumsum(model.inputs[ids], 0)])
    for lo in range(0, len(ids), PAIRS):
        i = np.arange(lo, min(lo + PAIRS, len(ids)))
        first, last = np.maximum(i - window, 0), np.minimum(i + window + 1, len(ids))
        n = (last - first)[:, None]  # the words around and the document
        h = (cumulated[last] - cumulated[first] - model.inputs[ids[i]] + vec) / n
        drawn = model.drawn(rng, len(i), negatives)
        out = model.outputs[np.column_stack([ids[i], drawn])]
        slope = 1 / (1 + np.exp(-np.clip(np.einsum("nkd,nd->nk", out, h), -30, 30)))
        slope[:, 0] -= 1
        slope[:, 1:][drawn == ids[i][:, None]] = 0
        vec = vec - rate * (np.einsum("nk,nkd->nd", slope, out) / n).mean(0) * min(len(i), TOGETHER)
    return vec


def train_documents(tokens: DataFrame, size: int = 16, buckets: int = 1 << 13, window: int = 5, negatives: int = 5, epochs: int = 10, rate: float = 0.1, seed: int = 0) -> tuple[Vectors, DataFrame]:
    """(model, vectors(node, vec)): distributed memory over tokens(node, tokens).

    A document's vector and its neighbours' word vectors, averaged, predict each word. Document vectors stay in
    a table with their documents; only the word matrices travel.
    """
    model = new_vectors(tokens, size, buckets, seed, high=0)
    kind = tokens.schema["node"].dataType.simpleString()
    schema = f"node {kind}, tokens array<string>, vec array<double>, {sums.DDL}"
    state = stored(spread(tokens, TEXTS).select("node", "tokens", F.lit(None).cast("array<double>").alias("vec")), "documents")
    for epoch in range(epochs):
        now, speed = model, rate * (1 - epoch / epochs)

        def run(batches: Iterator[pa.RecordBatch], now: Vectors = now, speed: float = speed, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rng = np.random.default_rng(_seed(seed, epoch, TaskContext.get().partitionId()))
            t = _Trainer(now, speed, negatives, rng)
            empty = {"slot": pa.int32(), "sums": pa.binary()}
            for b in batches:
                texts = [[w for w in s if w is not None] if s is not None else [] for s in b.column("tokens").to_pylist()]
                out = []
                for node, words, vec in zip(b.column("node").to_pylist(), texts, b.column("vec").to_pylist()):
                    v = _first_vector(node, size, seed) if vec is None else np.array(vec)
                    ids = np.array([bucket(f"<{w}>", buckets) for w in words], int)
                    out.append(_document(t, ids, v, window, negatives, rng) if words else v)
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("tokens"), pa.array(out, pa.list_(pa.float64())), *[pa.nulls(len(out), k) for k in empty.values()]], ["node", "tokens", "vec", "slot", "sums"])
            if t.seen_out.any():
                row = sums.row_of(t.moved())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, b.schema.field("node").type), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.float64())), pa.array([row["slot"]], pa.int32()), pa.array([row["sums"]], pa.binary())], ["node", "tokens", "vec", "slot", "sums"])

        done = stored(state.mapInArrow(run, schema), "documents")
        model = _averaged(model, sums.total(done.filter("sums is not null").select("slot", "sums")))
        state = done.filter("sums is null").select("node", "tokens", "vec")
    return model, state.select("node", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("vec"))


def infer_documents(tokens: DataFrame, model: Vectors, window: int = 5, negatives: int = 5, epochs: int = 10, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """(node, vec) of documents by the trained words, which stay as they are; a document's vector is its own alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, words in zip(b.column("node").to_pylist(), b.column("tokens").to_pylist()):
                words = [w for w in words or [] if w is not None]
                vec, rng = _first_vector(node, model.size, seed), np.random.default_rng(_seed(seed, node, "draws"))
                ids = np.array([bucket(f"<{w}>", model.buckets) for w in words], int)
                for epoch in range(epochs if words else 0):
                    vec = _moved_alone(model, ids, vec, window, negatives, rng, rate * (1 - epoch / epochs))
                out.append(vec)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.list_(pa.float64()))], ["node", "vec"])

    return spread(tokens.select("node", "tokens"), TEXTS).mapInArrow(run, f"node {tokens.schema['node'].dataType.simpleString()}, vec array<double>")


def context_means(tokens: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """(word, n, vec): the mean over a word's n occurrences of the summed vectors of the words up to window places away.

    tokens(node, tokens), vectors(word, vec). Occurrences without a known word around do not count. The words
    around a place are cut from the row's own list, so places never meet in a join, and equal contexts of a word are one
    row with their number. Pairs of words are counted first, so vectors meet one row a pair.
    """
    size = width(vectors, "vec")
    around = lambda i: F.concat(F.slice("tokens", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))), F.slice("tokens", i + 2, F.lit(window)))
    places = F.transform("tokens", lambda w, i: F.struct(w.alias("word"), around(i).alias("around")))
    met = tokens.filter("node is not null").select(F.explode(places).alias("c")).groupBy("c.word", "c.around").agg(F.count("*").cast("long").alias("times"))
    contexts = stored(met.withColumn("context", F.monotonically_increasing_id()), "contexts")
    near = contexts.select("context", "word", "times", F.explode("around").alias("near"))
    counts = near.groupBy("word", "near").agg(F.sum("times").cast("double").alias("n"))
    known = near.join(vectors.select(F.col("word").alias("near")), "near", "left_semi").select("context", "word", "times").distinct()
    occurrences = known.groupBy("word").agg(F.sum("times").alias("occurrences"))
    total = combined(counts.join(vectors.withColumnRenamed("word", "near"), "near"), ["word"], "vec", size, weight="n")
    mean = F.transform("vec", lambda v: v / F.col("occurrences"))
    return total.join(occurrences, "word").select("word", F.col("occurrences").alias("n"), mean.alias("vec"))


def induction_sums(context: DataFrame, vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums over words of context times context and of context times vector; context(word, vec), vectors(word, vec)."""
    pairs = context.select("word", F.col("vec").alias("c")).join(vectors.select("word", F.col("vec").alias("v")), "word").select("c", "v")

    def of_task(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
        out = None
        for b in batches:
            c, v = (np.array(b.column(k).to_pylist(), float) for k in ("c", "v"))
            one = [c.T @ c, c.T @ v]
            out = one if out is None else sums.added([out, one])
        return out

    found = sums.summed(pairs, of_task)
    n = width(vectors, "vec")
    return (found[0], found[1]) if found else (np.zeros((n, n)), np.zeros((n, n)))


def induction_matrix(context: DataFrame, vectors: DataFrame) -> np.ndarray:
    """The least-squares matrix that takes context vectors to word vectors."""
    a, b = induction_sums(context, vectors)
    return np.linalg.lstsq(a, b, rcond=None)[0].T


def unseen_vectors(tokens: DataFrame, known: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """(word, vec) of the words of tokens(node, tokens) that vectors(word, vec) lack: the induced image of their contexts.

    The matrix is fitted on the contexts that words with vectors have in known(node, tokens).
    """
    matrix = induction_matrix(context_means(known, vectors, window), vectors)
    new = context_means(tokens, vectors, window).join(vectors.select("word"), "word", "left_anti")
    return new.select("word", times_matrix("vec", matrix.T).alias("vec"))
