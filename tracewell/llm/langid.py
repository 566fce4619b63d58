"""Language identification by nearest centroid.

Letters n-grams (1 to 3) of the lower-cased text are hashed into DIM cells; TF
(log-damped) times IDF, scaled to unit length, is a document's vector. For each
language the vectors of a bounded labelled sample are clustered by spherical
k-means into several centroids. A document takes the language of the centroid of
largest cosine; it is rejected where that cosine lies below the limit for texts
of its number of distinct n-grams: a share of the least cosine that such sample
texts have to their own language's centroids (short texts lie further off).

The sample is bounded by `per_language` distinct labelled texts a language (all if
there are fewer), those of least hash, so that the driver holds per_language *
languages vectors at most, however often a text is repeated. Predictions read
whole texts only. Of languages of equal cosine the first by name wins.

Null texts and texts without a letter are `und` with score 0, and rejected. With
no labelled row every text is `und`. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .support import extended, settle, slices, texts_of, with_columns

DIM = 1 << 12
SIZES = (24, 64, 160, 400)  # distinct n-grams at which another limit begins
UNKNOWN = "und"
_LETTER = None


def has_letter(text: str) -> bool:
    global _LETTER
    if _LETTER is None:
        import regex

        _LETTER = regex.compile(r"\p{L}")
    return _LETTER.search(text) is not None


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of the text's letter 1- to 3-grams and their counts; other characters count as one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = np.where(c < 128, (c >= 97) & (c <= 122), c >= 0xAA)
    c = np.where(letter, c, 32).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = np.concatenate([[np.uint64(32)], c[keep], [np.uint64(32)]])
    grams = c[c != 32]
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint64(0x1F123BB5) + c[1:] + np.uint64(1 << 40)
        three = two[:-1] * np.uint64(0x5851F42D4C957F2D) + c[2:] + np.uint64(1 << 41)
        h = np.concatenate([grams, two, three]) * np.uint64(0x9E3779B97F4A7C15)
    n = np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(DIM, np.float32)
    v[at] = (1 + np.log(n)) * idf[at]
    return v / max(float(np.linalg.norm(v)), 1e-12)


@dataclass
class Centroids:
    """A fitted model: unit centroids, the language of each, and the limit for each size of text."""

    idf: np.ndarray
    centre: np.ndarray
    lang: list[str]
    limit: np.ndarray

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in 0 to 1, rejected."""
        if not text or not self.lang or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, n = gram_counts(text)
        cos = self.centre @ vector(at, n, self.idf)
        k = int(np.round(cos, 6).argmax())
        score = min(1.0, max(0.0, float(cos[k])))
        return self.lang[k], score, score < float(self.limit[np.searchsorted(SIZES, len(at), side="right")])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are spread out, from the row nearest the mean on."""
    first = x @ x.mean(axis=0)
    centre = x[[int(first.argmax())]]
    while len(centre) < min(k, len(x)):
        centre = np.concatenate([centre, x[[int((x @ centre.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        moved = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centre[i] for i in range(len(centre))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centre, atol=1e-6):
            break
        centre = moved
    return centre


def learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~F.coalesce(held_out, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def drawn(keyed: DataFrame, n: dict[str, int], per_language: int) -> DataFrame:
    """The per_language rows of least key a language, copies of a text counted once; n: about how many there are.

    The share that a language's count asks for, and half as much again, is
    filtered where rows lie, so that only about the sample is moved.
    """
    share = F.create_map(*[x for k, v in sorted(n.items()) for x in (F.lit(k), F.lit(min(1.0, (1.5 * per_language + 50) / max(v, 1))))])
    draw = F.pmod("_key", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = keyed.withColumn("_draw", draw).filter(F.col("_draw") < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "_key"])
    place = F.row_number().over(W.partitionBy("lang").orderBy("_draw", "_key"))
    return few.withColumn("_place", place).filter(F.col("_place") <= per_language).drop("_place", "_draw")


def fit(rows: DataFrame, per_language: int = 1500, clusters: int = 4, share_of_least: float = 0.6, floor: float = 0.1) -> Centroids:
    """rows: text and lang. At most per_language distinct texts a language, those of least hash."""
    keyed = rows.withColumn("_key", F.xxhash64("text", "lang"))
    n = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("_key").alias("n")).collect()}
    if not n:
        return Centroids(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(len(SIZES) + 1))
    sample = drawn(keyed, n, per_language).drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [gram_counts(t) if has_letter(t) else (np.zeros(0, int), np.zeros(0, int)) for t in texts_of(b)]
            yield with_columns(b.select(["lang"]), at=pa.array([g[0] for g in got], pa.list_(pa.int32())), n=pa.array([g[1] for g in got], pa.list_(pa.int32())))

    model = _model(sample.mapInArrow(run, "lang string, at array<int>, n array<int>").toPandas(), clusters, share_of_least, floor)
    settle()  # the driver lives on, too
    return model


def _model(found: pd.DataFrame, clusters: int, share_of_least: float, floor: float) -> Centroids:
    found = found[found["at"].map(len) > 0]
    order = sorted(range(len(found)), key=lambda i: (found["lang"].iloc[i], len(found["at"].iloc[i]), tuple(found["n"].iloc[i][:50])))
    found = found.iloc[order]
    df = np.zeros(DIM)
    for at in found["at"]:
        df[at] += 1
    idf = (np.log((1 + len(found)) / (1 + df)) + 1).astype(np.float32)
    centre, lang, limit = [], [], np.full(len(SIZES) + 1, np.inf)
    for name, group in found.groupby("lang", sort=True):
        x = np.zeros((len(group), DIM), np.float32)
        for i, (at, k) in enumerate(zip(group["at"], group["n"])):
            x[i, at] = (1 + np.log(k)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _kmeans(x, clusters)
        centre.append(c)
        lang += [name] * len(c)
        np.minimum.at(limit, np.searchsorted(SIZES, [len(a) for a in group["at"]], side="right"), share_of_least * (x @ c.T).max(axis=1))
    limit = np.minimum.accumulate(np.where(np.isfinite(limit), limit, floor)[::-1])[::-1]
    limit[0] = min(limit[0], floor)
    return Centroids(idf, np.concatenate(centre) if centre else np.zeros((0, DIM), np.float32), lang, limit)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """The columns of docs, and lang_pred, score and rejected."""
    docs = docs.drop("lang_pred", "score", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [model.classify(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield with_columns(b, lang_pred=pa.array([g[0] for g in got], pa.string()), score=pa.array([g[1] for g in got], pa.float64()), rejected=pa.array([g[2] for g in got], pa.bool_()))

    return docs.mapInArrow(run, extended(docs.schema, "lang_pred string, score double, rejected boolean"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept for judging: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
